"""Vectorised functions on binary columns: features, hashes, checksums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.constants import BLOCK

FEATURES = T.StructType([T.StructField("entropy", T.DoubleType()), T.StructField("run_length_density", T.DoubleType()), T.StructField("uniqueness", T.DoubleType()), T.StructField("byte_variety", T.IntegerType()), T.StructField("zero_density", T.DoubleType())])


def by_length(values: pd.Series):
    """Rows of equal length as one matrix: (row numbers, bytes (rows, length)). Null rows are left out."""
    size = values.map(lambda b: -1 if b is None else len(b)).to_numpy(np.int64) if len(values) else np.zeros(0, np.int64)
    for n in np.unique(size[size >= 0]):
        at = np.flatnonzero(size == n)
        yield at, np.frombuffer(b"".join(values.iloc[i] for i in at), np.uint8).reshape(len(at), n)


def histograms(m: np.ndarray) -> np.ndarray:
    rows = np.arange(len(m), dtype=np.int64)[:, None] * 256
    return np.bincount((rows + m).ravel(), minlength=256 * len(m)).reshape(len(m), 256)


def entropies(counts: np.ndarray, n: int) -> np.ndarray:
    if n == 0:
        return np.zeros(len(counts))
    p = counts / n
    return np.round(-(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=1), 6) + 0.0


@F.pandas_udf(FEATURES)
def features(block: pd.Series) -> pd.DataFrame:
    """All features of a block from one histogram. Empty input: zeros, and a null zero density; null input: nulls."""
    out = np.full((len(block), 5), np.nan)
    for at, m in by_length(block):
        n, counts = m.shape[1], histograms(m)
        kinds = (counts > 0).sum(axis=1)
        same = (m[:, 1:] == m[:, :-1]).sum(axis=1) if n > 1 else np.zeros(len(m))
        out[at, 0] = entropies(counts, n)
        out[at, 1] = np.round(same / max(n, 1), 6)
        out[at, 2] = np.round(kinds / 256, 6)
        out[at, 3] = kinds
        out[at, 4] = np.round(counts[:, 0] / n, 6) if n else np.nan
    df = pd.DataFrame(out, columns=FEATURES.names)
    return df.assign(byte_variety=df["byte_variety"].astype("Int32"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def byte_histogram(block: pd.Series) -> pd.Series:
    out = [None] * len(block)
    for at, m in by_length(block):
        for i, row in zip(at, histograms(m).astype(np.int32)):
            out[i] = row
    return pd.Series(out)


FIRMWARE = T.StructType([T.StructField("entropy_fixed", T.IntegerType()), T.StructField("adjacent_equal", T.IntegerType())])


@F.pandas_udf(FIRMWARE)
def firmware_features(block: pd.Series) -> pd.DataFrame:
    """Integer entropy (whole bits; logarithms rounded down) and the number of bytes equal to the one before."""
    out = np.zeros((len(block), 2), np.int32)
    log2 = np.array([0] + [int(i).bit_length() - 1 for i in range(1, 4097)])
    for at, m in by_length(block):
        counts = histograms(m)
        out[at, 0] = (counts * (12 - log2[np.minimum(counts, 4096)])).sum(axis=1) // 4096
        out[at, 1] = (m[:, 1:] == m[:, :-1]).sum(axis=1) if m.shape[1] > 1 else 0
    return pd.DataFrame(out, columns=FIRMWARE.names)


def _rot(x, r):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _final(x):
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def murmur128(m: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """MurmurHash3 x64-128 of every row, over all rows lane by lane."""
    c1, c2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
    rows, n = m.shape
    whole = n // 16
    lanes = np.ascontiguousarray(m[:, : whole * 16]).view("<u8").reshape(rows, whole * 2)
    h1, h2 = np.full(rows, seed, np.uint64), np.full(rows, seed, np.uint64)
    for i in range(whole):
        h1 ^= _rot(lanes[:, 2 * i] * c1, 31) * c2
        h1 = (_rot(h1, 27) + h2) * np.uint64(5) + np.uint64(0x52DCE729)
        h2 ^= _rot(lanes[:, 2 * i + 1] * c2, 33) * c1
        h2 = (_rot(h2, 31) + h1) * np.uint64(5) + np.uint64(0x38495AB5)
    rest = np.zeros((rows, 16), np.uint8)
    rest[:, : n - whole * 16] = m[:, whole * 16 :]
    tail = rest.view("<u8")
    if n % 16 > 8:
        h2 ^= _rot(tail[:, 1] * c2, 33) * c1
    if n % 16:
        h1 ^= _rot(tail[:, 0] * c1, 31) * c2
    h1, h2 = h1 ^ np.uint64(n), h2 ^ np.uint64(n)
    h1 = h1 + h2
    h2 = h2 + h1
    h1, h2 = _final(h1), _final(h2)
    h1 = h1 + h2
    return h1, h2 + h1


def murmur3_128(block: Column, seed: int) -> Column:
    """32 hex digits: the first and the second half, highest digit first."""

    @F.pandas_udf("string")
    def run(b: pd.Series) -> pd.Series:
        out = [None] * len(b)
        for at, m in by_length(b):
            for i, x, y in zip(at, *murmur128(m, seed)):
                out[i] = f"{int(x):016x}{int(y):016x}"
        return pd.Series(out, dtype=object)

    return run(block)


def murmur3_simple(block: Column, seed: int = 42) -> Column:
    """The controller's 64-bit variant over whole 8-byte lanes, as 16 hex digits."""

    @F.pandas_udf("string")
    def run(b: pd.Series) -> pd.Series:
        out = [None] * len(b)
        for at, m in by_length(b):
            n = m.shape[1]
            lanes = np.ascontiguousarray(m[:, : n // 8 * 8]).view("<u8").reshape(len(m), n // 8)
            h = np.full(len(m), (seed ^ (n * 0xC4CEB9FE1A85EC53)) % (1 << 64), np.uint64)
            for i in range(n // 8):
                h = _rot(h ^ _rot(lanes[:, i] * np.uint64(0x87C37B91114253D5), 31) * np.uint64(0x4CF5AD432745937F), 27) * np.uint64(5) + np.uint64(0x52DCE729)
            for i, x in zip(at, h ^ (h >> np.uint64(33))):
                out[i] = f"{int(x):016x}"
        return pd.Series(out, dtype=object)

    return run(block)


def _table(poly: int, low_first: bool) -> np.ndarray:
    """What 16 bits make of an empty register, two bytes at a step."""
    t = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        t = np.where(t & 1, (t >> 1) ^ poly, t >> 1) if low_first else np.where(t & 0x8000, (t << 1) ^ poly, t << 1) & 0xFFFF
    return t.astype(np.uint16)


_LOW, _HIGH = _table(0xA001, True), _table(0x1021, False)


def _crc_of(m: np.ndarray, table: np.ndarray, start: int, low_first: bool) -> np.ndarray:
    """Of all rows at once, two columns at a step."""
    n = m.shape[1]
    words = np.ascontiguousarray(m[:, : n // 2 * 2]).view("<u2" if low_first else ">u2")
    c = np.full(len(m), start, np.uint16)
    for a in range(0, words.shape[1], 256):
        for col in np.ascontiguousarray(words[:, a : a + 256].T).astype(np.uint16, copy=False):
            c = table[c ^ col]
    if n % 2:
        last = m[:, -1].astype(np.uint16)
        # One byte: the table's step for two bytes, of which the register's other half is shifted in.
        c = (c >> 8) ^ _byte_step((c ^ last) & 0xFF, table, True) if low_first else (c << 8) ^ _byte_step((c >> 8) ^ last, table, False)
    return c.astype(np.uint32)


def _byte_step(x: np.ndarray, table: np.ndarray, low_first: bool) -> np.ndarray:
    """What one byte makes of an empty register: that of the byte after a zero byte."""
    return table[x << 8] if low_first else table[x]


def crc_low(m: np.ndarray) -> np.ndarray:
    """Polynomial 0xA001, lowest bit first, from 0xFFFF."""
    return _crc_of(m, _LOW, 0xFFFF, True)


def crc_high(m: np.ndarray, start: int = 0xFFFF) -> np.ndarray:
    """Polynomial 0x1021, highest bit first."""
    return _crc_of(m, _HIGH, start, False)


def _crc(function):
    @F.pandas_udf(T.IntegerType())
    def run(b: pd.Series) -> pd.Series:
        out = np.zeros(len(b), np.int32)
        for at, m in by_length(b):
            out[at] = function(m)
        return pd.Series(out)

    return run


crc16_modbus = _crc(crc_low)
crc16_ccitt = _crc(crc_high)


def is_zero(block: Column) -> Column:
    """All bytes zero; true for an empty block."""
    return F.when(F.octet_length(block) == BLOCK, block == F.lit(bytes(BLOCK))).otherwise(F.rtrim(F.hex(block), F.lit("0")) == "")


def padded(data: Column, size: int = 4096) -> Column:
    """Cut or filled with zero bytes to ``size``."""
    return F.rpad(F.substring(data, F.lit(1), F.lit(size)), size, F.lit(b"\x00"))


def prefix(block: Column) -> Column:
    return F.substring(block, F.lit(1), F.lit(4))


def prefix_number(block: Column) -> Column:
    """The first four bytes, highest first, as a number."""
    return F.conv(F.hex(prefix(block)), 16, 10).cast("long")
