"""LZ4 block formats: an own encoder, the library's, and a decoder."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.constants import LEAST_RAW_SIZE

#: Format limits: shortest match, bytes a match may grow beyond it, and the reach of an offset.
LEAST, GROWTH, REACH = 4, 264, 65536
CODED = "codec_used string, size int, ratio double, benefit boolean"


def _fours(data: bytes, bits: int) -> tuple[list[int], list[int]]:
    """The four bytes at every place as a number, and their slot in a table of 2^bits."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    v = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    return v.tolist(), ((v * np.uint32(2654435761)) >> np.uint32(32 - bits)).tolist()


def _number(out: bytearray, rest: int) -> None:
    whole, part = divmod(rest, 255)
    out += b"\xff" * whole
    out.append(part)


def _sequence(out: bytearray, literals: bytes, match: int | None, offset: int = 0) -> None:
    n, extra = len(literals), 0 if match is None else match - LEAST
    out.append(min(n, 15) << 4 | min(extra, 15))
    if n >= 15:
        _number(out, n - 15)
    out += literals
    if match is not None:
        out += offset.to_bytes(2, "little")
        if extra >= 15:
            _number(out, extra - 15)


def _common(data: bytes, a: int, b: int, most: int) -> int:
    """Equal bytes from two places on: by sixteens, then one by one."""
    n = 0
    while n + 16 <= most and data[a + n : a + n + 16] == data[b + n : b + n + 16]:
        n += 16
    while n < most and data[a + n] == data[b + n]:
        n += 1
    return n


def encode(data: bytes, deep: bool) -> bytes:
    """Greedy search in a table of last places, 2^12 slots; deep: 2^13 slots, and a match gives way to one at the next byte that is longer by two."""
    n, out, start, at = len(data), bytearray(), 0, 0
    end = n - LEAST
    if end > 0:
        four, slots = _fours(data, 13 if deep else 12)
        last = [-REACH] * (1 << (13 if deep else 12))
    while at < end:
        slot = slots[at]
        found, last[slot] = last[slot], at
        if at - found >= REACH or four[found] != four[at]:
            at += 1
            continue
        size = LEAST + _common(data, at + LEAST, found + LEAST, min(GROWTH, end - at))
        if deep and at + 1 < end:
            slot = slots[at + 1]
            later, last[slot] = last[slot], at + 1
            if at + 1 - later < REACH and four[later] == four[at + 1]:
                longer = LEAST + _common(data, at + 1 + LEAST, later + LEAST, min(GROWTH, end - at - 1))
                if longer > size + 1:
                    at, found, size = at + 1, later, longer
        _sequence(out, data[start:at], size, at - found)
        at += size
        start = at
    _sequence(out, data[start:], None)
    return bytes(out)


def decode(packed: bytes, size: int) -> bytes:
    out, at = bytearray(), 0

    def more(n: int) -> int:
        nonlocal at
        while n >= 15:
            step = packed[at]
            at, n = at + 1, n + step
            if step != 255:
                break
        return n

    while at < len(packed):
        token = packed[at]
        at += 1
        n = more(token >> 4)
        out += packed[at : at + n]
        at += n
        if at + 2 > len(packed):
            break
        offset = int.from_bytes(packed[at : at + 2], "little")
        at += 2
        n = LEAST + more(token & 15)
        begin = len(out) - offset
        if offset >= n:
            out += out[begin : begin + n]
        else:
            piece = bytes(out[begin:])
            out += (piece * (n // max(1, offset) + 1))[:n]
    return bytes(out[:size])


_FAST, _DEEP = pa.Codec("lz4_raw"), pa.Codec("lz4_raw", compression_level=9)


def lib_encode(data: bytes, deep: bool) -> bytes:
    return (_DEEP if deep else _FAST).compress(data, asbytes=True)


def lib_decode(packed: bytes, size: int) -> bytes:
    return _FAST.decompress(packed, size, asbytes=True)


def encoded(block: Column, deep: bool, own: bool) -> Column:
    """The block in LZ4, or LZ4HC if deep, by the own encoder or the library's. Null stays null."""

    @F.pandas_udf("binary")
    def run(b: pd.Series) -> pd.Series:
        pack = encode if own else lib_encode
        return pd.Series([None if x is None else pack(bytes(x), deep) for x in b], dtype=object)

    return run(block)


def decoded(packed: Column, size: Column) -> Column:
    @F.pandas_udf("binary")
    def run(p: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decode(bytes(x), int(k)) for x, k in zip(p, n)], dtype=object)

    return run(packed, size)


def lib_sizes(block: Column) -> Column:
    """struct(lz4, lz4hc): sizes by the library's two modes."""

    @F.pandas_udf("lz4 int, lz4hc int")
    def run(b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"lz4": [len(lib_encode(bytes(x), False)) for x in b], "lz4hc": [len(lib_encode(bytes(x), True)) for x in b]}, dtype="int32")

    return run(block)


def beneficial(size: Column, original: Column | int = 4096) -> Column:
    """Size, 10 bytes of header and 64 of least saving are less than the original."""
    original = original if isinstance(original, Column) else F.lit(original)
    return size + 74 < original


def coded(codec: Column, block: Column, packed: Column) -> Column:
    """What is stored: struct of CODED. Without benefit, and for RAW and SKIP, the block is stored raw with ratio 1."""
    return coded_sizes(codec, F.octet_length(block), F.octet_length(packed))


def coded_sizes(codec: Column, n: Column, packed: Column) -> Column:
    """The same from the sizes of the block and of its code."""
    name = F.upper(F.trim(codec))
    name = F.when(name.isin("RAW", "SKIP", "LZ4", "LZ4HC"), name).otherwise(F.raise_error(F.concat(F.lit("unknown codec "), codec)).cast("string"))
    keep = name.isin("LZ4", "LZ4HC") & beneficial(packed, n)
    return F.struct(
        F.when(keep, name).otherwise("RAW").alias("codec_used"), F.when(keep, packed).otherwise(n).alias("size"),
        F.when(keep, F.bround(packed / n, 6)).otherwise(1.0).alias("ratio"), F.coalesce(keep, F.lit(False)).alias("benefit"),
    )


def own_size(codec: Column, block: Column) -> Column:
    """Size of the block in the own encoder's LZ4 or LZ4HC; null for other codecs, which encode nothing."""

    @F.pandas_udf("int")
    def run(c: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(encode(bytes(x), k == "LZ4HC")) if k in ("LZ4", "LZ4HC") else None for k, x in zip(c, b)], dtype="Int32")

    return run(codec, block)


def stored_raw(size: Column) -> Column:
    return size >= LEAST_RAW_SIZE
