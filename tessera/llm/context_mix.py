"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its lower-cased words and one end. Where the two words before stood in the text already, one
bit says whether the word that followed them last follows again; a table of what happened predicts it.
Any other word has a code: its place in the order of the training texts' word counts, as a bucket of
four bits and the place in it; words that training texts hold less than twice have place 0 and are
spelled, byte by byte with a closing space. So it is a row of symbols of at most eight bits. Each of
their bits is predicted by counts of what followed three hashed contexts: the symbol's beginning alone,
with the word before (the first symbol, if that word is among the 1,365 most frequent), and with the
language word (the most frequent of the 32 words before); for spelled words the three and five bytes
before, and two bytes with the language word. The predictions meet in the logistic domain under
weights that a gate selects; a table refines the result.

Counts are kept by hash of 56 bits and symbol in partitions that grow in number with the input; chunks
of texts ask for those that they meet, and get the states of the predictors back. Rows hold packed
arrays. All symbols that have the same contexts in a chunk are worked out once. Whatever depends on
the training texts is a sum of whole numbers, or is learned by a chunk of fixed membership in a fixed
order, so other partitionings and lost executors change nothing.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import written

#: Characters in one chunk of texts; symbols that are worked on at once; contexts; kinds of bits; words before that may name the language; most frequent words that are contexts.
CHUNK_CHARS = 6_000_000
STEP = 150_000
CONTEXTS, KINDS = 3, 3
REACH = 32
FREQUENT = 1_365
END = b"\n"
#: Places of words in order of their counts: bucket j holds 4^j of them; rarer words are spelled.
BUCKETS = 14
FIRST = np.array([(4**j - 1) // 3 for j in range(BUCKETS + 1)], np.int64)
#: Word counts by quarters of powers of two.
CLASSES = 256
#: States: nothing seen; one bit alone seen so often; both seen, by the logarithm of their ratio in halves.
ALONE = np.array([1, 2, 3, 4, 6, 10, 20, 50, 200])
RATIOS = 10
STATES = 1 + 2 * len(ALONE) + 2 * RATIOS + 1
_MIX = 2 + 2 * len(ALONE) - 1
#: Bins of states, for the sample of bits that the weights are fitted to.
BINS = np.array([0] + [1, 1, 2, 2, 2, 3, 3, 3, 3] + [4, 4, 5, 5, 5, 6, 6, 6, 6] + [7] * 5 + [8] * 3 + [9] * 2 + [10] + [11] * 2 + [12] * 3 + [13] * 5)
N_BINS = 14
GATES, STEPS = KINDS * 4, 33
_ODD, _EVEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _EVEN
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def pack(*arrays) -> bytes:
    raw = pickle.dumps(arrays, 5)
    return _CODEC.compress(raw, asbytes=True) + len(raw).to_bytes(8, "little")


def unpack(data: bytes) -> tuple:
    return pickle.loads(_CODEC.decompress(data[:-8], int.from_bytes(data[-8:], "little"), asbytes=True))


_CODEC = pa.Codec("zstd", compression_level=2)


def planes(x: np.ndarray) -> np.ndarray:
    """A sorted array as differences, byte by byte, which compress well."""
    return by_byte(np.diff(x, prepend=x.dtype.type(0)))


def by_byte(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T)


def from_bytes(p: np.ndarray, kind) -> np.ndarray:
    return np.ascontiguousarray(p.T).view(kind).ravel()


def from_planes(p: np.ndarray, kind) -> np.ndarray:
    return np.cumsum(from_bytes(p, kind), dtype=kind)


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys, and each key's number among them."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    new = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])) if len(keys) else np.zeros(0, bool)
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return sorted_keys[new], number


# Chunks: texts as numbers of words.


class Ids(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def dealt(words: list[bytes], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and partitions of words in order of partition and hash, and the words' numbers in that order."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    part = (h >> np.uint64(40)).astype(np.int64) % parts
    order = np.lexsort((h, part))
    return h[order], part[order], order


def packed_texts(batches, most_chars: int = 32_000_000):
    """The rows of one task, by chunk, so many characters at a time; equal rows become one with their number."""
    held: dict[int, dict] = {}
    size = 0

    def packed():
        out = [(0, chunk, -1, pack(*map(list, zip(*((*key, *r) for key, r in rows.items()))))) for chunk, rows in held.items()]
        return pd.DataFrame(out, columns=["kind", "chunk", "p", "data"])

    for b in batches:
        for doc_id, text, fold, h, chunk, copies in zip(*(b[c].tolist() for c in ("doc_id", "text", "fold", "h", "chunk", "copies"))):
            row = held.setdefault(chunk, {}).setdefault((doc_id, text), [fold, h, 0])
            row[2] += copies
            size += len(text or "") if row[2] == copies else 0
        if size >= most_chars:
            yield packed()
            held, size = {}, 0
    yield packed()


def first_pass(pdf: pd.DataFrame, parts: int) -> pd.DataFrame:
    """A chunk's body and, for each partition of words, the hashes and training counts of its words."""
    number, rows = int(pdf["chunk"].iloc[0]), {}
    for data in pdf["data"]:
        for doc_id, text, fold, h, copies in zip(*unpack(data)):
            rows.setdefault((doc_id, text), [fold, h, 0])[2] += copies  # rows that are equal are scored once
    rows = [(*key, fold, copies) for key, (fold, h, copies) in sorted(rows.items(), key=lambda x: (x[1][1], *(("", "") if y is None else ("1", y) for y in x[0])))]
    ids, parts_of = Ids({END: 0}), []
    for _, text, _, _ in rows:
        w = (text or "").encode("utf-8", "surrogatepass").lower().split()
        parts_of += [np.fromiter(map(ids.__getitem__, w), np.int32, len(w)), np.zeros(1, np.int32)]
    tokens, words = np.concatenate(parts_of), list(ids)
    lengths = np.array([len(x) + 1 for x in parts_of[::2]], np.int32)
    # Frequent words first: small numbers are short.
    order = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
    place = np.empty(len(words), np.int32)
    place[order] = np.arange(len(words), dtype=np.int32)
    tokens, words = place[tokens], [words[i] for i in order]
    held, copies = np.array([r[2] == 0 for r in rows]), np.array([r[3] for r in rows], np.int64)
    counts = np.bincount(tokens, np.repeat(np.where(held, 0, copies), lengths), len(words)).astype(np.int64)
    null = np.array([r[0] is None for r in rows])
    guess = guesses(tokens, lengths)
    out = [(0, number, -1, pack(by_byte(tokens), np.packbits(guess >= 0), by_byte(guess[guess >= 0]), lengths, b" ".join(words), np.array([int(r[0] or 0) for r in rows], np.int64), null, held, copies))]
    h, part, order = dealt(words, parts)
    for p in np.unique(part):
        a, b = np.searchsorted(part, (p, p + 1))
        out.append((1, number, int(p), pack(planes(h[a:b]), counts[order[a:b]].astype(np.uint32))))
    return pd.DataFrame(out, columns=["kind", "chunk", "p", "data"])


def guesses(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each token, the word that followed the same two words last in its text, or -1."""
    t, doc = tokens.astype(np.uint64), np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    h = doc * _EVEN
    h[2:] += _mix(t[1:-1] + np.uint64(3)) * _ODD + t[:-2]
    h = _mix(h)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    out = np.full(len(h), -1, np.int32)
    out[order[1:][same]] = tokens[order[:-1][same]]
    # At a text's second word the hash has words of the text before; nothing is guessed there.
    starts = np.cumsum(lengths) - lengths
    for k in range(3):
        at = starts + k
        out[at[k < lengths]] = -1
    return out


class Body:
    """A chunk's texts as numbers of words, and places and counts of its words over all training texts."""

    def __init__(self, pdf: pd.DataFrame, parts: int):
        tokens, some, guess, lengths, words, self.ids, self.null, self.held, self.copies = unpack(pdf.loc[pdf["kind"] == 0, "data"].iloc[0])
        self.words, self.tokens, self.lengths = words.split(b" "), from_bytes(tokens, np.int32), lengths.astype(np.int64)
        self.guess = np.full(len(self.tokens), -1, np.int32)
        self.guess[np.unpackbits(some, count=len(self.tokens)).astype(bool)] = from_bytes(guess, np.int32)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.times = np.repeat(np.where(self.held, 0, self.copies), self.lengths)
        order = dealt(self.words, parts)[2]
        got = [unpack(x) for x in pdf[pdf["kind"] == 2].sort_values("p")["data"]]
        self.place, self.counts = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        for out, k in ((self.place, 0), (self.counts, 1)):
            out[order] = np.concatenate([from_bytes(g[k], np.uint32) for g in got])


# Words: counts over all training texts, and places in their order.


def _merged(pdf: pd.DataFrame):
    """Of one partition: hashes and counts over all chunks, and each chunk's hashes."""
    blobs = [unpack(x) for x in pdf["data"]]
    own = [from_planes(h, np.uint64) for h, _ in blobs]
    every, at = np.unique(np.concatenate(own), return_inverse=True)
    return every, np.bincount(at, np.concatenate([c for _, c in blobs]), len(every)).astype(np.int64), own


def _class(c: np.ndarray) -> np.ndarray:
    """Larger counts first: by quarters of powers of two, at most CLASSES."""
    return CLASSES - 1 - np.minimum((4 * np.log2(np.maximum(c, 1))).astype(np.int64), CLASSES - 1)


def place_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each chunk, counts of its words in this partition and places among the words of their class here (0 for words that are spelled), from 1.

    One more row has the partition's tokens, words and sizes of classes.
    """
    every, c, own = _merged(pdf)
    p = int(pdf["p"].iloc[0])
    known = np.flatnonzero(c > 1)
    known = known[np.lexsort((every[known], -c[known]))]
    kind = _class(c[known])
    place = np.zeros(len(every), np.int64)
    place[known] = 1 + np.arange(len(known)) - np.searchsorted(kind, kind, "left")
    rows = [(5, -1, p, pack(int(c.sum()), int((c > 0).sum()), np.bincount(kind, minlength=CLASSES).astype(np.int64)))]
    for chunk, h in zip(pdf["chunk"], own):
        at = np.searchsorted(every, h)
        rows.append((2, chunk, p, pack(by_byte(place[at].astype(np.uint32)), by_byte(c[at].astype(np.uint32)))))
    return pd.DataFrame(rows, columns=["kind", "chunk", "p", "data"])


def class_sizes(batches):
    """(p, class, n, tokens, words) of each partition of words; the sums stand in its first row."""
    for b in batches:
        for p, data in zip(b["p"], b["data"]):
            tokens, words, sizes = unpack(data)
            at = np.append(np.flatnonzero(sizes), CLASSES)  # one row at least
            first = np.arange(len(at)) == 0
            yield pd.DataFrame({"p": p, "class": at, "n": np.append(sizes, 0)[at], "tokens": first * tokens, "words": first * words})


def first_places(sizes: DataFrame) -> DataFrame:
    """(p, starts): for each partition of words, how many words stand before its own of each class. Classes are at most CLASSES."""
    total = sizes.groupBy("class").agg(F.sum("n").alias("all")).withColumn("before", F.sum("all").over(Window.orderBy("class")) - F.col("all"))
    own = F.sum("n").over(Window.partitionBy("class").orderBy("p")) - F.col("n")
    starts = sizes.withColumn("own", own).join(F.broadcast(total), "class")
    return starts.groupBy("p").agg(F.collect_list(F.struct("class", (F.col("before") + F.col("own")).alias("start"))).alias("starts"))


def placed_words(batches):
    """Places among the words of a class in a partition become places among all words."""
    for b in batches:
        out = []
        for starts, data in zip(b["starts"], b["data"]):
            own, counts = (from_bytes(x, np.uint32).astype(np.int64) for x in unpack(data))
            table = np.zeros(CLASSES + 1, np.int64)
            for x in starts:
                table[x["class"]] = x["start"]
            place = np.where(own > 0, own + table[_class(counts)], 0)
            out.append(pack(by_byte(np.where(place < FIRST[BUCKETS], place, 0).astype(np.uint32)), by_byte(counts.astype(np.uint32))))
        yield b[["kind", "chunk", "p"]].assign(data=out)


# Symbols and their contexts.


class Codes:
    """Codes of different words: the first symbol of each, and all further symbols in a row.

    A symbol is a value in the highest of eight bits and a number of bits.
    """

    def __init__(self, words: list[bytes], place: np.ndarray):
        j = np.searchsorted(FIRST, place, "right") - 1
        index, rest = place - FIRST[j], 2 * j
        top = np.minimum(rest, 4)
        self.value, self.bits = ((j << 4) | ((index >> (rest - top)) << (4 - top))).astype(np.uint8), (4 + top).astype(np.uint8)
        inner, done, step, parts = _mix(((j << 4) | (index >> (rest - top))).astype(np.uint64) + np.uint64(1)), top, 1, []
        while (more := np.flatnonzero(rest > done)).size:
            n = np.minimum(rest - done, 8)
            value = (index >> (rest - done - n)) & ((1 << n) - 1)
            none = np.zeros(len(more), np.uint64)
            parts.append((more, np.full(len(more), step), (value << (8 - n))[more], n[more], inner[more], none, none))
            inner, done, step = _mix(inner * _ODD + value.astype(np.uint64) + np.uint64(7)), done + n, step + 1
        spelled = np.flatnonzero(place == 0)
        size = np.fromiter((len(words[i]) + 1 for i in spelled), np.int64, len(spelled))
        flat = np.frombuffer(b"".join(words[i] + b" " for i in spelled), np.uint8)
        where = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        b, back = flat.astype(np.uint64) + np.uint64(1), []
        for k in range(1, 6):
            x = np.zeros(len(flat), np.uint64)
            x[k:] = b[:-k]
            x[where < k] = 0
            back.append(x)
        two = back[0] * np.uint64(512) + back[1]
        three = two * np.uint64(512) + back[2]
        five = (three * np.uint64(512) + back[3]) * np.uint64(512) + back[4]
        parts.append((np.repeat(spelled, size), 1 + where, flat.astype(np.int64), np.full(len(flat), 8), three, five, two))
        word, step, value, bits, *own = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((step, word))
        #: Further symbols: value, bits, and what each context holds of the word itself (five bytes: 0 for coded words).
        self.more_value, self.more_bits = value.astype(np.uint8)[order], bits.astype(np.uint8)[order]
        self.more_own = [x[order] for x in own]
        self.count = np.bincount(word, minlength=len(words))
        self.start = np.cumsum(self.count) - self.count
        self.spelled = place == 0


class Symbols:
    """Different symbols of a chunk with their contexts, and the numbers of those that each token is made of.

    Rows are first symbols, one for each different (language word, word before, symbol), then all
    further symbols of each different (language word, word).
    """

    def __init__(self, body: Body):
        t, place = body.tokens, body.place
        codes = Codes(body.words, place)
        self.where = where = np.arange(len(t)) - np.repeat(body.starts, body.lengths)
        r, none = place[t], np.int64(1) << 29
        end = body.words.index(END)

        def before(x, by):
            out = np.full(len(x), none)
            out[by:] = x[:-by]
            out[where < by] = none
            return out

        one = before(r, 1)
        one[one > FREQUENT] = 0
        # The least place of the words before, by doubling the reach.
        language, by = before(np.where((r == 0) | (t == end), none, r), 1), 1
        while by < REACH:
            np.minimum(language, before(language, by), out=language)
            by *= 2
        self.guess = body.guess
        self.hit = self.guess == t
        coded = ~self.hit
        # First symbols.
        first, self.first = numbered((language << 34) | (one.clip(0, FREQUENT + 1) << 12) | (codes.bits[t].astype(np.int64) << 8) | codes.value[t])
        # Further ones.
        has = codes.count[t] > 0
        pairs, number = numbered((language[has] << 31) | t[has])
        n = codes.count[pairs & ((1 << 31) - 1)]
        self.more = np.full(len(t), -1, np.int64)
        self.more[has] = number
        word = pairs & ((1 << 31) - 1)
        at = np.repeat(codes.start[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        owner, word = np.repeat(np.arange(len(pairs)), n), np.repeat(word, n)
        self.more_start = len(first) + np.cumsum(n) - n
        self.value = np.concatenate((first & 255, codes.more_value[at])).astype(np.uint8)
        self.bits = np.concatenate((first >> 8 & 15, codes.more_bits[at])).astype(np.uint8)
        spelled = codes.spelled[word]
        self.kind = np.concatenate((np.zeros(len(first), np.int32), np.where(spelled, 2, 1).astype(np.int32)))
        times = np.where(coded, body.times, 0)
        seen = np.bincount(self.more[has], times[has], len(pairs)) if len(pairs) else np.zeros(0)
        self.times = np.concatenate((np.bincount(self.first, times, len(first)), seen[owner])).astype(np.int64)
        u = lambda x: x.astype(np.uint64)
        tongue = np.concatenate((first >> 34, (pairs >> 31)[owner]))
        own = [np.concatenate((np.zeros(len(first), np.uint64), x[at])) for x in codes.more_own]
        side = np.where(self.kind == 2, np.uint64(1 << 40), np.uint64(0))
        prev = np.concatenate((u((first >> 12) & ((1 << 22) - 1)) + np.uint64(1), np.zeros(len(at), np.uint64)))
        #: Context hashes; 0 for none.
        self.contexts = [_mix(own[0] * _ODD + side + np.uint64(11)), np.where(prev > 0, _mix(prev + np.uint64(13)), np.where(self.kind == 2, _mix(own[1] * _ODD + np.uint64(17)), np.uint64(0))), _mix(np.where(self.kind == 2, own[2], own[0]) * _ODD + _mix(u(tongue) + side + np.uint64(19)))]

    def keys(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that have a context k, and their keys."""
        at = np.flatnonzero(self.contexts[k])
        return at, (self.contexts[k][at] & ~np.uint64(255)) | self.value[at]


def second_pass(pdf: pd.DataFrame, word_parts: int, parts: int) -> pd.DataFrame:
    """Keys of a chunk's contexts with their training counts, dealt to partitions by hash."""
    s = Symbols(Body(pdf, word_parts))
    number, rows = int(pdf["chunk"].iloc[0]), []
    for k in range(CONTEXTS):
        at, keys = s.keys(k)
        every, place = numbered(keys)
        counts = np.bincount(place, s.times[at], len(every)).astype(np.uint32)
        part = _part(every, parts)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(edges)):
            here = order[edges[p] : edges[p + 1]]
            rows.append((3, number, int(p * CONTEXTS + k), pack(planes(every[here]), by_byte(counts[here]))))
    return pd.DataFrame(rows, columns=["kind", "chunk", "p", "data"])


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """By the context alone: all symbols of a context meet."""
    return ((_mix(keys >> np.uint64(8)) >> np.uint64(20)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)


# States of contexts.


def state_of(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The state of a bit that was 0 and 1 so often after a context; swapping the counts mirrors the state."""
    high, low = np.maximum(n0, n1), np.minimum(n0, n1)
    alone = np.searchsorted(ALONE, high, "right") + np.where(n1 > n0, len(ALONE), 0)
    out = np.where(high > 0, alone, 0)
    both = np.flatnonzero(low > 0)
    ratio = np.log((n1[both] + 0.4) / (n0[both] + 0.4))
    out[both] = _MIX + RATIOS + np.clip(np.trunc(2 * ratio + 0.5 * np.sign(ratio)), -RATIOS, RATIOS).astype(np.int64)
    return out.astype(np.uint8)


def mirrored() -> np.ndarray:
    n = len(ALONE)
    return np.concatenate(([0], np.arange(n) + 1 + n, np.arange(n) + 1, _MIX + 2 * RATIOS - np.arange(2 * RATIOS + 1)))


_SMALL = 64
_TABLE = state_of(*(x.ravel() for x in np.meshgrid(np.arange(_SMALL), np.arange(_SMALL), indexing="ij"))).reshape(_SMALL, _SMALL)


def states_of(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    out = _TABLE[np.minimum(n0, _SMALL - 1), np.minimum(n1, _SMALL - 1)]
    large = np.flatnonzero((n0 >= _SMALL) | (n1 >= _SMALL))
    out[large] = state_of(n0[large], n1[large])
    return out


def path_states(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted different keys: states of the eight bits on each symbol's path, (8, keys); and as if the symbol had been counted once less."""
    full, less = np.empty((8, len(keys)), np.uint8), np.empty((8, len(keys)), np.uint8)

    def total(bits):
        new = np.concatenate(([True], (keys[1:] >> np.uint64(bits)) != (keys[:-1] >> np.uint64(bits))))
        return np.add.reduceat(counts, np.flatnonzero(new))[np.cumsum(new) - 1]

    above = total(8)
    for d in range(8):
        here = total(7 - d)
        one = (keys >> np.uint64(7 - d)) & np.uint64(1) == 1
        other = above - here
        for out, own in ((full, here), (less, np.maximum(here - 1, 0))):
            out[d] = states_of(np.where(one, other, own), np.where(one, own, other))
        above = here
    return full, less


def third_pass(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts of one partition's keys over all chunks; each chunk gets the states of its own."""
    own, held, waiting = [], [], 0
    every, total = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for data in pdf["data"]:
        p, c = unpack(data)
        own.append(p)
        held.append((from_planes(p, np.uint64), from_bytes(c, np.uint32)))
        waiting += len(held[-1][0])
        if waiting > max(1_000_000, len(every)) or len(own) == len(pdf):
            every, at = numbered(np.concatenate([every, *(k for k, _ in held)]))
            total = np.bincount(at, np.concatenate([total, *(c for _, c in held)]), len(every)).astype(np.int64)
            held, waiting = [], 0
    full, less = path_states(every, total)
    rows = []
    for chunk, p, keys in zip(pdf["chunk"], pdf["p"], own):
        at = np.searchsorted(every, from_planes(keys, np.uint64))
        f = full[:, at]
        rows.append((4, chunk, p, pack(f, less[:, at] ^ f)))
    return pd.DataFrame(rows, columns=["kind", "chunk", "p", "data"])


# The mixer.


def squash(x):
    return 1 / (1 + np.exp(-x))


class Mixer:
    """Predictions of states, weights by gate and the refining table, learned from counts of what happened."""

    def __init__(self):
        self.happened = np.zeros((CONTEXTS * KINDS * STATES, 2))
        self.cells = np.zeros((N_BINS**CONTEXTS * KINDS, 2))

    def see(self, states: list[np.ndarray], kind: np.ndarray, bit: np.ndarray, n: np.ndarray) -> None:
        """Takes in bits: states by context, kind, the bit and how often it happened."""
        for k, s in enumerate(states):
            self.happened += _tally((k * KINDS + kind) * STATES + s, bit, n, len(self.happened))
        cell = kind
        for s in states:
            cell = cell * np.int32(N_BINS) + _BINS32[s]
        self.cells += _tally(cell, bit, n, len(self.cells))

    def fit(self, laps: int = 10, rate: float = 0.05) -> Mixer:
        """Online over cells of equal bins in a fixed order: gradient steps of the logistic loss, weighted by how often a cell was seen."""
        mirror = mirrored()
        n = self.happened.reshape(CONTEXTS, KINDS, STATES, 2)
        n = n + n[:, :, mirror][..., ::-1]  # a mirrored state predicts the other bit
        value = np.concatenate(([0.0], np.log((ALONE + 0.1) / 0.1) * -1, np.log((ALONE + 0.1) / 0.1), (np.arange(2 * RATIOS + 1) - RATIOS) / 2))
        prior = squash(value)
        self.stretch = np.log((n[..., 1] + 4 * prior) / (n[..., 0] + 4 * (1 - prior)))
        weight = n.sum(axis=3) + 1e-6
        at = np.flatnonzero(self.cells.sum(axis=1))
        at = at[np.argsort(_mix(at.astype(np.uint64)))]
        kind = at // N_BINS**CONTEXTS
        bins = [at // N_BINS ** (CONTEXTS - 1 - k) % N_BINS for k in range(CONTEXTS)]
        inputs = np.zeros((len(at), CONTEXTS))
        for k in range(CONTEXTS):
            mean = np.stack([np.bincount(BINS, weight[k, q] * self.stretch[k, q], N_BINS) / np.bincount(BINS, weight[k, q], N_BINS) for q in range(KINDS)])
            inputs[:, k] = mean[kind, bins[k]]
        gate = self._gate(kind, bins[1] > 0, bins[2] > 0)
        zeros, ones = self.cells[at].T
        seen = zeros + ones
        self.weights = np.full((GATES, CONTEXTS), 0.4)
        square = np.full((GATES, CONTEXTS), 1e-4)
        for _ in range(laps):
            for a in range(0, len(at), 128):
                part = slice(a, a + 128)
                g, x = gate[part], inputs[part]
                err = seen[part] * squash((self.weights[g] * x).sum(axis=1)) - ones[part]
                size = np.maximum(np.bincount(g, seen[part], GATES), 1)
                step = np.stack([np.bincount(g, err * x[:, i], GATES) / size for i in range(CONTEXTS)], axis=1)
                square += step * step
                self.weights -= rate * step / np.sqrt(square)
        x = (self.weights[gate] * inputs).sum(axis=1)
        i, f = self._grid(x)
        outcome = np.zeros((GATES * STEPS, 2))
        for j, part in ((i, 1 - f), (i + 1, f)):
            outcome += np.stack([np.bincount(gate * STEPS + j, part * y, GATES * STEPS) for y in (zeros, ones)], axis=1)
        start = np.tile(squash((np.arange(STEPS) - STEPS // 2) / 2.0), GATES)
        self.refine = ((outcome[:, 1] + 16 * start) / (outcome.sum(axis=1) + 16)).astype(np.float32)
        return self

    @staticmethod
    def _gate(kind, one, two):
        return (kind * 2 + one) * 2 + two

    @staticmethod
    def _grid(x):
        q = np.clip(2 * x + STEPS // 2, 0, STEPS - 1.001)
        i = q.astype(np.int32)
        return i, q - i

    def chance(self, states: list[np.ndarray], kind: np.ndarray) -> np.ndarray:
        """The probability of a 1: the mean of mixed and refined predictions."""
        gate = self._gate(kind, states[1] > 0, states[2] > 0)
        at = gate * np.int32(STATES)
        x = np.zeros(len(at), np.float32)
        for k, s in enumerate(states):
            # Weight by gate times prediction by the gate's kind.
            weighted = (self.weights[:, k, None] * self.stretch[k][np.arange(GATES) // 4]).astype(np.float32)
            x += weighted.ravel()[at + s]
        np.clip(x, -14, 14, out=x)
        i, f = self._grid(x)
        i += gate * np.int32(STEPS)
        return (squash(x) + self.refine[i] * (1 - f) + self.refine[i + 1] * f) / 2


_BINS32 = BINS.astype(np.int32)


def _tally(at: np.ndarray, bit: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at * np.int64(2) + bit, n, 2 * size).reshape(size, 2)


class Bits:
    """Bits of some rows as rows of eight: value and kind, and whether the symbol has so many bits; states of the contexts."""

    def __init__(self, s: Symbols, where: list[np.ndarray], at):
        depth = np.arange(8)
        self.bit = np.unpackbits(s.value[at][:, None], axis=1).ravel()
        # The first symbol's further bits are of the second kind.
        kind = s.kind[at][:, None]
        self.kind = (kind | ((kind == 0) & (depth >= 4))).ravel()
        self.real = depth < s.bits[at][:, None]
        self.rows = [w[at] for w in where]

    def states(self, tables: list[np.ndarray]) -> list[np.ndarray]:
        """tables: (keys + 1, 8) for each context; the last row is for symbols without it."""
        return [t[w].ravel() for t, w in zip(tables, self.rows)]


class Guesses:
    """The bit that says whether a guess is right: how often it was, by the guess's bucket and what became of the guess before."""

    def __init__(self, s: Symbols, body: Body):
        self.at = np.flatnonzero(s.guess >= 0)
        bucket = np.searchsorted(FIRST, body.place[s.guess[self.at]], "right")
        last = np.where(s.guess < 0, 0, np.where(s.hit, 1, 2))
        self.context = bucket * 3 + np.where(s.where[self.at] > 0, last[self.at - 1], 0)
        self.hit = s.hit[self.at].astype(np.int64)
        n = _tally(self.context, self.hit, body.times[self.at], 3 * (BUCKETS + 2))
        self.right = (n[:, 1] + 0.5) / (n.sum(axis=1) + 1)

    def bits(self, size: int) -> np.ndarray:
        p = self.right[self.context]
        return np.bincount(self.at, -np.log2(np.where(self.hit == 1, p, 1 - p)), size)


def score_chunk(known: pd.DataFrame, states: pd.DataFrame, word_parts: int, parts: int, n: int, v: int) -> pd.DataFrame:
    """Learns from the chunk's training texts, each without its own counts, then scores all its texts."""
    body = Body(known, word_parts)
    s = Symbols(body)
    got = states.sort_values("p")
    where, full, less = [], [], []
    for k in range(CONTEXTS):
        at, keys = s.keys(k)
        every, place = numbered(keys)
        order = np.argsort(_part(every, parts), kind="stable")
        blobs = [unpack(x) for x in got.loc[got["p"] % CONTEXTS == k, "data"]]
        tables = []
        for part in (0, 1):
            t = np.zeros((len(every) + 1, 8), np.uint8)
            if blobs:
                t[order] = np.concatenate([b[part] for b in blobs], axis=1).T
            tables.append(t)
        full.append(tables[0])
        less.append(tables[0] ^ tables[1])
        w = np.full(len(s.bits), len(every), np.int32)
        w[at] = place
        where.append(w)
    cuts = list(range(0, len(s.bits), STEP))
    mixer = Mixer()
    learns = np.flatnonzero(s.times)
    for a in range(0, len(learns), STEP):
        at = learns[a : a + STEP]
        x = Bits(s, where, at)
        mixer.see(x.states(less), x.kind, x.bit, (s.times[at, None] * x.real).ravel())
    mixer.fit()
    del less
    cost = np.zeros(len(s.bits))
    for a in cuts:
        x = Bits(s, where, slice(a, a + STEP))
        p = mixer.chance(x.states(full), x.kind)
        p = np.where(x.bit == 1, p, 1 - p).reshape(-1, 8)
        cost[a : a + STEP] = -np.log2(np.where(x.real, p, 1), dtype=np.float32).sum(axis=1, dtype=np.float64)
    further = np.add.reduceat(np.append(cost, 0), s.more_start) if len(s.more_start) else np.zeros(0)
    coded = cost[s.first] + np.where(s.more >= 0, np.append(further, 0)[s.more], 0)
    token_bits = Guesses(s, body).bits(len(body.tokens)) + np.where(s.hit, 0, coded)
    per = lambda x: np.add.reduceat(x, body.starts)
    t, counts = body.tokens, body.counts
    base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
    length = np.array([1 if w == END else len(w) + 1 for w in body.words])
    bits, n_bytes = per(token_bits), per(length[t])
    ids = pd.array(body.ids, "Int64")
    ids[body.null] = pd.NA
    out = pd.DataFrame({"doc_id": ids, "held_out": body.held, "n_tokens": body.lengths, "n_known": per((counts[t] > 0).astype(np.int64)), "train_tokens": n, "base_score": per(base[t]), "score": -bits * math.log10(2), "n_bytes": n_bytes, "bits_per_byte": bits / n_bytes})
    return out.loc[out.index.repeat(body.copies)]


def _fold(col):
    return F.pmod(F.crc32(F.coalesce(col, F.lit("")).cast("binary")), F.lit(10))


def score_documents(docs: DataFrame, *, text_col="text", chunk_chars=CHUNK_CHARS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Texts whose crc32(doc_id) is no multiple of 10 train: counts of words and contexts come from all
    of them. Chunks of about ``chunk_chars`` characters are dealt by a hash of id and text; each
    learns states, weights and refining table from all its training texts, as if a text's own use
    of a context had not been counted, and scores its texts with the full counts.

    A null text is an empty one, which has the end alone; a null doc_id counts as an empty id; equal
    rows are scored alike and each stays; other columns are left out.
    """
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    chars = docs.select(F.sum(F.length("text"))).first()[0] or 0
    n_chunks = max(1, math.ceil(chars / chunk_chars))
    word_parts = max(1, n_chunks // 8)
    rows = "kind int, chunk int, p int, data binary"
    h = F.xxhash64("doc_id", "text")
    texts = docs.select("doc_id", "text", _fold(F.col("doc_id")).cast("int").alias("fold"), h.alias("h"), F.pmod(F.shiftright(h, 7), F.lit(n_chunks)).cast("int").alias("chunk"), F.lit(1).cast("long").alias("copies"))
    texts = texts.mapInPandas(packed_texts, rows)
    begun = written(texts.groupBy("chunk").applyInPandas(lambda pdf: first_pass(pdf, word_parts), rows), "lm-begun")

    counted = written(begun.filter("kind = 1").groupBy("p").applyInPandas(place_words, rows), "lm-counted")
    sizes = written(counted.filter("kind = 5").select("p", "data").mapInPandas(class_sizes, "p int, class int, n long, tokens long, words long"), "lm-classes")
    n, v = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    places = written(counted.filter("kind = 2").join(first_places(sizes), "p").mapInPandas(placed_words, rows), "lm-places")

    known = begun.filter("kind = 0").union(places)
    keys = known.groupBy("chunk").applyInPandas(lambda pdf: second_pass(pdf, word_parts, n_chunks), rows)
    states = keys.groupBy("p").applyInPandas(third_pass, rows)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    # The same exchange of what is known serves both passes.
    return known.groupBy("chunk").cogroup(states.groupBy("chunk")).applyInPandas(lambda a, b: score_chunk(a, b, word_parts, n_chunks, n, v), schema)


def query(docs: DataFrame) -> DataFrame:
    return score_documents(docs)
