"""Benchmark passages in training shards, found by an FM-index over each shard's words.

The index is over what can hold a phrase: words of no test item are one separator, and so are runs of
the others that are shorter than the shortest phrase. This drops no occurrence, so counts, places and
spans are those of an index over all words of the shard.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import few_at_once, fields, spared

#: ASCII letters and digits and every byte above ASCII make words; A-Z count as a-z.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Characters of test items that are sent to every task at once; more are searched in several rounds.
MOST_CHARS = 40_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Phrases:
    """The windows of all items as rows of word ids; ids from 1, by first use."""

    def __init__(self, items: list[tuple], size: int):
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words_of(text)]
            for i in range(max(1, len(w) - size + 1) if w else 0):
                owners.setdefault(tuple(w[i : i + size]), set()).add(item)
        self.windows = list(owners)
        self.owners = [sorted(owners[w], key=str) for w in self.windows]
        self.shortest = min(map(len, self.windows), default=0)


class Known(dict):
    """Word ids; 0 for words of no item."""

    def __missing__(self, word: bytes) -> int:
        return 0


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector with running counts for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.counts, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b) & 1
            self.counts.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(seq) - int(self.counts[-1][-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol stands before at."""
        start = np.zeros_like(at)
        for k, (ones, zeros) in enumerate(zip(self.counts, self.zeros)):
            up = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            at = np.where(up, zeros + ones[at], at - ones[at])
            start = np.where(up, zeros + ones[start], start - ones[start])
        return at - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at a place, and how often it stands before it."""
        symbol, start, at = np.zeros_like(at), np.zeros_like(at), at.copy()
        for ones, zeros in zip(self.counts, self.zeros):
            up = ones[at + 1] > ones[at]
            symbol = symbol * 2 + up
            at = np.where(up, zeros + ones[at], at - ones[at])
            start = np.where(up, zeros + ones[start], start - ones[start])
        return symbol, at - start


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By doubling: ranks of 2h symbols from pairs of ranks of h symbols."""
    n, h = len(seq), 1
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[: n - h if h < n else 0] += rank[h:] + 1 if h < n else 0
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or h >= n:
            return order
        h *= 2


class FMIndex:
    """Counts and finds phrases in a sequence of symbols, from its Burrows-Wheeler transform and sampled suffix positions."""

    def __init__(self, seq: np.ndarray, symbols: int, every: int = 16):
        # A least symbol at the end, found nowhere else, makes every step back exact.
        seq, symbols = np.concatenate((seq + 1, np.zeros(1, seq.dtype))), symbols + 1
        suffixes = suffix_array(seq)
        self.wave = WaveletMatrix(seq[suffixes - 1].astype(np.int32), max(1, int(symbols - 1).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=symbols))))
        kept = suffixes % every == 0
        self.marked, self.before, self.sampled = kept, np.cumsum(kept, dtype=np.int32), suffixes[kept].astype(np.int32)
        self.n = len(seq)

    def find(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of equally long phrases, by backward search for all at once."""
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        for c in windows.T[::-1] + 1:
            lo, hi = self.first[c] + self.wave.rank(c, lo), self.first[c] + self.wave.rank(c, hi)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: steps back in the text up to a marked one."""
        at, steps, out = rows.copy(), np.zeros_like(rows), np.full(len(rows), -1, np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.marked[at[todo]]
            out[todo[hit]] = self.sampled[self.before[at[todo[hit]]] - 1] + steps[todo[hit]]
            todo = todo[~hit]
            if len(todo):
                c, before = self.wave.access(at[todo])
                at[todo] = self.first[c] + before
                steps[todo] += 1
        return out


def search_shard(texts: list, phrases: Phrases) -> list[tuple]:
    """For each text of a shard: number of words, whether each is hit (none: nothing is), and item ids."""
    parts, doc_at, word_at, counts = [], [], [], []
    ids_of = Known(phrases.ids).__getitem__
    for d, text in enumerate(texts):
        w = words_of(text)
        counts.append(len(w))
        ids = np.fromiter(map(ids_of, w), np.int32, len(w))
        if not phrases.windows or len(w) < phrases.shortest:
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ids != 0, [0])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= phrases.shortest
        for s, e in zip(starts[long], ends[long]):
            parts += [ids[s:e], _GAP]
            doc_at.append(np.full(e - s + 1, d, np.int32))
            word_at.append(np.arange(s, e + 1, dtype=np.int32))
    hits: dict[int, np.ndarray] = {}
    items: dict[int, set] = {}
    if parts:
        seq = np.concatenate([_GAP, *parts])
        doc_of, word_of = np.concatenate([_GAP, *doc_at]), np.concatenate([_GAP, *word_at])
        index = FMIndex(seq, len(phrases.ids) + 1)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(phrases.windows):
            by_size.setdefault(len(w), []).append(i)
        cover = np.zeros(len(seq) + 1, np.int64)
        for size, which in by_size.items():
            lo, hi = index.find(np.array([phrases.windows[i] for i in which], np.int64))
            some = np.flatnonzero(hi > lo)
            for rows, owner in _batches(lo[some], hi[some], np.array(which, np.int64)[some]):
                at = index.locate(rows)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + size, -1)
                for pair in np.unique(doc_of[at] * np.int64(len(phrases.windows)) + owner).tolist():
                    d, i = divmod(pair, len(phrases.windows))
                    items.setdefault(d, set()).update(phrases.owners[i])
        inside = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        for d, words in zip(*_split(doc_of[inside], word_of[inside])):
            hits[d] = np.zeros(counts[d], bool)
            hits[d][words] = True
    return [(counts[d], hits.get(d), sorted(items.get(d, ()), key=str)) for d in range(len(texts))]


def _batches(lo: np.ndarray, hi: np.ndarray, owner: np.ndarray, most: int = 1 << 20):
    """Rows of all ranges with their phrase, at most ``most`` at once however often a phrase occurs."""
    ends = np.cumsum(hi - lo)
    for a in range(0, int(ends[-1]) if len(ends) else 0, most):
        x = np.arange(a, min(a + most, int(ends[-1])))
        r = np.searchsorted(ends, x, "right")
        yield hi[r] - (ends[r] - x), owner[r]


def _split(keys: np.ndarray, values: np.ndarray) -> tuple[list, list]:
    """Values by rising key."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return keys[np.concatenate(([0], cuts))].tolist() if len(keys) else [], np.split(values, cuts) if len(keys) else []


_GAP = np.zeros(1, np.int32)


def spans_of(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Hit words that follow each other make one span, from the first word's start to the last one's end."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0])).astype(np.int8)))
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(chars[places[a][0]]), int(chars[places[b - 1][1]])) for a, b in zip(edges[::2], edges[1::2])]


def cut(text: str, spans) -> str:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join(out) + text[at:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window=10, shard_words=1_000_000, text_col="text", keep=("doc_id",), remove=False, most_chars=MOST_CHARS) -> DataFrame:
    """Words of each document that lie in an occurrence of a test window.

    A window is ``window`` consecutive words of an item, or the whole of a shorter one. Each task
    indexes its documents in shards of about ``shard_words`` words and searches all windows in each;
    no row leaves its task. Adds n_words, n_hit, items (ids as strings, sorted) and spans (start, end
    in code points); with ``remove``, text_cut is the text without its spans. More than ``most_chars``
    characters of items are searched in rounds, each with a share of the items by hash.

    Null and empty texts have no words; items without words have no window; items of one id are one;
    an empty benchmark hits nothing; repeated rows are judged alike; a column in ``keep`` with the
    name of an added one gives way to it.
    """
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null")
    chars = rows.select(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    rounds = max(1, -(-chars // most_chars))
    added = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>" + ", text_cut string" * remove
    keep = spared(keep, added)
    schema = fields(docs.select(*keep), added)
    src = few_at_once(docs.select(*keep, F.col(text_col).alias("text\0")))
    before = fields(src, "`hit\0` binary, `items\0` array<string>")
    for r in range(rounds):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == r) if rounds > 1 else rows
        sent = docs.sparkSession.sparkContext.broadcast([(x[0], x[1]) for x in part.collect()])
        last = r == rounds - 1
        src = src.mapInPandas(_round(sent, window, shard_words, remove, last), schema if last else before)
    return src


def _round(sent, window: int, shard_words: int, remove: bool, last: bool):
    def run(batches):
        phrases, held, size = Phrases(sent.value, window), [], 0

        def flush():
            found = iter(search_shard([t for b in held for t in b["text\0"]], phrases))
            for b in held:
                out = []
                for i in range(len(b)):
                    n, hit, items = next(found)
                    if "hit\0" in b and b["hit\0"].iloc[i] is not None:
                        old = np.unpackbits(np.frombuffer(b["hit\0"].iloc[i], np.uint8), count=n).astype(bool)
                        hit = old if hit is None else hit | old
                        items = sorted({*items, *b["items\0"].iloc[i]}, key=str)
                    out.append((n, hit, items))
                texts = list(b["text\0"])
                if not last:
                    yield b.assign(**{"hit\0": [None if h is None else np.packbits(h).tobytes() for _, h, _ in out], "items\0": [x for _, _, x in out]})
                    continue
                b = b.drop(columns=[c for c in b.columns if c.endswith("\0")])
                spans = [[] if h is None else spans_of(t, h) for t, (_, h, _) in zip(texts, out)]
                b["n_words"], b["n_hit"], b["items"], b["spans"] = [x[0] for x in out], [0 if x[1] is None else int(x[1].sum()) for x in out], [x[2] for x in out], [[{"start": s, "end": e} for s, e in x] for x in spans]
                if remove:
                    b["text_cut"] = [cut(t, x) if x else t for t, x in zip(texts, spans)]
                yield b

        for b in batches:
            for k in range(0, len(b), 512):
                held.append(b.iloc[k : k + 512].reset_index(drop=True))
                size += sum(len(t) for t in held[-1]["text\0"] if t) // 6
                if size >= shard_words:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    d = decontaminate(docs, benchmark)
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def oracle(window: int = 10) -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    n = window
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {words} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), {n}) AS k, array_to_string(w[p:p+{n}-1], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {n} + 1, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT rid, k, p, array_to_string(w[p:p+k-1], ' ') AS win FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
h AS (SELECT rid, dw.k, p, item FROM dw JOIN iw ON dw.win = iw.win AND dw.k = iw.k),
hit AS (SELECT rid, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM h) GROUP BY rid),
it AS (SELECT rid, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)"""
