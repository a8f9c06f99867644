"""Exact similarity join of documents on word shingles by a token-group matrix."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import few_at_once, written
from tessera.llm.components import components

#: Logarithm of the places at which shingles are counted; shingles in one block of members; queries that meet one block; logarithms of the least and most bits of a filter.
PLACES = 25
BLOCK = 2_000_000
QUERIES = 500
FILTER_BITS = (16, 27)
#: A group of n sets has the square root of n over this in blocks, at least.
SPREAD = 12
#: Shingles that are sorted at once when they are counted.
CHUNK = 4_000_000
#: A near copy that shares no signature with its group is a group of its own: with J in common, (1 - J) to this power of them are.
SIGNATURES = 8


@dataclass(frozen=True)
class Rule:
    """Sets of ``words``-word shingles link when den * intersection >= num * union."""

    words: int = 4
    num: int = 85
    den: int = 100

    def extra(self, n):
        """How many more shingles than one a prefix must share at least."""
        return n // 20 + 1

    def prefix(self, n: int) -> int:
        return min(n, n - -(-self.num * n // self.den) + self.extra(n))

    def may_link(self, n, low, high, hits):
        """Whether a set of n shingles can link with one of low to high, of whose prefixes it has no more than these hits.

        Sets of n and m link with num / (num + den) * (n + m) shingles in common at least. In the common
        order those outside one of the prefixes come last, so there are no more of them than the
        larger set has outside its own: less than (num / den - 1 / 20) * max(n, m) + 1. What is left
        of the sum is least at one end of the sizes that can link.
        """
        share = self.num / self.den
        left = lambda m: (n + m) * (share / (1 + share)) - F.greatest(n.cast("double"), m) * (share - 0.05) - 1
        ends = F.greatest(low.cast("double"), n * share), F.least(high.cast("double"), n / share)
        return (self.den * high >= self.num * n) & (self.num * low <= self.den * n) & (hits > F.least(*map(left, ends)) - 1e-6)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted different shingle hashes (uint64) of a text.

    A word's hash is a polynomial of its bytes modulo 2^64, taken from running sums over the whole
    text at once: the sum between a word's ends over the power at its start.
    """

    BASE = 0xD6E8FEB86659FD93

    def __init__(self, words: int):
        self.k = words
        self.by = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64)) for i in range(words)]
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.up = self.down = np.ones(1, np.uint64)

    def _words(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw)
        if len(self.up) <= n:
            powers = lambda x: np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(2 * n, x, np.uint64))))
            self.up, self.down = powers(self.BASE), powers(pow(self.BASE, -1, 1 << 64))
        out = self.space[raw]
        edge = np.flatnonzero(out[1:] != out[:-1]) + 1
        edge = np.concatenate(([0] if not out[0] else [], edge, [n] if not out[-1] else [])).astype(np.int64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
        start, end = edge[::2], edge[1::2]
        return _mixed((total[end] - total[start]) * self.down[start])

    def __call__(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
        h = self._words(raw) if len(raw) else raw
        if not len(h):
            return np.zeros(0, np.uint64)
        n = min(self.k, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = _mixed(out + h[i : len(h) - n + 1 + i] * self.by[i])
        out.sort()
        return out[np.concatenate(([True], out[1:] != out[:-1]))]


def _levels(docs: DataFrame, rule: Rule) -> np.ndarray:
    """How common shingles are: a level from 0 to 15 for each of 2^PLACES hashed places, two to a byte.

    Every shingle of every text is counted at its place, two bytes each in the shuffle, so what counts
    as common depends neither on tasks nor, while places suffice, on the size of the input. Level 0
    lies within what places hold by chance; from there each level is twice as common. Any order of
    shingles keeps the join exact; this one puts shared passages last.
    """

    def run(batches):
        shingle, held, size = Shingler(rule.words), [], 0

        def places():
            p = np.sort(np.concatenate(held))
            part, at = np.unique(p >> 16, return_index=True)
            return pd.DataFrame({"i": part.astype(np.int64), "at": [x.astype(np.uint16).tobytes() for x in np.split(p & 0xFFFF, at[1:])]})

        for b in batches:
            for text in b["text"]:
                held.append((shingle(text) & np.uint64((1 << PLACES) - 1)).astype(np.uint32))
                size += len(held[-1])
                if size >= CHUNK:
                    yield places()
                    held, size = [], 0
        if size:
            yield places()

    def merged(pdf):
        n = np.bincount(np.frombuffer(b"".join(pdf["at"]), np.uint16), minlength=1 << 16)
        usual = np.median(n)
        base = usual + 2 * np.sqrt(usual) + 2
        level = np.where(n < base, 0, np.minimum(15, 1 + np.floor(np.log2(np.maximum(n, base) / base)))).astype(np.uint8)
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "level": [(level[::2] | level[1::2] << 4).tobytes()]})

    out = np.zeros((1 << PLACES) // 2, np.uint8)
    for i, x in docs.select("text").mapInPandas(run, "i long, at binary").groupBy("i").applyInPandas(merged, "i long, level binary").toLocalIterator():
        out[i << 15 : (i + 1) << 15] = np.frombuffer(bytes(x), np.uint8)
    return out


def _profiles(docs: DataFrame, rule: Rule, levels) -> DataFrame:
    """Per row: its key k, size n, set id v, prefix (rarest shingles first) and signatures."""

    def run(batches):
        shingle, level = Shingler(rule.words), levels.value
        starts = np.arange(SIGNATURES, dtype=np.uint64) * np.uint64((1 << 64) // SIGNATURES)
        for b in batches:
            ns, vs, ps, sigs = [], [], [], []
            for text in b.pop("text"):
                s = shingle(text)
                ns.append(len(s))
                if not len(s):
                    vs.append(0), ps.append(np.zeros(0, np.int64)), sigs.append(np.zeros(0, np.int64))
                    continue
                vs.append(int(np.sum(_mixed(s), dtype=np.uint64).astype(np.int64)))
                p = s & np.uint64(2 * len(level) - 1)
                rank = level[p >> np.uint64(1)] >> ((p & np.uint64(1)) << np.uint64(2)).astype(np.uint8) & np.uint8(15)
                ps.append(s[np.argsort(rank, kind="stable")[: rule.prefix(len(s))]].view(np.int64))
                # One look at the sorted shingles gives the first from each start, after the last the first.
                sigs.append(s[np.searchsorted(s, starts) % len(s)].view(np.int64))
            b["n"], b["v"], b["prefix"], b["sig"] = ns, vs, ps, sigs
            yield b

    return docs.select("doc_id", "k", "text").mapInPandas(run, "doc_id long, k long, n long, v long, prefix array<long>, sig array<long>")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A filter for the numbers of a one-column table, with eight bits and more for each up to the most: at most 2^27 bits reach the driver."""
    col = keys.columns[0]
    low, high = FILTER_BITS
    size = min(max(low, (8 * keys.count()).bit_length()), high)

    def places(held):
        p = np.unique(np.concatenate(held) & ((1 << size) - 1))
        part, at = np.unique(p >> low, return_index=True)
        return pd.DataFrame({"i": part, "at": [x.astype(np.uint16).tobytes() for x in np.split(p & ((1 << low) - 1), at[1:])]})

    def placed(batches):
        held = []
        for b in batches:
            held.append(b[col].to_numpy(np.int64))
            if sum(map(len, held)) >= 1_000_000:
                yield places(held)
                held = []
        if any(map(len, held)):
            yield places(held)

    def merged(pdf):
        bits = np.zeros(1 << low, np.uint8)
        for x in pdf["at"]:
            bits[np.frombuffer(x, np.uint16)] = 1
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    out = np.zeros((1 << size) // 8, np.uint8)
    for i, x in keys.mapInPandas(placed, "i long, at binary").groupBy("i").applyInPandas(merged, "i long, bits binary").toLocalIterator():
        out[i << (low - 3) : (i + 1) << (low - 3)] = np.frombuffer(bytes(x), np.uint8)
    return out


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    p = h & (8 * len(bits) - 1)
    return (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1


def _open(docs: DataFrame, profiles: DataFrame, rows: DataFrame, rule: Rule) -> DataFrame:
    """Edges (a, b, linked) between queries and members of opened groups.

    rows: (g, part, v, c, query). Members of a part and the queries sent to it meet by (g, part),
    texts with them. c is what a set is known to be joined with: an edge that joins nothing new is
    left out, so a part gives fewer edges than it has rows. Without ``linked``, an edge says that the
    sets share half of their union.
    """
    reps = profiles.filter("n > 0").groupBy("v").agg(F.min("k").alias("k"))
    rows = written(rows.join(reps, "v"), "opened")
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(rows.select("k")))

    def wanted(batches):
        for b in batches:
            yield b[_in(sent.value, b["k"].to_numpy(np.int64))]

    texts = docs.select("k", "text").mapInPandas(wanted, "k long, text string")
    met = rows.join(texts, "k").select("g", "part", "v", "c", "query", "text").repartition("g", "part").sortWithinPartitions("g", "part", "query", "v")

    def run(batches):
        shingle = Shingler(rule.words)
        now = sets = ids = index = last = sides = None

        def root(x):
            while (y := sides.setdefault(x, x)) != x:
                sides[x] = sides[y]
                x = y
            return x

        for b in batches:
            out = []
            for g, part, v, c, query, text in zip(b["g"].tolist(), b["part"].tolist(), b["v"].tolist(), b["c"].tolist(), b["query"].tolist(), b["text"]):
                if now != (g, part):
                    now, sets, ids, index, last, sides = (g, part), [], [], None, None, {}
                if (v, query) == last:
                    continue  # a row that the table holds twice
                last = (v, query)
                s = shingle(text)
                if not query:
                    sets.append(s), ids.append((v, c))
                    continue
                if not sets:
                    continue
                if index is None:
                    flat = np.concatenate(sets)
                    order = np.argsort(flat, kind="stable")
                    sizes = np.array([len(x) for x in sets])
                    index = flat[order], np.repeat(np.arange(len(sets)), sizes)[order], sizes
                tokens, owner, sizes = index
                lo, hi = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
                some = hi > lo
                lo, n = lo[some], (hi - lo)[some]
                if not len(lo):
                    continue
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(sets))
                union = sizes + len(s) - both
                linked = rule.den * both >= rule.num * union
                for i in np.flatnonzero(linked | (2 * both >= union)).tolist():
                    u, uc = ids[i]
                    if u == v:
                        continue
                    if linked[i]:
                        x, y = root(("c", c)), root(("c", uc))
                        if x != y:
                            sides[x] = y
                            out.append((v, u, True))
                    else:
                        x, y = root(("g", c)), root(("g", uc))
                        if x != y:
                            sides[x] = y
                            out.append((v, u, False))
            yield pd.DataFrame(out, columns=["a", "b", "linked"]).astype({"a": "int64", "b": "int64", "linked": "bool"})

    return met.mapInPandas(run, "a long, b long, linked boolean")


def _stars(profiles: DataFrame, rule: Rule) -> DataFrame:
    """First comparisons: sets that share a signature, each with the least set of its signature."""
    sigs = profiles.filter("n > 0").select("v", F.posexplode("sig").alias("i", "s")).distinct()
    lead = sigs.groupBy("i", "s").agg(F.min("v").alias("g"), F.count("*").alias("c")).filter("c > 1").select("i", "s", "g")
    pairs = sigs.join(lead, ["i", "s"]).filter("v <> g").select("g", "v").distinct()
    parts = pairs.groupBy("g").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    queries = pairs.join(parts, "g").select("g", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), "v", F.col("v").alias("c"), F.lit(True).alias("query"))
    members = parts.select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("g").alias("v"), F.col("g").alias("c"), F.lit(False).alias("query"))
    return queries.union(members)


def _sets(profiles: DataFrame, groups: DataFrame, comps: DataFrame) -> DataFrame:
    """(v, n, g, c): every set once, with its group and the component of links found so far."""
    v = profiles.filter("n > 0").select("v", "n").distinct()
    v = v.join(groups.select("v", F.col("comp").alias("g")), "v", "left").join(comps.select("v", F.col("comp").alias("c")), "v", "left")
    return v.select("v", "n", F.coalesce("g", "v").alias("g"), F.coalesce("c", "v").alias("c"))


def _qualifying(profiles: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The token-group matrix: (v, open) for every set and the other groups that may hold a set it links with.

    A group's row of the matrix is the union of its sets' prefixes. A set can link into a group only
    if the union holds enough of the set's prefix, so only such groups are opened. Shingles of one
    set say nothing: they are left out first, through a filter that may let a few pass,
    and with them all sets that keep too few. A shingle of two sets needs no join: counting its sets
    names both. Only shingles of more sets meet the matrix.
    """
    seen = profiles.filter("n > 0").select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    sent = profiles.sparkSession.sparkContext.broadcast(_bitmap(seen))

    def shared(batches):
        for b in batches:
            keep = [p[_in(sent.value, p)] for p in b["prefix"]]
            b["prefix"] = keep
            least = b["n"].to_numpy(np.int64) * rule.num // rule.den // 20 + 1
            yield b[np.array([len(p) for p in keep]) >= least] if len(b) else b

    groups = sets.groupBy("g").agg(F.count("*").alias("members"), F.min("n").alias("low"), F.max("n").alias("high"))
    placed = sets.join(groups, "g").select("v", "g", "members")
    left = profiles.filter("n > 0").select("v", "n", "prefix").mapInPandas(shared, "v long, n long, prefix array<long>")
    tokens = left.dropDuplicates(["v"]).join(placed, "v").select("v", "n", "g", "members", F.explode("prefix").alias("t"))
    tokens = written(tokens, "shared-shingles")
    ends = [f(c).alias(c + i) for c in ("g", "v") for f, i in ((F.min, "0"), (F.max, "1"))]
    between = written(tokens.groupBy("t").agg(F.count("*").alias("sets"), *ends).filter("g0 <> g1"), "between")
    # The sets of the smaller group ask for the larger one.
    pairs = between.filter("sets = 2").groupBy("v0", "v1").agg(F.count("*").alias("hits"))
    pairs = pairs.join(placed.toDF("v0", "g0", "m0"), "v0").join(placed.toDF("v1", "g1", "m1"), "v1")
    asks = F.expr("m0 < m1 or m0 = m1 and g0 < g1")
    pairs = pairs.select(F.when(asks, F.col("v0")).otherwise(F.col("v1")).alias("v"), F.when(asks, F.col("g1")).otherwise(F.col("g0")).alias("open"), "hits")
    cross = written(tokens.join(between.filter("sets > 2").select("t"), "t", "left_semi"), "matrix")
    matrix = cross.select("t", F.col("g").alias("open"), F.col("members").alias("of")).distinct()
    met = cross.join(matrix, "t").filter("members < of or members = of and g < open").groupBy("v", "open").agg(F.count("*").alias("hits"))
    bound = pairs.union(met).groupBy("v", "open").agg(F.sum("hits").alias("hits"))
    bound = bound.join(sets.select("v", "n"), "v").join(groups.withColumnRenamed("g", "open"), "open")
    least = F.floor(F.floor(F.col("n") * rule.num / rule.den) / 20) + 1
    return bound.filter((F.col("hits") >= least) & rule.may_link(F.col("n"), F.col("low"), F.col("high"), F.col("hits"))).select("v", "open")


def _opened(sets: DataFrame, other: DataFrame) -> DataFrame:
    """Members of the groups to open, in blocks of about BLOCK shingles, and the queries to each block.

    Besides the groups that the matrix names, a set opens its own group unless it is in the group's
    largest component: two sets of one component need no more links.
    """
    per = sets.groupBy("g", "c").agg(F.count("*").alias("n"), F.sum("n").alias("shingles"))
    per = per.groupBy("g").agg(F.count("*").alias("comps"), F.max_by("c", "n").alias("most"), F.sum("shingles").alias("shingles"), F.sum("n").alias("members"))
    own = sets.join(per.filter("comps > 1"), "g").filter("c <> most").select("v", F.col("g").alias("open"))
    found = written(other.select("v", "open").union(own), "qualifying")
    wanted = found.select(F.col("open").alias("g")).distinct()
    # A group of many small sets is cut too: its blocks and the members of each grow alike.
    blocks = F.greatest(F.ceil(F.col("shingles") / BLOCK), F.ceil(F.sqrt("members") / SPREAD)).cast("int")
    parts = per.join(wanted, "g").select("g", blocks.alias("parts"))
    members = sets.join(parts, "g").select("g", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), "v", "c", F.lit(False).alias("query"))
    queries = found.join(parts.withColumnRenamed("g", "open"), "open").join(sets.select("v", "c"), "v")
    queries = queries.select(F.col("open").alias("g"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "v", "c", F.lit(True).alias("query"))
    return members.union(queries)


def link_documents(docs: DataFrame, rule: Rule = Rule(), *, text_col="text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), c (the component's own id) and k (hash of id and text).

    Equal sets are one vertex. Sets with a common signature are compared with one leader; sets that
    share half of their union with it make the groups of the token-group matrix. The matrix finds
    every group that a set may link into; there, and within its own group, the set is held against
    all members. Links that change no component are not returned.

    Null, empty and white-space texts have no shingles and stand alone; rows of equal texts, also
    under one doc_id, are one vertex; a null doc_id is never the least.
    """
    docs = few_at_once(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text_col).alias("k"), F.col(text_col).alias("text")))
    levels = docs.sparkSession.sparkContext.broadcast(_levels(docs, rule))
    profiles = written(_profiles(docs, rule, levels), "profiles")
    first = written(_open(docs, profiles, _stars(profiles, rule), rule), "links-1")
    links = first.filter("linked")
    sets = written(_sets(profiles, components(first), components(links)), "sets")
    second = written(_open(docs, profiles, _opened(sets, _qualifying(profiles, sets, rule)), rule).filter("linked"), "links-2")
    comps = components(links.select("a", "b").union(second.select("a", "b")))
    vertex = profiles.select("doc_id", "k", "n", "v").join(comps, "v", "left").withColumn("c", F.coalesce("comp", "v"))
    least = vertex.filter("n > 0").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    out = vertex.join(least, "c", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "c", "k")


def query(docs: DataFrame) -> DataFrame:
    return link_documents(docs).select("doc_id", "n_shingles", "component_id")


def oracle(words: int = 4, num: int = 85, den: int = 100) -> str:
    """Least reachable ids by recursion over exact pairs; pairs are counted over shared shingles."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p+{words}-1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words} + 1, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * o >= {num} * (x.n + y.n - o)),
r(v, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v WHERE r.c < e.b),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.v = d.doc_id"""
