"""Exact URL lists as a cascade of Bloom filters, and longest-match host and path rules."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lower_ascii, packed, spared, written

#: Names of listed sites and the domains they stand under.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "malware-host", "phish-login", "spam-farm", "torrent-hub", "warez-zone")
LISTED_UNDER = ("example.com", "example.net", "example.org")
LISTED_SITES = tuple(f"{n}.{d}" for n in LISTED_NAMES for d in LISTED_UNDER)
#: Fixed values: (verdict, rule).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Filters are sent to every task only up to this size; larger lists are cut.
MOST_BYTES = 32 << 20


def url_host(url: Column) -> Column:
    """What lies after the first :// up to / ? # or the end, in lower case; empty for null or without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_keys(host: Column) -> Column:
    """The host and all domains above it: a.b.c gives a.b.c, b.c, c. Empty host: no keys."""
    parts = F.split(host, r"\.")
    return F.when(host != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).otherwise(F.array().cast("array<string>"))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, start = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


class Level:
    """One Bloom filter: a binary literal, tested without Python."""

    def __init__(self, index: int, bits: int, hashes: int):
        self.index, self.bits, self.hashes, self.data, self.literal = index, bits, hashes, b"", None

    def places(self, key: Column) -> list[Column]:
        h = F.xxhash64(key, F.lit(self.index))
        a, b = F.shiftrightunsigned(h, 33), h.bitwiseAND(F.lit(0x7FFFFFFF))
        return [F.pmod(a + b * F.lit(j).cast("long"), F.lit(self.bits).cast("long")) for j in range(self.hashes)]

    def fill(self, keys: DataFrame) -> Level:
        """The driver gets the 64-bit words that are not zero, packed: at most twice the filter's size."""
        at = keys.select(F.explode(F.array(*self.places(F.col("key")))).alias("p"))
        words = at.groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v"))
        i, v = packed(words, {"i": np.int64, "v": np.int64})
        data = np.zeros(self.bits // 64, "<i8")
        data[i] = v
        self.data = data.tobytes()
        self.literal = F.lit(self.data)  # one for all hashes
        return self

    def has(self, key: Column) -> Column:
        def bit(p: Column) -> Column:
            byte = F.conv(F.hex(F.substring(self.literal, (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.getbit(byte, p.bitwiseAND(F.lit(7)).cast("int")) == 1

        out = F.lit(True)
        for p in self.places(key):
            out = out & bit(p)
        return out


class Cascade:
    """Levels in turn hold listed keys and false positives; the first level without a key decides."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def listed(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(level.has(key), out).otherwise(F.lit(level.index % 2 == 1))
        return out

    def bytes(self) -> int:
        return sum(len(x.data) for x in self.levels)


def bits_for(n: int, k: int) -> int:
    return max(64, 64 * math.ceil(n * k / math.log(2) / 64))


def hashes_for(n: int, total: int) -> int:
    return max(1, round(math.log2(max(2.0, (total - n) / n))))


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade:
    """An exact cascade for one-column ``key`` tables over every key of the universe.

    Level 0 holds the listed keys of the universe, level 1 the other keys that level 0 lets through,
    level 2 the listed keys that level 1 lets through, and so on until nothing is let through. Only
    level 0 meets the whole universe; what it lets through shrinks by half a level. Null keys are no
    keys, repeated keys are one; an empty list gives a cascade without levels, which lists nothing.
    """
    universe = universe.filter("key is not null").distinct()
    listed = written(listed.filter("key is not null").distinct().join(universe, "key", "left_semi"), "listed")
    total, n = universe.count(), listed.count()
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    levels: list[Level] = []
    while n:
        k = hashes_for(n, total) if not levels else 1
        levels.append(level := Level(len(levels), bits_for(n, k), k).fill(inside))
        outside = written(outside.filter(level.has(F.col("key"))), "passed")
        inside, outside = outside, inside
        n = inside.count()
    return Cascade(levels)


def judge_urls(pages: DataFrame, listed: DataFrame, *, rules=RULES, url_col="url", keep=("page_id",), most_bytes=MOST_BYTES) -> DataFrame:
    """host, path, rule, verdict and listed site of every URL.

    A rule decides where one fits, the longest first; else a URL is blocked if its host or a domain
    above it is listed. A list whose first filter would pass ``most_bytes`` is cut by a hash of the
    key; its parts have cascades of their own, which are sent one after the other, each in a pass over
    the hosts. Null URLs and URLs without :// have empty host and path and are allowed; repeated rows
    are judged alike; a kept column with the name of an added one gives way to it.
    """
    keep = spared(keep, "host x, path x, rule x, verdict x, listed_site x")
    urls = pages.select(*keep, url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    universe = written(urls.select("host").distinct().select(F.explode(host_keys(F.col("host"))).alias("key")).distinct(), "universe")
    total, n = universe.count(), listed.filter("key is not null").distinct().count()
    parts = max(1, math.ceil(bits_for(n, hashes_for(n, total)) / 8 / most_bytes)) if n else 1
    part = F.pmod(F.xxhash64(F.lit("part"), "key"), F.lit(parts))
    found = F.array().cast("array<string>")
    for i in range(parts):
        here = lambda t: t.filter(part == i) if parts > 1 else t
        cascade = build_cascade(here(universe), here(listed))
        mine = lambda k: (F.pmod(F.xxhash64(F.lit("part"), k), F.lit(parts)) == i) & cascade.listed(k) if parts > 1 else cascade.listed(k)
        found = F.filter(host_keys(F.col("host")), mine) if parts == 1 else F.concat(F.col("found") if i else found, F.filter(host_keys(F.col("host")), mine))
        if parts > 1:
            urls = written(urls.withColumn("found", found), "judged")
    # The longest listed name of a host, however the list was cut.
    site = F.get(found, F.lit(0)) if parts == 1 else F.get(F.filter(host_keys(F.col("host")), lambda k: F.array_contains(F.col("found"), k)), F.lit(0))
    out = urls.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("listed_site", site)
    verdict = F.coalesce("r.verdict", F.when(F.col("listed_site").isNotNull(), "block").otherwise("allow"))
    return out.select(*keep, "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "listed_site")


def listed_sites(spark, sites=LISTED_SITES) -> DataFrame:
    return spark.createDataFrame([(s,) for s in sites], "key string")


def oracle(sites=LISTED_SITES, rules=RULES) -> str:
    fits = lambda rule: f"((host = '{rule[: rule.index('/')]}' OR ends_with(host, '.{rule[: rule.index('/')]}')) AND starts_with(path, '{rule[rule.index('/') :]}'))"
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{pick(r)}'" for r in ordered)
    hit = " OR ".join(f"host = '{s}' OR ends_with(host, '.{s}')" for s in sites)
    first = "CASE " + " ".join(f"WHEN host = '{s}' OR ends_with(host, '.{s}') THEN '{s}'" for s in sites) + " END"
    return rf"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, {case(lambda r: r[1])} END AS rule, {case(lambda r: r[0])} WHEN {hit} THEN 'block' ELSE 'allow' END AS verdict, {first} AS listed_site FROM u"""
