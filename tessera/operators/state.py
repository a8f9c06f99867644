"""Caches, learned ratios and throttling as window queries over (volume_id, seq)."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.constants import ENGINE_CACHE, PIPELINE_CACHE, TIMINGS_KEPT, Adaptivity, Throttle


def _ordered(*keys: str):
    return Window.partitionBy(*keys).orderBy("seq")


#: Numbers of one cell: 2^34, which hold 1,024 sources. Cells of a volume run at the same time.
CELL_BITS = 34


def _simulated(codes: np.ndarray, start: int, capacity: int) -> np.ndarray:
    """Hits of a least-recently-used cache over whole numbers; the first ``start`` of them fill it and are not reported."""
    if pd.unique(codes).size <= capacity:
        return pd.Series(codes).duplicated().to_numpy()[start:]
    cache, hit = OrderedDict(), np.zeros(len(codes), bool)
    for i, k in enumerate(codes.tolist()):
        if k in cache:
            hit[i] = True
            cache.move_to_end(k)
        else:
            cache[k] = None
            if len(cache) > capacity:
                cache.popitem(last=False)
    return hit[start:]


def lru_hits(accesses: DataFrame, capacity: int | None = ENGINE_CACHE, key: str = "key", cell_bits: int = CELL_BITS) -> DataFrame:
    """Adds cache_hit: is the key still among the ``capacity`` last used ones of its volume? Without a capacity nothing leaves, so every use but a key's first is a hit.

    A volume is cut into cells of seq. What the cache holds at the start of a cell follows from the
    last uses of at most ``capacity`` keys in each cell before, so these are merged first, and then
    all cells run at the same time, each in order. Null keys are one key.
    """
    if capacity is None:
        return accesses.withColumn("cache_hit", F.row_number().over(_ordered("volume_id", key)) > 1)
    cell = F.shiftright("seq", cell_bits)
    a = accesses.withColumn("_cell", cell)
    last = accesses.select("volume_id", cell.alias("_cell"), F.col(key).alias("_key"), "seq").groupBy("volume_id", "_cell", "_key").agg(F.max("seq").alias("_last"))
    newest = Window.partitionBy("volume_id", "_cell").orderBy(F.desc("_last"))
    last = last.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= capacity).drop("_r")

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each cell but the first, the keys that the cache holds, the one used longest ago first."""
        parts, held = [], None
        for c, g in pdf.sort_values(["_cell", "_last"], kind="stable").groupby("_cell"):
            if held is not None:
                parts.append(held.assign(_cell=c))
                g = pd.concat([held, g])
            held = g.drop_duplicates("_key", keep="last").tail(capacity)
        return pd.concat(parts) if parts else pdf.iloc[:0]

    starts = last.groupBy("volume_id").applyInPandas(begin, last.schema)

    def run(start: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        both = pd.concat([start.sort_values("_last")["_key"], pdf[key]], ignore_index=True)
        codes = pd.factorize(both.map(lambda x: bytes(x) if isinstance(x, (bytes, bytearray)) else x), use_na_sentinel=False)[0]
        return pdf.drop(columns="_cell").assign(cache_hit=_simulated(codes, len(start), capacity))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in accesses.schema.fields) + ", cache_hit boolean"
    return starts.groupBy("volume_id", "_cell").cogroup(a.groupBy("volume_id", "_cell")).applyInPandas(lambda s, d: run(s, d) if len(d) else d.drop(columns="_cell").assign(cache_hit=pd.Series(dtype=bool)), schema)


def pipeline_hits(accesses: DataFrame, key: str = "key") -> DataFrame:
    return lru_hits(accesses, PIPELINE_CACHE, key)


def generations(hits: DataFrame, key: str = "key") -> DataFrame:
    """Adds generation (the entry's number for its key: misses so far) and use (the access's number in it)."""
    g = hits.withColumn("generation", F.sum(F.when(F.col("cache_hit"), 0).otherwise(1)).over(_ordered("volume_id", key)))
    return g.withColumn("use", F.row_number().over(_ordered("volume_id", key, "generation")))


def learned(g: DataFrame, ratio: Column, raw: Column, a: Adaptivity = Adaptivity()) -> DataFrame:
    """Adds avg_before, force_raw, skip_benefit and confidence_before of an entry's n-th use.

    Every use mixes the same ratio r into the average, which starts at 1 and so only falls: after
    n - 1 uses it is r + (1 - r) * 0.75^(n - 1). An entry is trusted from its third use on; forced raw
    then, it learns no more and stays forced, so the third use decides.
    """
    r, n = F.when(raw, 1.0).otherwise(ratio), F.col("use")
    keep = 1 - a.alpha
    before = r + (F.lit(a.start) - r) * F.pow(F.lit(keep), n - 1)
    force = (n >= a.trusted) & (r + (F.lit(a.start) - r) * keep ** (a.trusted - 1) > a.high)
    return g.withColumns({"avg_before": before, "force_raw": force, "skip_benefit": (n >= a.trusted) & ~force & (before < a.low), "confidence_before": F.when(force, a.trusted).otherwise(F.least(n, F.lit(255)))})


#: Rows, counted from a volume's start, that are summed on their own; means this close to a limit (as a part of it) may fall on either side by rounding.
SUMMED = 16
CLOSE = 1e-9


def _summed(last: Column, at: Column) -> Column:
    """The sum of the last rows' entropies, the newest being the volume's row number ``at``, as DuckDB's windows add doubles: whole sixteens on their own, the rows before and after them one by one."""
    first = at - F.size(last) + 1

    def step(s: Column, x: Column) -> Column:
        v, begin = F.coalesce(x["entropy"], F.lit(0.0)), s["p"] - F.pmod(s["p"], F.lit(SUMMED))
        whole, ends = (begin >= first) & (begin + SUMMED - 1 <= at), s["p"] - begin == SUMMED - 1
        part = s["part"] + v
        total = F.when(~whole, s["total"] + v).when(ends, s["total"] + part).otherwise(s["total"])
        return F.struct(total.alias("total"), F.when(whole & ~ends, part).otherwise(F.lit(0.0)).alias("part"), (s["p"] + 1).alias("p"))

    return F.aggregate(last, F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("part"), first.alias("p")), step)["total"]


def throttle(misses: DataFrame, t: Throttle = Throttle(), *by: str) -> DataFrame:
    """Adds throttled to rows of misses: mean entropy of the last ones, this one included. ``by`` keeps other rows apart.

    Where the mean is so close to the limit that the order of adding decides, it is added up again in
    the order that the SQL's engine has (for windows below 256 rows).
    """
    o = _ordered("volume_id", *by)
    w = o.rowsBetween(-(t.window - 1), 0)
    m = misses.withColumns({"_n": F.count("entropy").over(w), "_mean": F.avg("entropy").over(w), "_last": F.collect_list(F.struct(F.col("entropy").cast("double").alias("entropy"))).over(w), "_at": F.row_number().over(o) - 1})
    close = F.abs(F.col("_mean") - t.limit) <= CLOSE * abs(t.limit)
    mean = F.when(close, _summed(F.col("_last"), F.col("_at")) / F.col("_n")).otherwise(F.col("_mean"))
    return m.withColumn("throttled", (F.col("_n") >= t.least) & (mean > t.limit)).drop("_n", "_mean", "_last", "_at")


def running_waf(rows: DataFrame, physical: Column, logical: Column) -> Column:
    """Physical over logical bytes up to each row."""
    w = _ordered("volume_id").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(physical).over(w) / F.sum(logical).over(w)


def running_averages(features: DataFrame) -> DataFrame:
    """Adds block_index and the averages so far of entropy, run-length density and uniqueness."""
    w = _ordered("volume_id").rowsBetween(Window.unboundedPreceding, 0)
    return features.withColumns({
        "block_index": F.row_number().over(_ordered("volume_id")), "avg_entropy": F.bround(F.avg("entropy").over(w), 4),
        "avg_rld": F.bround(F.avg("run_length_density").over(w), 4), "avg_uniqueness": F.bround(F.avg("uniqueness").over(w), 4),
    })


def direct_mapped(accesses: DataFrame, signature: Column, prefix: Column, slots: int = PIPELINE_CACHE) -> DataFrame:
    """Adds slot and cache_hit of a cache in which the last writer of a slot stays: the access before in the slot had the same signature and prefix."""
    a = accesses.withColumns({"_sig": signature, "_prefix": prefix})
    a = a.withColumn("slot", F.pmod(F.conv(F.substring("_sig", 9, 8), 16, 10).cast("long"), F.lit(slots)))
    w = _ordered("volume_id", "slot")
    return a.withColumn("cache_hit", F.coalesce((F.lag("_sig").over(w) == F.col("_sig")) & (F.lag("_prefix").over(w) == F.col("_prefix")), F.lit(False))).drop("_sig", "_prefix")


def integer_average(ratios: Column) -> Column:
    """Thousandths learned from an ordered array of ratios: the first as it is, then (7 * old + new) >> 3. Null for none."""
    thousandth = lambda r: F.floor(r * 1000).cast("int")
    return F.aggregate(ratios, F.lit(None).cast("int"), lambda old, r: F.when(old.isNull(), thousandth(r)).otherwise(F.shiftright(old * 7 + thousandth(r), 3)))


def entry_ratios(accesses: DataFrame, key: str = "key") -> DataFrame:
    """Per volume and key: hit_count, avg_ratio in thousandths and last_seq."""
    rows = F.sort_array(F.collect_list(F.struct("seq", "ratio")))
    g = accesses.groupBy("volume_id", key).agg(rows.alias("r"), F.max("seq").alias("last_seq"))
    return g.select("volume_id", key, (F.size("r") - 1).alias("hit_count"), integer_average(F.col("r.ratio")).alias("avg_ratio"), "last_seq")


def invalidated(accesses: DataFrame, drops: DataFrame, key: str = "key") -> DataFrame:
    """Accesses with their cache epoch: a drop of (volume_id, seq, key) ends its key's entry, one with a null key the whole volume's."""
    events = accesses.withColumn("_drop", F.lit(0)).unionByName(drops.withColumn("_drop", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("volume_id").orderBy("seq", F.desc("_drop")).rowsBetween(Window.unboundedPreceding, 0)
    flushed = events.withColumn("_f", F.sum(F.when((F.col("_drop") == 1) & F.col(key).isNull(), 1).otherwise(0)).over(w))
    k = Window.partitionBy("volume_id", key).orderBy("seq", F.desc("_drop")).rowsBetween(Window.unboundedPreceding, 0)
    return flushed.withColumn("epoch", F.col("_f") + F.sum(F.when((F.col("_drop") == 1) & F.col(key).isNotNull(), 1).otherwise(0)).over(k)).filter("_drop = 0").drop("_drop", "_f")


def ring_buffer(timings: DataFrame, keep: int = TIMINGS_KEPT) -> DataFrame:
    """The last rows of each volume."""
    return timings.withColumn("_r", F.row_number().over(Window.partitionBy("volume_id").orderBy(F.desc("seq")))).filter(F.col("_r") <= keep).drop("_r")
