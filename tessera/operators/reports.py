"""Aggregates and reports over results, timings and benchmark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.constants import BLOCK, CODECS, ENGINE_CACHE, RAW, SKIP, SLOW_US, STAGE_BUDGET, STAGES, TOTAL_BUDGET


def share(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """part / whole, 0 where whole is 0 or null."""
    return F.when(whole > 0, part / whole * scale).otherwise(0.0)


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def engine_stats(results: DataFrame, capacity: int = ENGINE_CACHE) -> DataFrame:
    """One row. Zero blocks are neither hits nor misses; they count as 4096 physical bytes and ratio 0. A volume's cache holds ``capacity`` entries."""
    zero, hit = F.col("zero_block"), F.col("cache_hit")
    miss = ~hit & ~zero
    per = results.groupBy("volume_id").agg(
        F.count("*").alias("total_blocks_processed"), _n(hit & ~zero).alias("total_cache_hits"), _n(miss).alias("total_cache_misses"), _n(F.col("codec_used") == RAW).alias("total_raw_blocks"),
        _n(~F.col("codec_used").isin(RAW, SKIP)).alias("total_compressed_blocks"), _n(zero).alias("total_skip_blocks"), F.sum(F.when(miss, F.col("entropy"))).alias("_entropy"),
        F.sum(F.when(miss, F.col("uniqueness"))).alias("_uniqueness"), F.sum(F.when(zero, 0.0).otherwise(F.col("ratio"))).alias("_ratio"), F.sum(F.when(zero, BLOCK).otherwise(F.col("compressed_size"))).alias("physical_bytes_written"),
        _n(F.col("force_raw") | F.col("skip_benefit")).alias("adaptive_overrides"), _n(F.col("force_raw")).alias("adaptive_skip_compress"), _n(F.col("skip_benefit")).alias("adaptive_force_compress"),
        _n(F.col("raw_avoided")).alias("raw_avoided_by_uniqueness"), F.least(F.countDistinct(F.when(~zero, F.col("key"))), F.lit(capacity)).alias("cache_entries_used"),
    )
    counts = [c for c in per.columns if c[0] != "_" and c != "volume_id"]
    out = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts], *[F.sum(c).alias(c) for c in ("_entropy", "_uniqueness", "_ratio")])
    n, logical = F.col("total_blocks_processed"), F.col("total_blocks_processed") * BLOCK
    misses = F.col("total_cache_misses")
    return out.select(
        *[c for c in counts if c != "cache_entries_used"], share(F.col("_entropy"), misses).alias("average_entropy"), share(F.col("_uniqueness"), misses).alias("average_uniqueness"),
        share(F.col("total_cache_hits"), F.col("total_cache_hits") + misses).alias("cache_hit_rate"),
        share(F.col("_ratio"), n).alias("average_compression_ratio"), logical.alias("logical_bytes_written"), share(F.col("physical_bytes_written"), logical).alias("waf"),
        space_saving(F.col("physical_bytes_written"), logical).alias("space_saving_pct"), "cache_entries_used",
    )


def space_saving(physical: Column, logical: Column) -> Column:
    return share(logical - physical, logical, 100.0)


def row_saving(ratio: Column) -> Column:
    return F.bround((1 - ratio) * 100, 2)


def analyzer_stats(features: DataFrame) -> DataFrame:
    """Averages and shares of flagged blocks."""
    flag = lambda c: F.bround(share(_n(c), F.count("*"), 100.0), 2)
    return features.agg(
        F.count("*").alias("blocks_analyzed"), F.bround(F.avg("entropy"), 4).alias("avg_entropy"), F.bround(F.avg("run_length_density"), 4).alias("avg_rld"), F.bround(F.avg("uniqueness"), 4).alias("avg_uniqueness"),
        flag(F.col("zero_density") > 0.9999).alias("zero_block_pct"), flag(F.col("entropy") > 7.5).alias("high_entropy_pct"), flag(F.col("run_length_density") > 0.4).alias("high_rld_pct"),
    )


def codec_distribution(results: DataFrame, codec: str = "codec_used") -> DataFrame:
    """All four codecs with counts and per cent, 0 for those not used."""
    n = results.groupBy(F.col(codec).alias("codec")).agg(F.count("*").alias("blocks"))
    names = results.sparkSession.createDataFrame([(c,) for c in CODECS], "codec string")
    out = names.join(n, "codec", "left").withColumn("blocks", F.coalesce("blocks", F.lit(0)))
    return out.withColumn("pct", F.bround(share(F.col("blocks"), F.sum("blocks").over(Window.partitionBy()), 100.0), 2))


def codec_stats(results: DataFrame, latency: Column | None = None) -> DataFrame:
    """Per codec and, as codec null, in all: blocks, average ratio, blocks stored raw against their choice, bytes, and the average time if there is one."""
    fallback = _n((F.col("codec_selected") != F.col("codec_used")) & (F.col("codec_used") == RAW))
    return results.rollup(F.col("codec_used").alias("codec")).agg(F.count("*").alias("blocks"), F.bround(F.avg("ratio"), 4).alias("avg_ratio"), fallback.alias("fallbacks"), F.sum("compressed_size").alias("bytes"), *([] if latency is None else [F.bround(F.avg(latency), 3).alias("avg_us")]))


def cache_stats(hits: DataFrame, capacity: int, entry_bytes: int = 16) -> DataFrame:
    """One row over all volumes, each with a cache of ``capacity`` entries: what is not held any more was evicted."""
    per = hits.groupBy("volume_id").agg(_n(F.col("cache_hit")).alias("hits"), _n(~F.col("cache_hit")).alias("misses"), F.least(F.countDistinct("key"), F.lit(capacity)).alias("entries"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = per.agg(total("hits").alias("hits"), total("misses").alias("misses"), total("entries").alias("entries"), (F.count("*") * capacity).alias("capacity"))
    lookups = F.col("hits") + F.col("misses")
    return out.select("*", lookups.alias("lookups"), F.col("misses").alias("inserts"), (F.col("misses") - F.col("entries")).alias("evictions"), F.bround(share(F.col("hits"), lookups), 4).alias("hit_rate"), F.bround(share(F.col("entries"), F.col("capacity"), 100.0), 2).alias("utilisation_pct"), (F.col("entries") * entry_bytes).alias("memory_bytes"))


def top_entries(accesses: DataFrame, n: int, key: str = "key") -> DataFrame:
    """The n keys with most hits; the one used longest ago first among equals."""
    g = accesses.groupBy("volume_id", key).agg((F.count("*") - 1).alias("hit_count"), F.max("seq").alias("last_seq"))
    return g.orderBy(F.desc("hit_count"), "last_seq", "volume_id", key).limit(n)


def packer_stats(frames: DataFrame) -> DataFrame:
    return frames.agg(F.count("*").alias("frames"), _n(F.col("is_zero")).alias("zero_blocks"), _n(~F.col("crc_valid")).alias("crc_errors"), F.sum("compressed_size").alias("payload_bytes"))


def stage_stats(timings: DataFrame) -> DataFrame:
    """Per stage: count, average, extremes, population deviation and share of its budget; zeros for stages without rows."""
    stages = timings.sparkSession.createDataFrame([(s, float(STAGE_BUDGET[s])) for s in STAGES], "stage string, budget_us double")
    return with_budgets(timings, stages)


def with_budgets(timings: DataFrame, stages: DataFrame) -> DataFrame:
    g = timings.groupBy("stage").agg(F.count("us").alias("count"), F.avg("us").alias("_avg"), F.min("us").alias("min_us"), F.max("us").alias("max_us"), F.stddev_pop("us").alias("std_us"))
    r3 = lambda c: F.bround(F.coalesce(c, F.lit(0.0)), 3).alias(c if c[0] != "_" else "avg_us")
    return stages.join(g, "stage", "left").select("stage", F.coalesce("count", F.lit(0)).alias("count"), r3("_avg"), r3("min_us"), r3("max_us"), r3("std_us"), "budget_us", F.bround(share(F.coalesce("_avg", F.lit(0.0)), F.col("budget_us"), 100.0), 1).alias("budget_pct"))


def budget_report(blocks: DataFrame, per_stage: DataFrame) -> DataFrame:
    """Blocks over budget, and the sum of the stages' rounded averages."""
    over = blocks.agg(F.count("*").alias("total_blocks"), _n(F.col("total_us") > TOTAL_BUDGET).alias("budget_exceeded"))
    total = per_stage.agg(F.bround(F.sum("avg_us"), 3).alias("avg_total_us"))
    both = over.join(total, how="inner", on=F.lit(True))
    return both.select("*", F.bround(share(F.col("budget_exceeded"), F.col("total_blocks"), 100.0), 2).alias("budget_exceed_pct"), F.bround(F.col("avg_total_us") / TOTAL_BUDGET * 100, 1).alias("overall_budget_pct"))


def slow_blocks(timings: DataFrame, limit: float = SLOW_US) -> DataFrame:
    return timings.filter(F.col("total_us") > limit)


def last_rows(timings: DataFrame, n: int) -> DataFrame:
    return timings.orderBy(F.desc("seq")).limit(n)


def index_percentiles(values: DataFrame, by: list[str], value: str, marks=(0.95, 0.99)) -> DataFrame:
    """Average and, for each mark q, the value at place int(q * n) of the sorted group (from 0)."""
    w = Window.partitionBy(*by)
    r = values.withColumns({"_r": F.row_number().over(w.orderBy(value)) - 1, "_n": F.count(F.lit(1)).over(w)})
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("avg"), *[F.max(F.when(F.col("_r") == F.floor(F.lit(q) * F.col("_n")), F.col(value))).alias(f"p{round(q * 100)}") for q in marks])


def median_mean(values: DataFrame, by: list[str], value: str) -> DataFrame:
    return values.groupBy(*by).agg(F.percentile(value, 0.5).alias("median"), F.avg(value).alias("mean"))


def workload_breakdown(results: DataFrame, latency: Column | None = None) -> DataFrame:
    """Per workload: blocks, average ratio, hit rate, saving, and share of all blocks."""
    g = results.groupBy("workload").agg(F.count("*").alias("block_count"), F.avg("ratio").alias("_r"), F.bround(F.avg(F.col("cache_hit").cast("int")), 4).alias("cache_hit_rate"), *([] if latency is None else [F.bround(F.avg(latency), 2).alias("avg_latency_us")]))
    return g.select(*[c for c in g.columns if c != "_r"], F.bround("_r", 4).alias("avg_ratio"), F.bround((1 - F.col("_r")) * 100, 2).alias("space_saving_pct"), F.bround(F.col("block_count") / F.sum("block_count").over(Window.partitionBy()) * 100, 2).alias("pct"))


def throughput(blocks: Column, seconds: Column) -> dict[str, Column]:
    """In 1e6 and in 2^20 bytes a second."""
    s = F.greatest(seconds, F.lit(1e-9))
    return {"mb_s": blocks * BLOCK / 1e6 / s, "mib_s": blocks * BLOCK / 1048576 / s}


def compare_policies(sizes: DataFrame, by: str = "workload") -> DataFrame:
    """Adaptive against static LZ4 per group, and in all as a null group. sizes has adaptive and static: stored bytes of each block."""
    g = sizes.rollup(by).agg(F.count("*").alias("blocks"), F.sum("adaptive").alias("adaptive_bytes"), F.sum("static").alias("static_bytes"))
    ratio = lambda c: F.bround(share(F.col(c), F.col("blocks") * BLOCK), 4)
    return g.select("*", ratio("adaptive_bytes").alias("adaptive_ratio"), ratio("static_bytes").alias("static_ratio"), (F.col("static_bytes") - F.col("adaptive_bytes")).alias("saved_bytes"))


def per_file(results: DataFrame) -> DataFrame:
    """Per path: adaptive and static ratios, their difference and the share of raw blocks. Needs adaptive and static sizes and codec_used."""
    n = F.greatest(F.count("*"), F.lit(1)) * BLOCK
    g = results.groupBy("path").agg(F.count("*").alias("blocks"), (F.sum("adaptive") / n).alias("cs_ratio"), (F.sum("static") / n).alias("lz4_ratio"), F.bround(F.avg((F.col("codec_used") == RAW).cast("int")) * 100, 1).alias("raw_pct"))
    return g.withColumn("delta", F.col("lz4_ratio") - F.col("cs_ratio"))


def file_summary(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.avg("cs_ratio").alias("avg_cs_ratio"), F.avg("lz4_ratio").alias("avg_lz4_ratio"), _n(F.col("cs_ratio") <= F.col("lz4_ratio")).alias("wins"))


def matrix_pivot(matrix: DataFrame, metric: str, pipelines: list[str], order: str = "_at") -> DataFrame:
    """Sizes by pipelines; the last row of a pair wins and a missing pair is a dash."""
    g = matrix.groupBy("size").pivot("pipeline", pipelines).agg(F.max_by(F.col(metric).cast("string"), order))
    return g.select("size", *[F.coalesce(F.col(f"`{p}`"), F.lit("—")).alias(p) for p in pipelines])


def lookup(matrix: DataFrame, size: str, pipeline: str, metric: str, default: float = 0.0) -> DataFrame:
    """The first row's value, or the default where it is null or there is none."""
    return matrix.filter((F.col("size") == size) & (F.col("pipeline") == pipeline)).agg(F.coalesce(F.first(metric), F.lit(default)).alias(metric))


def chart_series(matrix: DataFrame, sizes: list[str], pipelines: list[str], metric: str, floor: float | None = None) -> DataFrame:
    """Every size and pipeline with a value, missing ones 0, raised to the floor."""
    spark = matrix.sparkSession
    grid = spark.createDataFrame([(s, p, i, j) for i, s in enumerate(sizes) for j, p in enumerate(pipelines)], "size string, pipeline string, size_at int, pipeline_at int")
    v = F.coalesce(F.first(F.col(metric)), F.lit(0.0))
    g = grid.join(matrix, ["size", "pipeline"], "left").groupBy("size", "pipeline", "size_at", "pipeline_at").agg(v.alias(metric))
    return g if floor is None else g.withColumn(metric, F.greatest(metric, F.lit(floor)))


def saved_megabytes(physical_mb: Column, written_mb: float = 10240.0) -> dict[str, Column]:
    return {"saved_mb": F.lit(written_mb) - physical_mb, "saved_pct": (F.lit(written_mb) - physical_mb) / written_mb * 100}


def warmup_curve(spark, points: int, top: float, rate: float) -> DataFrame:
    return spark.range(points).select("id", (F.lit(top) * (1 - F.exp(-F.lit(rate) * F.col("id")))).alias("hit_rate"))


def cpu_budget(shares: DataFrame, blocks_per_second: float = 25_000.0) -> DataFrame:
    """(operation, us, share): part of a core that each takes."""
    return shares.withColumn("cpu_pct", F.col("us") * blocks_per_second * F.col("share") / 1e6 * 100)


def warmup_samples(hits: DataFrame, capacity: int, every: int = 100) -> DataFrame:
    """Hit rate and cached entries after each ``every`` blocks of a volume: the different keys so far, at most ``capacity``."""
    by = Window.partitionBy("volume_id").orderBy("seq")
    w = by.rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy("volume_id", "key").orderBy("seq")) == 1
    r = hits.withColumn("_first", first).withColumns({"blocks": F.row_number().over(by), "hit_rate": F.avg(F.col("cache_hit").cast("int")).over(w), "entries": F.least(F.sum(F.col("_first").cast("int")).over(w), F.lit(capacity))})
    return r.filter(F.col("blocks") % every == 0).select("volume_id", "blocks", "hit_rate", "entries")


def dashboard(stats: DataFrame, per_stage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Key figures, and the stages' averages as bars against the longest."""
    figures = stats.withColumns({"saving": 1 - F.col("average_compression_ratio")})
    bars = per_stage.withColumn("bar", share(F.col("avg_us"), F.max("avg_us").over(Window.partitionBy()), 100.0))
    return figures, bars


def hit_rate(hits: DataFrame) -> DataFrame:
    """One row: hits, misses and their rate, 0 for no lookups."""
    n = hits.agg(_n(F.col("cache_hit")).alias("hits"), _n(~F.col("cache_hit")).alias("misses"))
    return n.select("*", share(F.col("hits"), F.col("hits") + F.col("misses")).alias("hit_rate"))


def block_shares(results: DataFrame) -> DataFrame:
    """One row: per cent of blocks stored raw, compressed and skipped."""
    pct = lambda c: share(_n(c), F.count("*"), 100.0)
    codec = F.col("codec_used")
    return results.agg(pct(codec == RAW).alias("raw_pct"), pct(~codec.isin(RAW, SKIP)).alias("compressed_pct"), pct(codec == SKIP).alias("skip_pct"))


def benchmark(results: DataFrame, latency: Column, seconds: float) -> DataFrame:
    """A run's key figures in one row: blocks, throughput over ``seconds``, ratio and saving of what was written, hit rate, and mean, p95 and p99 of the microseconds in ``latency``, as milliseconds."""
    r = results.select(F.lit(1).alias("_run"), latency.alias("_us"), "cache_hit", F.coalesce("ratio", F.lit(0.0)).alias("_ratio"))
    marks = index_percentiles(r, ["_run"], "_us")
    one = r.groupBy("_run").agg(F.avg("_ratio").alias("_r"), F.avg(F.col("cache_hit").cast("int")).alias("_h"))
    ms = lambda c: F.bround(F.col(c) / 1000, 4)
    return marks.join(one, "_run").select(
        F.col("n").alias("total_blocks"), F.bround(throughput(F.col("n"), F.lit(seconds))["mb_s"], 3).alias("throughput_mb_s"), F.bround("_r", 4).alias("compression_ratio"), F.bround((1 - F.col("_r")) * 100, 2).alias("space_saving_pct"),
        F.bround("_h", 4).alias("cache_hit_rate"), ms("avg").alias("avg_latency_ms"), ms("p95").alias("p95_latency_ms"), ms("p99").alias("p99_latency_ms"),
    )


def lines_of(title: str, rows: DataFrame, order: str) -> DataFrame:
    """(line_no, line): a title, a header and a line a row in the given order; numbers with two digits stand right."""
    kinds = dict(rows.dtypes)
    cell = lambda c: F.format_string("%-20s", F.coalesce(F.col(c), F.lit("-"))) if kinds[c] == "string" else F.format_string("%14.2f", F.col(c).cast("double"))
    head = "".join(f"{c:<20}" if kinds[c] == "string" else f"{c[:14]:>14}" for c in rows.columns)
    top = rows.sparkSession.createDataFrame([(0, title), (1, head)], "line_no int, line string")
    numbered = rows.withColumn("_no", F.row_number().over(Window.partitionBy().orderBy(order)) + 1)
    return top.unionByName(numbered.select(F.col("_no").alias("line_no"), F.concat(*map(cell, rows.columns)).alias("line")))


def text_report(stats: DataFrame) -> DataFrame:
    """One row a line of the engine's report."""
    names = [(c, "%.4f" if dict(stats.dtypes)[c] == "double" else "%d") for c in stats.columns]
    lines = F.array(*[F.format_string(f"%-32s {f}", F.lit(c), F.col(c)) for c, f in names])
    return stats.select(F.posexplode(lines).alias("line_no", "line"))


def metrics(stats: DataFrame, codecs: DataFrame, cache: DataFrame) -> DataFrame:
    """One nested row of all parts, ready for to_json."""
    nested = lambda df, name: df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
    one = F.lit(True)
    return stats.select(F.struct(*stats.columns).alias("engine")).join(nested(codecs, "codecs"), one).join(cache.select(F.struct(*cache.columns).alias("cache")), one)
