"""Writers of frames, metadata, timings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIMING_COLUMNS = ("block_index", "hashing_us", "cache_lookup_us", "feature_us", "codec_select_us", "compression_us", "packing_us", "total_us", "codec_used", "cache_hit", "compression_ratio", "within_budget")


def write_frames(frames: DataFrame, path: str) -> None:
    """Frames as a table dealt by volume; a job commits as a whole."""
    frames.write.mode("overwrite").partitionBy("volume_id").parquet(path)


def write_metadata(files: DataFrame, path: str) -> None:
    files.write.mode("overwrite").json(path)


def write_timings(timings: DataFrame, path: str) -> None:
    timings.select(*TIMING_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def block_lines(results: DataFrame, time_us=None) -> DataFrame:
    """The eight columns of the per-block report as text, in order of seq; null features and missing times are blank."""
    shown = lambda c, f: F.coalesce(F.when(c.isNotNull(), F.format_string(f, c)), F.lit(""))
    time = F.lit("") if time_us is None else shown(time_us, "%.2f")
    return results.select(
        F.col("seq").alias("block_index"), F.col("workload").alias("workload_type"), "codec_used", "compressed_size", F.col("cache_hit").cast("int").alias("cache_hit"),
        shown(F.col("entropy"), "%.4f").alias("entropy"), shown(F.col("rld"), "%.4f").alias("rld"), time.alias("block_time_us"),
    )


def write_blocks_csv(results: DataFrame, path: str, time_us=None) -> None:
    block_lines(results, time_us).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def sections(*named: tuple[str, DataFrame]) -> DataFrame:
    """Several tables as one text: (section, row, line), each with its title and header first."""
    out = None
    for k, (title, df) in enumerate(named):
        head = df.sparkSession.createDataFrame([(k, 0, title), (k, 1, ",".join(df.columns))], "section int, row int, line string")
        body = df.select(F.lit(k).alias("section"), F.lit(2).alias("row"), F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("line"))
        part = head.unionByName(body)
        out = part if out is None else out.unionByName(part)
    return out


def html_page(metrics: DataFrame) -> str:
    """A page that holds the metrics' one row as JSON."""
    import html

    value = metrics.select(F.to_json(F.struct(*metrics.columns))).first()[0]
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Block engine</title></head><body><h1>Block engine</h1><pre>{html.escape(value)}</pre></body></html>"
