"""Weighted fair queueing: virtual finish times give every source its target share of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import SPACE_WORD, spared, written

#: Ranges of the shuffle key within a source, and of the virtual finish time.
KEY_RANGES = 1024
TIME_RANGES = 4096


def source_targets(sizes: DataFrame, *, weights=(5, 2, 1), share=1.5, most=2) -> DataFrame:
    """(source, source_size) to (source, source_rank, source_size, target).

    Sources by code point, null last, take the weights in turn. A target above ``most`` times the
    source's size stops there and the rest is shared again by weight: with sources ordered by
    cap / weight, those whose cap lies under the running level are full. One row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("source_rank"), F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("source_rank", F.row_number().over(by_name) - 1).withColumn("w", w).withColumn("cap", F.col("source_size") * float(most))
    every = Window.partitionBy()
    fill = Window.orderBy((F.col("cap") / F.col("w")).asc(), "source_rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("budget", F.sum("source_size").over(every) * float(share))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("full", F.col("cap") / F.col("w") <= F.col("level")).withColumn("rank", F.row_number().over(fill))
    level = F.min(F.when(~F.col("full"), F.struct("rank", "level"))).over(every)["level"]
    return s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * level)).select("source", "source_rank", "source_size", "target")


def mix_sources(docs: DataFrame, *, weights=(5, 2, 1), share=1.5, most=2, seed=17, text_col="text", keep=("doc_id",)) -> DataFrame:
    """Words that a mix of sources takes from each document.

    Documents of a source are shuffled by an MD5 key and queued ``most`` times over; a copy's virtual
    finish time is the source's words up to and with it, divided by the source's target. Copies are
    taken in order of that time until the words reach the sum of the targets; the copy on the edge
    gives only its first words. Sums run over ranges of the key or of the time first, then within a
    range, so no source and no sort meets in one task.

    Null text has size 0; a null source is a source of its own; documents of no words take none;
    equal ids and repeated rows each count, ties going by id, then by a hash of the text, so rows that
    tie beyond that are equal and what they get is the same whichever comes first.
    Returns the ``keep`` columns of docs, size, source_size, target, taken and the row's number
    ``mix_row``; a kept column with one of these names gives way to it.
    """
    keep = spared(keep, "size x, source_size x, target x, taken x, mix_row x")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = docs.select(F.struct(*keep).alias("mix_doc"), F.col("source").alias("mix_source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size"), key.alias("mix_key"), F.col("doc_id").alias("mix_id"), F.xxhash64(text_col).alias("mix_hash"), F.monotonically_increasing_id().alias("mix_row"))
    sized = written(sized.withColumn("key_range", (F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") / F.lit(2**32 // KEY_RANGES)).cast("int")), "mix-sizes")

    cells = sized.groupBy("mix_source", "key_range").agg(F.sum("size").alias("cell_size"))
    targets = source_targets(cells.groupBy(F.col("mix_source").alias("source")).agg(F.sum("cell_size").alias("source_size")), weights=weights, share=share, most=most)
    up_to = Window.partitionBy("source_rank").orderBy("key_range").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.join(targets, cells["mix_source"].eqNullSafe(targets["source"])).withColumn("cell_start", F.coalesce(F.sum("cell_size").over(up_to), F.lit(0)))
    cells = cells.select("source", "key_range", "source_rank", "source_size", "target", "cell_start")

    in_cell = Window.partitionBy("source_rank", "key_range").orderBy("mix_key", "mix_id", "mix_hash", "mix_row").rowsBetween(Window.unboundedPreceding, 0)
    r = cells.withColumnRenamed("key_range", "cell_range")
    # What a document holds besides stays where it is until the end.
    whole_rows, sized = sized, sized.drop("mix_doc")
    queued = sized.join(r, sized["mix_source"].eqNullSafe(r["source"]) & (sized["key_range"] == r["cell_range"])).withColumn("upto", F.col("cell_start") + F.sum("size").over(in_cell))
    queued = queued.select("mix_row", "mix_id", "mix_hash", "mix_key", "source_rank", "size", "source_size", "target", "upto")
    copy = lambda e: F.when((F.col("size") > 0) & (F.col("target") > 0), (F.col("source_size") * e + F.col("upto")) / F.col("target"))
    for e in range(most):
        queued = queued.withColumn(f"time{e}", copy(e)).withColumn(f"range{e}", F.least((F.col(f"time{e}") * TIME_RANGES).cast("long"), F.lit(2 * TIME_RANGES)))
    queued = written(queued, "mix-queue")

    copies = queued.select("mix_row", "mix_id", "mix_hash", "mix_key", "source_rank", "size", F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), F.col(f"time{e}").alias("time"), F.col(f"range{e}").alias("range")) for e in range(most)])).alias("c")).select("mix_row", "mix_id", "mix_hash", "mix_key", "source_rank", "size", "c.*").filter("range is not null")
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    by_range = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    edge = copies.groupBy("range").agg(F.sum("size").alias("words")).withColumn("start", F.coalesce(F.sum("words").over(by_range), F.lit(0))).filter(F.col("start") + F.col("words") >= F.lit(budget)).agg(F.min(F.struct("range", "start")).alias("e")).select(F.coalesce("e.range", F.lit(4 * TIME_RANGES)).alias("edge"), "e.start")
    # One row: the range in which the budget ends.
    edge = edge.first()
    order = Window.orderBy("time", "source_rank", "epoch", "mix_key", "mix_id", "mix_hash", "mix_row").rowsBetween(Window.unboundedPreceding, 0)
    at_edge = copies.filter(F.col("range") == edge["edge"]).withColumn("left", F.lit(int(budget) - int(edge["start"] or 0)) - F.sum("size").over(order) + F.col("size"))
    at_edge = at_edge.groupBy("mix_row").agg(F.sum(F.greatest(F.least("left", "size"), F.lit(0))).alias("edge_taken"))
    whole = sum(F.when(F.col(f"range{e}") < edge["edge"], F.col("size")).otherwise(0) for e in range(most))
    taken = queued.join(at_edge, "mix_row", "left").select("mix_row", "size", "source_size", "target", (whole + F.coalesce("edge_taken", F.lit(0))).cast("long").alias("taken"))
    return whole_rows.select("mix_doc", "mix_row").join(taken, "mix_row").select("mix_doc.*", "size", "source_size", "target", "taken", "mix_row")


def oracle(weights=(5, 2, 1), share=1.5, most=2, seed=17) -> str:
    w = " ".join(f"WHEN {i} THEN {x}.0" for i, x in enumerate(weights))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank FROM s0),
s2 AS (SELECT *, CASE source_rank % {len(weights)} {w} END::DOUBLE AS w, source_size * {float(most)}::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, sum(source_size) OVER () * {float(share)}::DOUBLE AS budget, row_number() OVER (ORDER BY cap / w, source_rank) AS rk,
              coalesce(sum(cap) OVER (ORDER BY cap / w, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS caps,
              coalesce(sum(w) OVER (ORDER BY cap / w, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS ws, sum(w) OVER () AS wt FROM s2),
s4 AS (SELECT *, (budget - caps) / (wt - ws) AS level FROM s3),
lv AS (SELECT arg_min(level, rk) AS level FROM s4 WHERE NOT cap / w <= level),
s AS (SELECT source, source_rank, source_size, CASE WHEN cap / w <= s4.level THEN cap ELSE w * lv.level END AS target FROM s4 LEFT JOIN lv ON true),
q AS (SELECT rid, doc_id, k, size, source_rank, source_size, target,
             sum(size) OVER (PARTITION BY source_rank ORDER BY k, doc_id, rid ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
c AS (SELECT *, e, (source_size * e + upto) / target AS t FROM q, range({most}) r(e) WHERE size > 0 AND target > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY t, source_rank, e, k, doc_id, rid ROWS UNBOUNDED PRECEDING) AS total FROM c),
b AS (SELECT floor(sum(target)) AS budget FROM s),
taken AS (SELECT rid, sum(greatest(least(size, budget - (total - size)), 0))::BIGINT AS taken FROM o, b GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN taken USING (rid)"""
