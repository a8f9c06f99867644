"""The row after each row in a global order, without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import shuffle_partitions, written


def with_next(ids: DataFrame, *order: str) -> DataFrame:
    """ids with next_<c> of every column c, from the row that follows by the ``order`` columns, nulls first; after the last comes the first.

    Rows go to ranges of the order as a whole, so neither a range nor equal values of its first
    columns meet in one task; only each range's first row is looked at across ranges. The columns
    together must be distinct. A single row follows itself.
    """
    row, kept = F.struct(*ids.columns), ids.columns
    by = [F.col(c).asc_nulls_first() for c in order]
    ranged = written(ids.repartitionByRange(shuffle_partitions(ids.sparkSession), *by).withColumn("cell", F.spark_partition_id()), "ranges")
    heads = ranged.groupBy("cell").agg(F.min(F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order], row.alias("row"))).alias("m")).select("cell", F.col("m.row").alias("head"))
    # One row a range.
    over = Window.orderBy("cell")
    heads = heads.select("cell", F.coalesce(F.lead("head").over(over), F.first("head").over(over)).alias("after"))
    nxt = ranged.withColumn("follows", F.lead(row).over(Window.partitionBy("cell").orderBy(*by))).join(heads, "cell")
    nxt = nxt.withColumn("follows", F.coalesce("follows", "after"))
    return nxt.select(*kept, *[F.col(f"follows.{c}").alias(f"next_{c}") for c in kept])
