"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (v, comp): comp is the least vertex of v's component. Vertices without edges are absent.

    Each round takes minima of neighbours by aggregation and joins them back, so a vertex with very
    many neighbours is never collected; rounds grow with the logarithm of the vertices.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("n")).distinct(), "edges")
    size = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("n").alias("u"), F.col("u").alias("n")))
        low = both.groupBy("u").agg(F.least(F.min("n"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("n > u and n <> m").select(F.col("n").alias("u"), F.col("m").alias("n")).distinct()
        low = large.groupBy("u").agg(F.min("n").alias("m"))
        down = large.join(low, "u")
        small = down.filter("n <> m").select(F.col("n").alias("u"), F.col("m").alias("n")).union(low.select("u", F.col("m").alias("n"))).distinct()
        edges = written(small, "stars")
        now = _state(edges)
        if now == size:
            break
        size = now
    comp = edges.groupBy(F.col("u").alias("v")).agg(F.min("n").alias("comp"))
    return comp.union(edges.select(F.col("n").alias("v"), F.col("n").alias("comp"))).groupBy("v").agg(F.min("comp").alias("comp"))


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "n"))).first()
