"""Documents to a clean, mixed training set: five stages, each a table that the next one reads.

All but the last return the columns of documents. SQL can express neither the fitted classifier nor
the disclosure estimates, so there is no ORACLE_SQL; tests hold each stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, pii, quality, set_join
from tessera.llm.common import table, written

ORACLE_SQL = None


def _held(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with names of the stage's own for all columns, so that none clashes with what an operator adds or needs; doc_id, text and source go along under those names."""
    names = [f"held_{i}" for i in range(len(docs.columns))]
    own = {c: F.col(h) for c, h in zip(docs.columns, names)}
    return docs.toDF(*names).withColumns({c: own[c] for c in ("doc_id", "text", "source") if c in own}), names


def _freed(held: DataFrame, docs: DataFrame, text=None) -> DataFrame:
    """docs' columns from their own names, with a new text and an n_chars to go with it."""
    out = []
    for i, (name, kind) in enumerate(docs.dtypes):
        c = F.col(f"held_{i}")
        if text is not None and name in ("text", "n_chars"):
            c = text if name == "text" else F.length(text).cast(kind)
        out.append(c.alias(name))
    return held.select(*out)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade is at least a half.

    Null and empty texts are judged as texts without words; equal texts alike, so repeated rows stay
    or go together; an empty table stays empty, and without labels all texts are judged by the prior.
    """
    held, names = _held(docs)
    model = quality.train(held, table(spark, sf_dir, "labels"))
    return _freed(quality.score(held, model, keep=tuple(names)).filter("accepted"), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8: the one with the least doc_id.

    Of ties (rows of one doc_id) the one with the least hash of id and text stays, and one of equal
    rows. Null ids come after all others. Texts without words, nulls too, all stay.
    """
    held, _ = _held(docs)
    links = set_join.link_documents(held, set_join.Rule(words=5, num=80))
    grouped = links.filter("n_shingles > 0").groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("k"))).alias("least"))
    keep = grouped.select(F.col("least.k").alias("held_key"), F.lit(True).alias("held_once")).union(links.filter("n_shingles = 0").select("k", F.lit(False)).distinct())
    keyed = held.withColumn("held_key", F.xxhash64(F.col("doc_id").cast("long"), "text")).join(keep, "held_key")
    # Rows that are equal share the key; only groups of texts with words leave one of them.
    return _freed(keyed.filter("not held_once").union(keyed.filter("held_once").dropDuplicates(["held_key"])), docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of test items; a document of which no word is left goes.

    Null and empty texts have no passages and stay as they are; repeated rows are cut alike; an empty
    benchmark changes nothing.
    """
    held, names = _held(docs)
    found = decontaminate.decontaminate(held, table(spark, sf_dir, "benchmark"), keep=tuple(names), remove=True)
    return _freed(found.filter("n_hit = 0 or n_hit < n_words"), docs, F.col("text_cut"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and secrets generalised, and with the terms that disclose them generalised or removed.

    A null text stays null; repeated rows are sanitised alike and all stay.
    """
    held, names = _held(docs)
    text = F.col(names[docs.columns.index("text")])
    return _freed(pii.sanitise(held, keep=tuple(names)), docs, pii.rewrite(text))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix of sources takes, with size, source_size, target and taken: the words that it takes of each.

    Documents without words are not taken; null sources are one source; ties go by id and then by row;
    a column of docs with the name of one of these four gives way to it.
    """
    held, names = _held(docs)
    out = mixing.mix_sources(held, keep=tuple(names)).filter("taken > 0")
    added = ("size", "source_size", "target", "taken")
    return out.select(*[F.col(h).alias(c) for h, c in zip(names, docs.columns) if c not in added], *added)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mix_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs
