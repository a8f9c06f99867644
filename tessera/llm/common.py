"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of documents: runs of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Where none is set, a session on one machine (local[...]) gets a temporary folder of its own; on a cluster it is an error.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context._conf.get("spark.checkpoint.dir", None)
    if not path:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        context._conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(col):
    return F.translate(col, UPPER, UPPER.lower())


def hashed(*cols):
    """A non-negative 62-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 2)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Rows of whole texts that go to a Python worker at once.
TEXTS_AT_ONCE = 1_000


def few_at_once(rows: DataFrame) -> DataFrame:
    """The same rows. Sets the session to send at most TEXTS_AT_ONCE of them to a Python worker at once, as whole texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(rows.sparkSession.conf.get(name, "10000")) <= TEXTS_AT_ONCE:
        rows.sparkSession.conf.set(name, str(TEXTS_AT_ONCE))
    return rows


def packed(rows: DataFrame, kinds: dict) -> list[np.ndarray]:
    """Columns of a bounded table of whole numbers on the driver, as arrays of the kinds named: each task sends one row of bytes."""

    def run(batches):
        parts = [[b[c].to_numpy(np.int64).astype(k) for c, k in kinds.items()] for b in batches]
        yield pd.DataFrame([[np.concatenate(x).tobytes() for x in zip(*parts)]] if parts else [], columns=list(kinds))

    found = rows.select(*kinds).mapInPandas(run, ", ".join(f"`{c}` binary" for c in kinds)).collect()
    return [np.frombuffer(b"".join(r[c] for r in found), k) for c, k in kinds.items()]


def spared(keep, added: str) -> list[str]:
    """The columns to keep but those that have the name of an added one, which gives its place to that."""
    names = {c.split()[0].lower() for c in re.sub(r"<[^()]*>", "", added).split(", ")}
    return [c for c in keep if c.lower() not in names]


def fields(src: DataFrame, added: str = "") -> str:
    """The schema of src's columns and those added."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields), *([added] if added else [])])


#: Elements that one fold adds up; folds of folds keep long arrays from being copied at every step.
FOLD = 64


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, start: Column, op) -> Column:
    """For each of the values, op over start and all values before it; op is a sum or a maximum."""

    def part(x: Column, first: Column) -> Column:
        step = lambda a, v: F.struct(op(a["at"], v).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
        return F.aggregate(x, F.struct(first.alias("at"), F.slice(F.array(first), 1, 0).alias("out")), step)["out"]

    def whole(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(v), F.lit(FOLD)), lambda i: F.slice(v, i, F.lit(FOLD)))
        starts = lambda p: part(F.transform(p, lambda x: F.aggregate(F.slice(x, 2, FOLD), F.get(x, F.lit(0)), op)), start)
        return let(parts, lambda p: F.flatten(F.zip_with(p, starts(p), part)))

    return let(values, lambda v: F.when(F.size(v) > FOLD, whole(v)).otherwise(part(v, start)))
