"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.order import with_next

#: Samples of a fingerprint.
SAMPLES = 32


def terms(text: Column) -> Column:
    """Hashes of a text's words."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _unit(h: Column, shift: int) -> Column:
    """21 bits of a hash as a number between 0 and 1, never 0."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(0x1FFFFF)) + F.lit(0.5)) * F.lit(2.0**-21)


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """The logarithm of a term's arrival value in sample k; the least over a text's terms is the sample.

    r and c are gamma(2, 1), b is uniform, all from hashes of term and k. t = floor(ln w / r + b) is
    equal for weights in one step, and so is the value, which depends on r, c, b and t alone: two
    texts share a sample with the probability of their generalised Jaccard similarity.
    """
    h, g = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r = -F.ln(_unit(h, 0) * _unit(h, 21))
    c = -F.ln(_unit(g, 0) * _unit(g, 21))
    b = _unit(h.bitwiseXOR(F.shiftright(g, 21)), 42)
    return F.ln(c) - r * (F.floor(log_weight / r + b) - b + F.lit(1.0))


def fingerprints(texts: DataFrame, keys: list[str], *, text_col="text", samples=SAMPLES) -> DataFrame:
    """(keys, text) to (keys, sig): an array of ``samples`` integers, equal for equal texts.

    Terms are words with their counts as weights. A text without words (empty, null, white space) has
    a signature of zeros. Keys must be distinct; if texts are partitioned by one of the keys, no
    shuffle follows.
    """
    # Sorted hashes: equal ones stand together, and the gaps between first places are counts.
    hashes = F.array_sort(terms(F.col(text_col)))
    starts = F.filter(F.sequence(F.lit(0), F.size("h")), lambda i: (i == 0) | (i == F.size("h")) | (F.get("h", i) != F.get("h", i - 1)))
    runs = texts.select(*keys, hashes.alias("h")).select(*keys, "h", starts.alias("s"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("s") - 1, F.lit(1))), lambda i: F.struct(F.get("h", F.get("s", i - 1)).alias("t"), F.ln((F.get("s", i) - F.get("s", i - 1)).cast("double")).alias("lw")))
    flat = runs.select(*keys, F.explode(pairs).alias("p")).select(*keys, F.col("p.t").alias("t"), F.coalesce("p.lw", F.lit(0.0)).alias("lw"))
    out = flat.groupBy(*keys).agg(*[F.min(sample(F.col("t"), F.col("lw"), k)).alias(f"m{k}") for k in range(samples)])
    return out.select(*keys, F.array(*[F.when(F.col(f"m{k}").isNull(), 0).otherwise(F.hash(f"m{k}")) for k in range(samples)]).alias("sig"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(samples))


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def neighbours(docs: DataFrame) -> DataFrame:
    """(k, doc_id, n, next_k, times, last): each different row (doc_id, text) with the row that follows it by doc_id.

    Of equal rows all but the last are followed by their equal, ``times`` of them in one row here; the
    last one is followed by the next different row. Rows of one doc_id go by their hash k, null ids first.
    """
    ids = docs.groupBy("k", "doc_id").agg(F.count("*").alias("copies"), F.max("n").alias("n"))
    order = with_next(ids.select("doc_id", "k", "n", "copies"), "doc_id", "k")
    both = F.array(F.struct(F.col("next_k"), F.lit(1).cast("long").alias("times"), F.lit(True).alias("last")), F.struct(F.col("k").alias("next_k"), (F.col("copies") - 1).alias("times"), F.lit(False).alias("last")))
    return order.select("k", "doc_id", "n", F.explode(both).alias("x")).select("k", "doc_id", "n", "x.*").filter("times > 0")


def query(docs: DataFrame) -> DataFrame:
    """Every document, its edited text and the next document.

    Null texts are empty; null and repeated ids and repeated rows keep all their rows (see neighbours);
    an empty table gives none. Other columns are left out.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("k", F.xxhash64("doc_id", "text"))
    order = written(neighbours(docs.select("k", "doc_id", F.length("text").cast("long").alias("n"))), "fingerprint-order")
    # Each document sends its neighbour before it only as many first characters as that one replaces.
    need = order.select(F.col("next_k").alias("k"), F.floor(F.col("n") / 4).cast("int").alias("want"), F.col("k").alias("to_k"), "last")
    texts = docs.select("k", "text")
    sent = texts.join(need, "k").select(F.col("to_k").alias("k"), "last", F.substring("text", F.lit(1), F.col("want")).alias("start")).repartition("k").dropDuplicates(["k", "last"])
    keep = F.length("text") - F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), keep), "start")
    # Equal rows give equal samples, of which the least is one.
    edit = texts.join(sent, "k")
    both = edit.select("k", "last", F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text")), F.struct(F.lit(1).alias("v"), edited.alias("text")))).alias("x")).select("k", "last", "x.v", "x.text")
    both = both.withColumn("sha", F.when(F.col("v") == 1, F.sha2("text", 256))).withColumn("n_chars", F.length("text").cast("long"))
    sigs = fingerprints(both, ["k", "last", "v", "sha", "n_chars"])
    one = sigs.groupBy("k", "last").agg(F.max("n_chars").alias("n_chars"), F.max("sha").alias("edited_sha256"), F.max(F.when(F.col("v") == 0, F.col("sig"))).alias("sig"), F.max(F.when(F.col("v") == 1, F.col("sig"))).alias("edited_sig"))
    one = written(one, "fingerprints")
    after = order.join(one.filter("last").select(F.col("k").alias("next_k"), F.col("sig").alias("next_sig")), "next_k").select("k", "last", "doc_id", "times", "next_sig")
    out = one.join(after, ["k", "last"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))
