"""Personal data by pattern, and terms that disclose it by corpus co-occurrence.

Protected values are matches of the base patterns and secrets (long strings of letters and digits
together, as keys and tokens are). What a term t tells of a value v is their pointwise mutual
information; the rest of v's information content, -log2 p(v|t) bits, stays hidden. Terms that leave
too little hidden are generalised or removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, running, spared, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: A match starts where no match could have begun earlier, or where the last one ended; so a run of characters is read once, however long it is.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{24,}+",
}
#: A text without these has no match.
SIGNS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "secret": r"[A-Za-z0-9+/_-]{24}"}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
TERM = r"[\p{L}]{4,}+"
SPAN = "array<struct<start:int,end:int,value:string>>"
#: What stands for a value in a sanitised text.
GENERAL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "secret": "[SECRET]", "term": "[TERM]"}


#: Cells of the filter for words, of 64 bits each.
CELLS = 1 << 20


def located(text: Column, pattern: str | Column, sign: str | None = None) -> Column:
    """All matches with their places in code points: the text is split at the matches, and the lengths of pieces and matches add up."""
    pattern = pattern if isinstance(pattern, Column) else F.lit(f"(?s){pattern}")
    found, pieces = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)

    def places(x: Column) -> Column:
        # The last piece has no match after it.
        sizes = F.zip_with(F.slice(x["p"], F.lit(1), F.size(x["m"])), x["m"], lambda p, m: F.length(p) + F.length(m))
        ends = F.transform(running(sizes, F.lit(0), lambda a, n: a + n), lambda at, i: at + F.length(F.get(x["p"], i)) + F.length(F.get(x["m"], i)))
        return F.zip_with(ends, x["m"], lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("value")))

    all_places = let(F.struct(found.alias("m"), pieces.alias("p")), lambda x: F.when(F.size(x["m"]) > 0, places(x)).otherwise(F.array().cast(SPAN)))
    return all_places if sign is None else F.when(F.rlike(text, F.lit(sign)), all_places).otherwise(F.array().cast(SPAN))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn(d: Column) -> Column:
    n = F.length(d)

    def worth(i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 1, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.rlike(value, F.lit(OCTETS))
    if kind == "card":
        return F.when(F.length(digits(value)).between(16, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(located(text, PATTERNS[kind], SIGNS[kind]), lambda s: valid(kind, s["value"]))


def outside(text: Column, spans: Column) -> Column:
    """The text's parts between the spans, a space for each span; a word that reaches into a span is not in them."""
    reach = lambda s: running(F.transform(s, lambda x: x["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
    letters = lambda at: F.rlike(F.substring(text, at, F.lit(2)), F.lit(r"^\p{L}\p{L}"))

    def part(at: Column, stop: Column) -> Column:
        x = F.substring(text, at + 1, stop - at)
        x = F.when((at > 0) & letters(at), F.regexp_replace(x, r"^\p{L}+", "")).otherwise(x)
        return F.when((stop > 0) & letters(stop), F.regexp_replace(x, r"\p{L}+$", "")).otherwise(x)

    def parts(s: Column) -> Column:
        before = F.zip_with(reach(s), s, lambda at, x: F.when(x["start"] > at, part(at, x["start"])).otherwise(F.lit("")))
        return F.concat(F.array_join(before, " "), F.lit(" "), part(F.array_max(F.transform(s, lambda x: x["end"])), F.length(text)))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return let(ordered, lambda s: F.when(F.size(s) > 0, parts(s)).otherwise(text))


def words(text: Column) -> Column:
    """The different words of a text as they are written."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def sanitise(docs: DataFrame, *, text_col="text", keep=("doc_id",), general=(1.0, 0.1), remove=(0.1, 0.02), alone=0.5) -> DataFrame:
    """Spans of personal data: one array of (start, end, value) for each kind, and ``term`` (start, end, action).

    For a value v and a term t that stands outside values in a document of v, p counts documents: t
    leaves IC(v) - PMI(t; v) = -log2 p(v|t) bits of v hidden. p(v|t) has one more document of t, in
    which v is as likely as in any, so few documents say less than many. Terms are generalised if no
    more stays hidden than ``general`` allows, in bits and as a share of IC(v), and removed if no more
    than ``remove`` allows, wherever they stand in any document, by the value of which they tell most.
    In documents without protected values they must leave at most ``alone`` bits hidden.
    Counts cover all documents. For rare values the bits decide, and they mean the same at every size.

    Null texts are empty ones and have no spans; equal texts have equal spans, and each counts as a
    document; no rows are dropped; repeated rows and null ids are rows of their own; a column in
    ``keep`` with the name of an added one gives way to it. Adds n_chars to the ``keep`` columns.
    """
    keep = spared(keep, ", ".join(f"{c} x" for c in ("n_chars", *KINDS, "term")))
    src = docs.select(F.struct(*keep).alias("pii_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("pii_text"))
    text = F.col("pii_text")
    found = src.select("pii_doc", "pii_text", F.length(text).cast("long").alias("n_chars"), *[base_spans(text, k).alias(k) for k in KINDS])
    base = written(found.withColumn("pii_row", F.monotonically_increasing_id()), "pii-base")

    terms = written(disclosing(base, general, remove, alone), "pii-terms")
    # Most words are told from terms before they are dealt out.
    placed = base.select("pii_row", F.explode(hashes(words(text))).alias("h"))
    placed = placed.join(F.broadcast(cells(terms.select("h"))), F.col("h").bitwiseAND(F.lit(CELLS - 1)) == F.col("cell")).filter(F.expr("getbit(bits, cast(shiftright(h, 20) & 63 as int)) = 1")).select("pii_row", "h")
    holds = base.select("pii_row", F.expr(" or ".join(f"size({k}) > 0" for k in KINDS)).alias("holds"))
    acting = placed.join(terms, "h").join(holds, "pii_row").filter("holds or strong")
    here = acting.groupBy("pii_row").agg(F.map_from_entries(F.collect_set(F.struct("h", "action"))).alias("by_term"))
    own = lambda w: F.xxhash64(F.lower(w))
    named = base.join(here, "pii_row").withColumn("written_as", F.filter(words(text), lambda w: F.array_contains(F.map_keys("by_term"), own(w))))
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("written_as", "|"), F.lit(r")(?!\p{L})"))
    free = lambda w: ~F.exists(F.concat(*[F.transform(k, lambda s: F.struct(s["start"], s["end"])) for k in KINDS]), lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"]))
    action = lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.element_at("by_term", own(w["value"])).alias("action"))
    spans = F.transform(F.filter(located(text, pattern), free), action)
    extra = named.filter(F.size("written_as") > 0).select("pii_row", spans.alias("term"))
    out = base.drop("pii_text").join(extra, "pii_row", "left")
    return out.select("pii_doc.*", "n_chars", *KINDS, F.coalesce("term", F.array().cast("array<struct<start:int,end:int,action:string>>")).alias("term"))


def hashes(w: Column) -> Column:
    """Different hashes of words in lower case."""
    return F.array_distinct(F.transform(w, lambda x: F.xxhash64(F.lower(x))))


def cells(h: DataFrame) -> DataFrame:
    """A filter for hashes: (cell, bits), at most CELLS rows however many hashes there are."""
    return h.groupBy(F.col("h").bitwiseAND(F.lit(CELLS - 1)).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftright(h, 20) & 63 as int))")).alias("bits"))


def disclosing(base: DataFrame, general: tuple, remove: tuple, alone: float) -> DataFrame:
    """(h, level, strong, action) of the terms that disclose a value; h is the term's hash."""
    text = F.col("pii_text")
    value = lambda k: F.transform(k, lambda s: F.xxhash64(F.lit(k), F.lower(s["value"])))
    spans = F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS])
    held = base.filter(" or ".join(f"size({k}) > 0" for k in KINDS)).select("pii_row", F.array_distinct(F.concat(*map(value, KINDS))).alias("vs"), hashes(words(outside(text, spans))).alias("hs"))
    held = written(held, "pii-held")
    p_v = F.col("n_v") / F.lit(float(base.count()))
    values = held.select("pii_row", F.explode("vs").alias("v"))
    n_v = values.groupBy("v").agg(F.count("*").alias("n_v"))
    values = values.join(n_v, "v").groupBy("pii_row").agg(F.collect_list(F.struct("v", "n_v")).alias("vs"), F.max("n_v").alias("most"))
    # Every word's documents are counted before the join, so no word's rows meet.
    n_t = base.select(F.explode(hashes(words(text))).alias("h")).groupBy("h").agg(F.count("*").alias("n_t"))
    # n_vt is n_v at most, so a term of more documents than the limit allows for any value of its text is none.
    may = F.col("n_t") + 1 <= F.lit(2.0 ** general[0] * (1 + 1e-9)) * (F.col("most") + 1)
    rare = held.select("pii_row", F.explode("hs").alias("h")).join(n_t, "h").join(values, "pii_row").filter(may)
    pairs = rare.select("h", "n_t", F.explode("vs").alias("x")).select("h", "n_t", "x.v", "x.n_v").groupBy("h", "v", "n_t", "n_v").agg(F.count("*").alias("n_vt"))
    hidden = -F.log2((F.col("n_vt") + p_v) / (F.col("n_t") + 1))
    within = lambda most: (F.col("hidden") <= most[0]) & (F.col("hidden") <= F.lit(most[1]) * -F.log2(p_v))
    scored = pairs.withColumn("hidden", hidden).withColumn("level", F.when(within(remove), 2).when(within(general), 1).otherwise(0)).filter("level > 0")
    return scored.groupBy("h").agg(F.max("level").alias("level"), (F.min("hidden") <= alone).alias("strong")).withColumn("action", F.when(F.col("level") == 2, "remove").otherwise("generalise"))


def span_list(kinds=KINDS, term: bool = False) -> Column:
    def part(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(part, (*kinds, *(["term"] if term else [])))), ",")


def rewrite(text: Column) -> Column:
    """The text with values and terms generalised or removed; spans that overlap make one, under the first one's name."""

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg_end"), F.lit(GENERAL[kind]).alias("by")))

    typed = list(map(named, KINDS))
    typed.append(F.transform("term", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg_end"), F.when(s["action"] == "remove", F.lit("")).otherwise(F.lit(GENERAL["term"])).alias("by"))))

    def pieces(s: Column) -> Column:
        before = running(F.transform(s, lambda x: -x["neg_end"]), F.lit(0), lambda a, b: F.greatest(a, b))
        parts = F.zip_with(before, s, lambda at, x: F.when(x["start"] >= at, F.concat(F.substring(text, at + 1, x["start"] - at), x["by"])).otherwise(F.lit("")))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.array_max(F.transform(s, lambda x: -x["neg_end"])) + 1, F.length(text)))

    return let(F.array_sort(F.concat(*typed)), lambda s: F.when(F.size(s) > 0, pieces(s)).otherwise(text))


def query(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, secrets and terms; n_found is that of protected values, base kinds and secrets together."""
    s = sanitise(docs)
    n = lambda k: F.size(k).cast("long")
    more = [n("secret").alias("n_secret"), n("term").alias("n_term"), sum((n(k) for k in KINDS[1:]), n(KINDS[0])).alias("n_found")]
    return s.select("doc_id", *[n(k).alias(f"n_{k}") for k in BASE], F.sha2(span_list(BASE), 256).alias("base_sha256"), span_list(term=True).alias("spans"), *more)
