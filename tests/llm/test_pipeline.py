"""The pipeline's stages against brute force, each on what the one before it kept."""

import re

import corpus_pipeline
from pyspark.sql import functions as F
from tessera.llm import decontaminate
from test_operators import brute_components, brute_spans


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in kept.collect()}
        kept = stage(spark, kept, sf)
        kept.write.parquet(str(tmp_path / name.replace(" ", "_")))
        kept = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        after = {r["doc_id"]: r for r in kept.collect()}
        assert set(after) <= set(before) and len(after) == kept.count()
        if not name.startswith("mixing"):
            assert kept.columns == columns and all(r["n_chars"] == len(r["text"]) for r in after.values())
        if name == "quality classifier":
            labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            good = [i for i, x in labels.items() if x == (1, 0) and i in before]
            bad = [i for i, x in labels.items() if x[1] == 1 or x[0] == 0]
            assert sum(i in after for i in good) >= 0.95 * len(good) and sum(i in after for i in bad) <= 0.2 * len(bad)
        elif name == "n-gram Jaccard join":
            want = {c for _, c in brute_components([(i, r["text"]) for i, r in before.items()], 5, 80, 100).values()}
            assert set(after) == want
        elif name == "benchmark decontamination":
            for i, r in before.items():
                n, hit, _ = decontaminate_hits(r["text"], bench)
                assert (i in after) == (hit < n or hit == 0)
                if i in after and not hit:
                    assert after[i]["text"] == r["text"]
        elif name == "PII":
            for i, r in before.items():
                found = brute_spans(r["text"])
                if any(found.values()):
                    assert not any(r["text"][a:b] in after[i]["text"] for k in ("email", "card") for a, b in found[k])
        else:
            words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
            assert all(0 < r["taken"] <= 2 * words(r["text"]) for r in after.values())


def decontaminate_hits(text, items):
    from test_operators import brute_hits

    return brute_hits(text, items)


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, clashing names and an empty table; every stage gives the columns of documents."""
    sf = "/root/testdata/sf0.001"
    base = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").limit(30).collect()]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = [(*[r[c] for c in names], "k", 1, 2, 3.0) for r in base]
    rows += [rows[3]] * 4 + [(None, base[5]["text"], None, None, None, None, None, None, None)] * 2 + [(900, None, "en", "s", 1, "k", 1, 1, 1.0), (901, "", "en", "s", 1, "k", 1, 1, 1.0), (902, " ", None, None, 1, "k", 1, 1, 1.0)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, k string, once int, n_hit int, score double"
    docs = spark.createDataFrame(rows, schema).withColumns({"held_0": F.lit("x"), "size": F.lit(7), "term": F.lit("t"), "c": F.lit(1)})
    for at in (docs, docs.filter("false")):
        kept = at
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, kept, sf)
            path = str(tmp_path / (name.replace(" ", "_") + ("" if at is docs else "_empty")))
            out.write.parquet(path)
            out = spark.read.parquet(path)
            if name.startswith("mixing"):
                assert out.columns == [c for c in docs.columns if c != "size"] + ["size", "source_size", "target", "taken"]
                break
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
            if at is docs and name == "n-gram Jaccard join":
                seen = [r for r in out.collect()]
                texts = [r["text"] for r in seen if r["text"] and r["text"].split()]
                assert len(texts) == len(set(texts)) and {r["held_0"] for r in seen} == {"x"}
                before = [r["text"] for r in kept.collect()]
                assert sum(not (r["text"] or "").split() for r in seen) == sum(not (t or "").split() for t in before)
            kept = out
        assert at is docs or kept.count() == 0


def test_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert decontaminate.words_of("A-b é9") == [b"a", b"b", "é9".encode()]
