"""Unit tables, round trips and sequential models of the block engine."""

import hashlib
import os
import shutil
import subprocess
import sys
from collections import OrderedDict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.constants import BLOCK, ENGINE_CACHE, PIPELINE_CACHE, Adaptivity
from tessera.functions import bytes as fb
from tessera.functions import codecs
from tessera.operators import files, frames, policy, reports, sinks, state
from tessera.plans import engine as plans
from tessera.sources import blocks as sources

#: Features and the codec they lead to.
TRUTH = [
    (0.0, 1.0, 1.0, 0.004, "SKIP"), (0.01, 0.99, 0.999, 0.004, "SKIP"), (7.9, 0.01, 0, 0.98, "RAW"), (7.7, 0.02, 0, 0.92, "RAW"), (7.8, 0.01, 0, 0.60, "LZ4HC"), (7.6, 0.00, 0, 0.40, "LZ4HC"),
    (4.2, 0.55, 0, 0.25, "LZ4"), (2.1, 0.65, 0, 0.10, "LZ4"), (5.0, 0.10, 0, 0.35, "LZ4"), (3.5, 0.03, 0, 0.45, "LZ4HC"), (1.2, 0.02, 0, 0.15, "LZ4HC"), (5.5, 0.02, 0, 0.20, "LZ4HC"),
    (6.0, 0.03, 0, 0.55, "LZ4HC"), (6.8, 0.04, 0, 0.65, "LZ4HC"), (7.6, 0, 0, 0.9, "LZ4HC"), (7.61, 0, 0, 0.85, "LZ4HC"), (4.0, 0.05, 0, 0.5, "LZ4HC"), (1.0, 0.9, 0.998999, 0.01, "LZ4"),
]


def test_policy_table(spark):
    df = spark.createDataFrame([tuple(map(float, r[:4])) + (r[4],) for r in TRUTH], "entropy double, run_length_density double, zero_density double, uniqueness double, want string")
    got = df.withColumn("d", policy.decision(F.struct("entropy", "run_length_density", "zero_density", "uniqueness"))).select("want", "d.*").collect()
    assert all(r["want"] == r["codec_name"] and 0.5 <= r["confidence"] <= 1 and r["decision_reason"] for r in got)
    none = spark.range(1).select(F.struct(*[F.lit(None).cast("double").alias(c) for c in ("entropy", "run_length_density", "zero_density", "uniqueness")]).alias("f"))
    assert none.select(policy.decision(F.col("f"))["codec_name"]).first()[0] == "LZ4HC"


def blocks_of(spark, items):
    return spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(items)], "seq long, block binary")


def test_features(spark):
    items = [bytes(4096), b"\xab\xcd" * 2048, b"\x00\xab\xcd\x00" * 1024, b"\x10\x20\x30\x40\x50" * 819 + b"\x10", b"", b"a", bytes(range(256)) * 16]
    got = [r["f"] for r in blocks_of(spark, items).select(fb.features("block").alias("f"), "seq").orderBy("seq").collect()]
    assert [(g["entropy"], g["run_length_density"], g["uniqueness"]) for g in got[:4]] == [(0.0, 0.999756, 0.003906), (1.0, 0.0, 0.007812), (1.5, 0.249756, 0.011719), (2.321928, 0.0, 0.019531)]
    assert got[0]["zero_density"] == 1.0 and got[4]["zero_density"] is None and got[4]["entropy"] == 0.0 and got[5]["byte_variety"] == 1 and got[6]["entropy"] == 8.0


def test_hashes(spark):
    """Published check values of the two checksums and of MurmurHash3."""
    df = blocks_of(spark, [b"123456789", b"", b"hello", b"The quick brown fox jumps over the lazy dog"])
    got = df.select(fb.crc16_modbus("block").alias("a"), fb.crc16_ccitt("block").alias("b"), fb.murmur3_128(F.col("block"), 0).alias("m"), "seq").orderBy("seq").collect()
    assert (got[0]["a"], got[0]["b"]) == (0x4B37, 0x29B1)
    assert got[1]["m"] == "0" * 32 and got[2]["m"] == "cbd8a7b341bd9b025b1e906a48ae1d19" and got[3]["m"] == "e34bbc7bbc071b6c7a433ca9c49a9347"


def samples():
    r = np.random.default_rng(4)
    yield from (bytes(4096), b"\xab\xcd" * 2048, r.bytes(4096), (b"key=value;type=metadata;\n" * 200)[:4096], r.bytes(100) * 41, b"", b"a", b"abcd", b"aaaaaaaaaa", b"x" * 300 + r.bytes(50) + b"x" * 300)
    for _ in range(20):
        yield bytes(r.choice(list(b"abcd "), int(r.integers(1, 5000))).astype(np.uint8))


@pytest.mark.parametrize("deep", [False, True])
def test_lz4_round_trips(deep):
    for b in samples():
        assert codecs.decode(codecs.encode(b, deep), len(b)) == b
        if b:
            # The own encoder may end a block with a match, which the library's decoder refuses; the other way round holds.
            assert codecs.decode(codecs.lib_encode(b, deep), len(b)) == b


def test_coded(spark):
    df = spark.createDataFrame([("lz4 ", bytearray(4096), bytearray(100)), ("LZ4HC", bytearray(4096), bytearray(4050)), ("RAW", bytearray(4096), bytearray(3)), ("SKIP", bytearray(4096), bytearray(0))], "c string, b binary, p binary")
    got = [r["x"] for r in df.select(codecs.coded(F.col("c"), F.col("b"), F.col("p")).alias("x")).collect()]
    assert [(g["codec_used"], g["size"], g["benefit"]) for g in got] == [("LZ4", 100, True), ("RAW", 4096, False), ("RAW", 4096, False), ("RAW", 4096, False)]
    with pytest.raises(Exception, match="unknown codec"):
        df.select(codecs.coded(F.lit("ZIP"), F.col("b"), F.col("p"))["size"]).collect()


def test_frames(spark):
    df = spark.createDataFrame([("RAW", bytearray(b"\x01" * 4096), bytearray(b"\x01" * 4096)), ("LZ4", bytearray(4096), bytearray(b"abc")), ("odd", bytearray(b"z" * 10), bytearray(b"z" * 10)), ("SKIP", bytearray(4096), bytearray())], "c string, o binary, p binary")
    f = df.withColumn("frame", frames.pack_module(F.col("c"), F.col("o"), F.col("p")))
    got = frames.unpack_module(f).collect()
    assert [len(r["frame"]) for r in got] == [4096] * 4 and all(r["crc_valid"] for r in got)
    assert [(r["codec_name"], r["compressed_size"], r["flags"]) for r in got] == [("RAW", 4084, 0), ("LZ4", 3, 3), ("RAW", 10, 0), ("SKIP", 0, 2)]
    broken = f.withColumn("frame", F.concat(F.lit(b"\x07"), F.substring("frame", F.lit(2), F.lit(4095))))
    assert not any(r["crc_valid"] for r in frames.unpack_module(broken).collect())
    assert frames.unpack_module(broken).first()["codec_name"] == "UNKNOWN(0x07)"
    assert f.select(frames.crc_valid_module(F.substring("frame", F.lit(1), F.lit(5)))).first()[0] is False
    e = frames.unpack_engine(df.withColumn("frame", frames.pack_engine(F.col("c"), F.col("p")))).filter("c <> 'odd'").collect()
    assert all(r["crc_valid"] and len(r["frame"]) == 4096 for r in e) and [r["original_size"] for r in e] == [4096, 4096, 0]
    with pytest.raises(Exception, match="payload over"):
        df.select(frames.pack_module(F.lit("LZ4"), F.col("o"), F.col("o"))).collect()
    c = frames.pack_firmware(F.lit("LZ4"), F.col("p"))
    assert [r[0] is None for r in df.select(c).collect()] == [True, False, False, False]


def sequential(rows, capacity, a=Adaptivity()):
    """The cache one access after another: (hit, force, skip) for (key, ratio)."""
    cache, out = OrderedDict(), []
    for key, ratio in rows:
        force = skip = False
        hit = key in cache
        if hit:
            cache.move_to_end(key)
            avg, conf = cache[key]
            force, skip = conf >= a.trusted and avg > a.high, conf >= a.trusted and not avg > a.high and avg < a.low
        else:
            avg, conf = a.start, 1
            cache[key] = (avg, conf)
            if len(cache) > capacity:
                cache.popitem(last=False)
        if not force:
            cache[key] = (a.alpha * ratio + (1 - a.alpha) * avg, min(255, conf + 1))
        out.append((hit, force, skip))
    return out


@pytest.mark.parametrize("capacity", [3, 7, 1000])
def test_state_matches_sequential_model(spark, capacity):
    r = np.random.default_rng(capacity)
    keys = r.zipf(1.5, 400) % 25
    ratio = {int(k): float(r.uniform(0, 1.0)) for k in set(keys.tolist())}
    rows = [(int(k), ratio[int(k)]) for k in keys]
    df = spark.createDataFrame([("v", i, k, x) for i, (k, x) in enumerate(rows)] + [("w", 5, 1, 0.5)], "volume_id string, seq long, key long, ratio double")
    g = state.generations(state.lru_hits(df, capacity))
    got = state.learned(g, F.col("ratio"), F.lit(False)).filter("volume_id = 'v'").orderBy("seq").collect()
    assert [(x["cache_hit"], x["force_raw"], x["skip_benefit"]) for x in got] == sequential(rows, capacity)


def test_engine_branches(spark):
    r = plans.engine(sources.branch_stream(spark, 200))
    s = reports.engine_stats(r).first()
    assert (s["total_blocks_processed"], s["total_cache_hits"], s["total_cache_misses"], s["total_skip_blocks"]) == (200, 94, 96, 10)
    assert (s["total_raw_blocks"], s["adaptive_skip_compress"], s["adaptive_force_compress"]) == (88, 8, 50)
    codec = {x["codec"]: x["blocks"] for x in reports.codec_distribution(r).collect()}
    assert codec == {"SKIP": 10, "RAW": 88, "LZ4": 31, "LZ4HC": 71} and abs(s["waf"] - 0.5453) < 5e-4
    small = reports.engine_stats(plans.engine(sources.branch_stream(spark, 2000), capacity=50)).first()
    assert (small["total_cache_hits"], small["total_cache_misses"]) == (1084, 816)


def test_read_path_restores_every_byte(spark):
    r = np.random.default_rng(8)
    data = {"a": r.bytes(9000), "b": b"log line\n" * 3000, "c": bytes(5000), "d": b"tiny"}
    src = spark.createDataFrame([("v", "w", p, i, bytearray(d)) for i, (p, d) in enumerate(data.items())] + [("v", "w", "e", 9, bytearray())], "volume_id string, workload string, path string, n long, data binary")
    fr = plans.engine_frames(plans.engine(sources.split(src, F.col("data"), F.col("n")))).persist()
    sizes = spark.createDataFrame([(p, len(d)) for p, d in data.items()], "path string, real long")
    idx = files.index(fr).join(sizes, "path").select("path", F.col("real").alias("size"), "blocks")
    for path, offset, size in (("a", 0, 9000), ("a", 4090, 20), ("a", 8000, 5000), ("b", 5, 26_000), ("c", 4095, 3), ("d", 0, 100), ("d", 50, 5)):
        got = files.read_range(idx, fr, path, offset, size).collect()
        assert b"".join(bytes(x["data"]) for x in got) == data[path][offset : offset + size]
    assert files.read_range(idx, fr, "e", 0, 10).count() == 0
    assert {x["name"] for x in files.names(idx).collect()} == {".", "..", ".stats", "a", "b", "c", "d"}
    more = files.append(idx, spark.createDataFrame([("d", 1, 4, 10, [4096 * 50])], "path string, seq long, offset long, length long, blocks array<long>"))
    assert more.filter("path = 'd'").first()["size"] == 14 and len(more.filter("path = 'd'").first()["blocks"]) == 2
    assert files.truncate(idx, "a", 3).filter("path = 'a'").first()["size"] == 3 and files.exists(files.create(idx, "z"), "z").first()[0]


def test_read_range_has_all_documents(spark, tmp_path, monkeypatch):
    """The query's store and index hold every document, and the operator chooses the path."""
    docs = [(i, c * 6000, "en", "web", 6000) for i, c in enumerate("abc")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    given, read = [], files.read_range
    monkeypatch.setattr(files, "read_range", lambda idx, fr, *a: given.append((idx, fr)) or read(idx, fr, *a))
    got = catalog.queries()["read_range"](spark, str(tmp_path)).collect()
    assert {r["path"]: r["data"] for r in got} == {str(i): hashlib.sha256(c * 4096).hexdigest() for i, c in enumerate((b"a", b"b", b"c"))}
    one = read(*given[0], "1", 1000, 4096).collect()
    assert [(r["path"], bytes(r["data"])) for r in one] == [("1", b"b" * 4096)]
    for x in given[0]:
        assert {r["path"] for r in x.select("path").distinct().collect()} == {"0", "1", "2"}


def test_firmware_and_pipeline(spark):
    b = sources.branch_stream(spark, 100)
    f = plans.firmware(b).collect()
    seen, hits = {}, {}
    for x in sorted(f, key=lambda x: x["seq"]):
        hits[x["seq"]] = seen.get(x["slot"]) == (x["signature"], bytes(x["block"][:4]))
        seen[x["slot"]] = (x["signature"], bytes(x["block"][:4]))
    assert all(x["cache_hit"] == hits[x["seq"]] for x in f) and not any(x["codec_selected"] == "RAW" for x in f)
    p = {x["seq"]: x for x in plans.pipeline(b).collect()}
    assert p[14]["codec_used"] == "RAW" and p[14]["ratio"] == 1.0 and p[14]["codec_selected"] == "SKIP" and [p[i]["frame_offset"] for i in (0, 1, 99)] == [0, 4096, 99 * 4096]


def test_sources_and_sinks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, data in (("b.log", b"x" * 5000), ("a.txt", b"y" * 4096), ("c.bin", b"z" * 2000), ("e.txt", b"")):
        (folder / name).write_bytes(data)
    got = sources.file_blocks(spark, str(folder), (".log", ".txt")).select("path", "block_no", F.octet_length("block").alias("n")).collect()
    assert sorted((r["path"][-5:], r["block_no"], r["n"]) for r in got) == [("a.txt", 0, 4096), ("b.log", 0, 4096), ("b.log", 1, 4096)]
    listed = spark.createDataFrame([(f"/d/f{i}.txt", 1025 + i) for i in range(90)] + [("/d/.h/x.txt", 2000), ("/d/y.bin", 2000), ("/d/s.txt", 1024)], "path string, length long")
    assert [r["length"] - 1025 for r in sources.sample_files(listed).collect()] == list(range(0, 90, 3))
    meta = spark.createDataFrame([("p", 5, [0, 4096])], "path string, size long, blocks array<long>")
    sinks.write_metadata(meta, str(tmp_path / "meta"))
    assert sources.read_metadata(spark, str(tmp_path / "meta")).collect() == meta.collect()
    assert sources.read_metadata(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "m.json").write_text('[{"size": "10MB", "pipeline": "a", "ratio": 0.5}, {"size": "10MB", "pipeline": "b"}]')
    m = sources.read_matrix(spark, str(tmp_path / "m.json"), str(tmp_path / "m.json"))
    assert m.count() == 4 and reports.lookup(m, "10MB", "b", "ratio", 7.0).first()[0] == 7.0 and reports.lookup(m, "1GB", "b", "ratio").first()[0] == 0.0
    assert reports.chart_series(m, ["10MB", "1GB"], ["a"], "ratio", 0.25).orderBy("size_at").collect()[1]["ratio"] == 0.25
    r = plans.engine(sources.branch_stream(spark, 40))
    sinks.write_blocks_csv(r, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 40
    sinks.write_frames(plans.engine_frames(r), str(tmp_path / "frames"))
    assert spark.read.parquet(str(tmp_path / "frames")).count() == 40
    assert "average_entropy" in sinks.html_page(reports.engine_stats(r)) and reports.text_report(reports.engine_stats(r)).count() > 10
    assert sources.mixed_stream(spark, 300).select("workload").distinct().count() == 4 and sources.warm_up(spark).count() == 500


def test_stream_equals_batch(spark, tmp_path):
    from tessera.streaming import ingest

    r = np.random.default_rng(6)
    rows = [("v" + str(i % 3), i, "k" + str(int(k))) for i, k in enumerate(r.integers(0, 12, 300))]
    schema = "volume_id string, seq long, key string"
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    ingest.run_once(ingest.lru_stream(stream, 6), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(x["volume_id"], x["seq"]): x["cache_hit"] for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(x["volume_id"], x["seq"]): x["cache_hit"] for x in state.lru_hits(spark.createDataFrame(rows, schema), 6).collect()}
    assert got == want and len(got) == 300 and BLOCK == 4096


def test_engine_stream_equals_batch(spark, tmp_path):
    """Three micro-batches of blocks of all kinds against the batch plan."""
    from tessera.streaming import ingest

    rows = plans.measured(sources.branch_stream(spark, 300)).drop("path", "workload", "block_no")
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    rows.write.parquet(str(tmp_path / "all"))
    rows = spark.read.parquet(str(tmp_path / "all"))
    for part in range(3):
        rows.filter(F.floor(F.col("seq") / 100) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.run_once(ingest.engine_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), capacity=60), str(tmp_path / "out"), str(tmp_path / "ck"))
    names = ["seq", "zero_block", "codec_used", "compressed_size", "ratio", "cache_hit", "throttled", "raw_avoided", "force_raw", "skip_benefit", "waf_current"]
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*names).orderBy("seq").collect()]
    want = [tuple(r) for r in plans.engine_state(rows, capacity=60).select(*names).orderBy("seq").collect()]
    assert got == want and len(got) == 300 and sum(r[5] for r in got) > 50


def test_generators(spark):
    """Log blocks are lines of a log, fixtures have their sizes, and blocks of every kind are whole."""
    r = spark.range(3).select(sources.log_block(F.col("id")).alias("b")).collect()
    for x in r:
        text = bytes(x["b"]).decode()
        assert len(text) == BLOCK and all(len(line.split()) >= 5 and line.startswith("12:") for line in text.splitlines()[:-1])
    kinds = ["random", "structured", "repetitive", "archive_like", "runs", "few", "partial", "log", "variants", "zero"]
    got = spark.createDataFrame([(k, i) for k in kinds for i in range(4)], "k string, s long").select(F.octet_length(sources.generated(F.col("k"), F.col("s"))).alias("n")).collect()
    assert {x["n"] for x in got} == {BLOCK}
    assert {x["path"]: len(x["content"]) for x in sources.fixture_files(spark, 3).collect()} == {p: 3 * BLOCK for p in ("random_data.bin", "app_logs.log", "zero_blocks.bin", "repetitive.bin", "mixed_data.bin")}


def test_cache_entry_and_timings(spark, tmp_path):
    """The entry's 16 bytes, lowest first; timings as a table of text."""
    import struct

    df = spark.createDataFrame([("0123456789abcdef", 0xCAFE, 2, 321)], "sig string, p long, c int, r int")
    got = bytes(df.select(frames.cache_entry(F.col("sig"), F.col("p"), F.col("c"), F.col("r")).alias("e")).first()["e"])
    assert got == struct.pack("<QIBHB", 0x0123456789ABCDEF, 0xCAFE, 2, 321, 0)
    row = {c: 1.5 for c in sinks.TIMING_COLUMNS} | {"block_index": 7, "codec_used": "LZ4", "cache_hit": True, "within_budget": False}
    sinks.write_timings(spark.createDataFrame([row]), str(tmp_path / "t"))
    back = spark.read.option("header", True).csv(str(tmp_path / "t"))
    assert back.columns == list(sinks.TIMING_COLUMNS) and back.first()["block_index"] == "7"
    lines = [r["line"] for r in reports.lines_of("Codecs", reports.codec_stats(plans.pipeline(sources.branch_stream(spark, 30), with_block=False), F.lit(2.0)).na.fill({"codec": "all"}), "codec").orderBy("line_no").collect()]
    assert lines[0] == "Codecs" and "avg_us" in lines[1] and any(x.startswith("all") and "30.00" in x for x in lines)


def test_entry(spark):
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 60
    assert e.entry(spark).count() >= 1


def test_entry_without_optional_part(tmp_path):
    """A copy without the training-data part imports and has all other queries."""
    here = Path(catalog.__file__).parents[1]
    for name in ("__spark_entry__.py", "tessera"):
        src = here / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    n, llm, sql = out.stdout.split()
    assert int(n) == len(catalog.queries()) and llm == "False" and int(sql) == len(catalog.oracle_sql())


def test_cells_give_the_same_hits(spark):
    """A volume cut into many cells has the hits of one that runs as a whole, for keys of several kinds and for null ones."""
    r = np.random.default_rng(12)
    rows = [("v" + str(i % 2), i, None if k == 3 else int(k)) for i, k in enumerate(r.zipf(1.4, 600) % 40)] + [(None, i, 1) for i in range(3)]
    df = spark.createDataFrame(rows, "volume_id string, seq long, key long")
    for capacity in (1, 5, 20, 100):
        one = {(x["volume_id"], x["seq"]): x["cache_hit"] for x in state.lru_hits(df, capacity).collect()}
        cut = {(x["volume_id"], x["seq"]): x["cache_hit"] for x in state.lru_hits(df, capacity, cell_bits=5).collect()}
        model = {}
        for v in ("v0", "v1", None):
            mine = [(i, k) for w, i, k in rows if w == v]
            model |= {(v, i): h for (i, _), (h, _, _) in zip(mine, sequential([(k, 0.5) for _, k in mine], capacity))}
        assert one == cut == model


def test_checksums_of_odd_lengths(spark):
    """Against a bit-by-bit register."""

    def plain(data, poly, low):
        c = 0xFFFF
        for b in data:
            c ^= b if low else b << 8
            for _ in range(8):
                c = (c >> 1) ^ poly * (c & 1) if low else ((c << 1) ^ poly * (c >> 15)) & 0xFFFF
        return c

    r = np.random.default_rng(3)
    items = [r.bytes(n) for n in (0, 1, 2, 3, 255, 1000, 1001, 4094)]
    got = blocks_of(spark, items).select("seq", fb.crc16_modbus("block").alias("a"), fb.crc16_ccitt("block").alias("b")).orderBy("seq").collect()
    assert [(x["a"], x["b"]) for x in got] == [(plain(d, 0xA001, True), plain(d, 0x1021, False)) for d in items]
    zero = blocks_of(spark, [bytes(4096), bytes(5), b"", bytes(4095) + b"\1", b"\0\1"]).select(fb.is_zero(F.col("block")).alias("z")).collect()
    assert [x["z"] for x in zero] == [True, True, True, False, False]


def test_cache_hits_without_a_capacity(spark, tmp_path):
    """More blocks than the engine's cache holds lie between a block and its repeat: the query's SQL still counts it as a hit."""
    n = ENGINE_CACHE + 10
    rows = [(i, f"{i % n:08d}", "en", "web", 8) for i in range(n + 20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["cache_hits"](spark, str(tmp_path)).collect()
    assert len(got) == n + 20 and {r["seq"] >> 24 for r in got if r["cache_hit"]} == set(range(n, n + 20))


def test_pipeline_decisions_without_a_capacity(spark, tmp_path):
    """More blocks than the module pipeline's cache holds lie between a block and its repeat."""
    n = PIPELINE_CACHE + 10
    d = spark.range(n + 20).select(F.col("id").alias("doc_id"), F.format_string("%08d", F.col("id") % n).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(8).alias("n_chars"))
    d.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["pipeline_decisions"](spark, str(tmp_path)).collect()
    assert len(got) == n + 20 and {r["seq"] >> 24 for r in got if r["cache_hit"]} == set(range(n, n + 20))
    assert all((r["chosen"] is None and r["entropy"] == 0) == r["cache_hit"] for r in got) and sorted(r["frame_offset"] for r in got) == list(range(0, (n + 20) * BLOCK, BLOCK))


#: Orders whose last hundred have a mean entropy of 6.5 but for rounding: added one by one it is above, in the SQL's order not.
ON_THE_LIMIT = [
    0, 6, 11, 16, 18, 20, 48, 49, 59, 60, 62, 74, 82, 84, 95, 101, 115, 119, 120, 138, 139, 141, 143, 147, 151, 154, 160, 167, 177, 180, 182, 189, 199, 211, 212, 216, 220, 228, 230, 231, 234, 235, 237, 239, 247, 253, 258, 267, 269, 275, 280, 287,
    290, 295, 297, 301, 307, 308, 310, 316, 320, 323, 327, 333, 339, 340, 344, 346, 350, 356, 365, 368, 375, 379, 390, 404, 407, 414, 417, 425, 428, 437, 441, 445, 446, 449, 454, 457, 464, 471, 474, 482, 488, 489, 498, 500, 509, 512, 517, 536, 537, 543, 548, 551,
]


def test_throttle_on_the_limit(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    path = f"{tmp_path}/orders.parquet"
    spark.createDataFrame([("1-URGENT", 3941240 + k) for k in ON_THE_LIMIT], "o_orderpriority string, o_orderkey long").coalesce(1).write.parquet(path)
    got = {r["seq"]: r["throttled"] for r in catalog.queries()["thermal_throttle"](spark, str(tmp_path)).collect()}
    assert got[3941791] is False
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert got == {seq: throttled for _, seq, throttled in con.execute(catalog.oracle_sql()["thermal_throttle"]).fetchall()}
