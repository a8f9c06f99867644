"""Byte sources as tables of 4096-byte blocks, and generated workloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.constants import BLOCK
from tessera.functions.bytes import padded

#: Blocks of one source get numbers below this, so (source, block) orders a volume without a sort.
PER_SOURCE = 1 << 24
#: Suffixes of files worth sampling.
SUFFIXES = (".txt", ".log", ".csv", ".json", ".xml", ".html", ".py", ".c")


def split(sources: DataFrame, data: Column, number: Column, keep=("volume_id", "workload", "path")) -> DataFrame:
    """Sources to blocks: (keep, seq, block_no, block). The last block is filled with zeros; empty and null sources have none.

    seq rises with the source's number and the block's, and is computed in the row: no sort, no shuffle.
    """
    size = F.octet_length("_data")
    rows = sources.select(*keep, number.cast("long").alias("_number"), data.alias("_data")).filter(F.octet_length("_data") > 0)
    rows = rows.withColumn("block_no", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int"))))
    block = padded(F.substring("_data", F.col("block_no") * BLOCK + 1, F.lit(BLOCK)))
    return rows.select(*keep, (F.col("_number") * PER_SOURCE + F.col("block_no")).alias("seq"), "block_no", block.alias("block"))


#: Inputs up to this size are dealt out before they are split.
SMALL = 1 << 30


def spread(rows: DataFrame, number: str) -> DataFrame:
    """A small input is often one row group, which one task would read and work on alone; a large one has enough of them and stays as it is."""
    if int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL:
        return rows
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, number)


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("lang").alias("volume_id"), F.col("source").alias("workload"), F.col("doc_id").cast("string").alias("path"), "doc_id", "text")
    return split(spread(d, "doc_id"), F.encode("text", "UTF-8"), F.col("doc_id"))


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lit("pages").alias("volume_id"), F.lit("html").alias("workload"), F.col("url").alias("path"), "page_id", "html")
    return split(spread(d, "page_id"), F.encode("html", "UTF-8"), F.col("page_id"))


def file_blocks(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (), recursive: bool = False) -> DataFrame:
    """Blocks of the files in a folder, each its own volume, in order of names; unreadable files are left out."""
    r = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").option("recursiveFileLookup", str(recursive).lower())
    files = r.load(folder)
    if suffixes:
        files = files.filter(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    return split(files.select(F.col("path").alias("volume_id"), F.lit("file").alias("workload"), "path", "content"), F.col("content"), F.lit(0))


def sample_files(files: DataFrame, suffixes=SUFFIXES, least=1024, most=5 * 1024 * 1024, found=200, take=30) -> DataFrame:
    """A spread of sizes: (path, length) of the first files found with a known suffix and a size between the limits, every n/30-th by size. Hidden folders are skipped."""
    ok = F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$") & ~F.col("path").rlike(r"/\.[^/]") & (F.col("length") > least) & (F.col("length") < most)
    some = files.filter(ok).select("path", "length").orderBy("path").limit(found)
    w = Window.orderBy("length", "path")
    ranked = some.withColumns({"_r": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy())})
    return ranked.filter(F.pmod("_r", F.greatest(F.floor(F.col("_n") / take), F.lit(1))) == 0).orderBy("length", "path").limit(take).select("path", "length")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, blocks) of a metadata table; missing or broken files give no rows."""
    schema = "path string, size long, blocks array<long>"
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).filter("path is not null")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_matrix(spark: SparkSession, *paths: str) -> DataFrame:
    """Benchmark rows of several JSON lists, one after the other."""
    schema = "size string, pipeline string, ratio double, saving_pct double, waf double, throughput_mbs double, iops double, cpu_s double, cpu_avg_pct double, mem_peak_mb double, avg_lat_ms double, p99_lat_ms double, cache_hit_pct double, lossless string, orig_mb double, comp_mb double"
    return spark.read.schema(schema).option("multiLine", "true").json(list(paths))


def chain(tag: Column, n: int) -> Column:
    """n SHA-256 digests of tag:0, tag:1, ... one after the other: fixed bytes that look random."""
    return F.unhex(F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.sha2(F.concat(tag, F.lit(":"), i.cast("string")), 256))))


def repeated(pattern: Column, size: int = BLOCK) -> Column:
    h = F.hex(pattern)
    return F.unhex(F.substring(F.repeat(h, F.ceil(F.lit(2 * size) / F.length(h)).cast("int")), 1, 2 * size))


#: The line of structured blocks and the header of an archive.
LINE = "key={};timestamp=1234567890;type=metadata;flag=true;\n"
ARCHIVE = b"PK\x03\x04\x14\x00\x00\x00\x08\x00\x00\x00\x00\x00"
KINDS = {"random": 0.40, "structured": 0.25, "repetitive": 0.20, "archive_like": 0.15}


#: Words of log lines.
LEVELS = ("INFO ", "DEBUG", "WARN ", "ERROR", "TRACE")
MODULES = ("StorageEngine", "WriteBuffer", "GCManager", "NVMeController", "FTL", "ECC")
MESSAGES = ("write_command_received", "cache_lookup result=miss", "gc_cycle started", "compression_complete", "pattern_cache hit codec=LZ4HC")


def drawn(seed: Column, what: str, i: Column, n: int) -> Column:
    """A number below n that looks random: from the MD5 of seed, name and place."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(seed.cast("string"), F.lit(f":{what}:"), i.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(n))


def log_block(seed: Column, size: int = BLOCK) -> Column:
    """Lines of a log with rising times, levels, modules, messages and addresses, cut at the block's end."""

    def line(i: Column) -> Column:
        pick = lambda what, words: F.element_at(F.array(*map(F.lit, words)), (drawn(seed, what, i, len(words)) + 1).cast("int"))
        ms = i * 25 + drawn(seed, "ms", i, 25)
        clock = F.format_string("12:%02d:%02d.%03d", (ms / 60_000).cast("int") % 60, (ms / 1000).cast("int") % 60, ms % 1000)
        return F.concat(clock, F.lit(" ["), pick("module", MODULES), F.lit("] "), pick("level", LEVELS), F.lit(" "), pick("message", MESSAGES), F.format_string(" lba=0x%08X len=4096\n", drawn(seed, "lba", i, 1 << 32)))

    return F.substring(F.encode(F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(size // 40)), line)), "UTF-8"), F.lit(1), F.lit(size))


def repetitive_block(seed: Column, size: int = BLOCK) -> Column:
    """By seed % 4: zeros, one byte, a pattern of 2, 4, 8 or 16 bytes, or zeros with some written places."""
    hexed = lambda what, i=F.lit(0): F.md5(F.concat(seed.cast("string"), F.lit(f":{what}:"), i.cast("string")))
    length = F.pow(F.lit(2), drawn(seed, "length", F.lit(0), 4) + 1).cast("int")
    zeros = "00" * size
    sparse = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(size // 128 - 1)), lambda i: F.when(drawn(seed, "written", i, 4) == 0, F.concat(F.substring(hexed("data", i), 1, 16), F.lit("00" * 120))).otherwise(F.lit("00" * 128))))
    h = F.when(seed % 4 == 0, F.lit(zeros)).when(seed % 4 == 1, F.repeat(F.substring(hexed("byte"), 1, 2), F.lit(size)))
    return F.unhex(h.when(seed % 4 == 2, F.repeat(F.substring(hexed("pattern"), F.lit(1), 2 * length), (F.lit(size) / length).cast("int"))).otherwise(sparse))


def fixture_files(spark: SparkSession, blocks: int = 25) -> DataFrame:
    """(path, content) of five files that each show a kind of data: random, log lines, repetitive, zeros, mixed."""
    parts = {
        "random_data.bin": lambda i: chain(F.concat(F.lit("f"), i.cast("string")), BLOCK // 32), "app_logs.log": log_block, "zero_blocks.bin": lambda i: F.lit(bytes(BLOCK)),
        "repetitive.bin": lambda i: F.unhex(F.repeat(F.concat(F.repeat(F.lpad(F.hex(i % 256), 2, "0"), F.lit(64)), F.lit("FF" * 64)), F.lit(32))),
        "mixed_data.bin": lambda i: F.when(i % 3 == 0, chain(F.concat(F.lit("m"), i.cast("string")), BLOCK // 32)).when(i % 3 == 1, repeated(F.lit(b"\0\1\2\3"))).otherwise(repeated(F.lit(b"FIXTURE_BLOCK_DATA_"))),
    }
    out = None
    for name, block in parts.items():
        g = spark.range(blocks).select(F.lit(name).alias("path"), "id", F.hex(block(F.col("id"))).alias("h"))
        out = g if out is None else out.unionByName(g)
    rows = out.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("id", "h"))).alias("b"))
    return rows.select("path", F.unhex(F.concat_ws("", F.col("b.h"))).alias("content"))


def many_files(spark: SparkSession, files: int = 10_000, size: int = BLOCK) -> DataFrame:
    """(path, content) of files of letters that look random."""
    letters = F.translate(F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(-(-size // 32) - 1)), lambda i: F.md5(F.concat(F.col("id").cast("string"), F.lit(":"), i.cast("string"))))), "0123456789", "ghijklmnop")
    return spark.range(files).select(F.concat(F.lit("file_"), "id", F.lit(".txt")).alias("path"), F.encode(F.substring(letters, 1, size), "UTF-8").alias("content"))


def generated(kind: Column, seed: Column) -> Column:
    """A block of a kind; the seed varies random and archive blocks, and the key of structured ones."""
    s = seed.cast("string")
    first, last = LINE.split("{}")
    return (
        F.when(kind == "random", chain(F.concat(F.lit("r"), s), BLOCK // 32))
        .when(kind == "structured", repeated(F.encode(F.concat(F.lit(first), s, F.lit(last)), "UTF-8")))
        .when(kind == "repetitive", repeated(F.lit(b"\xab\xcd")))
        .when(kind == "archive_like", padded(F.concat(F.lit(ARCHIVE), chain(F.concat(F.lit("a"), s), BLOCK // 32))))
        .when(kind == "runs", repeated(F.lit(b"\x00\xab\xcd\x00")))
        .when(kind == "log", log_block(seed)).when(kind == "variants", repetitive_block(seed)).when(kind == "few", repeated(F.lit(b"\x10\x20\x30\x40\x50")))
        .when(kind == "partial", F.rpad(chain(F.concat(F.lit("p"), s), 105), BLOCK, F.lit(b"A")))
        .otherwise(repeated(F.lit(b"\x00")))
    )


def mixed_stream(spark: SparkSession, n: int, kinds: dict[str, float] = KINDS, seed: int = 42) -> DataFrame:
    """n blocks, each of a kind drawn by weight from a hash of its number."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) / 1e6
    kind, upto = F.lit(next(iter(kinds))), 0.0
    for k, w in reversed(list(kinds.items())):
        kind = F.when(draw < sum(list(kinds.values())[: list(kinds).index(k) + 1]), k).otherwise(kind)
        upto += w
    return _stream(spark.range(n).withColumn("workload", kind), F.col("id"))


def exact_stream(spark: SparkSession, n: int, kinds: dict[str, float] = KINDS, seed: int = 42) -> DataFrame:
    """Exactly int(n * share) blocks of each kind, topped up with random ones, shuffled by a hash."""
    parts = None
    for k, w in kinds.items():
        p = spark.range(int(n * w)).select(F.col("id").alias("k"), F.lit(k).alias("workload"))
        parts = p if parts is None else parts.unionByName(p)
    short = n - sum(int(n * w) for w in kinds.values())
    parts = parts.unionByName(spark.range(max(0, short)).select((F.col("id") + n).alias("k"), F.lit("random").alias("workload")))
    return _stream(_numbered(parts, F.xxhash64(F.lit(seed), "workload", "k")).filter(F.col("id") < n).drop("k"), F.col("id"))


def _numbered(rows: DataFrame, draw: Column) -> DataFrame:
    """Adds id: rows numbered from 0 in the order of a hash. Ranges of the hash are counted first, so no task has all rows."""
    rows = rows.withColumns({"_draw": draw, "_range": F.shiftrightunsigned(draw, 54)})
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))  # 1,024 rows at most
    within = Window.partitionBy("_range").orderBy("_draw", *[c for c in rows.columns if c[0] != "_"])
    return rows.join(F.broadcast(starts), "_range").withColumn("id", F.col("_start") + F.row_number().over(within) - 1).drop("_draw", "_range", "_start")


def warm_up(spark: SparkSession, n: int = 500) -> DataFrame:
    return _stream(spark.range(n).withColumn("workload", F.when(F.col("id") % 2 == 0, "repetitive").otherwise("structured")), F.lit(0))


def round_robin(spark: SparkSession, n: int) -> DataFrame:
    """40 of 100 blocks random, 30 structured, 30 runs."""
    at = F.col("id") % 100
    return _stream(spark.range(n).withColumn("workload", F.when(at < 40, "random").when(at < 70, "structured").otherwise("runs")), F.col("id"))


def _stream(rows: DataFrame, seed: Column) -> DataFrame:
    return rows.select(F.lit("generated").alias("volume_id"), "workload", F.concat(F.lit("gen/"), F.col("id")).alias("path"), F.col("id").alias("seq"), F.lit(0).alias("block_no"), generated(F.col("workload"), seed).alias("block"))


def branch_stream(spark: SparkSession, n: int) -> DataFrame:
    """A stream that reaches every branch of the engine: kinds by seq % 20, with repeats."""
    t, s = F.col("id") % 20, F.col("id")
    kind = (
        F.when(t < 7, "random").when(t < 11, "structured").when(t < 14, "repetitive").when(t == 14, "zero")
        .when(t == 15, "runs").when(t < 18, "partial").when(t == 18, "few").otherwise("archive_like")
    )
    seed = F.when(t < 7, s % 900).when(t < 11, s % 7).when((t == 16) | (t == 17), s % 60).otherwise(s)
    return _stream(spark.range(n).withColumn("workload", kind), seed)
