"""End-to-end write paths: blocks to codecs, sizes, cache and WAF columns, and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.constants import BLOCK, ENGINE_CACHE, LZ4, PIPELINE_CACHE, PIPELINE_SEED, RAW, SKIP, Adaptivity, Thresholds, Throttle
from tessera.functions.bytes import features, firmware_features, is_zero, murmur3_128, murmur3_simple, prefix
from tessera.functions.codecs import coded_sizes, encoded, lib_sizes, own_size, stored_raw
from tessera.operators import frames, policy, state


def with_features(blocks: DataFrame) -> DataFrame:
    """Adds key (SHA-256 of the block) and f (features), made where the block lies: no block is dealt out."""
    return blocks.withColumn("key", F.sha2("block", 256)).withColumn("f", features("block"))


def measured(blocks: DataFrame, compressor=lib_sizes) -> DataFrame:
    """All columns but the block, and key, zero_block, entropy, rld, uniqueness, lz4 and lz4hc (sizes). Everything after it is narrow."""
    m = blocks.select(*[c for c in blocks.columns if c != "block"], F.sha2("block", 256).alias("key"), is_zero(F.col("block")).alias("zero_block"), features("block").alias("f"), compressor(F.col("block")).alias("z"))
    return m.select(*[c for c in m.columns if c not in ("f", "z")], F.col("f.entropy").alias("entropy"), F.col("f.run_length_density").alias("rld"), F.col("f.uniqueness").alias("uniqueness"), F.col("z.lz4").alias("lz4"), F.col("z.lz4hc").alias("lz4hc"))


def engine(blocks: DataFrame, *, capacity: int = ENGINE_CACHE, thresholds: Thresholds = Thresholds(), adaptivity: Adaptivity = Adaptivity(), limit: Throttle = Throttle(), compressor=lib_sizes, with_block: bool = True) -> DataFrame:
    """The adaptive engine over (volume_id, seq, block): engine_state of what is measured, and the blocks again if wanted."""
    out = engine_state(measured(blocks, compressor), capacity=capacity, thresholds=thresholds, adaptivity=adaptivity, limit=limit)
    return out.join(blocks.select("volume_id", "seq", "block"), ["volume_id", "seq"]) if with_block else out


def engine_state(rows: DataFrame, *, capacity: int = ENGINE_CACHE, thresholds: Thresholds = Thresholds(), adaptivity: Adaptivity = Adaptivity(), limit: Throttle = Throttle()) -> DataFrame:
    """The engine's state machine over rows of ``measured``.

    Zero blocks leave first. A hit is a use within the cache's reach; an entry's codec is the one of
    its first use, which the mean entropy of the last misses may lower; its learned ratio has a closed
    form. One chain of windows, no joins: caches run in cells of a volume, entries by key, the mean
    over the last misses and the running write amplification by volume.

    Adds codec_used, compressed_size, ratio, cache_hit, throttled, raw_avoided, force_raw, skip_benefit,
    use, generation and waf_current; entropy, rld and uniqueness are null on hits.
    """
    names = rows.columns
    g = state.generations(state.lru_hits(rows.filter(~F.col("zero_block")), capacity))
    h, r, u, hit = F.col("entropy"), F.col("rld"), F.col("uniqueness"), F.col("cache_hit")
    g = state.throttle(g, limit, "cache_hit").withColumn("throttled", F.when(~hit, F.col("throttled")))
    entry = state._ordered("volume_id", "key", "generation")
    g = g.withColumn("codec", F.first(F.when(~hit, policy.engine_codec(h, r, u, F.col("throttled"), thresholds))).over(entry))
    size = F.when(F.col("codec") == LZ4, F.col("lz4")).otherwise(F.col("lz4hc"))
    g = g.withColumns({"size": size, "raw": (F.col("codec") == RAW) | stored_raw(size)})
    g = state.learned(g, F.col("size") / BLOCK, F.col("raw"), adaptivity)
    raw = F.col("raw") | F.col("force_raw")
    own = [c for c in names if c not in ("entropy", "rld", "uniqueness", "lz4", "lz4hc")]
    done = g.select(
        *own, F.when(raw, RAW).otherwise(F.col("codec")).alias("codec_used"), F.when(raw, BLOCK).otherwise(F.col("size")).alias("compressed_size"),
        F.when(raw, 1.0).otherwise(F.col("size") / BLOCK).alias("ratio"), hit, *[F.when(~hit, F.col(c)).alias(c) for c in ("entropy", "rld", "uniqueness")],
        "throttled", (~hit & policy.raw_avoided(h, u, thresholds)).alias("raw_avoided"), "force_raw", "skip_benefit", "use", "generation",
    )
    no = F.lit(False)
    zero = rows.filter("zero_block").select(
        *own, F.lit(SKIP).alias("codec_used"), F.lit(0).alias("compressed_size"), F.lit(None).cast("double").alias("ratio"), no.alias("cache_hit"), F.lit(0.0).alias("entropy"), F.lit(1.0).alias("rld"), F.lit(0.004).alias("uniqueness"),
        F.lit(None).cast("boolean").alias("throttled"), no.alias("raw_avoided"), no.alias("force_raw"), no.alias("skip_benefit"), F.lit(None).cast("int").alias("use"), F.lit(None).cast("long").alias("generation"),
    )
    out = done.unionByName(zero)
    return out.withColumn("waf_current", state.running_waf(out, F.when(F.col("zero_block"), BLOCK).otherwise(F.col("compressed_size")), F.lit(BLOCK)))


def engine_frames(results: DataFrame) -> DataFrame:
    """(volume_id, seq, frame_offset, frame, raw_tail): offsets in order of seq. Frames cut raw blocks at 4084 bytes; raw_tail keeps the other 12, so reading restores every byte."""
    deep = F.col("codec_used") == "LZ4HC"
    payload = F.when(F.col("codec_used") == RAW, F.col("block")).when(deep, encoded(F.col("block"), True, False)).when(F.col("codec_used") == LZ4, encoded(F.col("block"), False, False)).otherwise(F.lit(b""))
    w = state._ordered("volume_id")
    return results.withColumn("payload", payload).select(
        "volume_id", "seq", "path", "block_no", ((F.row_number().over(w) - 1) * BLOCK).cast("long").alias("frame_offset"), frames.pack_engine(F.col("codec_used"), F.col("payload")).alias("frame"),
        F.when(F.col("codec_used") == RAW, F.substring("block", F.lit(BLOCK - 11), F.lit(12))).alias("raw_tail"),
    )


def pipeline(blocks: DataFrame, *, capacity: int | None = PIPELINE_CACHE, thresholds: Thresholds = Thresholds(), with_block: bool = True) -> DataFrame:
    """The module pipeline: own encoder, explainable policy, cached codec on hits (the entry's stored codec). SKIP is stored as raw with ratio 1.

    The codec is chosen first; a block is encoded once, and not at all for RAW and SKIP. Adds signature,
    cache_hit, entropy and rld (0 on hits), codec_selected, codec_used, compressed_size, ratio,
    space_saving_pct, benefit, frame_offset.
    """
    own = [c for c in blocks.columns if c != "block"]
    b = with_features(blocks).withColumn("signature", F.substring(murmur3_128(F.col("block"), PIPELINE_SEED), 1, 16)).withColumn("d", policy.decision(F.col("f"), thresholds)["codec_name"])
    c = coded_sizes(F.col("d"), F.octet_length("block"), own_size(F.col("d"), F.col("block")))
    b = b.withColumn("c", c).select(*own, "key", "signature", F.col("f.entropy").alias("h"), F.col("f.run_length_density").alias("r"), "d", "c.*")
    hit = F.col("cache_hit")
    out = state.lru_hits(b, capacity).select(
        *own, "signature", "cache_hit", F.when(hit, 0.0).otherwise(F.col("h")).alias("entropy"), F.when(hit, 0.0).otherwise(F.col("r")).alias("rld"),
        F.when(hit, F.col("codec_used")).otherwise(F.col("d")).alias("codec_selected"), "codec_used", F.col("size").alias("compressed_size"), "ratio", F.bround((1 - F.col("ratio")) * 100, 2).alias("space_saving_pct"), "benefit",
        ((F.row_number().over(state._ordered("volume_id")) - 1) * BLOCK).cast("long").alias("frame_offset"),
    )
    return out.join(blocks.select("volume_id", "seq", "block"), ["volume_id", "seq"]) if with_block else out


def firmware(blocks: DataFrame, *, slots: int = PIPELINE_CACHE, with_block: bool = True) -> DataFrame:
    """The controller's path: direct-mapped cache, integer features, benefit check after the cache keeps the codec."""
    own = [c for c in blocks.columns if c != "block"]
    j = blocks.select(*own, murmur3_simple(F.col("block")).alias("signature"), firmware_features("block").alias("f"), lib_sizes(F.col("block")).alias("z"), prefix(F.col("block")).alias("_first"))
    j = state.direct_mapped(j, F.col("signature"), F.col("_first"), slots)
    chosen = policy.firmware_codec(F.col("f.entropy_fixed"), F.col("f.adjacent_equal"))
    size = F.when(chosen == LZ4, F.col("z.lz4")).otherwise(F.col("z.lz4hc"))
    raw = (chosen == RAW) | stored_raw(size)
    out = j.select(*own, "signature", "slot", "cache_hit", chosen.alias("codec_selected"), F.when(raw, RAW).otherwise(chosen).alias("codec_used"), F.when(raw, frames.DATA_AREA).otherwise(size).alias("payload_size"))
    return out.join(blocks.select("volume_id", "seq", "block"), ["volume_id", "seq"]) if with_block else out
