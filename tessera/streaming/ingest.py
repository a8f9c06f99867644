"""Block writes that arrive over time: keyed engine state in Structured Streaming."""

from __future__ import annotations

from collections import OrderedDict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from tessera.constants import BLOCK, ENGINE_CACHE, LEAST_RAW_SIZE, LZ4, LZ4HC, RAW, SKIP, Adaptivity, Thresholds, Throttle


def lru_stream(accesses: DataFrame, capacity: int = ENGINE_CACHE) -> DataFrame:
    """(volume_id, seq, key) as a stream to (volume_id, seq, key, cache_hit).

    A volume's state is its keys in order of last use, at most ``capacity`` of them. Rows of a
    micro-batch are taken in order of seq; batches must bring a volume's rows in order. Equal to the
    batch plan on the same rows.
    """

    def step(group, batches, state):
        cache = OrderedDict.fromkeys(state.get[0]) if state.exists else OrderedDict()
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        hits = []
        for k in rows["key"]:
            hits.append(k in cache)
            cache[k] = None
            cache.move_to_end(k)
            if len(cache) > capacity:
                cache.popitem(last=False)
        state.update((list(cache),))
        yield rows.assign(cache_hit=hits)[["volume_id", "seq", "key", "cache_hit"]]

    return accesses.groupBy("volume_id").applyInPandasWithState(step, "volume_id string, seq long, key string, cache_hit boolean", "keys array<string>", "append", GroupStateTimeout.NoTimeout)


STATE = "keys array<string>, codecs array<string>, averages array<double>, uses array<int>, entropies array<double>, logical long, physical long"
WRITTEN = "volume_id string, seq long, key string, zero_block boolean, codec_used string, compressed_size int, ratio double, cache_hit boolean, throttled boolean, raw_avoided boolean, force_raw boolean, skip_benefit boolean, waf_current double"


class Volume:
    """What a volume remembers: its entries in order of last use, the entropies of its last misses and its bytes."""

    def __init__(self, kept, thresholds: Thresholds, adaptivity: Adaptivity, limit: Throttle, capacity: int):
        keys, codecs, averages, uses, entropies, self.logical, self.physical = kept or ([], [], [], [], [], 0, 0)
        self.entries = OrderedDict((k, [c, a, n]) for k, c, a, n in zip(keys, codecs, averages, uses))
        self.entropies = deque(entropies, limit.window)
        self.t, self.a, self.limit, self.capacity = thresholds, adaptivity, limit, capacity

    def kept(self) -> tuple:
        e = list(self.entries.values())
        return list(self.entries), [x[0] for x in e], [x[1] for x in e], [x[2] for x in e], list(self.entropies), self.logical, self.physical

    def _codec(self, row) -> tuple[str, bool]:
        self.entropies.append(row.entropy)
        hot = len(self.entropies) >= self.limit.least and sum(self.entropies) / len(self.entropies) > self.limit.limit
        if row.entropy > self.t.entropy_random and row.uniqueness > self.t.uniqueness_random:
            return RAW, hot
        return (LZ4 if row.rld > self.t.rld or hot else LZ4HC), hot

    def write(self, row) -> tuple:
        self.logical += BLOCK
        if row.zero_block:
            self.physical += BLOCK
            return SKIP, 0, None, False, None, False, False, False, self.physical / self.logical
        hit, hot = row.key in self.entries, None
        if not hit:
            codec, hot = self._codec(row)
            self.entries[row.key] = [codec, self.a.start, 1]
            if len(self.entries) > self.capacity:
                self.entries.popitem(last=False)
        self.entries.move_to_end(row.key)
        entry = self.entries[row.key]
        codec, average, uses = entry
        trusted = uses >= self.a.trusted
        force = trusted and average > self.a.high
        skip = trusted and not force and average < self.a.low
        size = row.lz4 if codec == LZ4 else row.lz4hc
        raw = codec == RAW or size >= LEAST_RAW_SIZE
        if not force:
            entry[1:] = [self.a.alpha * (1.0 if raw else size / BLOCK) + (1 - self.a.alpha) * average, min(255, uses + 1)]
        raw = raw or force
        stored = BLOCK if raw else size
        self.physical += stored
        avoided = not hit and row.entropy > self.t.entropy_random and row.uniqueness <= self.t.uniqueness_random
        return RAW if raw else codec, stored, stored / BLOCK, hit, hot, avoided, force, skip, self.physical / self.logical


def engine_stream(rows: DataFrame, *, capacity: int = ENGINE_CACHE, thresholds: Thresholds = Thresholds(), adaptivity: Adaptivity = Adaptivity(), limit: Throttle = Throttle()) -> DataFrame:
    """The adaptive engine over a stream of rows of ``measured`` (features and sizes are stateless and made before).

    Columns of WRITTEN. A volume is a key of the state; rows of a micro-batch are taken in order of
    seq, and batches must bring a volume's rows in order. Equal to engine_state on the same rows.
    """

    def step(group, batches, state):
        volume = Volume(state.get if state.exists else None, thresholds, adaptivity, limit, capacity)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = [volume.write(r) for r in rows.itertuples(index=False)]
        state.update(volume.kept())
        names = ["codec_used", "compressed_size", "ratio", "cache_hit", "throttled", "raw_avoided", "force_raw", "skip_benefit", "waf_current"]
        yield pd.concat([rows[["volume_id", "seq", "key", "zero_block"]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    return rows.groupBy("volume_id").applyInPandasWithState(step, WRITTEN, STATE, "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that has arrived, to a Parquet folder."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
