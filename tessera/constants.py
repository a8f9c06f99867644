"""Fixed values of block formats and policies."""

from __future__ import annotations

from dataclasses import dataclass

BLOCK = 4096
HEADER = 10
CRC = 2
DATA_AREA = BLOCK - HEADER - CRC

SKIP, RAW, LZ4, LZ4HC = "SKIP", "RAW", "LZ4", "LZ4HC"
CODECS = (SKIP, RAW, LZ4, LZ4HC)
#: Codec numbers in frames and engine results; in the module pipeline SKIP is -1.
CODEC_ID = {SKIP: 255, RAW: 0, LZ4: 1, LZ4HC: 2}
PIPELINE_ID = CODEC_ID | {SKIP: -1}

ENGINE_CACHE = 2340
PIPELINE_CACHE = 16384
ENGINE_SEED = 42
PIPELINE_SEED = 0xDEADBEEF
#: A compressed size from here on is stored raw: the size with its header would pass 4032.
LEAST_RAW_SIZE = 4022

STAGES = ("hashing", "cache_lookup", "feature_extraction", "codec_selection", "compression", "packing")
#: Microseconds for each stage.
STAGE_BUDGET = {"hashing": 2, "cache_lookup": 1, "feature_extraction": 15, "codec_selection": 1, "compression": 200, "packing": 5}
TOTAL_BUDGET = 224
SLOW_US = 300.0
TIMINGS_KEPT = 100_000


@dataclass(frozen=True)
class Thresholds:
    """Limits of the policies; comparisons are strict but for zero density."""

    entropy_random: float = 7.6
    uniqueness_random: float = 0.85
    rld: float = 0.05
    entropy_deep: float = 6.5
    uniqueness_low: float = 0.30
    zero_density: float = 0.999


@dataclass(frozen=True)
class Adaptivity:
    """Learned ratios: trusted from so many results on, above high stored raw, below low sure of benefit."""

    trusted: int = 3
    high: float = 0.88
    low: float = 0.35
    alpha: float = 0.25
    start: float = 1.0


@dataclass(frozen=True)
class Throttle:
    """Mean entropy over the last misses above the limit asks for the faster codec."""

    window: int = 100
    least: int = 20
    limit: float = 6.5
