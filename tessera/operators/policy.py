"""Codec policies as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.constants import CODEC_ID, LZ4, LZ4HC, PIPELINE_ID, RAW, SKIP, STAGES, TOTAL_BUDGET, Thresholds


def hint(entropy: Column, rld: Column, uniqueness: Column, zero_density: Column) -> Column:
    """A feature vector's hint. The six texts and their limits."""
    return (
        F.when(zero_density > 0.9999, "ZERO_BLOCK — deduplicate or skip")
        .when((entropy > 7.5) & (uniqueness > 0.85), "RANDOM/ENCRYPTED — use RAW codec (high entropy + high uniqueness)")
        .when(entropy > 7.5, "HIGH_ENTROPY_LOW_UNIQ — try LZ4 (entropy high but limited byte diversity)")
        .when(rld > 0.4, "HIGH_RLD — use LZ4 (run-length friendly)")
        .when((entropy < 3.0) | (uniqueness < 0.10), "LOW_ENTROPY — use LZ4HC (deep compression)")
        .otherwise("MODERATE — use LZ4HC (balanced structured data)")
    )


def engine_codec(entropy: Column, rld: Column, uniqueness: Column, throttled: Column | None = None, t: Thresholds = Thresholds()) -> Column:
    """The engine's choice for a block that is not all zeros."""
    fast = (rld > t.rld) if throttled is None else (rld > t.rld) | throttled
    return F.when((entropy > t.entropy_random) & (uniqueness > t.uniqueness_random), RAW).when(fast, LZ4).otherwise(LZ4HC)


def raw_avoided(entropy: Column, uniqueness: Column, t: Thresholds = Thresholds()) -> Column:
    return (entropy > t.entropy_random) & (uniqueness <= t.uniqueness_random)


def policy_codec(entropy: Column, rld: Column, zero_density: Column, uniqueness: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when(zero_density >= t.zero_density, SKIP).otherwise(engine_codec(entropy, rld, uniqueness, t=t))


def confidence(entropy: Column, rld: Column, zero_density: Column, uniqueness: Column, t: Thresholds = Thresholds()) -> Column:
    one, none = F.lit(1.0), F.lit(0.0)
    random = F.least(one, F.lit(0.5) * (entropy - t.entropy_random) / 0.4 + F.lit(0.5) * (uniqueness - t.uniqueness_random) / 0.15 + 0.6)
    runs = F.least(one, 0.6 + rld * 0.5)
    deep = F.least(one, 0.55 + 0.3 * F.greatest(none, (t.entropy_deep - entropy) / t.entropy_deep) + 0.3 * F.greatest(none, (t.uniqueness_low - uniqueness) / t.uniqueness_low))
    rest = F.greatest(F.lit(0.5), (t.entropy_random - entropy) / t.entropy_random)
    path = _path(entropy, rld, zero_density, uniqueness, t)
    return F.bround(F.when(path == "zero", one).when(path == "random", random).when(path == "runs", runs).when(path == "deep", deep).otherwise(rest), 4)


def _path(entropy, rld, zero_density, uniqueness, t):
    return (
        F.when(zero_density >= t.zero_density, "zero").when((entropy > t.entropy_random) & (uniqueness > t.uniqueness_random), "random")
        .when(rld > t.rld, "runs").when((entropy < t.entropy_deep) | (uniqueness < t.uniqueness_low), "deep").otherwise("rest")
    )


def reason(entropy: Column, rld: Column, zero_density: Column, uniqueness: Column, t: Thresholds = Thresholds()) -> Column:
    """The explanations' wording."""
    f3 = lambda c: F.format_string("%.3f", c)
    parts = F.concat_ws(
        " AND ", F.when(entropy < t.entropy_deep, F.concat(F.lit("entropy="), f3(entropy), F.lit(f" < {t.entropy_deep}"))),
        F.when(uniqueness < t.uniqueness_low, F.concat(F.lit("uniqueness="), f3(uniqueness), F.lit(f" < {t.uniqueness_low}"))),
    )
    path = _path(entropy, rld, zero_density, uniqueness, t)
    return (
        F.when(path == "zero", F.concat(F.lit("Zero block detected (zero_density="), f3(zero_density), F.lit(f" ≥ {t.zero_density})")))
        .when(path == "random", F.concat(F.lit("Truly random/encrypted: entropy="), f3(entropy), F.lit(f" > {t.entropy_random} AND uniqueness="), f3(uniqueness), F.lit(f" > {t.uniqueness_random}")))
        .when(path == "runs", F.concat(F.lit("Run-length structure: rld="), f3(rld), F.lit(f" > {t.rld} (LZ4 handles runs efficiently)")))
        .when(path == "deep", F.concat(F.lit("LZ4HC fast-path: "), parts, F.lit(" (structured/low-diversity data → deep compression)")))
        .otherwise(F.concat(F.lit("Default structured path: entropy="), f3(entropy), F.lit(", rld="), f3(rld), F.lit(", uniqueness="), f3(uniqueness), F.lit(" (moderate data → LZ4HC deep compression)")))
    )


def decision(features: Column, t: Thresholds = Thresholds()) -> Column:
    """Codec, number, reason and confidence of a feature struct; missing features count as entropy 4, uniqueness 0.5, others 0."""
    h, r, z, u = (F.coalesce(features[k], F.lit(d)) for k, d in (("entropy", 4.0), ("run_length_density", 0.0), ("zero_density", 0.0), ("uniqueness", 0.5)))
    name = policy_codec(h, r, z, u, t)
    return F.struct(number(name, PIPELINE_ID).alias("codec_id"), name.alias("codec_name"), reason(h, r, z, u, t).alias("decision_reason"), confidence(h, r, z, u, t).alias("confidence"))


def number(name: Column, ids: dict[str, int] = CODEC_ID) -> Column:
    out = F.lit(None).cast("int")
    for k, v in ids.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def firmware_codec(entropy_fixed: Column, adjacent_equal: Column) -> Column:
    """The controller's choice. Its entropy is in whole bits and its limit in 256ths, so RAW is never chosen."""
    return F.when(entropy_fixed > 1920, RAW).when(adjacent_equal > 1638, LZ4).otherwise(LZ4HC)


def total_us(stages=STAGES) -> Column:
    return F.bround(sum((F.col(f"{s}_us") for s in stages[1:]), F.col(f"{stages[0]}_us")), 3)


def within_budget(total: Column) -> Column:
    return total <= TOTAL_BUDGET
