"""Detectors: pure functions from metric readings to gap candidates, all with the same columns.

A reading has scope_id, value, n (observations, may be null) and what a detector needs beside them. Unknown values are skipped, never taken as
zero. A reading that breaks a detector's assumptions makes its whole run fail: run() then returns no candidates, and the
run's record says why.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scoring

COLUMNS = ("gap_type", "scope_type", "scope_id", "observed", "expected", "severity", "confidence_score", "confidence_band", "exposure_low", "exposure_base", "exposure_high", "reason_codes")


@dataclass(frozen=True)
class Rule:
    """What all detectors share; the fields are the detectors' thresholds."""

    gap_type: str
    scope_type: str = "location"
    rule_id: str = "rule-1"
    least_observations: int = 30
    latency_seconds: float = 86400.0


def sufficient(rule: Rule) -> Column:
    return F.lit(rule.least_observations == 0) | F.coalesce(F.col("n") >= rule.least_observations, F.lit(False))


def severity(x: Column, *steps: tuple[str, float], otherwise: str = "medium", falling: bool = False) -> Column:
    """The first step that x reaches (or, falling, doesn't exceed)."""
    out = F
    for name, limit in steps:
        out = out.when(x <= limit if falling else x >= limit, name)
    return out.otherwise(otherwise)


def candidates(df: DataFrame, rule: Rule, observed: Column, expected: Column, level: Column, components: dict[str, Column], exposure: list[Column] | None = None, reasons: Column | None = None, attribution: bool = False) -> DataFrame:
    money = exposure or [F.lit(None).cast("long")] * 3
    codes = [reasons if reasons is not None else F.array().cast("array<string>")]
    if exposure is not None:
        codes.append(F.array(F.lit("modelled_exposure")))
    if attribution:
        codes.append(F.array(F.lit("attribution_limited")))
    return df.where(observed.isNotNull()).select(
        F.lit(rule.gap_type).alias("gap_type"),
        F.lit(rule.scope_type).alias("scope_type"),
        F.col("scope_id"),
        observed.cast("double").alias("observed"),
        expected.cast("double").alias("expected"),
        level.alias("severity"),
        F.round(scoring.score(components), 3).alias("confidence_score"),
        scoring.band(scoring.band_rank(components, attribution)).alias("confidence_band"),
        *[m.alias(n) for m, n in zip(money, ("exposure_low", "exposure_base", "exposure_high"), strict=True)],
        F.array_join(F.array_sort(F.array_distinct(F.concat(*codes))), ",").alias("reason_codes"),
    )


def dec(x: float) -> Column:
    return F.lit(str(x)).cast("decimal(18,4)")


# The default thresholds, shares and margins of the detectors below.
def source_mismatch(readings: DataFrame, rule: Rule, threshold: float = 0.05, critical: float = 0.30, high: float = 0.15, margins: tuple[int, int, int] = (150, 220, 310)) -> DataFrame:
    """Two sources disagree about more than threshold of the observations."""
    v, n = F.col("value"), F.col("n")
    units = F.bround(v.cast("decimal(18,6)") * n, 0)
    fit = {"sample_size": scoring.sample_size(n, rule.least_observations), "detector_fit": F.lit(1.0), "source_agreement": F.greatest(F.lit(0.0), 1 - v), "freshness": scoring.freshness(F.col("age_seconds"), rule.latency_seconds)}
    rows = readings.where(sufficient(rule) & (v > threshold))
    return candidates(rows, rule, v, F.lit(0.0), severity(v, ("critical", critical), ("high", high)), fit, [(units * m).cast("long") for m in margins], F.array(F.lit("source_disagreement")))


def ratio_threshold(readings: DataFrame, rule: Rule, expected: float, lower: float | None = None, upper: float | None = None, per_unit: int | None = None) -> DataFrame:
    """A ratio left its band; severity follows how far, relative to the bound it crossed."""
    v, n = F.col("value"), F.col("n")
    below = (v < lower) if lower is not None else F.lit(False)
    above = (v > upper) if upper is not None else F.lit(False)
    excess = F.when(below, (lower - v) / lower if lower else F.lit(0.0)).when(above, (v - upper) / upper if upper else F.lit(0.0))
    fit = {"sample_size": scoring.sample_size(n, rule.least_observations), "detector_fit": F.lit(1.0), "freshness": scoring.freshness(F.col("age_seconds"), rule.latency_seconds)}
    money = None
    if per_unit is not None:
        money = [(F.bround(F.abs(v.cast("decimal(18,6)") - dec(expected)) * n, 0) * per_unit).cast("long")] * 3
    rows = readings.where(sufficient(rule) & (below | above))
    return candidates(rows, rule, v, F.lit(expected), severity(excess, ("critical", 0.5), ("high", 0.25)), fit, money, F.array(F.when(below, "ratio_below_band").otherwise("ratio_above_band")))


def baseline_comparison(readings: DataFrame, rule: Rule, drop: float = 0.15, least_peers: int = 5) -> DataFrame:
    """A value fell behind its own past or the exact median of its peers; the worse of both counts, its own past on a tie."""
    rows = readings.where(sufficient(rule) & F.col("value").isNotNull())
    peers = rows.agg(F.expr("percentile(value, 0.5)").alias("peer_median"), F.count("*").alias("peers"))  # one row
    both = rows.join(F.broadcast(peers))
    v, base, median = F.col("value"), F.col("baseline_value"), F.col("peer_median")
    own = F.when((base > 0) & ((base - v) / base >= drop), (base - v) / base)
    peer = F.when((F.col("peers") >= least_peers) & (median > 0) & ((median - v) / median >= drop), (median - v) / median)
    own_first = own.isNotNull() & (peer.isNull() | (own >= peer))
    worst = F.when(own_first, own).otherwise(peer)
    fit = {
        "sample_size": scoring.sample_size(F.col("n"), rule.least_observations),
        "detector_fit": F.when(own.isNotNull() & peer.isNotNull(), 1.0).otherwise(0.7),
        "source_agreement": F.when(peer.isNotNull(), F.least(F.lit(1.0), F.col("peers") / (2.0 * least_peers))),
    }
    reasons = F.filter(F.array(F.when(own.isNotNull(), "below_own_baseline"), F.when(peer.isNotNull(), "below_peer_group")), lambda x: x.isNotNull())
    return candidates(both.where(worst.isNotNull()), rule, v, F.when(own_first, base).otherwise(median), severity(worst, ("critical", 0.5), ("high", 0.3)), fit, None, reasons)


def attribution_comparison(readings: DataFrame, rule: Rule, expected: float = 1.0, threshold: float = 0.8, high: float = 0.5, critical: float | None = None, shares: tuple[float, float, float] = (0.2, 0.4, 0.7)) -> DataFrame:
    """Fewer outcomes than the attribution says there should be; confidence is never more than medium."""
    v, n = F.col("value"), F.col("n")
    missing = F.bround((dec(expected) - v.cast("decimal(18,6)")) * n, 0)
    fit = {"sample_size": scoring.sample_size(n, rule.least_observations), "detector_fit": F.lit(0.6)}
    steps = ([("critical", critical)] if critical is not None else []) + [("high", high)]
    rows = readings.where(sufficient(rule) & (v < threshold))
    return candidates(rows, rule, v, F.lit(expected), severity(v, *steps, falling=True), fit, [F.round(missing * dec(s), 0).cast("long") for s in shares], F.array(F.lit("below_attributed_share")), attribution=True)


def funnel_drop(readings: DataFrame, rule: Rule, stages: list[tuple[str, float, float]], value_per_unit: int) -> DataFrame:
    """The worst step of a funnel whose survival fell below its threshold. stages: (name, expected, threshold) of each step after the first.

    readings: scope_id, n, counts (array, one for each stage).
    """
    steps = []
    for i, (name, expected, threshold) in enumerate(stages):
        entered, left = F.col("counts")[i], F.col("counts")[i + 1]
        survival = left / F.nullif(entered, F.lit(0)).cast("double")
        steps.append(F.when(survival < threshold, F.struct((expected - survival).alias("shortfall"), F.lit(-i).alias("order"), F.lit(name).alias("stage"), F.lit(expected).alias("expected"), survival.alias("survival"), entered.alias("entered"))))
    worst = readings.where(sufficient(rule) & (F.col("counts")[0] > 0)).withColumn("w", F.array_max(F.filter(F.array(*steps), lambda s: s.isNotNull()))).where("w is not null")
    w = F.col("w")
    units = F.bround((w["expected"].cast("decimal(18,6)") - F.round(w["survival"], 6).cast("decimal(18,6)")) * w["entered"], 0)
    fit = {"sample_size": scoring.sample_size(w["entered"], max(1, rule.least_observations)), "detector_fit": F.lit(1.0)}
    return candidates(worst, rule, F.round(w["survival"], 6), w["expected"], severity(w["shortfall"], ("critical", 0.4), ("high", 0.2)), fit, [(units * value_per_unit).cast("long")] * 3, F.array(F.concat(F.lit("stage_"), w["stage"])))


def increasing_stages(readings: DataFrame) -> DataFrame:
    """Readings that break the funnel's assumption and so fail its run."""
    return readings.where(F.exists(F.sequence(F.lit(0), F.size("counts") - 2), lambda i: F.col("counts")[i + 1] > F.col("counts")[i]))


def financial_leakage(readings: DataFrame, rule: Rule, least_drop: float = 0.02, band: float = 0.02, allowed: tuple[str, ...] = ("up", "flat")) -> DataFrame:
    """Margin fell while revenue didn't. readings: margin, prior_margin, revenue, prior_revenue (minor units)."""
    drop = F.round(F.col("prior_margin") - F.col("margin"), 6)
    now, then = F.col("revenue"), F.col("prior_revenue")
    shape = F.when(then <= 0, "flat").when(now > then * (1 + band), "up").when(now < then * (1 - band), "down").otherwise("flat")
    fit = {"sample_size": scoring.sample_size(F.col("n"), rule.least_observations), "detector_fit": F.lit(1.0), "completeness": F.lit(1.0)}
    rows = readings.where(sufficient(rule) & (drop >= least_drop) & shape.isin(*allowed))
    lost = F.round(now.cast("decimal(20,0)") * drop.cast("decimal(10,6)"), 0).cast("long")
    return candidates(rows, rule, F.col("margin"), F.col("prior_margin"), severity(drop, ("critical", 0.10), ("high", 0.05)), fit, [lost] * 3, F.array(F.concat(F.lit("revenue_"), shape))).withColumn("reason_codes", F.regexp_replace("reason_codes", "modelled_exposure,", ""))


def missing_figures() -> Column:
    """Readings of margins that lack a figure, and so fail their run."""
    return F.col("margin").isNull() | F.col("prior_margin").isNull() | F.col("revenue").isNull() | F.col("prior_revenue").isNull() | F.col("n").isNull()


def unknown_drift() -> Column:
    """Changes of a kind that nobody knows, which fail their run."""
    return ~F.coalesce(F.col("drift_kind").isin("removed_field", "type_change", "new_field"), F.lit(False))


def data_completeness(readings: DataFrame, rule: Rule, least: float = 0.98) -> DataFrame:
    v = F.col("value")
    rows = readings.where(sufficient(rule) & (v < least))
    return candidates(rows, rule, v, F.lit(1.0), severity(v, ("critical", 0.70), ("high", 0.90), falling=True), {"detector_fit": F.lit(1.0), "completeness": v}, None, F.array(F.lit("incomplete_delivery")))


def source_freshness(readings: DataFrame, rule: Rule, latency_seconds: int = 3600, tolerance: float = 2.0) -> DataFrame:
    age = F.col("age_seconds")
    overdue = age / float(latency_seconds)
    rows = readings.where(age > latency_seconds * tolerance)
    return candidates(rows, rule, age.cast("long"), F.lit(latency_seconds), severity(overdue, ("critical", 12.0), ("high", 4.0)), {"detector_fit": F.lit(1.0)}, None, F.array(F.lit("late_source")))


def schema_changes(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """field, drift_kind of what differs between two tables of (field, type)."""
    both = declared.withColumnRenamed("type", "was").join(observed.withColumnRenamed("type", "is"), "field", "full_outer")
    kind = F.when(F.col("is").isNull(), "removed_field").when(F.col("was").isNull(), "new_field").when(F.col("was") != F.col("is"), "type_change")
    return both.select("field", kind.alias("drift_kind")).where("drift_kind is not null")


def schema_drift(changes: DataFrame, rule: Rule) -> DataFrame:
    level = F.when(F.col("drift_kind") == "removed_field", "critical").when(F.col("drift_kind") == "type_change", "high").otherwise("low")
    rows = changes.withColumn("scope_id", F.col("field"))
    return candidates(rows, rule, F.lit(1), F.lit(0), level, {"detector_fit": F.lit(1.0)}, None, F.array(F.col("drift_kind")))


def run(name: str, detect, readings: DataFrame, rule: Rule, invalid: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, record): a run with an invalid reading gives no candidates and an error; every run leaves one record."""
    found = detect(readings, rule)
    wrong = (invalid if invalid is not None else readings.limit(0)).agg((F.count("*") > 0).alias("failed"))
    found = found.join(F.broadcast(wrong)).where(~F.col("failed")).drop("failed")  # one row
    counts = readings.agg(F.count("*").alias("considered"), F.count_if(~sufficient(rule)).alias("insufficient"))
    record = counts.join(F.broadcast(found.agg(F.count("*").alias("candidates")))).join(F.broadcast(wrong))
    outcome = F.when(F.col("failed"), "failed").otherwise("succeeded")
    return found, record.select(F.lit(name).alias("detector"), "considered", "insufficient", "candidates", outcome.alias("outcome"))
