"""The nine detectors as runs: their records and what they publish."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import detect, detector_runs
from ..operators.detector_runs import Config
from ..streaming.once import working_dir
from . import detection as d
from .admission import _part

WINDOW = ("2024-01-01", d.AS_OF)
#: detector: rule, metric, what its readings are counted by, thresholds, whether low values are the bad ones.
SETTINGS = {
    "source_mismatch": (d.MISMATCH, "error_rate", "errors / events by user", {"threshold": 0.05, "high": 0.15, "critical": 0.30}, False),
    "ratio_threshold": (d.RATIO, "error_rate", "errors / events by user", {"expected": 0.2, "lower": 0.15, "upper": 0.25, "per_unit": 1250}, False),
    "baseline_comparison": (d.BASELINE, "purchase_share", "purchases / events by user and half", {"drop": 0.15, "least_peers": 5}, False),
    "attribution_comparison": (d.ATTRIBUTION, "purchases_by_clicks", "purchases / clicks by user", {"expected": 1.0, "threshold": 0.8, "high": 0.5}, True),
    "funnel_drop": (d.FUNNEL, "funnel", "events by stage and location", {"stages": d.STAGES, "value_per_unit": 4500}, False),
    "financial_leakage": (d.LEAKAGE, "margin", "discounts by brand, size and year", {"least_drop": 0.02, "band": 0.02}, False),
    "data_completeness": (d.COMPLETENESS, "completeness", "accepted / total by source", {"least": 0.98}, False),
    "source_freshness": (d.FRESHNESS, "newest_record", "latest event by source", {"latency_seconds": 3600, "tolerance": 2.0}, False),
    "schema_drift": (d.DRIFT, "declared_fields", "declared against observed fields", {}, False),
}
READINGS = {
    "source_mismatch": d.error_rates, "ratio_threshold": d.error_rates, "baseline_comparison": d.halves, "attribution_comparison": d.purchases_by_clicks, "funnel_drop": d.funnels,
    "financial_leakage": d.margins, "data_completeness": d.completeness, "source_freshness": d.source_ages, "schema_drift": lambda spark, sf_dir: d.drift(spark, sf_dir).withColumn("n", F.lit(1)),
}


def config(name: str, **more) -> Config:
    rule, metric, query, thresholds, falling = SETTINGS[name]
    return Config.of({"detector": name, "rule": rule, "metric_key": metric, "query": query, "window_start": WINDOW[0], "window_end": WINDOW[1], "thresholds": thresholds, "falling": falling} | more)


def rising_stages() -> F.Column:
    """A funnel in which a later stage has more is no funnel."""
    return F.exists(F.sequence(F.lit(0), F.size("counts") - 2), lambda i: F.col("counts")[i + 1] > F.col("counts")[i])


#: Which readings fail a run.
INVALID = {"funnel_drop": rising_stages, "schema_drift": detect.unknown_drift}


def all_runs(spark, sf_dir) -> str:
    """The folder of a run of each detector; of one over readings that aren't a funnel, one that finds what it expects, one that lacks a column, and one that is disabled."""
    folder = f"{working_dir(spark)}/detectors"
    for name in SETTINGS:
        detector_runs.run(spark, config(name), getattr(detect, name), READINGS[name](spark, sf_dir), folder, INVALID[name]() if name in INVALID else None)
    backwards = d.funnels(spark, sf_dir).withColumn("counts", F.reverse("counts"))
    detector_runs.run(spark, config("funnel_drop", detector="funnel_reversed"), detect.funnel_drop, backwards, folder, rising_stages())
    partly = d.margins(spark, sf_dir).withColumn("prior_margin", F.when(F.col("scope_id") >= "Brand#2", F.col("prior_margin")))
    detector_runs.run(spark, config("financial_leakage", detector="leakage_incomplete"), detect.financial_leakage, partly, folder, detect.missing_figures())
    odd = READINGS["schema_drift"](spark, sf_dir).withColumn("drift_kind", F.when(F.col("field") == "props", "renamed").otherwise(F.col("drift_kind")))
    detector_runs.run(spark, config("schema_drift", detector="drift_unknown"), detect.schema_drift, odd, folder, detect.unknown_drift())
    nothing_new = lambda r, rule: detect.candidates(r, rule, F.col("value"), F.col("value"), F.lit("low"), {"detector_fit": F.lit(1.0)})
    detector_runs.run(spark, config("source_mismatch", detector="no_difference", thresholds={}), nothing_new, d.error_rates(spark, sf_dir), folder)
    detector_runs.run(spark, config("source_mismatch", detector="no_value"), detect.source_mismatch, d.error_rates(spark, sf_dir).drop("value"), folder)
    detector_runs.run(spark, config("source_freshness", detector="switched_off", enabled=False), detect.source_freshness, d.source_ages(spark, sf_dir), folder)
    return folder


def detector_run_records(spark, sf_dir):
    """Every run's record, without its duration; errors without their details."""
    r = detector_runs.records(spark, all_runs(spark, sf_dir))
    return r.select(
        "detector", "rule_id", "rule_version", "config_fingerprint", "window_start", "window_end", "readings_considered", "insufficient_readings", "candidates_produced", "outcome",
        F.size("errors").alias("errors"), "skipped_reason", F.array_join("query_hashes", ",").alias("query_hashes"), "thresholds",
    )


def run_candidates(spark, sf_dir):
    """What the runs publish, with the digest of each candidate."""
    found = detector_runs.published(spark, all_runs(spark, sf_dir), "fingerprint", "evidence")
    return found.select("detector", "scope_id", "severity", "fingerprint", F.size("evidence").alias("evidence"), F.element_at(F.col("evidence")[0]["dimensions"], F.col("scope_type")).alias("measured_at"))


QUERIES = {f.__name__: f for f in (detector_run_records, run_candidates)}

_SQL = {
    "source_mismatch": "det_source_mismatch", "ratio_threshold": "det_ratio_threshold", "baseline_comparison": "det_baseline_comparison", "attribution_comparison": "det_attribution", "funnel_drop": "det_funnel_drop",
    "financial_leakage": "det_financial_leakage", "data_completeness": "det_completeness", "source_freshness": "det_freshness", "schema_drift": "det_schema_drift",
}


def _candidates_sql(name: str) -> str:
    c = config(name)
    text = lambda x: f"CAST({x} AS VARCHAR)"
    lit = lambda x: f"'{x}'"
    parts = [
        "gap_type", "scope_type", "scope_id", lit(c.metric_key), lit(c.metric_version), text("observed"), text("expected"), lit(c.unit), "severity", text("confidence_score"), "confidence_band",
        text("exposure_low"), text("exposure_base"), text("exposure_high"), f"CASE WHEN exposure_base IS NOT NULL THEN '{c.currency}' END", "reason_codes",
        lit(f"{c.metric_key}@v{c.metric_version}:{c.query_hash}"), lit(c.window_start), lit(c.window_end),
    ]
    digest = " || ".join(_part(p) for p in parts)
    return f"SELECT '{name}' AS detector, scope_id, severity, sha256({digest}) AS fingerprint, 1 AS evidence, scope_id AS measured_at FROM ({d.ORACLE_SQL[_SQL[name]]})"


_READINGS_SQL = {
    "source_mismatch": (d.RATES, "n < 30"), "ratio_threshold": (d.RATES, "n < 30"), "baseline_comparison": (d.HALVES, "n < 20"),
    "attribution_comparison": ("(SELECT user_id, count(*) FILTER (event_type = 'click') AS n FROM events GROUP BY 1)", "n < 5"), "funnel_drop": (d.FUNNELS, "false"), "financial_leakage": (d.MARGINS, "n < 30"),
    "data_completeness": (f"(WITH {d.QUALITY} SELECT organization_id, source_key, sum(total_records) AS n FROM dq GROUP BY 1, 2)", "n < 1"), "source_freshness": (d.AGES, "false"), "schema_drift": (d.DRIFTS, "false"),
}


def _record_sql(name: str, c: Config, source: str, insufficient: str, outcome: str, skipped: str = "NULL") -> str:
    ok = outcome == "succeeded"
    n = f"(SELECT count(*) FROM ({_candidates_sql(name)}))" if ok else "0"
    hashes = f"CASE WHEN {n} > 0 THEN '{c.query_hash}' ELSE '' END" if ok else "''"
    read = "count(*)" if source else "0"
    few = f"count(*) FILTER ({insufficient})" if source else "0"
    return f"""SELECT '{c.detector}' AS detector, '{c.rule.rule_id}' AS rule_id, {c.version} AS rule_version, '{c.fingerprint}' AS config_fingerprint, '{c.window_start}' AS window_start, '{c.window_end}' AS window_end,
  {read} AS readings_considered, {few} AS insufficient_readings, {n} AS candidates_produced, '{outcome}' AS outcome, {1 if outcome == 'failed' else 0} AS errors, {skipped} AS skipped_reason, {hashes} AS query_hashes,
  '{json.dumps(c.thresholds, sort_keys=True)}' AS thresholds {f'FROM {source}' if source else ''}"""


def _records_sql() -> str:
    rows = [_record_sql(name, config(name), *_READINGS_SQL[name], "succeeded") for name in SETTINGS]
    rows.append(_record_sql("", config("funnel_drop", detector="funnel_reversed"), d.FUNNELS, "false", "failed"))
    rows.append(_record_sql("", config("financial_leakage", detector="leakage_incomplete"), d.MARGINS, "n < 30", "failed"))
    rows.append(_record_sql("", config("schema_drift", detector="drift_unknown"), d.DRIFTS, "false", "failed"))
    rows.append(_record_sql("", config("source_mismatch", detector="no_difference", thresholds={}), d.RATES, "n < 30", "failed"))
    rows.append(_record_sql("", config("source_mismatch", detector="no_value"), "", "", "failed"))
    rows.append(_record_sql("", config("source_freshness", detector="switched_off", enabled=False), "", "", "skipped", "'detector disabled'"))
    return " UNION ALL ".join(f"({r})" for r in rows)


ORACLE_SQL = {"detector_run_records": _records_sql(), "run_candidates": " UNION ALL ".join(f"({_candidates_sql(n)})" for n in SETTINGS)}
