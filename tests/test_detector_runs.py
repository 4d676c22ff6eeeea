"""Detector runs: records, invariants, configurations and fingerprints."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallywright.operators import detect, detector_runs
from tallywright.operators.detect import Rule
from tallywright.operators.detector_runs import Config

SETTINGS = {"detector": "mismatch", "rule": Rule("m"), "metric_key": "rate", "query": "q", "window_start": "2026-08-01", "window_end": "2026-08-02", "thresholds": {"threshold": 0.05}}
READING = "scope_id string, value double, n long, age_seconds long"


def readings(spark, *rows):
    return spark.createDataFrame(list(rows), READING)


def one(spark, folder, config, data, find=detect.source_mismatch, invalid=None):
    outcome = detector_runs.run(spark, config, find, data, folder, invalid)
    (record,) = [r for r in detector_runs.records(spark, folder).collect() if r.run_id == config.run_id]
    assert record.outcome == outcome
    return record


def test_a_run_leaves_its_candidates_and_its_record(spark, tmp_path):
    config = Config.of(SETTINGS)
    data = readings(spark, ("quiet", 0.03, 200, 7200), ("thin", 0.60, 5, 7200), ("high", 0.22, 400, 7200), ("critical", 0.41, 90, 7200), ("unknown", None, 90, 7200))
    r = one(spark, str(tmp_path), config, data)
    assert (r.outcome, r.readings_considered, r.insufficient_readings, r.candidates_produced, r.errors) == ("succeeded", 5, 1, 2, [])
    assert r.query_hashes == [config.query_hash] and r.config_fingerprint == config.fingerprint
    found = detector_runs.published(spark, str(tmp_path), "evidence").collect()
    assert {x.scope_id: x.severity for x in found} == {"high": "high", "critical": "critical"}
    (e,) = found[0].evidence
    assert (e.metric_key, e.window_start, e.captured_at, e.dimensions) == ("rate", "2026-08-01", "2026-08-02", {"location": found[0].scope_id})
    one(spark, str(tmp_path), config, data)  # again: nothing is there twice
    assert detector_runs.published(spark, str(tmp_path)).count() == 2


def test_readings_are_read_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    data = readings(spark, *[(f"s{i}", 0.2, 100, 0) for i in range(50)])
    assert one(spark, str(tmp_path), Config.of(SETTINGS), data.mapInPandas(counted, READING)).candidates_produced == 50
    assert seen.value == 50


@pytest.mark.parametrize("fault", ["no_scope", "observed_is_expected"])
def test_one_faulty_candidate_fails_the_run(spark, tmp_path, fault):
    def find(r, rule):
        expected = F.when(F.col("scope_id") == "b", F.col("value")).otherwise(0.0) if fault == "observed_is_expected" else F.lit(0.0)
        scope = F.when(F.col("scope_id") == "b", " ").otherwise(F.col("scope_id")) if fault == "no_scope" else F.col("scope_id")
        return detect.candidates(r.withColumn("scope_id", scope), rule, F.col("value"), expected, F.lit("low"), {"detector_fit": F.lit(1.0)})

    config = Config.of(SETTINGS | {"thresholds": {}})
    r = one(spark, str(tmp_path), config, readings(spark, ("a", 0.5, 99, 0), ("b", 0.5, 99, 0)), find)
    assert (r.outcome, r.candidates_produced, r.query_hashes) == ("failed", 0, []) and fault in r.errors[0]
    assert r.readings_considered == 2
    assert detector_runs.published(spark, str(tmp_path)).count() == 0


def test_failures_and_switched_off_detectors_leave_records(spark, tmp_path):
    good = readings(spark, ("a", 0.5, 99, 0))
    r = one(spark, str(tmp_path), Config.of(SETTINGS | {"detector": "x"}), good, invalid=F.col("value") > 0.4)
    assert (r.outcome, r.errors, r.candidates_produced) == ("failed", ["1 invalid readings"], 0)
    r = one(spark, str(tmp_path), Config.of(SETTINGS | {"detector": "y"}), good.drop("value"))
    assert r.outcome == "failed" and "value" in r.errors[0] and "\n" not in r.errors[0]
    r = one(spark, str(tmp_path), Config.of(SETTINGS | {"detector": "z", "enabled": False}), good)
    assert (r.outcome, r.skipped_reason, r.readings_considered) == ("skipped", "detector disabled", 0)
    r = one(spark, str(tmp_path), Config.of(SETTINGS | {"detector": "none"}), good.limit(0))
    assert (r.outcome, r.readings_considered, r.candidates_produced) == ("succeeded", 0, 0)


def test_configurations_are_checked():
    with pytest.raises(ValueError, match="unknown settings"):
        Config.of(SETTINGS | {"treshold": 1})
    for wrong in ({"version": 0}, {"pack_key": ""}, {"window_end": "2026-08-01"}, {"rule": Rule("m", least_observations=-1)}, {"thresholds": {"lower": 0.5, "upper": 0.4}}, {"thresholds": {"high": 0.5, "critical": 0.4}}, {"thresholds": {"high": 0.4, "critical": 0.5}, "falling": True}):
        with pytest.raises(ValueError):
            Config.of(SETTINGS | wrong)
    assert Config.of(SETTINGS | {"thresholds": {"high": 0.5, "critical": 0.4}, "falling": True}).thresholds
    a, b = Config.of(SETTINGS), Config.of(SETTINGS | {"thresholds": {"threshold": 0.06}})
    assert a.fingerprint == Config.of(dict(SETTINGS)).fingerprint != b.fingerprint and a.query_hash == b.query_hash


def test_fingerprints_cover_every_part(spark):
    base = dict(gap_type="g", scope_type="location", scope_id="s", observed=0.5, expected=0.0, severity="low", confidence_score=0.9, confidence_band="high", exposure_low=1, exposure_base=2, exposure_high=3, reason_codes="a")
    schema = "gap_type string, scope_type string, scope_id string, observed double, expected double, severity string, confidence_score double, confidence_band string, exposure_low long, exposure_base long, exposure_high long, reason_codes string"
    rows = [base] + [base | {k: (v + 1 if isinstance(v, (int, float)) else v + "x")} for k, v in base.items()] + [base | {"exposure_low": None, "exposure_base": None, "exposure_high": None}]
    data = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    marks = [r[0] for c in (SETTINGS, SETTINGS | {"metric_key": "r2"}, SETTINGS | {"metric_version": 2}, SETTINGS | {"query": "p"}, SETTINGS | {"window_end": "2026-08-03"}, SETTINGS | {"unit": "units"}) for r in detector_runs.with_evidence(data, Config.of(c)).select("fingerprint").collect()]
    assert len(set(marks)) == len(marks) == 6 * 14
    assert len(set(r[0] for r in detector_runs.with_evidence(data.limit(1), Config.of(SETTINGS | {"currency": "EUR"})).select("fingerprint").collect()) | set(marks)) == len(marks) + 1
