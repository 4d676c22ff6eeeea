"""Operators whose work is split: as-of joins of hot keys, exact quantiles without one group, suppression in one decision."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.operators import detect, ledger, quantile
from tallywright.operators.asof import asof_left
from tallywright.operators.detect import Rule
from tallywright.sources import overlay

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("slice_seconds", [None, 60, 3600, 86400])
def test_asof_by_slices_against_a_loop(spark, slice_seconds):
    r = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    at = lambda: start + dt.timedelta(minutes=r.randrange(6000))
    right = [(r.choice(["hot", "hot", "hot", "cold", None]), at(), i, i * 10) for i in range(300)]
    left = [(r.choice(["hot", "hot", "cold", "alone", None]), at(), i) for i in range(400)]
    got = asof_left(spark.createDataFrame(left, "k string, at timestamp, id int"), spark.createDataFrame(right, "k string, seen timestamp, tie int, v int"), ["k"], "at", "seen", ["v"], "tie", slice_seconds)
    want = {}
    for k, t, i in left:
        fits = [(s, tie, v) for q, s, tie, v in right if q == k and s <= t]
        want[i] = max(fits)[2] if fits else None
    assert {x.id: x.v for x in got.collect()} == want


def test_a_hot_key_is_many_tasks_work(spark):
    rows = spark.range(40_000).select(F.lit("hot").alias("k"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("at"), "id")
    sides = rows.where("id % 2 = 0"), rows.where("id % 2 = 1").withColumnsRenamed({"at": "seen", "id": "v"})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = asof_left(*sides, ["k"], "at", "seen", ["v"], slice_seconds=86400)
        parts = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert len(parts) == 4 and max(parts) < 12_000
        assert joined.where("v <> id - 1").count() == 0 and joined.where("v is null").count() == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_quantiles_are_exact(spark, share):
    g = np.random.default_rng(4)
    for values in ([], [1.5], [2.0, 1.0], [3.0] * 50, [1e-300, 1e300, -1e300], list(g.normal(size=999)), [round(x, 1) for x in g.normal(size=500)] + [1e9], list(g.integers(0, 5, 301) * 1.0)):
        rows = [(float(v),) for v in values] + [(None,), (float("nan"),)]
        n, got = quantile.exact_quantile(spark.createDataFrame(rows, "x double").repartition(3), "x", share)
        assert n == len(values)
        assert got == (pytest.approx(float(np.percentile(values, 100 * share)), rel=1e-12) if values else None)


def test_versions_of_orders_come_from_one_scan(spark):
    rows = overlay.raw_transactions(spark, SF)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("orders.parquet") == 1
    assert rows.count() == 1500 + sum(k % 11 == 0 for k in range(1500)) + sum(k % 7 == 0 for k in range(1500))


def test_scope_and_source_suppress_in_one_decision(spark):
    schema = "dedupe_key string, gap_type string, scope_type string, scope_id string, sources array<string>, confidence_band string, reason_codes string"
    found = [("a", "m", "user", "1", ["s1"], "high", "x"), ("b", "m", "user", "2", ["s2", "s3"], "high", "x"), ("c", "m", "user", "3", [], "high", "x"), ("d", "schema_drift", "user", "1", ["s2"], "high", "x"), ("e", "m", "user", "4", None, "high", "x")]
    gaps = [("schema_drift", "user", "1", ["s2"], "detected"), ("schema_drift", "user", "3", ["s9"], "resolved"), ("m", "user", "4", ["s2"], "detected"), ("data_completeness_drop", "user", "9", ["s2"], "triaged")]
    out = ledger.suppress(spark.createDataFrame(found, schema), spark.createDataFrame(gaps, "gap_type string, scope_type string, scope_id string, sources array<string>, status string")).collect()
    assert len(out) == 5
    assert {r.dedupe_key: (r.suppressed, r.confidence_band, r.reason_codes, r.cap_note) for r in out} == {
        "a": (True, "low", "x,suppressed_by_data_quality", "open data-quality gap of its scope"),
        "b": (True, "low", "x,suppressed_by_data_quality", "open data-quality gap of its source"),
        "c": (False, "high", "x", None),
        "d": (False, "high", "x", None),
        "e": (False, "high", "x", None),
    }


def test_windows_part_correlations(spark):
    rows = [("m", "user", "1", [], "w1", "w2"), ("n", "user", "1", [], "w1", "w2"), ("o", "user", "1", [], "w2", "w3"), ("p", "user", "2", ["k"], "w2", "w3"), ("q", "user", "3", ["k"], "w1", "w2")]
    found = spark.createDataFrame(rows, "gap_type string, scope_type string, scope_id string, correlation_keys array<string>, window_start string, window_end string")
    assert {(r.a, r.b) for r in ledger.correlate(found).collect()} == {("m:1", "n:1"), ("p:2", "q:3")}
    assert ("m:1", "o:1") in {(r.a, r.b) for r in ledger.correlate(found.drop("window_start", "window_end")).collect()}


def test_what_fails_a_run(spark):
    margins = spark.createDataFrame([("a", 0.1, 0.3, 5, 5, 50), ("b", 0.1, None, 5, 5, 50)], "scope_id string, margin double, prior_margin double, revenue long, prior_revenue long, n long")
    assert [r.scope_id for r in margins.where(detect.missing_figures()).collect()] == ["b"]
    changes = spark.createDataFrame([("a", "removed_field"), ("b", "renamed"), ("c", None)], "field string, drift_kind string")
    assert sorted(r.field for r in changes.where(detect.unknown_drift()).collect()) == ["b", "c"]
    assert Rule("x").least_observations == 30


def test_versions_of_parts_are_not_sent_to_all_tasks(spark):
    """A broadcast is built in the driver, whose memory it outgrew with eight versions of 1.2 million parts."""
    from tallywright.plans import governed

    sales = governed.scd2_cost(spark, SF)
    assert sales.where("cost_minor is not null").count() == sales.count() > 0
    assert "Broadcast" not in sales._jdf.queryExecution().executedPlan().toString()


def test_correlations_of_a_key_that_many_share(spark, monkeypatch):
    """Against a loop; pairs come once without being compared with each other, and no task has all findings of a key."""
    monkeypatch.setattr(ledger, "BLOCK", 7, raising=False)
    r = random.Random(5)
    rows = [(r.choice("mno"), "user", r.choice([None, *map(str, range(60))]), r.choice([None, [], ["k"], ["k", None], ["k", "q"], [f"r{r.randrange(9)}"]]), r.choice(["w1", "w2", None])) for _ in range(250)]
    found = spark.createDataFrame(rows, "gap_type string, scope_type string, scope_id string, correlation_keys array<string>, window_start string").withColumn("window_end", F.col("window_start"))
    want = set()
    for g, _, s, k, w in rows:
        for h, _, t, q, v in rows:
            shared = s is not None and s == t and w is not None and w == v or ({*(k or ())} - {None}) & {*(q or ())}
            a, b = ":".join(filter(None, (g, s))), ":".join(filter(None, (h, t)))
            if shared and a < b:
                want.add((a, b))
    pairs = ledger.correlate(found)
    got = sorted(map(tuple, pairs.collect()))
    assert got == sorted(want) and len(want) > 1000
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Distinct" not in plan and "Aggregate [a#" not in plan
