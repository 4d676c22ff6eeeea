"""The engine against fixed cases: the findings' arithmetic, as-of joins, mapping, ledger and plans."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tallywright.functions import scalars, signing
from tallywright.operators import access, detect, ingest, ledger, metric, scoring
from tallywright.operators.asof import asof_left
from tallywright.operators.detect import Rule
from tallywright.operators.latest import latest_wins
from tallywright.plans import catalogue
from tallywright.sources import files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return "null" if v is None else repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(sql.columns) == columns
    at = [sql.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in sql.fetchall())


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def outcome(df):
    return {r.scope_id: (r.severity, r.confidence_score, r.confidence_band, r.exposure_low, r.exposure_base, r.exposure_high) for r in df.collect()}


def test_source_mismatch_cases(spark):
    r = rows(spark, [("store-quiet", 0.03, 200, 7200), ("store-thin", 0.60, 5, 7200), ("store-medium", 0.08, 150, 7200), ("store-high", 0.22, 400, 7200), ("store-critical", 0.41, 90, 7200)], "scope_id string, value double, n long, age_seconds long")
    assert outcome(detect.source_mismatch(r, Rule("m"))) == {"store-medium": ("medium", 0.982, "high", 1800, 2640, 3720), "store-high": ("high", 0.949, "high", 13200, 19360, 27280), "store-critical": ("critical", 0.905, "high", 5550, 8140, 11470)}


def test_ratio_threshold_cases(spark):
    r = rows(spark, [("inside", 0.46, 600, 0), ("none", None, 600, 0), ("below", 0.33, 800, 0), ("far", 0.12, 450, 0)], "scope_id string, value double, n long, age_seconds long")
    assert outcome(detect.ratio_threshold(r, Rule("r"), 0.5, 0.4, None, 1250)) == {"below": ("medium", 1.0, "high", *[170000] * 3), "far": ("critical", 1.0, "high", *[213750] * 3)}


def test_attribution_cases(spark):
    r = rows(spark, [("healthy", 1.10, 900), ("soft", 0.62, 900), ("poor", 0.28, 1200)], "scope_id string, value double, n long")
    assert outcome(detect.attribution_comparison(r, Rule("a"))) == {"soft": ("medium", 0.829, "medium", 68, 137, 239), "poor": ("high", 0.829, "medium", 173, 346, 605)}


def test_funnel_cases(spark):
    r = rows(spark, [("healthy", [10000, 4200, 1100, 800]), ("checkout", [10000, 4200, 1100, 180]), ("top", [10000, 2100, 540, 400])], "scope_id string, counts array<long>").withColumn("n", F.lit(10000))
    got = detect.funnel_drop(r, Rule("f", least_observations=0), [("product_view", 0.40, 0.30), ("basket", 0.25, 0.18), ("order", 0.70, 0.55)], 4500)
    assert {k: (v[0], v[3]) for k, v in outcome(got).items()} == {"checkout": ("critical", 2655000), "top": ("medium", 8550000)}


def test_leakage_cases(spark):
    r = rows(spark, [("steady", 0.355, 0.36, 1000000, 1000000), ("fall", 0.28, 0.36, 600000, 1000000), ("leaking", 0.28, 0.36, 1200000, 1000000), ("creep", 0.33, 0.36, 1000000, 1000000)], "scope_id string, margin double, prior_margin double, revenue long, prior_revenue long").withColumn("n", F.lit(800))
    assert {k: (v[0], v[4]) for k, v in outcome(detect.financial_leakage(r, Rule("l"))).items()} == {"leaking": ("high", 96000), "creep": ("medium", 30000)}


def test_baseline_cases(spark):
    data = [("a", 0.30, 0.31, 600), ("b", 0.29, 0.30, 550), ("c", 0.31, 0.30, 700), ("d", 0.30, 0.29, 640), ("peer", 0.14, None, 480), ("both", 0.09, 0.28, 520)]
    got = outcome(detect.baseline_comparison(rows(spark, data, "scope_id string, value double, baseline_value double, n long"), Rule("b")))
    assert {k: v[:3] for k, v in got.items()} == {"peer": ("critical", 0.79, "high"), "both": ("critical", 0.88, "high")}


def test_quality_detector_cases(spark):
    r = rows(spark, [("complete", 1.0, 5000), ("short", 0.94, 5000), ("broken", 0.41, 5000)], "scope_id string, value double, n long")
    assert {k: v[:3] for k, v in outcome(detect.data_completeness(r, Rule("c", least_observations=1))).items()} == {"short": ("medium", 0.966, "high"), "broken": ("critical", 0.663, "medium")}
    f = rows(spark, [("ontime", 1800), ("late", 28800), ("very", 172800), ("never", None)], "scope_id string, age_seconds long")
    assert {k: v[0] for k, v in outcome(detect.source_freshness(f, Rule("f", least_observations=0))).items()} == {"late": "high", "very": "critical"}


def test_a_failed_run_has_no_candidates(spark):
    r = rows(spark, [("x", [10, 20, 5]), ("y", [10, 1, 0])], "scope_id string, counts array<long>").withColumn("n", F.lit(10))
    found, record = detect.run("funnel", lambda d, rule: detect.funnel_drop(d, rule, [("a", 0.5, 0.4), ("b", 0.5, 0.4)], 1), r, Rule("f", least_observations=0), detect.increasing_stages(r))
    assert found.count() == 0 and record.first().outcome == "failed"


def test_asof_takes_the_latest_snapshot_not_after(spark):
    t = lambda h, m=0: dt.datetime(2026, 8, 1, h, m)
    left = rows(spark, [("NS-014", "SKU-1", t(10), 35), ("NS-014", "NEVER", t(10), 3), ("NS-014", "SKU-1", t(11), 1)], "loc string, sku string, at timestamp, seen int")
    right = rows(spark, [("NS-014", "SKU-1", t(8), 50), ("NS-014", "SKU-1", t(9, 30), 42), ("NS-014", "SKU-1", t(11), 7)], "loc string, sku string, taken timestamp, system int")
    joined = asof_left(left, right, ["loc", "sku"], "at", "taken", ["system"])
    assert {(r.sku, r["at"].hour): r.system for r in joined.collect()} == {("SKU-1", 10): 42, ("NEVER", 10): None, ("SKU-1", 11): 7}
    plan = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_latest_wins(spark):
    d = rows(spark, [("o1", 1, 1000, 1), ("o1", 2, 1250, 1), ("o2", 1, 5, 1), ("o2", 1, 6, 2)], "id string, at int, amount int, version int")
    assert {r.id: r.amount for r in latest_wins(d, ["id"], "at", ("version",)).collect()} == {"o1": 1250, "o2": 6}


def test_pushdown_and_pruning(spark):
    plan = catalogue.QUERIES["window_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "props" not in plan


def test_rounding(spark):
    d = rows(spark, [("2.5",), ("3.5",)], "x string").select(F.col("x").cast("decimal(18,4)").alias("x"))
    one = F.lit(1).cast("decimal(18,4)")
    assert [r[0] for r in d.select(scoring.exposure([(F.col("x"), one, one)])[0]).collect()] == [3, 4]
    assert spark.range(1).select(scalars.to_minor_units(F.lit("19.99"))).first()[0] == 1999
    assert spark.range(1).select(scoring.freshness(F.lit(7200), 3600), scoring.freshness(F.lit(36000), 3600)).first()[:] == (0.5, 0.1)


def test_metric_refusals(spark):
    with pytest.raises(ValueError):
        metric.Metric("m", 1, "sum(x); drop table y", "s", ("a",), unit="count")
    for word in ("truncate", "revoke"):
        with pytest.raises(ValueError):
            metric.Metric("m", 1, f"sum(x) {word} y", "s", ("a",), unit="count")
    with pytest.raises(ValueError):
        metric.joined(metric.Metric("m", 1, "sum(x)", "s", ("a",), unit="count", joins=(("t", "b"),)), {"s": spark.range(1), "t": spark.range(1)})
    with pytest.raises(ValueError):
        metric.Metric("m", 1, "java_method(x)", "s", ("a",), unit="count")
    m = metric.Metric("m", 1, "sum(x)", "s", ("a",), unit="count")
    with pytest.raises(metric.DisallowedFilter):
        metric.query(m, spark.range(1), "1", filters={"b": "1"})
    with pytest.raises(ValueError):
        metric.query(m, spark.range(1), "")


def test_mapping_keeps_every_record(spark):
    d = rows(spark, [("1", " A ", "5"), ("2", None, "x"), (None, "b", "NaN")], "id string, sku string, q string")
    good, bad = ingest.split(ingest.apply_mapping(d, ingest.Mapping({"id": "id", "sku": "sku", "q": "q"}, {"sku": ("trim", "lower"), "q": ("to_decimal",)}, ("id",))))
    assert [r.sku for r in good.collect()] == ["a"] and bad.count() == 2
    with pytest.raises(ValueError):
        ingest.Mapping({"a": "a"}, {"a": ("eval",)})


def test_csv_irregularities():
    assert files.header(["a", "", "a", " b "]) == ["a", "column_2", "a_2", "b"]
    assert list(files.parse(b"")) == []
    assert list(files.parse("a|b\nü|2\n".encode())) == [(1, {"a": "ü", "b": "2"})]


def test_lifecycle_has_ten_edges(spark):
    assert ledger.transitions(spark).where("legal").count() == 10


def test_upsert_replay_changes_nothing(spark):
    from tallywright.plans import findings

    once = findings.after(spark, SF)
    twice = ledger.upsert(once, findings.second_run(spark, SF), F.lit(findings.SECOND_RUN).cast("timestamp_ntz"))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.select(*once.columns).collect()))


def test_hmac_is_the_standard_one(spark):
    import hashlib
    import hmac

    bodies = ["", "1.{}", "ünï"]
    data = rows(spark, [(b,) for b in bodies], "b string")
    for key in (b"k", b"\x00\xff" * 60):
        got = [r[0] for r in data.select(signing.hmac_sha256(key, F.encode("b", "UTF-8"))).collect()]
        assert got == [hmac.new(key, b.encode(), hashlib.sha256).hexdigest() for b in bodies]


def test_fingerprints_part_their_values(spark):
    data = rows(spark, [("a", "bc"), ("ab", "c"), (None, "x"), ("", "x")], "a string, b string")
    assert data.select(signing.fingerprint(F.col("a"), F.col("b")).alias("f")).distinct().count() == 4


def test_no_organization_sees_nothing(spark):
    data = rows(spark, [("1",), ("2",), (None,)], "o string")
    assert [access.scoped(data, "o", x).count() for x in ("1", None, "", "3")] == [1, 0, 0, 0]
