"""Canonical tables, backfills, row policy and JSON documents."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from tallywright.functions import documents
from tallywright.operators import policy
from tallywright.sources import canonical
from tallywright.streaming import backfill

T = dt.datetime


@pytest.fixture
def database(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex[:10]}"
    canonical.create(spark, name, f"file://{tmp_path}/db")
    return name


def quarantine(spark, *rows):
    data = spark.createDataFrame(list(rows), "organization_id string, source_record_id string, at string")
    fixed = {c: F.lit("x") for c in ("run_id", "source_key", "resource", "lineage_ref")} | {"mapping_version": F.lit(1), "reason_flags": F.array(F.lit("out_of_range"))}
    return data.withColumns(fixed | {"occurred_at": F.col("at").cast("timestamp_ntz"), "ingested_at": F.col("at").cast("timestamp_ntz")}).drop("at")


def test_the_registry(spark, database):
    tables = canonical.registry()
    assert len(tables) == 12 and len(tables["fact_transaction"].columns) == 18
    assert tables["fact_transaction"].key == ("organization_id", "location_id", "occurred_at", "source_key", "source_record_id")
    assert dict((c, t) for c, t, _ in tables["fact_stock_check"].columns)["observed_quantity"] == "decimal(18,4)"
    assert {c for c, _, optional in tables["dim_location"].columns if optional} == {"region", "floor_area_sqm", "valid_to"}
    assert all(set(t.key) <= {c for c, _, _ in t.columns} and t.version in {c for c, _, _ in t.columns} for t in tables.values())
    assert {t.tableName for t in spark.sql(f"SHOW TABLES IN {database}").collect() if t.namespace == database} == set(tables)


def test_creating_twice_keeps_what_is_there(spark, database, tmp_path):
    canonical.load(quarantine(spark, ("1", "a", "2024-01-05")), database, "quarantine_record")
    statements = canonical.create(spark, database, f"file://{tmp_path}/db")
    assert len(statements) == 13 and spark.table(f"{database}.quarantine_record").count() == 1


def test_a_load_replaces_its_partitions_only(spark, database):
    rows = quarantine(spark, ("1", "a", "2024-01-05"), ("1", "b", "2024-02-05"), ("2", "c", "2024-01-05"))
    table = f"{database}.quarantine_record"
    for _ in range(2):
        canonical.load(rows, database, "quarantine_record")
        assert spark.table(table).count() == 3
    canonical.load(quarantine(spark, ("1", "d", "2024-01-09"), ("1", "e", "2024-01-10")), database, "quarantine_record")
    assert sorted(r.source_record_id for r in spark.table(table).collect()) == ["b", "c", "d", "e"]
    plan = spark.table(table).where("organization_id = '1' and month = '202401'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(organization_id" in plan and "(month" in plan.split("PartitionFilters")[1]


def test_rows_that_dont_fit_are_refused(spark, database):
    with pytest.raises(ValueError, match="lacks run_id"):
        canonical.load(quarantine(spark, ("1", "a", "2024-01-05")).drop("run_id"), database, "quarantine_record")
    with pytest.raises(Exception, match="quarantine_record.source_record_id is null"):
        canonical.load(quarantine(spark, ("1", None, "2024-01-05")), database, "quarantine_record")
    assert spark.table(f"{database}.quarantine_record").count() == 0


def test_dimensions_are_replaced_whole_and_versions_win(spark, database):
    def channel(*rows):
        return spark.createDataFrame([(o, c, n, "k", T(2024, 1, d)) for o, c, n, d in rows], "organization_id string, channel_id string, name string, kind string, updated_at timestamp_ntz")

    canonical.load(channel(("1", "a", "old", 1), ("1", "a", "new", 2), ("2", "a", "other", 1)), database, "dim_channel")
    assert {(r.organization_id, r.name) for r in canonical.latest(spark, database, "dim_channel").collect()} == {("1", "new"), ("2", "other")}
    canonical.load(channel(("1", "b", "only", 3)), database, "dim_channel")
    assert [r.name for r in spark.table(f"{database}.dim_channel").collect()] == ["only"]


# -- backfill


def test_windows_are_clipped():
    assert backfill.windows(T(2024, 1, 1, 6), T(2024, 1, 3, 1)) == [(T(2024, 1, 1, 6), T(2024, 1, 2, 6)), (T(2024, 1, 2, 6), T(2024, 1, 3, 1))]
    assert backfill.windows(T(2024, 1, 1), T(2024, 1, 1)) == []


def test_a_failed_window_keeps_what_it_had_and_the_others_go_on(spark, tmp_path):
    rows = spark.createDataFrame([(T(2024, 1, d, h), d * 10 + h) for d in (1, 2, 4) for h in (1, 2)], "ts timestamp_ntz, x int")
    spans = backfill.windows(T(2024, 1, 1), T(2024, 1, 5))
    child = lambda bad: lambda part: part.select(F.when(F.col("x") == bad, F.raise_error(F.lit("bad"))).otherwise(F.col("x")).cast("int").alias("x"))
    stored = lambda: sorted(r.x for r in spark.read.parquet(f"{tmp_path}/rows").collect())
    first = backfill.run(rows, "ts", spans, child(-1), str(tmp_path))
    assert [(r.outcome, r.records) for r in first.collect()] == [("succeeded", 2), ("succeeded", 2), ("succeeded", 0), ("succeeded", 2)]
    assert backfill.overall(first).first().outcome == "succeeded" and stored() == [11, 12, 21, 22, 41, 42]
    again = backfill.run(rows.withColumn("x", F.col("x") + 100), "ts", spans, child(122), str(tmp_path))
    told = again.collect()
    assert [r.outcome for r in told] == ["succeeded", "failed", "succeeded", "succeeded"] and told[1].error
    assert stored() == [21, 22, 111, 112, 141, 142]
    assert backfill.overall(again).first()[:] == ("partial", 4, 1, 4, T(2024, 1, 2))
    plan = rows.where(F.col("ts") >= F.lit(T(2024, 1, 1)).cast("timestamp_ntz"))
    assert plan.count() == 6


# -- row policy


def test_without_an_organization_nothing_is_seen(spark, tmp_path):
    rows = spark.createDataFrame([("1", i) for i in range(4)] + [("2", 9), (None, 5), ("", 6)], "organization_id string, x int")
    rows.write.parquet(f"{tmp_path}/t")
    policy.declare(spark)
    policy.secure(spark, f"{tmp_path}/t", "secured_t")
    assert spark.table("secured_t").count() == 0
    seen = {}
    for who in ("1", "2", "", None, "1' OR '1'='1"):
        policy.act_for(spark, who)
        seen[who] = spark.table("secured_t").count()
    assert seen == {"1": 4, "2": 1, "": 0, None: 0, "1' OR '1'='1": 0}
    policy.act_for(spark, "1")
    plan = spark.table("secured_t").where("x > 1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(organization_id,1)" in plan and "GreaterThan(x,1)" in plan
    with pytest.raises(ValueError):
        policy.secure(spark, "x", "view; drop table y")


def test_writes_are_checked_too(spark):
    rows = spark.createDataFrame([("1", 1), ("1", 2)], "organization_id string, x int")
    policy.declare(spark)
    policy.act_for(spark, "1")
    assert policy.admitted(spark, rows).count() == 2
    for who, data in (("1", rows.unionByName(spark.createDataFrame([("2", 3)], rows.schema))), ("1", spark.createDataFrame([(None, 3)], rows.schema)), (None, rows), ("2", rows)):
        policy.act_for(spark, who)
        with pytest.raises(Exception, match="another organization"):
            policy.admitted(spark, data).collect()
    policy.declare(spark)


# -- documents


def test_seven_kinds(spark):
    values = {"true": "boolean", "1": "integer", "1.5": "number", "1e300": "number", '"x"': "string", "[]": "array", '[1,"a"]': "array", "{}": "object", '{"a":1}': "object", "null": "null"}
    data = spark.createDataFrame([(v, k) for v, k in values.items()], "v string, k string")
    assert all(r.k == r.found for r in data.select("k", documents.kind(F.parse_json("v")).alias("found")).collect())
    assert data.select(documents.kind(F.try_variant_get(F.parse_json(F.lit("{}")), "$.a", "variant"))).first()[0] == "null"


def test_equal_documents_share_an_identity(spark):
    texts = ['{"b":{"y":[1,{"q":1,"p":2}],"x":"ü\\n"},"a":null}', ' {"a" : null, "b":{"x":"ü\\u000a","y":[1, {"p":2,"q":1}]}}', '{"a":null,"b":{"x":"ü\\n","y":[{"p":2,"q":1},1]}}', '{"a":', None, ""]
    data = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    ids = [r[1] for r in sorted(data.select("i", documents.identity(F.lit(None).cast("string"), F.col("t"))).collect())]
    assert ids[0] == ids[1] != ids[2] and ids[3].startswith("sha256:") and ids[4] is None and ids[5].startswith("sha256:")
    assert data.select(documents.canonical(F.col("t"))).first()[0] == '{"a":null,"b":{"x":"ü\\n","y":[1,{"p":2,"q":1}]}}'
    assert data.select(documents.identity(F.lit("n-1"), F.col("t"))).first()[0] == "n-1"


def test_fields_of_documents(spark):
    data = spark.createDataFrame([(2, '{"a":"x","b":1}'), (1, '{"a":1}'), (3, '{"b":2,"c":{"d":1}}'), (4, "broken"), (5, "[1]"), (6, None)], "i int, t string")
    got = {r.field: (r.type, r.documents, r.fits) for r in documents.fields(data, "t", "i").collect()}
    assert got["a"][:2] == ("integer", 2) and got["b"] == ("integer", 2, "BIGINT") and got["c"][:2] == ("object", 1)
