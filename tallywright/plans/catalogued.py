"""The canonical catalogue, backfills by window, row policy and JSON documents as queries."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import documents
from ..operators import policy
from ..sources import canonical, overlay
from ..streaming import backfill
from ..streaming.once import working_dir
from .governed import TX

#: The organization whose partitions are loaded again, with doubled amounts.
AGAIN = "2"


def loaded(spark, sf_dir) -> str:
    """A database with all canonical tables, four of them loaded; one organization's transactions are loaded a second time."""
    database, top = f"canonical_{uuid.uuid4().hex[:12]}", working_dir(spark)
    canonical.create(spark, database, top)
    lineage = {"source_connection_id": F.lit("c-1"), "data_quality_flags": F.array().cast("array<string>"), "received_at": F.lit(None).cast("timestamp_ntz")}
    sold = overlay.raw_transactions(spark, sf_dir).withColumns(lineage | {"line_count": F.lit(1)})
    canonical.load(sold, database, "fact_transaction")
    canonical.load(sold.where(F.col("organization_id") == AGAIN).withColumn("amount_minor", F.col("amount_minor") * 2), database, "fact_transaction")
    seen = lineage | {"source_key": F.lit("events"), "source_record_id": F.col("event_id").cast("string"), "lineage_ref": F.concat(F.lit("events/"), "event_id"), "mapping_version": F.lit(1), "ingested_at": F.col("occurred_at"), "product_variant_id": F.col("variant_id")}
    canonical.load(overlay.snapshots(spark, sf_dir).withColumns(seen).withColumnRenamed("quantity", "system_quantity"), database, "fact_inventory_snapshot")
    canonical.load(overlay.checks(spark, sf_dir).withColumns(seen | {"check_id": F.col("event_id").cast("string")}).withColumnRenamed("quantity", "observed_quantity"), database, "fact_stock_check")
    refused = {"run_id": F.lit("run-1"), "resource": F.lit("events"), "lineage_ref": F.concat(F.lit("events/"), "source_record_id"), "mapping_version": F.lit(1), "ingested_at": F.col("occurred_at")}
    canonical.load(overlay.quarantined(spark, sf_dir).withColumns(refused), database, "quarantine_record")
    return database


def canonical_catalogue(spark, sf_dir):
    """Every canonical table: its shape, what identifies a row, how it is parted, and how many rows it holds."""
    database, rows = loaded(spark, sf_dir), None
    for t in canonical.registry().values():
        shape = [F.lit(t.name).alias("name"), F.lit(len(t.columns)).alias("columns"), F.lit(",".join(t.key)).alias("key"), F.lit(",".join(t.partitions)).alias("parted_by"), F.lit(t.version).alias("version"), F.lit(t.ttl_days).cast("int").alias("ttl_days")]
        one = spark.table(f"{database}.{t.name}").agg(F.count("*").alias("records")).select(*shape, "records")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def canonical_months(spark, sf_dir):
    """Latest transactions by organization and month, from the partitions."""
    rows = canonical.latest(spark, loaded(spark, sf_dir), "fact_transaction")
    return rows.groupBy("organization_id", "month").agg(F.count("*").alias("transactions"), F.sum("amount_minor").alias("amount_minor"))


def event_span(spark, sf_dir) -> tuple[DataFrame, list]:
    e = overlay.table(spark, sf_dir, "events")
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    return e, backfill.windows(low.replace(minute=0, second=0, microsecond=0), high + dt.timedelta(microseconds=1)) if low else []


def footfall(part: DataFrame) -> DataFrame:
    """Counts by location of a window; a record that can't be is an error."""
    bad = F.when(F.col("event_id") % 4999 == 77, F.raise_error(F.lit("a record that can't be"))).otherwise(F.col("user_id") % 25)
    return part.groupBy(bad.cast("string").alias("location_id")).agg(F.count("*").alias("visitors"))


def backfill_windows(spark, sf_dir):
    """A child run for each day of the events; days with a record that can't be fail by themselves."""
    e, spans = event_span(spark, sf_dir)
    done = backfill.run(e, "ts", spans, footfall, working_dir(spark))
    return done.select("window_start", "window_end", "outcome", "records")


def backfill_outcome(spark, sf_dir):
    e, spans = event_span(spark, sf_dir)
    return backfill.overall(backfill.run(e, "ts", spans, footfall, working_dir(spark)))


#: What a session may act for: an organization, none, nobody known.
SESSIONS = ("1", "3", "", None, "nobody")


def policy_rows(spark, sf_dir):
    """Rows of three secured tables that each session sees."""
    top, out = working_dir(spark), None
    tables = {
        "stock_checks": overlay.checks(spark, sf_dir).select("organization_id", "event_id"),
        "quarantine": overlay.quarantined(spark, sf_dir).select("organization_id", "source_key"),
        "transactions": overlay.raw_transactions(spark, sf_dir).select("organization_id", "transaction_id"),
    }
    policy.declare(spark)
    for name, rows in tables.items():
        rows.write.parquet(f"{top}/{name}")
        policy.secure(spark, f"{top}/{name}", f"secured_{name}")
    for session in SESSIONS:
        policy.act_for(spark, session)
        for name in tables:
            one = spark.table(f"secured_{name}").agg(F.lit(session if session is not None else "(not set)").alias("session"), F.lit(name).alias("seen"), F.count("*").alias("records"), F.count_if(F.col("organization_id") != (session or "")).alias("foreign"))
            out = one if out is None else out.unionByName(one)
    policy.declare(spark)
    return out


def bodies(spark, sf_dir) -> DataFrame:
    """Events as documents: a field of each kind, keys in two orders, some broken."""
    i, k = F.col("event_id"), F.get_json_object("props", "$.k")
    value = F.element_at(F.array(F.lit("true"), k, F.concat(k, F.lit(".5")), F.lit('"x"'), F.concat(F.lit("[1,"), k, F.lit("]")), F.concat(F.lit('{"b":2,"a":'), k, F.lit("}")), F.lit("null")), (i % 7 + 1).cast("int"))
    forth = F.concat(F.lit('{"v":'), value, F.lit(', "k":'), k, F.lit("}"))
    back = F.concat(F.lit('{ "k" :'), k, F.lit(',"v":'), F.when(i % 7 == 5, F.concat(F.lit('{"a":'), k, F.lit(',"b":2}'))).otherwise(value), F.lit("}"))
    return overlay.table(spark, sf_dir, "events").select("event_id", F.when(i % 31 == 0, '{"k":').when(i % 2 == 0, forth).otherwise(back).alias("body"), k.cast("long").alias("k"))


def json_kinds(spark, sf_dir):
    """Documents by the kind of a field's value."""
    value = F.try_variant_get(F.try_parse_json("body"), "$.v", "variant")
    rows = bodies(spark, sf_dir).where(F.try_parse_json("body").isNotNull())
    return rows.groupBy(documents.kind(value).alias("kind")).agg(F.count("*").alias("n"))


def json_fields(spark, sf_dir):
    return documents.fields(bodies(spark, sf_dir), "body", "event_id").select("field", "type", "documents", (F.col("fits") == "BIGINT").alias("all_integers"))


def json_identity(spark, sf_dir):
    """Identities of documents: those that differ only in the order of keys share one."""
    return bodies(spark, sf_dir).select("event_id", documents.identity(F.lit(""), F.col("body")).alias("record_id"))


QUERIES = {f.__name__: f for f in (canonical_catalogue, canonical_months, backfill_windows, backfill_outcome, policy_rows, json_kinds, json_fields, json_identity)}

_SHAPES = ", ".join(f"('{t.name}', {len(t.columns)}, '{','.join(t.key)}', '{','.join(t.partitions)}', '{t.version}', {t.ttl_days or 'NULL'})" for t in canonical.registry().values())
_SPANS = f"""WITH b AS (SELECT date_trunc('hour', min(ts)) AS low, max(ts) + INTERVAL 1 MICROSECOND AS high FROM events),
w AS (SELECT s AS window_start, least(s + INTERVAL 1 DAY, high) AS window_end FROM (SELECT unnest(generate_series(low, high - INTERVAL 1 MICROSECOND, INTERVAL 1 DAY)) AS s, high FROM b)),
o AS (SELECT window_start, window_end, CASE WHEN count(*) FILTER (event_id % 4999 = 77) > 0 THEN 'failed' ELSE 'succeeded' END AS outcome,
  CASE WHEN count(*) FILTER (event_id % 4999 = 77) > 0 THEN 0 ELSE count(DISTINCT user_id % 25) END AS records
  FROM w LEFT JOIN events ON ts >= window_start AND ts < window_end GROUP BY 1, 2)"""
_SEEN = "s AS (SELECT * FROM (VALUES ('1', '1'), ('3', '3'), ('', NULL), ('(not set)', NULL), ('nobody', 'nobody')) t(session, org))"
_VALUE = "(['true', k, k || '.5', '\"x\"', '[1,' || k || ']', '{\"a\":' || k || ',\"b\":2}', 'null'])[event_id % 7 + 1]"
_BODIES = f"d AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events), f AS (SELECT *, {_VALUE} AS v, event_id % 31 = 0 AS broken FROM d)"
ORACLE_SQL = {
    "canonical_catalogue": f"""WITH {TX}, n(name, records) AS (SELECT 'fact_transaction', count(*) FROM raw_tx UNION ALL SELECT 'fact_inventory_snapshot', count(*) FROM events WHERE event_type = 'view'
  UNION ALL SELECT 'fact_stock_check', count(*) FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'quarantine_record', count(*) FROM events WHERE event_type = 'error')
SELECT t.*, coalesce(records, 0) AS records FROM (VALUES {_SHAPES}) t(name, columns, key, parted_by, version, ttl_days) LEFT JOIN n USING (name)""",
    "canonical_months": f"""WITH {TX}, l AS (SELECT *, row_number() OVER (PARTITION BY organization_id, location_id, occurred_at, source_key, source_record_id ORDER BY ingested_at DESC) AS r FROM raw_tx)
SELECT organization_id, strftime(occurred_at, '%Y%m') AS month, count(*) AS transactions, CAST(sum(amount_minor * CASE WHEN organization_id = '{AGAIN}' THEN 2 ELSE 1 END) AS BIGINT) AS amount_minor FROM l WHERE r = 1 GROUP BY 1, 2""",
    "backfill_windows": f"{_SPANS} SELECT * FROM o",
    "backfill_outcome": f"""{_SPANS} SELECT CASE WHEN count(*) FILTER (outcome = 'failed') = 0 THEN 'succeeded' WHEN count(*) FILTER (outcome = 'failed') = count(*) THEN 'failed' ELSE 'partial' END AS outcome,
  count(*) AS windows, count(*) FILTER (outcome = 'failed') AS failed_windows, CAST(sum(records) AS BIGINT) AS records, min(window_start) FILTER (outcome = 'failed') AS first_failed FROM o""",
    "policy_rows": f"""WITH {TX}, {_SEEN}, r AS (SELECT 'stock_checks' AS seen, CAST(user_id % 5 AS VARCHAR) AS o FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'quarantine', CAST(user_id % 5 AS VARCHAR) FROM events WHERE event_type = 'error'
  UNION ALL SELECT 'transactions', organization_id FROM raw_tx)
SELECT session, seen, count(*) FILTER (o = org) AS records, 0 AS "foreign" FROM s CROSS JOIN r GROUP BY session, seen""",
    "json_kinds": f"WITH {_BODIES} SELECT (['boolean', 'integer', 'number', 'string', 'array', 'object', 'null'])[event_id % 7 + 1] AS kind, count(*) AS n FROM f WHERE NOT broken GROUP BY 1",
    "json_fields": f"""WITH {_BODIES}, x AS (SELECT event_id, 'k' AS field, 'integer' AS kind FROM f WHERE NOT broken UNION ALL SELECT event_id, 'v', (['boolean', 'integer', 'number', 'string', 'array', 'object', 'null'])[event_id % 7 + 1] FROM f WHERE NOT broken)
SELECT field, arg_min(kind, event_id) AS type, count(*) AS documents, bool_and(kind = 'integer') AS all_integers FROM x GROUP BY field""",
    "json_identity": f"""WITH {_BODIES} SELECT event_id, 'sha256:' || sha256(CASE WHEN broken THEN '{{"k":' ELSE '{{"k":' || k || ',"v":' || v || '}}' END) AS record_id FROM f""",
}
