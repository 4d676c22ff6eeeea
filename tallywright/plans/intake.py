"""Ingestion, scalar functions, routing and streaming as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import documents, scalars
from ..operators import ingest, routing
from ..sources import overlay
from ..streaming.once import events_stream, run_once

AS_OF = "2024-02-01T00:00:00Z"
def delivered(spark, sf_dir) -> DataFrame:
    """Stock checks as text, with every kind of fault."""
    e = overlay.table(spark, sf_dir, "events")
    i = F.col("event_id")
    moment = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.select(
        i.cast("string").alias("check_id"),
        F.when(i % 17 == 0, "").when(i % 19 == 0, "not a date").when(i % 23 == 0, "2031-01-01T00:00:00Z").otherwise(moment).alias("occurred_at"),
        F.when(i % 13 != 0, (F.col("user_id") % 25).cast("string")).alias("location_id"),
        F.concat(F.lit(" SKU-"), F.col("user_id").cast("string"), F.lit(" ")).alias("sku"),
        F.when(i % 7 == 0, "abc").when(i % 11 == 0, "-5").when(i % 29 == 0, "NaN").otherwise(F.floor("value").cast("string")).alias("observed_quantity"),
    )


def validate_csv(spark, sf_dir):
    """All reasons of every record."""
    d = delivered(spark, sf_dir)
    why = ingest.reasons(*ingest.required(("check_id", "occurred_at", "location_id", "sku", "observed_quantity")), *ingest.timestamps("occurred_at", AS_OF), *ingest.quantities("observed_quantity"))
    return d.select("check_id", F.array_join(why, ",").alias("reasons"))


MAPPING = ingest.Mapping({"id": "check_id", "product": "sku", "place": "location_id", "quantity": "observed_quantity", "channel": "channel_code"}, {"product": ("trim", "lower"), "quantity": ("to_int",)}, ("id", "place"))
KNOWN = ingest.Mapping({k: v for k, v in MAPPING.columns.items() if k != "channel"}, MAPPING.transforms, MAPPING.required)


def apply_mapping(spark, sf_dir):
    mapped = ingest.apply_mapping(delivered(spark, sf_dir), KNOWN)
    return mapped.select("id", "product", "place", "quantity", F.array_join("why", ",").alias("why"))


def schema_drift_mapping(spark, sf_dir):
    """A mapped field that the delivery no longer has rejects its records with that reason."""
    mapped = ingest.apply_mapping(delivered(spark, sf_dir), MAPPING)
    return mapped.select(F.explode("why").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def mapping_preview(spark, sf_dir):
    good, bad = ingest.split(ingest.apply_mapping(delivered(spark, sf_dir), KNOWN))
    counts = good.agg(F.count("*").alias("rows")).join(F.broadcast(bad.agg(F.count("*").alias("rejected"))))
    return counts.withColumn("rejection_rate", F.round(F.col("rejected") / (F.col("rows") + F.col("rejected")).cast("double"), 6))


def transforms(spark, sf_dir):
    """Every transform on texts of all shapes, made of the events' numbers."""
    i, k = F.col("event_id"), F.col("event_id").cast("string")
    shapes = [F.concat(F.lit(" "), k, F.lit(" ")), F.concat(F.lit("+"), k), F.concat(k, F.lit(".5")), F.concat(F.lit("1_"), k), F.lit("NaN"), F.lit(""), F.lit("  "), F.concat(k, F.lit(".345")), F.concat(F.lit("abc"), k), F.lit(None).cast("string"), F.lit("2024-01-05T10:00:00Z"), F.lit("2024-01-05")]
    c = F.col("v")
    rows = overlay.table(spark, sf_dir, "events").select(i.alias("i"), F.element_at(F.array(*shapes), (i % len(shapes) + 1).cast("int")).alias("v"))
    return rows.select(
        "i", scalars.nullify_empty(c).alias("kept"), F.upper(scalars.trim(c)).alias("upper"), scalars.to_int(c).alias("whole"), scalars.to_decimal(c).cast("double").alias("number"),
        scalars.to_minor_units(c).alias("minor"), F.coalesce(scalars.to_timestamp(c).isNotNull(), F.lit(False)).alias("is_time"),
    )


def scalar_functions(spark, sf_dir):
    e = overlay.table(spark, sf_dir, "events")
    v = F.floor("value").cast("long")
    return e.select("event_id", scalars.humanise(F.concat(F.lit("seen_"), "event_type")).alias("label"), scalars.age_label(v * 977).alias("age"), scalars.linear_scale(F.col("value"), 10.0, 60.0, 0.0, 100.0).alias("scaled0"), scalars.delta_label(v, F.when(v % 5 != 0, F.lit(40))).alias("delta"), scalars.subsequence(F.col("event_type"), "PC").alias("matches"), F.sha2("props", 256).alias("digest"), scalars.redact(F.col("event_type"), ["chase"]).alias("redacted")).withColumn("scaled", F.round("scaled0", 6)).drop("scaled0")


def json_path(spark, sf_dir):
    return overlay.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.a.b").alias("missing"))


def json_types(spark, sf_dir):
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("props"), "$.k", "variant"))
    named = F.when(kind == "BIGINT", "integer").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string").when(kind.isNull(), "null").otherwise("number")
    return overlay.table(spark, sf_dir, "events").groupBy(named.alias("type")).agg(F.count("*").alias("n"))


def inspect_schema(spark, sf_dir):
    """Each field of the deliveries, with the type that its first record shows."""
    first = overlay.table(spark, sf_dir, "events").orderBy("event_id").limit(50)
    keys = first.select("event_id", F.explode(F.json_object_keys("props")).alias("field"))
    return keys.groupBy("field").agg(F.min("event_id").alias("first_seen"))


def record_ids(spark, sf_dir):
    e = overlay.table(spark, sf_dir, "events")
    natural = F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string"))
    return e.select("event_id", documents.identity(natural, F.col("props")).alias("record_id"))


def upload_guard(spark, sf_dir):
    p = overlay.table(spark, sf_dir, "pages")
    body = F.coalesce(F.encode("html", "UTF-8"), F.encode(F.lit(""), "UTF-8"))
    verdict = F.when(F.octet_length(body) > 6000, "too_large").when(F.hex(F.substring(body, 1, 2)) == "4D5A", "executable").when(F.octet_length(body) == 0, "empty").otherwise("accepted")
    return p.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def quality_flags(spark, sf_dir):
    """Flags that need more than one record: late by a day, the same id twice, a value outside its list."""
    raw = overlay.raw_transactions(spark, sf_dir)
    twice = F.count("*").over(Window.partitionBy(*overlay.TRANSACTION_KEY)) > 1
    late = F.col("ingested_at") > F.col("occurred_at") + F.expr("INTERVAL 1 DAY")
    flags = F.concat_ws(",", F.when(late, "late_arrival"), F.when(twice, "duplicate_source_id"), F.when(~F.col("channel_id").isin("BUILDING", "MACHINERY", "FURNITURE", "HOUSEHOLD"), "unknown_enum"))
    return raw.select(flags.alias("flags")).groupBy("flags").agg(F.count("*").alias("n"))


def requests(spark, sf_dir) -> DataFrame:
    """A grid of requests dealt over the events."""
    i, u = F.col("event_id"), F.col("user_id")
    pick = lambda values, x: F.element_at(F.array(*[F.lit(v) for v in values]), (x % len(values) + 1).cast("int"))
    return overlay.table(spark, sf_dir, "events").select(
        i.alias("request_id"), (i % 13).cast("int").alias("queue_length"), pick(("shop_floor", "stockroom"), i), (u % 4).cast("int").alias("stock_units"), pick(routing.CONFIDENCE, F.floor(i / 2)).alias("stock_confidence"),
        (u % 9).cast("int").alias("walking_minutes"), pick(("as_soon_as_possible", "before_i_finish", "no_rush"), F.floor(i / 3)).alias("timing"), (i % 5 == 0).alias("companion"), (i % 3 == 0).alias("batch"), (i % 7 == 0).alias("accessibility"), (i % 2 == 0).alias("online"), (u % 3 == 0).alias("nearby"),
    ).toDF("request_id", "queue_length", "location", "stock_units", "stock_confidence", "walking_minutes", "timing", "companion", "batch", "accessibility", "online", "nearby")


def fulfilment_rank(spark, sf_dir):
    return routing.rank(requests(spark, sf_dir))


def unmet_demand(spark, sf_dir):
    why = routing.unmet_reason(routing.Policy())
    return requests(spark, sf_dir).groupBy(why.alias("reason")).agg(F.count("*").alias("requests"))


def capacity(spark, sf_dir):
    return requests(spark, sf_dir).groupBy(routing.capacity(F.col("queue_length"), routing.Policy()).alias("capacity")).agg(F.count("*").alias("requests"))


def tumbling_footfall(spark, sf_dir):
    """Events in windows of 15 minutes, from a stream."""
    counted = events_stream(spark, sf_dir).groupBy(F.window(F.col("ts").cast("timestamp"), "15 minutes")).agg(F.count("*").alias("n"))
    return run_once(counted.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n"), "complete")


def stream_dedupe(spark, sf_dir):
    """Deliveries that come twice are taken once."""
    e = events_stream(spark, sf_dir).select("event_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withWatermark("at", "40 days")
    return run_once(twice.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type"))


def session_funnel(spark, sf_dir):
    e = overlay.table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("at", "12 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started_at"), "n")


def late_arrivals(spark, sf_dir):
    """Events whose time lies more than a day behind what their source had already sent; flagged, not dropped."""
    seen = F.max("ts").over(Window.partitionBy("source").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    e = overlay.table(spark, sf_dir, "events").withColumn("source", F.col("user_id") % 40)
    return e.withColumn("late", F.coalesce(F.col("ts") < seen - F.expr("INTERVAL 1 DAY"), F.lit(False))).groupBy("source").agg(F.count_if("late").alias("late"), F.count("*").alias("n"))


def validate_amounts(spark, sf_dir):
    """Orders delivered with amounts and currencies as text, some of them wrong: why each is refused."""
    k = F.col("o_orderkey")
    amount = F.when(k % 7 == 0, "abc").when(k % 11 == 0, F.concat(F.lit("-"), k.cast("string"))).when(k % 13 == 0, "").otherwise(k.cast("string"))
    currency = F.when(k % 5 == 0, "G1P").when(k % 17 == 0, "  ").otherwise("gbp")
    rows = overlay.table(spark, sf_dir, "orders").select(k.alias("record_id"), amount.alias("amount"), currency.alias("currency"))
    why = ingest.reasons(*ingest.amounts("amount"), *ingest.currencies("currency"))
    return rows.select("record_id", F.array_join(why, ",").alias("why")).where("why <> ''")


def labels(spark, sf_dir):
    """Amounts and shares as they are shown."""
    k = F.col("o_orderkey")
    rows = overlay.table(spark, sf_dir, "orders")
    return rows.select(k.alias("record_id"), scalars.money(k * 1000 + 5).alias("amount"), scalars.percent(k % 1000 / 1000).alias("share"))


QUERIES = {f.__name__: f for f in (validate_amounts, labels, validate_csv, apply_mapping, schema_drift_mapping, mapping_preview, transforms, scalar_functions, json_path, json_types, inspect_schema, record_ids, upload_guard, quality_flags, fulfilment_rank, unmet_demand, capacity, tumbling_footfall, stream_dedupe, session_funnel, late_arrivals)}

from .governed import TX  # noqa: E402

DELIVERED = """d AS (SELECT event_id AS i, CAST(event_id AS VARCHAR) AS check_id,
  CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 = 0 THEN 'not a date' WHEN event_id % 23 = 0 THEN '2031-01-01T00:00:00Z' ELSE 'fine' END AS occurred_at,
  CASE WHEN event_id % 13 <> 0 THEN CAST(user_id % 25 AS VARCHAR) END AS location_id, 'sku-' || user_id AS product,
  CASE WHEN event_id % 7 = 0 THEN 'abc' WHEN event_id % 11 = 0 THEN '-5' WHEN event_id % 29 = 0 THEN 'NaN' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS q FROM events)"""
WHY = "concat_ws(',', CASE WHEN location_id IS NULL THEN 'missing_required:place' END, CASE WHEN q IN ('abc', 'NaN') THEN 'type_coerced:quantity' END)"
REQUESTS = """r AS (SELECT event_id AS request_id, event_id % 13 AS queue, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 3 END AS extra, user_id % 4 AS units, event_id // 2 % 3 + 1 AS sure, user_id % 9 AS walk, event_id // 3 % 3 AS timing,
  event_id % 5 = 0 AS companion, event_id % 3 = 0 AS batch, event_id % 7 = 0 AS acc, event_id % 2 = 0 AS online, user_id % 3 = 0 AS nearby FROM events),
c AS (SELECT *, CASE WHEN queue >= 10 THEN 'red' WHEN queue >= 5 THEN 'amber' ELSE 'green' END AS cap, greatest(2, walk + extra) AS m, CASE WHEN units <= 0 THEN 'no_stock' WHEN sure < 2 THEN 'confidence_below_minimum' END AS why FROM r)"""
OFFERS = """o AS (
  SELECT request_id, 'staff_delivery_now' AS method, CASE cap WHEN 'green' THEN 98 WHEN 'amber' THEN 63 ELSE 82 END AS score, m AS t, CASE WHEN acc THEN 'accessibility_need' END AS reason FROM c WHERE why IS NULL AND (cap <> 'red' OR acc)
  UNION ALL SELECT request_id, 'companion_collection', CASE cap WHEN 'green' THEN 76 ELSE 91 END, m, NULL FROM c WHERE why IS NULL AND companion
  UNION ALL SELECT request_id, 'customer_self_collection', CASE cap WHEN 'red' THEN 74 ELSE 48 END, m, NULL FROM c WHERE why IS NULL
  UNION ALL SELECT request_id, 'batch_pick', CASE cap WHEN 'amber' THEN 88 ELSE 70 END, m + 8, NULL FROM c WHERE why IS NULL AND batch
  UNION ALL SELECT request_id, 'bring_before_i_finish', CASE timing WHEN 1 THEN 86 ELSE 42 END, m + 3, NULL FROM c WHERE why IS NULL
  UNION ALL SELECT request_id, 'collect_at_checkout', CASE timing WHEN 2 THEN 75 ELSE 45 END, m + 5, NULL FROM c WHERE why IS NULL
  UNION ALL SELECT request_id, 'reserve_nearby', CASE WHEN why IS NULL THEN 39 ELSE 81 END, 0, NULL FROM c WHERE nearby
  UNION ALL SELECT request_id, 'home_delivery', CASE WHEN why IS NULL THEN 31 ELSE 77 END, 0, NULL FROM c WHERE online
  UNION ALL SELECT request_id, 'alternative_product', 96, 0, why FROM c WHERE why IS NOT NULL)"""
ORACLE_SQL = {
    "validate_amounts": """SELECT * FROM (SELECT o_orderkey AS record_id, concat_ws(',', CASE WHEN o_orderkey % 7 = 0 THEN 'type_coerced:amount' WHEN o_orderkey % 11 = 0 THEN 'negative_amount:amount' END,
  CASE WHEN o_orderkey % 5 = 0 THEN 'currency_mismatch:currency' END) AS why FROM orders) WHERE why <> ''""",
    "labels": "SELECT o_orderkey AS record_id, format('{:,.2f}', (o_orderkey * 1000 + 5) / 100.0) AS amount, printf('%.1f%%', o_orderkey % 1000 / 1000.0 * 100) AS share FROM orders",
    "validate_csv": f"WITH {DELIVERED} SELECT check_id, concat_ws(',', CASE WHEN occurred_at = '' THEN 'missing_required:occurred_at' END, CASE WHEN location_id IS NULL THEN 'missing_required:location_id' END, CASE WHEN occurred_at = 'not a date' THEN 'type_coerced:occurred_at' END, CASE WHEN occurred_at LIKE '2031%' THEN 'future_dated:occurred_at' END, CASE WHEN q IN ('abc', 'NaN') THEN 'type_coerced:observed_quantity' END, CASE WHEN q LIKE '-%' THEN 'out_of_range:observed_quantity' END) AS reasons FROM d",
    "apply_mapping": f"WITH {DELIVERED} SELECT check_id AS id, product, location_id AS place, TRY_CAST(q AS BIGINT) AS quantity, {WHY} AS why FROM d",
    "schema_drift_mapping": f"WITH {DELIVERED} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(concat_ws(',', nullif({WHY}, ''), 'schema_drift:channel_code'), ',')) AS reason FROM d) GROUP BY 1",
    "mapping_preview": f"WITH {DELIVERED} SELECT count(*) FILTER ({WHY} = '') AS rows, count(*) FILTER ({WHY} <> '') AS rejected, round(CAST(count(*) FILTER ({WHY} <> '') AS DOUBLE) / count(*), 6) AS rejection_rate FROM d",
    "transforms": """WITH e AS (SELECT event_id AS i, event_id % 12 AS s, CAST(event_id AS VARCHAR) AS k FROM events),
v AS (SELECT *, CASE s WHEN 0 THEN ' ' || k || ' ' WHEN 1 THEN '+' || k WHEN 2 THEN k || '.5' WHEN 3 THEN '1_' || k WHEN 4 THEN 'NaN' WHEN 5 THEN '' WHEN 6 THEN '  ' WHEN 7 THEN k || '.345' WHEN 8 THEN 'abc' || k
  WHEN 10 THEN '2024-01-05T10:00:00Z' WHEN 11 THEN '2024-01-05' END AS v, CASE s WHEN 0 THEN '.0' WHEN 1 THEN '.0' WHEN 2 THEN '.5' WHEN 7 THEN '.345' END AS rest FROM e)
SELECT i, CASE WHEN s NOT IN (5, 6) THEN v END AS kept, upper(trim(v)) AS upper, CASE WHEN s IN (0, 1) THEN i END AS whole, CAST(CAST(k || rest AS DECIMAL(18,4)) AS DOUBLE) AS number,
  CASE s WHEN 0 THEN i * 100 WHEN 1 THEN i * 100 WHEN 2 THEN i * 100 + 50 WHEN 7 THEN i * 100 + 34 END AS minor, s IN (10, 11) AS is_time FROM v""",
    "scalar_functions": """SELECT event_id, 'Seen ' || event_type AS label, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 172800 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS age,
      round(least(greatest((value - 10) / 50, 0), 1) * 100, 6) AS scaled, CASE WHEN v % 5 = 0 THEN 'no comparison available' WHEN v > 40 THEN 'up' WHEN v < 40 THEN 'down' ELSE 'unchanged' END AS delta,
      event_type LIKE '%p%c%' AS matches, sha256(props) AS digest, replace(event_type, 'chase', '***') AS redacted FROM (SELECT *, CAST(floor(value) AS BIGINT) AS v, CAST(floor(value) AS BIGINT) * 977 AS s FROM events)""",
    "json_path": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events",
    "json_types": "SELECT CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' ELSE 'null' END AS type, count(*) AS n FROM events GROUP BY 1",
    "inspect_schema": "SELECT field, min(event_id) AS first_seen FROM (SELECT event_id, unnest(json_keys(props)) AS field FROM (SELECT * FROM events ORDER BY event_id LIMIT 50)) GROUP BY 1",
    "record_ids": """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id AS VARCHAR) ELSE 'sha256:' || sha256('{"k":' || json_extract_string(props, '$.k') || '}') END AS record_id FROM events""",
    "upload_guard": "SELECT CASE WHEN strlen(coalesce(html, '')) > 6000 THEN 'too_large' WHEN html LIKE 'MZ%' THEN 'executable' WHEN strlen(coalesce(html, '')) = 0 THEN 'empty' ELSE 'accepted' END AS verdict, count(*) AS n FROM pages GROUP BY 1",
    "quality_flags": f"WITH {TX} SELECT concat_ws(',', CASE WHEN ingested_at > occurred_at + INTERVAL 1 DAY THEN 'late_arrival' END, CASE WHEN c > 1 THEN 'duplicate_source_id' END, CASE WHEN channel_id NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD') THEN 'unknown_enum' END) AS flags, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY organization_id, location_id, occurred_at, source_key, source_record_id) AS c FROM raw_tx) GROUP BY 1",
    "fulfilment_rank": f"WITH {REQUESTS}, {OFFERS} SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, method) AS INTEGER) AS rank, method, score, CASE WHEN t <= 12 THEN 'About ' || t || ' min' ELSE 'Timing will be confirmed' END AS estimate, reason FROM o",
    "unmet_demand": f"WITH {REQUESTS} SELECT why AS reason, count(*) AS requests FROM c GROUP BY 1",
    "capacity": f"WITH {REQUESTS} SELECT cap AS capacity, count(*) AS requests FROM c GROUP BY 1",
    "tumbling_footfall": "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, count(*) AS n FROM events GROUP BY 1",
    "stream_dedupe": "SELECT event_id, event_type FROM events",
    "session_funnel": "SELECT user_id, min(ts) AS started_at, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s",
    "late_arrivals": "SELECT source, count(*) FILTER (ts < seen - INTERVAL 1 DAY) AS late, count(*) AS n FROM (SELECT *, user_id % 40 AS source, max(ts) OVER (PARTITION BY user_id % 40 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) GROUP BY 1",
}
