"""Deliveries, raw objects, audit, access, and the invariants of findings as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.signing import fingerprint, hmac_sha256
from ..operators import access, ingest, ledger, receipt, scoring
from ..sources import overlay
from .intake import AS_OF, KNOWN, delivered

KEY = b"example-key"

def events(spark, sf_dir) -> DataFrame:
    return overlay.table(spark, sf_dir, "events")


def webhook_verification(spark, sf_dir):
    """Deliveries signed by HMAC-SHA256, some with a wrong signature, a bad time, or sent too early or too late."""
    i = F.col("event_id")
    sent = F.when(i % 31 == 0, "soon").otherwise((F.lit(1_700_000_000) + i).cast("string"))
    signed = hmac_sha256(KEY, F.encode(F.concat(sent, F.lit("."), "props"), "UTF-8"))
    rows = events(spark, sf_dir).select("event_id", "props", sent.alias("sent"), F.when(i % 7 == 0, F.sha2("props", 256)).otherwise(signed).alias("signature"), (F.lit(1_700_000_000) + i + (i % 5 - 2) * 200).alias("now"))
    return rows.select("event_id", "signature", receipt.webhook_refusal(KEY, F.col("sent"), F.col("props"), F.col("signature"), F.col("now")).alias("refusal"))


def validate_rest(spark, sf_dir):
    i = F.col("event_id")
    rows = events(spark, sf_dir).select("event_id", F.when(i % 9 == 0, "").otherwise(i.cast("string")).alias("id"), "ts", F.when(i % 10 == 0, "{}").when(i % 14 != 0, F.col("props")).alias("payload"))
    why = receipt.rest_reasons(F.col("id"), F.col("ts"), F.col("payload"), F.lit("2024-01-20").cast("timestamp_ntz"))
    return rows.select("event_id", F.array_join(why, ",").alias("why")).where("why <> ''")


def validated_then_mapped(spark, sf_dir):
    """Reasons by record: validation's where it has any, else the mapping's."""
    d = delivered(spark, sf_dir)
    checks = ingest.reasons(*ingest.required(("check_id", "occurred_at")), *ingest.timestamps("occurred_at", AS_OF))
    mapped = ingest.apply_mapping(d.select("*", checks.alias("checks")), ingest.Mapping({**KNOWN.columns, "checks": "checks"}, KNOWN.transforms, KNOWN.required))
    return mapped.select("id", F.array_join(receipt.validate_then_map(F.col("checks"), F.col("why")), ",").alias("why"))


def raw_put_outcomes(spark, sf_dir):
    """Objects put under a key a user and hour: kept once, and never overwritten by other bytes."""
    puts = events(spark, sf_dir).select(F.concat_ws("/", "user_id", F.col("event_id") % 2).alias("key"), "event_id", "event_type")
    return receipt.raw_puts(puts, "key", "event_id", "event_type").select("key", "event_id", "outcome", "sha256")


def audit_trail(spark, sf_dir):
    """Records of a change of orders: some removed, some with another status, some new."""
    k = F.col("o_orderkey")
    o = overlay.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("long").alias("customer"))
    after = o.where(k % 11 != 0).withColumn("status", F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("status")))
    return receipt.audit_records(o.where(k % 13 != 0), after, "o_orderkey", ["status", "customer"])


def mapping_versions(spark, sf_dir):
    versions = events(spark, sf_dir).select((F.col("user_id") % 50).alias("connection"), F.col("event_type").alias("resource"), (F.col("event_id") % 9).alias("version"))
    return receipt.next_version(versions, "connection", "resource")


def members(spark, sf_dir) -> DataFrame:
    c = overlay.table(spark, sf_dir, "customer")
    role = F.element_at(F.array(*[F.lit(r) for r in access.ROLES]), (F.col("c_custkey") % 6 + 1).cast("int"))
    granted = F.when(F.col("c_custkey") % 10 == 0, F.array(F.lit("gap.view_exposure"))).otherwise(F.array().cast("array<string>"))
    return c.select(F.col("c_custkey").alias("member"), F.col("c_nationkey").cast("string").alias("organization_id"), role.alias("role"), granted.alias("granted"))


def organizations(spark, sf_dir) -> DataFrame:
    return overlay.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("organization_id"), F.col("n_name").alias("organization"))


def member_organizations(spark, sf_dir):
    return access.memberships(members(spark, sf_dir), organizations(spark, sf_dir)).select("member", "organization", "role").orderBy("organization", "member")


def member_capabilities(spark, sf_dir):
    """Members by organization who may do a thing, by role or by grant."""
    m = members(spark, sf_dir)
    counts = [F.count_if(access.may(F.col("role"), c, F.col("granted"))).alias(c.replace(".", "_")) for c in ("gap.view", "gap.view_exposure", "metric.query", "audit.view", "org.manage")]
    return m.groupBy("organization_id").agg(*counts)


def capabilities(spark, sf_dir):
    """Members by capability of their role."""
    m = members(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n"))
    return m.join(F.broadcast(access.role_capabilities(spark)), "role").groupBy("capability").agg(F.sum("n").alias("members"))  # 59 rows


def scoped_members(spark, sf_dir, organization: str | None = "7"):
    return access.scoped(members(spark, sf_dir), "organization_id", organization).select("member", "role")


def findings(spark, sf_dir) -> DataFrame:
    """Orders as candidates, some without evidence, scope or difference."""
    k = F.col("o_orderkey")
    evidence = F.array(F.struct(F.lit("orders").alias("metric_key"), F.lit(1).alias("version"), F.col("o_orderpriority").alias("dimension"), F.lit("internal").alias("sensitivity")))
    return overlay.table(spark, sf_dir, "orders").select(
        k.alias("record_id"), k.cast("string").alias("dedupe_key"), F.when(k % 4 == 0, "schema_drift").otherwise("source_mismatch").alias("gap_type"),
        F.when(k % 6 == 0, " ").otherwise(F.col("o_custkey").cast("string")).alias("scope_id"), (k % 8).alias("observed"), F.lit(3).cast("long").alias("expected"),
        F.when(k % 5 != 0, evidence).otherwise(F.filter(evidence, lambda e: F.lit(False))).alias("evidence"), F.array(F.concat(F.lit("source:"), k % 20)).alias("sources"),
        F.when(k % 3 == 0, "resolved").otherwise("detected").alias("status"), F.lit("high").alias("confidence_band"),
    )


def candidate_invariants(spark, sf_dir):
    f = findings(spark, sf_dir)
    return f.select("record_id", F.array_join(ledger.candidate_faults(f), ",").alias("faults")).where("faults <> ''")


def candidate_fingerprints(spark, sf_dir):
    return findings(spark, sf_dir).select("record_id", fingerprint(F.col("gap_type"), F.col("scope_id"), F.col("observed"), F.nullif(F.col("expected"), F.col("observed"))).alias("fingerprint"))


def evidence_records(spark, sf_dir):
    e = findings(spark, sf_dir).select("record_id", F.explode("evidence").alias("e"))
    return e.groupBy("e.metric_key", "e.version", "e.dimension", "e.sensitivity").agg(F.count("*").alias("candidates"))


def source_suppression(spark, sf_dir):
    """Candidates that read one of the sources 0 to 5, of which some have an open gap of quality."""
    f = findings(spark, sf_dir)
    low = f.where(F.col("record_id") % 20 < 6)
    gaps = low.where(F.col("record_id") % 24 == 0).withColumn("status", F.lit("detected"))
    return ledger.suppress(f, gaps).select("record_id", "suppressed", "confidence_band")


def confidence_weights(spark, sf_dir):
    v = F.col("value")
    parts = {"sample_size": F.when(F.col("event_id") % 2 == 0, v), "freshness": F.when(F.col("event_id") % 3 == 0, v), "detector_fit": v}
    weights, dropped = scoring.weight_record(parts)
    rows = events(spark, sf_dir).where("value IS NOT NULL").select("event_id", F.array_join(F.transform(weights, lambda w: F.concat(w.getField("name"), F.lit("="), F.format_number(w.getField("weight"), 4))), ",").alias("weights"), F.array_join(dropped, ",").alias("dropped"))
    return rows


def exposure_statements(spark, sf_dir):
    """Exposures as they are stated, with their assumption, or the faults that forbid it."""
    k = F.col("o_orderkey")
    rows = overlay.table(spark, sf_dir, "orders").select(k.alias("record_id"), (k * 90).alias("low"), (k * 100 - F.when(k % 9 == 0, k * 50).otherwise(0)).alias("base"), (k * 12345).alias("high"), F.when(k % 5 == 0, "e?r").otherwise("eur").alias("currency"))
    given = F.array(scoring.assumption("share", "share that is lost", F.col("low"), F.col("base"), F.col("high"), "survey", "assumed"))
    rows = rows.withColumn("assumptions", F.filter(given, lambda a: F.col("record_id") % 8 != 0))
    faults = scoring.exposure_faults(F.col("low"), F.col("base"), F.col("high"), F.col("currency"), F.col("assumptions"))
    said = scoring.describe(F.col("low"), F.col("high"), F.col("currency"), F.lit("medium"))
    return rows.select("record_id", F.array_join(faults, ",").alias("faults"), F.when(F.size(faults) == 0, said).alias("statement"), F.get("assumptions", F.lit(0)).getField("value").alias("assumed"))


QUERIES = {f.__name__: f for f in (webhook_verification, validate_rest, validated_then_mapped, raw_put_outcomes, audit_trail, mapping_versions, member_organizations, member_capabilities, capabilities, scoped_members, candidate_invariants, candidate_fingerprints, evidence_records, source_suppression, confidence_weights, exposure_statements)}

from .intake import DELIVERED, WHY  # noqa: E402


def _pad(byte: int) -> str:
    """The key combined with a pad, as a DuckDB BLOB."""
    return "unhex('" + bytes(b ^ byte for b in KEY.ljust(64, b"\0")).hex() + "')"


HMAC = f"sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || encode(sent || '.' || props))))"
ROLES_SQL = ", ".join(f"'{r}'" for r in access.ROLES)
PAIRS_SQL = ", ".join(f"('{r}', '{c}')" for r, cs in access.ROLES.items() for c in cs)
MEMBERS = f"m AS (SELECT c_custkey AS member, CAST(c_nationkey AS VARCHAR) AS organization_id, [{ROLES_SQL}][c_custkey % 6 + 1] AS role, c_custkey % 10 = 0 AS extra FROM customer), rc AS (SELECT * FROM (VALUES {PAIRS_SQL}) t(role, capability))"
FINDINGS = """f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'schema_drift' ELSE 'source_mismatch' END AS gap_type, CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE CAST(o_custkey AS VARCHAR) END AS scope_id, o_orderkey % 8 AS observed, o_orderpriority FROM orders)"""


def _part(x: str) -> str:
    return f"coalesce(length({x}) || ':' || {x}, '-')"


def _can(capability: str, granted: str = "FALSE") -> str:
    return f"count(*) FILTER (role IN (SELECT role FROM rc WHERE capability = '{capability}') OR {granted}) AS {capability.replace('.', '_')}"


ORACLE_SQL = {
    "webhook_verification": f"""WITH d AS (SELECT event_id, props, CASE WHEN event_id % 31 = 0 THEN 'soon' ELSE CAST(1700000000 + event_id AS VARCHAR) END AS sent FROM events)
      SELECT event_id, CASE WHEN event_id % 7 = 0 THEN sha256(props) ELSE {HMAC} END AS signature, CASE WHEN event_id % 31 = 0 THEN 'timestamp is not a unix time' WHEN event_id % 5 IN (0, 4) THEN 'timestamp outside tolerance' WHEN event_id % 7 = 0 THEN 'signature mismatch' END AS refusal FROM d""",
    "validate_rest": """SELECT * FROM (SELECT event_id, concat_ws(',', CASE WHEN event_id % 9 = 0 THEN 'missing_required:source_record_id' END, CASE WHEN ts > TIMESTAMP '2024-01-20' THEN 'future_dated:occurred_at' END,
      CASE WHEN event_id % 10 = 0 OR event_id % 14 = 0 THEN 'missing_required:payload' END) AS why FROM events) WHERE why <> ''""",
    "validated_then_mapped": f"""WITH {DELIVERED}, v AS (SELECT *, CASE WHEN occurred_at = '' THEN 'missing_required:occurred_at' WHEN occurred_at = 'not a date' THEN 'type_coerced:occurred_at' WHEN occurred_at LIKE '2031%' THEN 'future_dated:occurred_at' ELSE '' END AS checks FROM d)
      SELECT check_id AS id, CASE WHEN checks <> '' THEN checks ELSE {WHY} END AS why FROM v""",
    "raw_put_outcomes": """SELECT key, event_id, CASE WHEN event_id = first_id THEN 'stored' WHEN event_type = first_type THEN 'already_there' ELSE 'conflict' END AS outcome, sha256(event_type) AS sha256
      FROM (SELECT *, min(event_id) OVER (PARTITION BY key) AS first_id, first_value(event_type) OVER (PARTITION BY key ORDER BY event_id) AS first_type FROM (SELECT user_id || '/' || event_id % 2 AS key, event_id, event_type FROM events))""",
    "audit_trail": """WITH b AS (SELECT o_orderkey, '{"customer":' || o_custkey || ',"status":"' || o_orderstatus || '"}' AS before FROM orders WHERE o_orderkey % 13 <> 0),
      a AS (SELECT o_orderkey, '{"customer":' || o_custkey || ',"status":' || CASE WHEN o_orderkey % 7 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}' AS after FROM orders WHERE o_orderkey % 11 <> 0)
      SELECT o_orderkey, before, after, CASE WHEN before IS NULL THEN 'created' WHEN after IS NULL THEN 'deleted' ELSE 'updated' END AS action FROM b FULL JOIN a USING (o_orderkey) WHERE before IS DISTINCT FROM after""",
    "mapping_versions": "SELECT user_id % 50 AS connection, event_type AS resource, max(event_id % 9) + 1 AS next_version FROM events GROUP BY 1, 2",
    "member_organizations": f"WITH {MEMBERS} SELECT member, n_name AS organization, role FROM m JOIN nation ON organization_id = CAST(n_nationkey AS VARCHAR)",
    "member_capabilities": f"WITH {MEMBERS} SELECT organization_id, {_can('gap.view')}, {_can('gap.view_exposure', 'extra')}, {_can('metric.query')}, {_can('audit.view')}, {_can('org.manage')} FROM m GROUP BY 1",
    "capabilities": f"WITH {MEMBERS} SELECT capability, count(*) AS members FROM m JOIN rc USING (role) GROUP BY 1",
    "scoped_members": f"WITH {MEMBERS} SELECT member, role FROM m WHERE organization_id = '7'",
    "candidate_invariants": f"WITH {FINDINGS} SELECT * FROM (SELECT k AS record_id, concat_ws(',', CASE WHEN k % 5 = 0 THEN 'no_evidence' END, CASE WHEN trim(scope_id) = '' THEN 'no_scope' END, CASE WHEN observed = 3 THEN 'observed_is_expected' END) AS faults FROM f) WHERE faults <> ''",
    "candidate_fingerprints": f"WITH {FINDINGS} SELECT k AS record_id, sha256({_part('gap_type')} || {_part('scope_id')} || {_part('CAST(observed AS VARCHAR)')} || CASE WHEN observed = 3 THEN '-' ELSE '1:3' END) AS fingerprint FROM f",
    "evidence_records": f"WITH {FINDINGS} SELECT 'orders' AS metric_key, 1 AS version, o_orderpriority AS dimension, 'internal' AS sensitivity, count(*) AS candidates FROM f WHERE k % 5 <> 0 GROUP BY o_orderpriority",
    "source_suppression": f"""WITH {FINDINGS}, bad AS (SELECT DISTINCT k % 20 AS s FROM f WHERE k % 20 < 6 AND k % 24 = 0)
      SELECT k AS record_id, hit AS suppressed, CASE WHEN hit THEN 'low' ELSE 'high' END AS confidence_band FROM (SELECT k, k % 4 <> 0 AND k % 20 IN (SELECT s FROM bad) AS hit FROM f)""",
    "confidence_weights": """SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'detector_fit=0.3000,freshness=0.3000,sample_size=0.4000' WHEN event_id % 2 = 0 THEN 'detector_fit=0.4286,sample_size=0.5714' WHEN event_id % 3 = 0 THEN 'detector_fit=0.5000,freshness=0.5000' ELSE 'detector_fit=1.0000' END AS weights,
      CASE WHEN event_id % 6 = 0 THEN '' WHEN event_id % 2 = 0 THEN 'freshness' WHEN event_id % 3 = 0 THEN 'sample_size' ELSE 'freshness,sample_size' END AS dropped FROM events WHERE value IS NOT NULL""",
    "exposure_statements": """WITH e AS (SELECT o_orderkey AS k, o_orderkey * 90 AS low, o_orderkey * CASE WHEN o_orderkey % 9 = 0 THEN 50 ELSE 100 END AS base, o_orderkey * 12345 AS high FROM orders),
      f AS (SELECT *, concat_ws(',', CASE WHEN k % 9 = 0 AND k > 0 THEN 'not_ordered' END, CASE WHEN k % 5 = 0 THEN 'no_currency' END, CASE WHEN k % 8 = 0 THEN 'no_assumptions' END) AS faults FROM e)
      SELECT k AS record_id, faults, CASE WHEN faults = '' THEN 'Estimated exposure EUR ' || format('{:,.2f}', low / 100.0) || '–' || format('{:,.2f}', high / 100.0) || ' (medium confidence)' END AS statement, CASE WHEN k % 8 <> 0 THEN low || '..' || high || ' (base ' || base || ')' END AS assumed FROM f""",
}
