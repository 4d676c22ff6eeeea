"""Ordered folds as queries: lifecycle actions on gaps, versions of mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import folds
from ..operators import ledger as book
from ..sources import overlay
from . import findings


def gap_requests(spark, sf_dir) -> DataFrame:
    """What people asked of gaps: every event is an action on its user's finding, several a gap, some on gaps that aren't there."""
    i = F.col("event_id")
    targets = F.array(*[F.lit(s) for s in book.STATUSES[1:]])
    at = F.when(i % 9 == 0, 6).otherwise(F.floor(i / 64) % 5 + 1).cast("int")
    scope = F.col("user_id").cast("string").alias("scope_id")
    gap = F.lit("source_mismatch").alias("gap_type")
    rows = overlay.table(spark, sf_dir, "events").select(
        gap, F.lit("user").alias("scope_type"), scope, i.alias("ordinal"),
        F.when(i % 5 == 0, "assign").when(i % 13 == 0, "action").otherwise("transition").alias("kind"),
        F.element_at(targets, at).alias("to_status"), F.when(i % 4 != 0, F.concat(F.lit("owner-"), (i % 7).cast("string"))).alias("owner"),
        (i % 17 != 0).alias("may_act"), (F.floor(i / 96) % 6 + 1).cast("int").alias("expected_version"),
        F.when(i % 2 == 0, "duplicate").alias("reason_code"), F.when(i % 6 == 0, " ").otherwise("seen").alias("note"), F.when(i % 3 == 0, "o").alias("outcome_id"),
    )
    shape = findings.found(spark, sf_dir, findings.FIRST_RUN).select("gap_type", "scope_type").limit(1)  # one row: the finding's type and scope type
    typed = rows.drop("gap_type", "scope_type").join(F.broadcast(shape))
    return typed.withColumn("dedupe_key", book.dedupe_key(findings.ORG, findings.PACK, findings.RULE))


def lifecycle_folds(spark, sf_dir):
    """Outcome of every action, and the gap's state after it."""
    return folds.gap_actions(findings.ledger(spark, sf_dir), gap_requests(spark, sf_dir)).drop("to_status")


def ledger_after_actions(spark, sf_dir):
    done = folds.after_actions(findings.ledger(spark, sf_dir), gap_requests(spark, sf_dir))
    return done.select("dedupe_key", "scope_id", "status", "owner", "lifecycle_version")


def mapping_log(spark, sf_dir) -> DataFrame:
    i = F.col("event_id")
    kind = F.when(i % 3 == 0, "create").when(i % 5 == 0, "rollback").when(i % 4 == 0, "edit").otherwise("apply")
    version = F.when(kind != "create", (F.floor(i / 16) % 9 + 1).cast("int"))
    return overlay.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("connection"), F.col("event_type").alias("resource"), i.alias("ordinal"), kind.alias("kind"), version.alias("version"))


def mapping_lifecycle(spark, sf_dir):
    """Versions made, applied, rolled back and edited, in the order of the log."""
    return folds.mapping_actions(mapping_log(spark, sf_dir), "connection", "resource")


QUERIES = {f.__name__: f for f in (lifecycle_folds, ledger_after_actions, mapping_lifecycle)}

_KEY = "sha256('1|retail|' || g.gap_type || '|' || g.scope_type || '|' || e.user_id || '|rule-1')"
_FOLD = f"""
WITH RECURSIVE {findings.BOOK.strip()},
q AS (
  SELECT {_KEY} AS dedupe_key, event_id AS ordinal, CASE WHEN event_id % 5 = 0 THEN 'assign' WHEN event_id % 13 = 0 THEN 'action' ELSE 'transition' END AS kind,
    {findings.STATUS}[CASE WHEN event_id % 9 = 0 THEN 6 ELSE event_id // 64 % 5 + 1 END + 1] AS to_status, CASE WHEN event_id % 4 <> 0 THEN 'owner-' || (event_id % 7) END AS new_owner,
    event_id % 17 <> 0 AS may_act, event_id // 96 % 6 + 1 AS expected, event_id % 2 = 0 AND event_id % 6 <> 0 AS reasoned, event_id % 3 = 0 AS has_outcome,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k
  FROM events e, (SELECT gap_type, scope_type FROM run1 LIMIT 1) g
),
f(dedupe_key, k, ordinal, kind, outcome, status, status_after, version_after, owner_after) AS (
  SELECT u.dedupe_key, 0, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, l.status, l.status, CASE WHEN l.status IS NOT NULL THEN 1 END, l.owner FROM (SELECT DISTINCT dedupe_key FROM q) u LEFT JOIN ledger l USING (dedupe_key)
  UNION ALL
  SELECT dedupe_key, k, ordinal, kind, outcome, s, CASE WHEN outcome = 'applied' AND kind = 'transition' THEN to_status ELSE s END, v + CASE WHEN outcome = 'applied' AND kind <> 'action' THEN 1 ELSE 0 END,
    CASE WHEN outcome = 'applied' AND kind = 'assign' THEN new_owner ELSE o END
  FROM (
    SELECT q.*, f.status_after AS s, f.version_after AS v, f.owner_after AS o,
      CASE WHEN f.status_after IS NULL THEN 'no_such_gap' WHEN NOT may_act THEN 'not_permitted'
        WHEN q.kind = 'action' THEN CASE WHEN f.status_after IN ('resolved', 'dismissed') THEN 'terminal' ELSE 'applied' END
        WHEN q.kind = 'transition' AND NOT ((f.status_after NOT IN ('resolved', 'dismissed') AND to_status = 'dismissed')
          OR (to_status <> 'dismissed' AND f.status_after <> 'dismissed' AND list_position({findings.STATUS}, to_status) = list_position({findings.STATUS}, f.status_after) + 1)) THEN 'illegal_transition'
        WHEN f.version_after <> expected THEN 'version_conflict'
        WHEN q.kind = 'transition' AND ((to_status = 'dismissed' AND NOT reasoned) OR (to_status = 'resolved' AND NOT has_outcome) OR (to_status = 'triaged' AND f.owner_after IS NULL)) THEN 'missing_requirement'
        ELSE 'applied' END AS outcome
    FROM f JOIN q ON q.dedupe_key = f.dedupe_key AND q.k = f.k + 1
  )
)
"""
_LOG = """
WITH RECURSIVE q AS (
  SELECT user_id % 50 AS connection, event_type AS resource, event_id AS ordinal, kind, CASE WHEN kind <> 'create' THEN event_id // 16 % 9 + 1 END AS version,
    row_number() OVER (PARTITION BY user_id % 50, event_type ORDER BY event_id) AS k
  FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'create' WHEN event_id % 5 = 0 THEN 'rollback' WHEN event_id % 4 = 0 THEN 'edit' ELSE 'apply' END AS kind FROM events)
), f(connection, resource, k, ordinal, kind, version, outcome, highest, active, applied) AS (
  SELECT DISTINCT connection, resource, 0, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::VARCHAR, 0::BIGINT, NULL::BIGINT, []::BIGINT[] FROM q
  UNION ALL
  SELECT connection, resource, k, ordinal, kind, v, outcome, CASE WHEN kind = 'create' THEN v ELSE highest END, CASE WHEN outcome IN ('applied', 'rolled_back') THEN v ELSE active END,
    CASE WHEN outcome IN ('applied', 'rolled_back') THEN list_distinct(list_append(applied, v)) ELSE applied END
  FROM (
    SELECT q.*, f.highest, f.active, f.applied, CASE WHEN q.kind = 'create' THEN f.highest + 1 ELSE q.version END AS v,
      CASE WHEN q.kind = 'create' THEN 'created' WHEN q.version NOT BETWEEN 1 AND f.highest THEN 'no_such_version'
        WHEN q.kind = 'edit' THEN CASE WHEN list_contains(f.applied, q.version) THEN 'frozen' ELSE 'edited' END
        WHEN q.version = f.active THEN 'already_active' WHEN q.kind = 'apply' THEN 'applied' WHEN q.version > f.active THEN 'newer_than_active' ELSE 'rolled_back' END AS outcome
    FROM f JOIN q ON q.connection = f.connection AND q.resource = f.resource AND q.k = f.k + 1
  )
)
"""
ORACLE_SQL = {
    "lifecycle_folds": f"{_FOLD} SELECT dedupe_key, ordinal, kind, outcome, status, status_after, version_after::INTEGER AS version_after, owner_after FROM f WHERE k > 0",
    "ledger_after_actions": f"""{_FOLD}, done AS (SELECT dedupe_key, arg_max(status_after, k) AS status, arg_max(coalesce(owner_after, ''), k) AS owner, max(version_after) AS version FROM f GROUP BY 1)
SELECT l.dedupe_key, l.scope_id, coalesce(d.status, l.status) AS status, CASE WHEN d.dedupe_key IS NULL THEN l.owner ELSE nullif(d.owner, '') END AS owner, coalesce(d.version, 1)::INTEGER AS lifecycle_version
FROM ledger l LEFT JOIN done d USING (dedupe_key)""",
    "mapping_lifecycle": f"{_LOG} SELECT connection, resource, ordinal, kind, version::INTEGER AS version, outcome, active::INTEGER AS active_version, len(applied)::INTEGER AS frozen_versions FROM f WHERE k > 0",
}
