"""Ordered folds: the actions of people on one record, applied one after another, each against what the ones before left.

The actions of a key are collected in order and folded by ``aggregate``; they are what people did to one gap or one mapping, so few.
Every action gets an outcome; the state after the last one is the record's new state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledger import CHAIN, DISMISSAL_REASONS, TERMINAL

STATE = "struct<status string, version int, owner string>"
STEP = f"struct<ordinal bigint, outcome string, before {STATE}, after {STATE}>"


def legal(status: Column, to: Column) -> Column:
    """One step along the chain, or dismissal from anywhere open; null statuses are nowhere."""
    chain = F.array(*[F.lit(s) for s in CHAIN])
    along = F.array_position(chain, to) == F.array_position(chain, status) + 1
    dismissal = (to == "dismissed") & ~status.isin(*TERMINAL)
    return F.coalesce((F.array_position(chain, status) > 0) & (F.array_position(chain, to) > 0) & along | dismissal, F.lit(False))


def filled(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) != ""


def gap_outcome(state: Column, a: Column) -> Column:
    """Why an action on a gap is refused, or ``applied``; the checks come in a fixed order."""
    stale = ~F.coalesce(state.version == a.expected_version, F.lit(False))
    reasoned = F.coalesce(a.reason_code.isin(*DISMISSAL_REASONS), F.lit(False)) & filled(a.note)
    lacking = F.when(a.to_status == "dismissed", ~reasoned).when(a.to_status == "resolved", a.outcome_id.isNull()).when(a.to_status == "triaged", state.owner.isNull())
    transition = F.when(~legal(state.status, a.to_status), "illegal_transition").when(stale, "version_conflict").when(lacking, "missing_requirement").otherwise("applied")
    assignment = F.when(stale, "version_conflict").otherwise("applied")
    work = F.when(state.status.isin(*TERMINAL), "terminal").otherwise("applied")
    allowed = F.coalesce(a.may_act, F.lit(False))
    return F.when(state.status.isNull(), "no_such_gap").when(~allowed, "not_permitted").when(a.kind == "transition", transition).when(a.kind == "assign", assignment).when(a.kind == "action", work).otherwise("unknown_kind")


def gap_actions(ledger: DataFrame, actions: DataFrame) -> DataFrame:
    """A row for each action, with its outcome and the gap's state before and after it.

    ledger: dedupe_key, status, lifecycle_version, owner. actions: dedupe_key, ordinal, kind (transition, assign, action), to_status,
    owner, may_act, expected_version, reason_code, note, outcome_id. Actions of one gap are taken by ordinal, equal ordinals by their
    other columns. Of several that expect one version the first that may be applied wins, and the others are in conflict.
    """
    fields = ["ordinal", "kind", "to_status", "owner", "may_act", "expected_version", "reason_code", "note", "outcome_id"]
    of_gap = actions.groupBy("dedupe_key").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("actions"))
    state = F.struct(F.col("status"), F.col("lifecycle_version").cast("int").alias("version"), F.col("owner")).cast(STATE)
    known = of_gap.join(ledger.select("dedupe_key", state.alias("state")), "dedupe_key", "left")

    def step(acc: Column, a: Column) -> Column:
        s = acc.state
        outcome = gap_outcome(s, a)
        moved = outcome == "applied"
        transition, assignment = moved & (a.kind == "transition"), moved & (a.kind == "assign")
        after = F.struct(
            F.when(transition, a.to_status).otherwise(s.status).alias("status"),
            (s.version + (transition | assignment).cast("int")).alias("version"),
            F.when(assignment, a.owner).otherwise(s.owner).alias("owner"),
        ).cast(STATE)
        done = F.struct(a.ordinal.cast("bigint").alias("ordinal"), outcome.alias("outcome"), s.alias("before"), after.alias("after")).cast(STEP)
        return F.struct(after.alias("state"), F.concat(acc.steps, F.array(done)).alias("steps"))

    start = F.struct(F.coalesce("state", F.lit(None).cast(STATE)).alias("state"), F.array().cast(f"array<{STEP}>").alias("steps"))
    folded = known.select("dedupe_key", "actions", F.aggregate("actions", start, step).alias("folded"))
    each = folded.select("dedupe_key", F.explode(F.arrays_zip(F.col("actions"), F.col("folded.steps").alias("steps"))).alias("x"))
    return each.select(
        "dedupe_key", "x.actions.ordinal", "x.actions.kind", "x.actions.to_status", "x.steps.outcome",
        F.col("x.steps.before.status").alias("status"), F.col("x.steps.after.status").alias("status_after"),
        F.col("x.steps.after.version").alias("version_after"), F.col("x.steps.after.owner").alias("owner_after"),
    )


def after_actions(ledger: DataFrame, actions: DataFrame) -> DataFrame:
    """The ledger as the actions leave it."""
    done = gap_actions(ledger, actions).where("outcome = 'applied'")
    last = done.groupBy("dedupe_key").agg(F.max_by(F.struct("status_after", "version_after", "owner_after"), F.struct("version_after", "ordinal")).alias("_last"))
    out = ledger.join(last, "dedupe_key", "left")
    changed = F.col("_last").isNotNull()
    return out.withColumns({
        "status": F.when(changed, F.col("_last.status_after")).otherwise(F.col("status")),
        "lifecycle_version": F.when(changed, F.col("_last.version_after")).otherwise(F.col("lifecycle_version")),
        "owner": F.when(changed, F.col("_last.owner_after")).otherwise(F.col("owner")),
    }).drop("_last")


def mapping_outcome(a: Column, highest: Column, active: Column, frozen: Column) -> Column:
    """create makes the next version; one is active at most; going back is no going forward; what was applied once is frozen."""
    exists = F.coalesce(a.version.between(1, highest), F.lit(False))
    is_active = F.coalesce(a.version == active, F.lit(False))
    apply = F.when(is_active, "already_active").otherwise("applied")
    back = F.when(is_active, "already_active").when(a.version > active, "newer_than_active").otherwise("rolled_back")
    return (
        F.when(a.kind == "create", "created")
        .when(~exists, "no_such_version")
        .when(a.kind == "apply", apply)
        .when(a.kind == "rollback", back)
        .when(a.kind == "edit", F.when(frozen, "frozen").otherwise("edited"))
        .otherwise("unknown_kind")
    )


def mapping_actions(actions: DataFrame, *keys: str) -> DataFrame:
    """A row for each action (keys, ordinal, kind, version) on the mapping of keys: version, outcome, and which version is active then.

    The fold is made of running counts, so a mapping may have any number of actions: as many versions exist as were created; after an
    apply the active one is the least of its version and of those gone back to since; frozen ones have been applied or gone back to.
    Equal actions (of one ordinal) are taken in turn.
    """
    rows = actions.select(*keys, F.col("ordinal").cast("bigint").alias("ordinal"), "kind", F.col("version").cast("int").alias("version"))
    a = F.struct("kind", "version")
    so_far = lambda *by: Window.partitionBy(*keys, *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    before = lambda *by: Window.partitionBy(*keys, *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal", "kind", "version")))
    made = numbered.withColumn("_highest", F.count_if(F.coalesce(F.col("kind") == "create", F.lit(False))).over(so_far()).cast("int"))
    named = F.coalesce(F.col("version").between(1, F.col("_highest")), F.lit(False))  # the version is there
    since = made.withColumn("_applies", F.count_if(named & F.coalesce(F.col("kind") == "apply", F.lit(False))).over(so_far()))
    held = since.withColumn("_active", F.min(F.when(named & F.col("kind").isin("apply", "rollback"), F.col("version"))).over(so_far("_applies")))
    known = held.withColumn("_was", F.lag("_active").over(Window.partitionBy(*keys).orderBy("_at")))
    live = mapping_outcome(a, F.col("_highest"), F.col("_was"), F.lit(False)).isin("applied", "rolled_back")
    seen = known.withColumn("_live", live).withColumn("_frozen", F.coalesce(F.max("_live").over(before("version")), F.lit(False)))
    counted = seen.withColumn("_versions", F.count_if(F.col("_live") & ~F.col("_frozen")).over(so_far()).cast("int"))
    version = F.when(F.col("kind") == "create", F.col("_highest")).otherwise(F.col("version"))
    outcome = mapping_outcome(a, F.col("_highest"), F.col("_was"), F.col("_frozen"))
    return counted.select(*keys, "ordinal", "kind", version.alias("version"), outcome.alias("outcome"), F.col("_active").alias("active_version"), F.col("_versions").alias("frozen_versions"))
