"""From candidates to the ledger: keys, suppression, correlation, create-or-update, lifecycle, and ledger summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Gap types about the data itself, statuses, legal transitions, dismissal reasons, severities in order.
QUALITY_TYPES = ("source_freshness_breach", "data_completeness_drop", "schema_drift", "identity_match_failure")
CHAIN = ("detected", "triaged", "investigating", "actioned", "validating", "resolved")
TERMINAL = ("resolved", "dismissed")
STATUSES = (*CHAIN, "dismissed")
SEVERITIES = ("critical", "high", "medium", "low", "info")
DISMISSAL_REASONS = ("not_a_problem", "known_and_accepted", "duplicate", "data_error", "out_of_scope", "already_fixed")
MEASURED = ("severity", "observed", "expected", "confidence_score", "confidence_band", "exposure_low", "exposure_base", "exposure_high", "reason_codes")
STALE_SECONDS = 6 * 3600


def dedupe_key(organization_id: str, pack: str, rule_id: str) -> Column:
    """What makes two candidates the same finding: never the window or the values."""
    parts = (F.lit(organization_id), F.lit(pack), F.col("gap_type"), F.col("scope_type"), F.col("scope_id"), F.lit(rule_id))
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def severity_rank(c: str = "severity") -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col(c)).cast("int")


def is_open(c: str = "status") -> Column:
    return ~F.col(c).isin(*TERMINAL)


def suppress(candidates: DataFrame, open_gaps: DataFrame) -> DataFrame:
    """Business candidates that depend on a scope, or read a source, with an open data-quality gap are kept, with low confidence and a reason.

    One decision for both: scopes count where both sides name them, sources (an array, by dedupe_key) where both do. A note says what
    capped the confidence.
    """
    bad = open_gaps.where(F.col("gap_type").isin(*QUALITY_TYPES) & is_open())
    has = lambda *names: all(n in candidates.columns and n in open_gaps.columns for n in names)
    out, hits = candidates, []
    if has("scope_type", "scope_id"):
        out = out.join(bad.select("scope_type", "scope_id", F.lit(True).alias("_scope")).distinct(), ["scope_type", "scope_id"], "left")
        hits.append("_scope")
    if has("sources"):
        named = bad.select(F.explode("sources").alias("source")).distinct()
        reading = candidates.select("dedupe_key", F.explode("sources").alias("source")).join(named, "source").select("dedupe_key", F.lit(True).alias("_source")).distinct()
        out = out.join(reading, "dedupe_key", "left")
        hits.append("_source")
    hit = F.coalesce(*hits, F.lit(False)) & ~F.col("gap_type").isin(*QUALITY_TYPES)
    capped = {"confidence_band": F.when(hit, "low").otherwise(F.col("confidence_band")), "suppressed": hit}
    capped["cap_note"] = F.when(hit, F.when(F.coalesce(hits[0], F.lit(False)), f"open data-quality gap of its {hits[0][1:]}").otherwise("open data-quality gap of its source")) if hits else F.lit(None).cast("string")
    if "reason_codes" in candidates.columns:
        capped["reason_codes"] = F.when(hit, F.concat_ws(",", "reason_codes", F.lit("suppressed_by_data_quality"))).otherwise(F.col("reason_codes"))
    return out.withColumns(capped).drop(*hits)


#: Findings of one scope or key that one task compares with as many others.
BLOCK = 1000


def correlate(candidates: DataFrame) -> DataFrame:
    """Pairs (a, b) of different findings that share a scope (and window, where they name one) or a correlation key; equality joins, never all pairs.

    What a finding may share are its tokens. A pair comes once, from the least token both have, so pairs are neither kept nor compared with each
    other. Findings with a token that many have are dealt into blocks by name, and any two blocks meet in one place: tasks are bounded, and
    what is sent grows with the pairs, a BLOCK-th part of them.
    """
    window = [x for x in ("window_start", "window_end") if x in candidates.columns]
    scope = F.when(F.concat(*[F.col(x).cast("string") for x in ("scope_type", "scope_id", *window)]).isNotNull(), F.to_json(F.array(*[F.col(x).cast("string") for x in ("scope_type", "scope_id", *window)])))
    keys = F.transform(F.coalesce("correlation_keys", F.array()), lambda k: F.concat(F.lit("key:"), k))
    own = F.filter(F.concat(F.array(scope), keys), lambda t: t.isNotNull())
    named = candidates.select(F.concat_ws(":", "gap_type", "scope_id").alias("name"), F.struct("gap_type", "scope_id").alias("of"), own.alias("tokens"))
    found = named.groupBy("name").agg(F.min("of").alias("of"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("tokens"))  # a finding's rows
    each = found.withColumn("token", F.explode("tokens"))
    blocks = each.groupBy("token").count().where(F.col("count") > BLOCK).select("token", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = each.join(F.broadcast(blocks), "token", "left")  # at most a row for every BLOCK findings
    n = F.coalesce("blocks", F.lit(1))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("name"), n).cast("int")).withColumn("last", n - 1)

    def side(letter: str, first: Column, last: Column) -> DataFrame:
        return dealt.select(F.col("token").alias(f"{letter}_token"), *[F.col(x).alias(f"{letter}_{x}") for x in ("name", "of", "tokens", "block")], F.explode(F.sequence(first, last)).alias(f"{letter}_other"))

    left, right = side("l", F.col("block"), F.col("last")), side("r", F.lit(0), F.col("block"))
    # the place of blocks i <= j: of the left, those in i, of the right, those in j
    met = (F.col("l_token") == F.col("r_token")) & (F.col("l_block") == F.col("r_other")) & (F.col("l_other") == F.col("r_block"))
    both = left.join(right.hint("merge"), met).where("(l_block < r_block and l_name <> r_name) or l_name < r_name")
    both = both.where("not (l_of.gap_type = r_of.gap_type and l_of.scope_id = r_of.scope_id)")
    once = both.where(F.array_min(F.array_intersect("l_tokens", "r_tokens")) == F.col("l_token"))
    return once.select(F.least("l_name", "r_name").alias("a"), F.greatest("l_name", "r_name").alias("b"))


def decisions(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """create or update for each candidate (dedupe_key, ordinal): an open gap or an earlier candidate of the run means update."""
    known = ledger.where(is_open()).select("dedupe_key", F.lit(True).alias("_open")).distinct()
    first = F.row_number().over(Window.partitionBy("dedupe_key").orderBy("ordinal")) == 1
    out = candidates.join(known, "dedupe_key", "left")
    return out.withColumn("decision", F.when(F.col("_open").isNull() & first, "create").otherwise("update")).drop("_open")


def upsert(ledger: DataFrame, candidates: DataFrame, as_of: Column) -> DataFrame:
    """The ledger after a run: open gaps get the run's last measurements, new findings are added, terminal gaps stay as they are.

    Status, owner, first_seen and lifecycle_version are people's and never overwritten.
    """
    last = F.row_number().over(Window.partitionBy("dedupe_key").orderBy(F.desc("ordinal")))
    new = candidates.withColumn("_n", last).where("_n = 1").select("dedupe_key", "gap_type", "scope_type", "scope_id", *[F.col(m).alias(f"new_{m}") for m in MEASURED], F.lit(True).alias("_new"))
    old, closed = ledger.where(is_open()), ledger.where(~is_open())
    both = old.withColumn("_old", F.lit(True)).join(new, ["dedupe_key", "gap_type", "scope_type", "scope_id"], "full_outer")
    fresh = F.col("_old").isNull()
    merged = both.select(
        "dedupe_key", "gap_type", "scope_type", "scope_id",
        *[F.when(F.col("_new"), F.col(f"new_{m}")).otherwise(F.col(m)).alias(m) for m in MEASURED],
        F.when(fresh, "detected").otherwise(F.col("status")).alias("status"),
        F.col("owner"),
        F.when(fresh, as_of).otherwise(F.col("first_seen")).alias("first_seen"),
        F.when(F.col("_new"), as_of).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(fresh, 1).otherwise(F.col("lifecycle_version")).alias("lifecycle_version"),
    )
    return merged.unionByName(closed.select(*merged.columns))


def transitions(spark: SparkSession) -> DataFrame:
    """All pairs of statuses, and which are legal: one step along the chain, or dismissal from anywhere open."""
    rows = [(a, b, (a in CHAIN[:-1] and b == CHAIN[CHAIN.index(a) + 1]) or (a not in TERMINAL and b == "dismissed")) for a in STATUSES for b in STATUSES]
    return spark.createDataFrame(rows, "from_status string, to_status string, legal boolean")


def envelope(ledger: DataFrame, *groups: str) -> DataFrame:
    """Exposure of a set of gaps: never across currencies, never a sum of base values, gaps of low confidence left out."""
    priced = F.col("exposure_high").isNotNull()
    counted = priced & (F.col("confidence_band") != "low")
    rank = F.array_position(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("confidence_band"))
    sums = ledger.groupBy(*groups).agg(
        F.count_if(priced).alias("priced"),
        F.count_if(counted).alias("contributing"),
        F.count_if(~priced).alias("without_exposure"),
        F.size(F.collect_set(F.when(priced, F.col("currency")))).alias("currencies"),
        F.sum(F.when(counted, F.col("exposure_low"))).alias("low"),
        F.sum(F.when(counted, F.col("exposure_high"))).alias("high"),
        F.min(F.when(counted, rank)).alias("_rank"),
    )
    kind = F.when((F.col("priced") == 0), "none").when(F.col("currencies") > 1, "mixed").when(F.col("contributing") == 0, "none").otherwise("range")
    shown = F.col("kind") == "range"
    return sums.withColumn("kind", kind).select(
        *groups, "kind", *[F.when(shown, F.col(c)).alias(c) for c in ("low", "high", "contributing")], (F.col("priced") - F.col("contributing")).alias("excluded_low_confidence"), "without_exposure",
        F.when(shown, F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("_rank").cast("int"))).alias("band"),
    )


def candidate_faults(candidates: DataFrame) -> Column:
    """What makes a candidate invalid, and with it the whole run: no evidence, no scope, nothing that differs."""
    faults = [
        F.when(F.coalesce(F.size("evidence"), F.lit(0)) < 1, "no_evidence"),
        F.when(F.trim(F.coalesce("scope_id", F.lit(""))) == "", "no_scope"),
        F.when(F.col("observed").eqNullSafe(F.col("expected")), "observed_is_expected"),
    ]
    return F.filter(F.array(*faults), lambda f: f.isNotNull())
