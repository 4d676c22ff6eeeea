"""Findings over two detector runs: keys, decisions, the ledger and everything that is read from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import detect, folds, ledger as book
from ..sources import overlay
from . import detection
from .detection import mismatch_sql

ORG, PACK, RULE, FIRST_RUN, SECOND_RUN = "1", "retail", "rule-1", "2024-01-16", "2024-02-01"


def num() -> F.Column:
    return F.col("scope_id").cast("long")


def found(spark, sf_dir, before: str) -> DataFrame:
    c = detect.source_mismatch(detection.error_rates(spark, sf_dir, before), detection.MISMATCH)
    return c.withColumn("dedupe_key", book.dedupe_key(ORG, PACK, RULE))


def ledger(spark, sf_dir) -> DataFrame:
    """The ledger as people have left it after the first run."""
    statuses = F.array(*[F.lit(s) for s in book.STATUSES])
    at = F.lit(FIRST_RUN).cast("timestamp_ntz")
    return found(spark, sf_dir, FIRST_RUN).where(num() % 3 != 0).select(
        "dedupe_key", "gap_type", "scope_type", "scope_id", *book.MEASURED,
        F.element_at(statuses, (num() % 7 + 1).cast("int")).alias("status"),
        F.when(num() % 4 != 0, F.concat(F.lit("owner-"), (num() % 3).cast("string"))).alias("owner"),
        at.alias("first_seen"), at.alias("last_seen"), F.lit(1).alias("lifecycle_version"),
    )


def read_model(spark, sf_dir) -> DataFrame:
    """Ledger rows as readers see them."""
    return ledger(spark, sf_dir).select(
        "scope_id", "severity", "status", "owner", "confidence_band", "reason_codes", F.col("observed"), F.when(num() % 5 != 0, F.col("exposure_low")).alias("exposure_low"), F.when(num() % 5 != 0, F.col("exposure_high")).alias("exposure_high"),
        F.lit("GBP").alias("currency"), (num() % 25).cast("string").alias("location_id"), F.when(num() % 6 != 0, num() % 50 * 900).alias("freshness_seconds"),
        (F.lit(FIRST_RUN).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), (num() % 40).cast("int"))).alias("last_seen"),
        F.concat(F.lit("Mismatch at "), "scope_id", F.lit(" Store-"), (num() % 25).cast("string")).alias("title"),
        F.when(F.col("status") == "dismissed", F.element_at(F.array(*[F.lit(r) for r in book.DISMISSAL_REASONS]), (num() % 6 + 1).cast("int"))).alias("dismissal_reason"),
    )


def second_run(spark, sf_dir) -> DataFrame:
    """The second run's candidates, some found twice."""
    c = found(spark, sf_dir, SECOND_RUN)
    return c.withColumn("ordinal", F.lit(1)).unionByName(c.where(num() % 10 == 0).withColumns({"ordinal": F.lit(2), "observed": F.col("observed") + 1}))


def dedupe_key(spark, sf_dir):
    return found(spark, sf_dir, SECOND_RUN).select("scope_id", "dedupe_key")


def dedupe_decisions(spark, sf_dir):
    return book.decisions(second_run(spark, sf_dir), ledger(spark, sf_dir)).select("scope_id", "ordinal", "decision")


def after(spark, sf_dir) -> DataFrame:
    return book.upsert(ledger(spark, sf_dir), second_run(spark, sf_dir), F.lit(SECOND_RUN).cast("timestamp_ntz"))


def gap_upsert(spark, sf_dir):
    return after(spark, sf_dir).select("dedupe_key", "scope_id", "status", "owner", "severity", "observed", "exposure_base", "first_seen", "last_seen", "lifecycle_version")


def broken_invariants(rows: DataFrame) -> DataFrame:
    """dedupe_key of gaps that break a rule of the ledger, and of keys with more than one open gap."""
    wrong = "exposure_low > exposure_base or exposure_base > exposure_high or confidence_score < 0 or confidence_score > 1 or observed = expected or first_seen > last_seen or lifecycle_version < 1"
    broken = rows.where(wrong).select("dedupe_key")
    twice = rows.where(book.is_open()).groupBy("dedupe_key").count().where("count > 1").select("dedupe_key")
    return broken.unionByName(twice)


def assert_gap_invariants(spark, sf_dir):
    """Over a ledger with six kinds of damage, one for each remainder of the scope's number by 7."""
    rows = after(spark, sf_dir)
    kind = num() % 7
    damaged = (
        rows.withColumn("first_seen", F.when(kind == 0, F.expr("last_seen + interval 1 day")).otherwise(F.col("first_seen")))
        .withColumn("lifecycle_version", F.when(kind == 1, 0).otherwise(F.col("lifecycle_version")))
        .withColumn("exposure_low", F.when(kind == 2, F.col("exposure_base") + 1).otherwise(F.col("exposure_low")))
        .withColumn("confidence_score", F.when(kind == 3, 1.5).otherwise(F.col("confidence_score")))
        .withColumn("observed", F.when(kind == 4, F.col("expected")).otherwise(F.col("observed")))
    )
    return broken_invariants(damaged.unionByName(damaged.where(kind == 5)))


def suppress(spark, sf_dir):
    gaps = ledger(spark, sf_dir).withColumn("gap_type", F.when(num() % 4 == 1, "source_freshness_breach").otherwise(F.col("gap_type")))
    return book.suppress(found(spark, sf_dir, SECOND_RUN), gaps).select("scope_id", "confidence_band", "reason_codes", "suppressed")


def suppress_once(spark, sf_dir):
    """Scopes and sources in one decision: users with an open gap of quality, and users that read one of the sources that have."""
    source = F.array(F.concat(F.lit("feed-"), (num() % 7).cast("string")))
    gaps = ledger(spark, sf_dir).withColumn("gap_type", F.when(num() % 4 == 1, "source_freshness_breach").otherwise(F.col("gap_type"))).withColumn("sources", F.when(num() % 5 == 0, source).otherwise(F.array().cast("array<string>")))
    out = book.suppress(found(spark, sf_dir, SECOND_RUN).withColumn("sources", source), gaps)
    return out.select("scope_id", "confidence_band", "reason_codes", "suppressed", "cap_note")


def correlate_windows(spark, sf_dir):
    """Findings of two runs: those of one scope belong together within a window only."""
    runs = [(FIRST_RUN, 0.15, 0.25), (SECOND_RUN, 0.1, 0.3)]
    rows = None
    for at, low, high in runs:
        r = detection.error_rates(spark, sf_dir, at)
        both = detect.source_mismatch(r, detection.MISMATCH).unionByName(detect.ratio_threshold(r, detection.RATIO, 0.2, low, high, 1250))
        one = both.withColumns({"window_start": F.lit("2024-01-01"), "window_end": F.lit(at), "correlation_keys": F.array().cast("array<string>"), "gap_type": F.concat("gap_type", F.lit("@" + at[5:7]))})
        rows = one if rows is None else rows.unionByName(one)
    return book.correlate(rows)


def correlate(spark, sf_dir):
    rows = detection.det_source_mismatch(spark, sf_dir).unionByName(detection.det_ratio_threshold(spark, sf_dir))
    keyed = rows.withColumn("correlation_keys", F.when(num() % 10 == 0, F.array(F.concat(F.lit("source:"), (num() % 50).cast("string")))).otherwise(F.array().cast("array<string>")))
    return book.correlate(keyed)


def gap_timeline(spark, sf_dir):
    """One evolving finding per scope: its measurement after the run at the end of each day."""
    e = overlay.table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), (F.col("event_type") == "error").cast("long").alias("error"))
    counts = e.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.sum("error").alias("errors"))
    spine = e.select("user_id").distinct().join(F.broadcast(e.select("day").distinct()))  # a row for each day
    so_far = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    sums = spine.join(counts, ["user_id", "day"], "left").select(F.col("user_id").cast("string").alias("scope_id"), "day", F.sum("n").over(so_far).alias("n"), F.sum("errors").over(so_far).alias("errors"))
    firing = sums.where("n >= 30").withColumn("value", F.round(F.col("errors") / F.col("n").cast("double"), 6)).where("value > 0.05")
    return firing.groupBy("scope_id").agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), (F.count("*") - 1).alias("updates"), F.max_by("value", "day").alias("observed"))


def legal_transitions(spark, sf_dir):
    """Every pair of statuses, whether it is legal, and how many gaps of the ledger are where it begins."""
    gaps = ledger(spark, sf_dir).groupBy(F.col("status").alias("from_status")).agg(F.count("*").alias("gaps"))
    return book.transitions(spark).join(gaps, "from_status", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)))


def lifecycle_requests(spark, sf_dir):
    targets = F.array(*[F.lit(s) for s in book.STATUSES[1:]])
    rows = ledger(spark, sf_dir)
    requests = rows.select(
        "dedupe_key", F.lit(1).alias("ordinal"), F.lit("transition").alias("kind"), F.element_at(targets, (num() % 6 + 1).cast("int")).alias("to_status"), F.lit(None).cast("string").alias("owner"),
        (num() % 11 != 0).alias("may_act"), F.when(num() % 8 == 0, 2).otherwise(1).alias("expected_version"),
        F.when(num() % 2 == 0, "duplicate").alias("reason_code"), F.lit("seen").alias("note"), F.when(num() % 5 == 0, F.lit("o")).alias("outcome_id"),
    )
    return folds.gap_actions(rows, requests).select("dedupe_key", "status", "to_status", "outcome", "status_after", "version_after")


def outcome_delta(spark, sf_dir):
    before, now = detection.error_rates(spark, sf_dir, FIRST_RUN), detection.error_rates(spark, sf_dir).withColumnRenamed("value", "after")
    return before.join(now.select("scope_id", "after"), "scope_id").select("scope_id", F.round(F.col("after") - F.col("value"), 6).alias("delta"))


def ledger_list(spark, sf_dir):
    return read_model(spark, sf_dir).where("status = 'triaged'").orderBy(book.severity_rank(), F.desc("last_seen"), "scope_id").offset(2).limit(10).select("scope_id", "severity", "last_seen")


def ledger_frontline(spark, sf_dir):
    """Without the capability to see exposure its columns are absent, and so are reasons that speak of it."""
    kept = F.array_join(F.filter(F.split("reason_codes", ","), lambda r: ~r.isin("modelled_exposure", "wide_exposure_interval")), ",")
    return read_model(spark, sf_dir).select("scope_id", "severity", "status", "confidence_band", kept.alias("reason_codes"))


def ledger_stale(spark, sf_dir):
    return read_model(spark, sf_dir).where(F.col("freshness_seconds").isNull() | (F.col("freshness_seconds") > book.STALE_SECONDS)).select("scope_id", "freshness_seconds")


def ledger_search(spark, sf_dir, words: str = "  STORE-1 "):
    return read_model(spark, sf_dir).where(F.lower(F.concat_ws(" ", "title", "scope_id", "severity")).contains(words.strip().lower())).select("scope_id", "title")


def ledger_severity(spark, sf_dir):
    return read_model(spark, sf_dir).where("severity = 'high'").select("scope_id", "status")


def open_gaps(spark, sf_dir):
    return read_model(spark, sf_dir).where(book.is_open()).select("scope_id", "status")


def ledger_rank(spark, sf_dir):
    order = Window.partitionBy("location_id").orderBy(F.desc_nulls_last("exposure_high"), "scope_id")
    return read_model(spark, sf_dir).select("location_id", "scope_id", "exposure_high", F.row_number().over(order).alias("rank"))


def topk_gaps_per_location(spark, sf_dir):
    return ledger_rank(spark, sf_dir).where("rank <= 2")


def situation_summary(spark, sf_dir):
    return read_model(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("freshness_seconds") > book.STALE_SECONDS).alias("stale"), F.count_if(F.col("freshness_seconds").isNull()).alias("age_unknown"), F.count_if(F.col("owner").isNull()).alias("unowned"), *[F.count_if(F.col("severity") == s).alias(s) for s in book.SEVERITIES])


def exposure_envelope(spark, sf_dir):
    return book.envelope(read_model(spark, sf_dir), "status")


def ledger_groups(spark, sf_dir):
    counts = read_model(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("gaps"))
    return book.envelope(read_model(spark, sf_dir), "severity").join(counts, "severity").select("severity", book.severity_rank().alias("position"), "gaps", "kind", "low", "high")


def dismissal_rates(spark, sf_dir):
    return read_model(spark, sf_dir).where("status = 'dismissed'").groupBy("dismissal_reason").agg(F.count("*").alias("n"))


def channel_strip(spark, sf_dir):
    """Each event type's daily series, its last reading and the change to the day before; a series of one isn't drawn."""
    daily = overlay.table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("v"))
    rows = daily.groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("day", "v"))).alias("s"))  # one entry a day
    v = F.transform("s", lambda x: x["v"])
    return rows.select("event_type", F.array_join(v, ",").alias("series"), F.element_at(v, -1).alias("latest"), F.when(F.size("s") >= 2, F.element_at(v, -1) - F.try_element_at(v, F.lit(-2))).alias("delta"))


def pressure_grid(spark, sf_dir):
    """Readings by location and hour over a complete grid; an hour without a reading is unknown, not zero."""
    e = overlay.table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    read = e.groupBy("day", (F.col("user_id") % 8).alias("location"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    hours = spark.range(8).select(F.col("id").alias("location"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    grid = e.select("day").distinct().join(F.broadcast(hours))  # the hours are 192 rows
    state = F.when(F.col("n").isNull(), "unknown").when(F.col("n") >= 4, "pressure").when(F.col("n") >= 2, "elevated").otherwise("normal")
    return grid.join(read, ["day", "location", "hour"], "left").select("day", "location", "hour", "n", state.alias("state"))


def pressure_totals(spark, sf_dir):
    wide = pressure_grid(spark, sf_dir).groupBy("day", "location").pivot("state", ["normal", "elevated", "pressure", "unknown"]).count()
    return wide.na.fill(0)


def source_health(spark, sf_dir):
    ages = detection.source_ages(spark, sf_dir)
    state = F.when(F.col("age_seconds") <= 7200, "healthy").when(F.col("age_seconds") <= 86400, "late").otherwise("silent")
    return ages.select(state.alias("state")).groupBy("state").agg(F.count("*").alias("sources"))


def quarantine_counts(spark, sf_dir):
    q = overlay.quarantined(spark, sf_dir).select("source_key", F.explode("reason_flags").alias("flag"))
    return q.groupBy("source_key", "flag").agg(F.count("*").alias("records"))


def run_summary(spark, sf_dir):
    """Read, written and quarantined records of each source, and how its run ended."""
    e = overlay.table(spark, sf_dir, "events").select(F.concat(F.lit("feed-"), (F.col("user_id") % 4).cast("string")).alias("source_key"), (F.col("event_type") == "error").alias("bad"), "event_id")
    counts = e.groupBy("source_key").agg(F.count("*").alias("records_read"), F.count_if(~F.col("bad")).alias("records_written"), F.count_if("bad").alias("records_quarantined"), F.min(F.when(F.col("bad"), F.col("event_id"))).alias("first_rejected"))
    outcome = F.when(F.col("records_written") == 0, "failed").when(F.col("records_quarantined") > 0, "partial").otherwise("succeeded")
    return counts.withColumn("outcome", outcome)


def runs_recent(spark, sf_dir):
    e = overlay.table(spark, sf_dir, "events")
    return e.groupBy(F.to_date("ts").alias("started_on")).agg(F.count("*").alias("records")).orderBy(F.desc("started_on")).limit(7)


QUERIES = {f.__name__: f for f in (dedupe_key, dedupe_decisions, gap_upsert, assert_gap_invariants, suppress, suppress_once, correlate, correlate_windows, gap_timeline, legal_transitions, lifecycle_requests, outcome_delta, ledger_list, ledger_frontline, ledger_stale, ledger_search, ledger_severity, open_gaps, ledger_rank, topk_gaps_per_location, situation_summary, exposure_envelope, ledger_groups, dismissal_rates, channel_strip, pressure_grid, pressure_totals, source_health, quarantine_counts, run_summary, runs_recent)}

N = "CAST(scope_id AS BIGINT)"
KEY = "sha256('1|retail|' || gap_type || '|' || scope_type || '|' || scope_id || '|rule-1')"
STATUS = "(['detected', 'triaged', 'investigating', 'actioned', 'validating', 'resolved', 'dismissed'])"
BOOK = f"""
run1 AS (SELECT *, {KEY} AS dedupe_key FROM ({mismatch_sql(FIRST_RUN)})),
run2 AS (SELECT *, {KEY} AS dedupe_key FROM ({mismatch_sql(SECOND_RUN)})),
ledger AS (SELECT *, {STATUS}[{N} % 7 + 1] AS status, CASE WHEN {N} % 4 <> 0 THEN 'owner-' || ({N} % 3) END AS owner FROM run1 WHERE {N} % 3 <> 0),
cand AS (SELECT *, 1 AS ordinal FROM run2 UNION ALL SELECT * REPLACE (observed + 1 AS observed), 2 AS ordinal FROM run2 WHERE {N} % 10 = 0),
model AS (
  SELECT scope_id, severity, status, owner, confidence_band, reason_codes, observed, CASE WHEN {N} % 5 <> 0 THEN exposure_low END AS exposure_low, CASE WHEN {N} % 5 <> 0 THEN exposure_high END AS exposure_high,
    CAST({N} % 25 AS VARCHAR) AS location_id, CASE WHEN {N} % 6 <> 0 THEN {N} % 50 * 900 END AS freshness_seconds, TIMESTAMP '{FIRST_RUN}' - to_hours(CAST({N} % 40 AS INTEGER)) AS last_seen,
    'Mismatch at ' || scope_id || ' Store-' || ({N} % 25) AS title,
    CASE WHEN status = 'dismissed' THEN (['not_a_problem', 'known_and_accepted', 'duplicate', 'data_error', 'out_of_scope', 'already_fixed'])[{N} % 6 + 1] END AS dismissal_reason
  FROM ledger
)"""
RANK = "list_position(['critical', 'high', 'medium', 'low', 'info'], severity)"
ENVELOPE = """count(*) FILTER (exposure_high IS NOT NULL) AS priced, count(*) FILTER (exposure_high IS NOT NULL AND confidence_band <> 'low') AS counted, count(*) FILTER (exposure_high IS NULL) AS without_exposure,
  CAST(sum(exposure_low) FILTER (exposure_high IS NOT NULL AND confidence_band <> 'low') AS BIGINT) AS lo, CAST(sum(exposure_high) FILTER (confidence_band <> 'low') AS BIGINT) AS hi,
  min(list_position(['low', 'medium', 'high'], confidence_band)) FILTER (exposure_high IS NOT NULL AND confidence_band <> 'low') AS r"""
UPSERTED = f"""
, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY ordinal DESC) AS rn FROM cand) WHERE rn = 1),
opened AS (SELECT * FROM ledger WHERE status NOT IN ('resolved', 'dismissed')),
merged AS (
  SELECT coalesce(o.dedupe_key, n.dedupe_key) AS dedupe_key, coalesce(o.scope_id, n.scope_id) AS scope_id, coalesce(o.status, 'detected') AS status, o.owner AS owner,
    coalesce(n.severity, o.severity) AS severity, coalesce(n.observed, o.observed) AS observed, coalesce(n.exposure_base, o.exposure_base) AS exposure_base,
    CASE WHEN o.dedupe_key IS NULL THEN TIMESTAMP '{SECOND_RUN}' ELSE TIMESTAMP '{FIRST_RUN}' END AS first_seen, CASE WHEN n.dedupe_key IS NULL THEN TIMESTAMP '{FIRST_RUN}' ELSE TIMESTAMP '{SECOND_RUN}' END AS last_seen, 1 AS lifecycle_version
  FROM opened o FULL OUTER JOIN latest n ON o.dedupe_key = n.dedupe_key
  UNION ALL SELECT dedupe_key, scope_id, status, owner, severity, observed, exposure_base, TIMESTAMP '{FIRST_RUN}', TIMESTAMP '{FIRST_RUN}', 1 FROM ledger WHERE status IN ('resolved', 'dismissed')
)"""
LEGAL = f"(SELECT a AS from_status, b AS to_status, (a NOT IN ('resolved', 'dismissed') AND b = 'dismissed') OR (list_position({STATUS}, b) = list_position({STATUS}, a) + 1 AND b <> 'dismissed' AND a <> 'dismissed') AS legal FROM (SELECT unnest({STATUS}) AS a), (SELECT unnest({STATUS}) AS b))"
TIMELINE = """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), u AS (SELECT DISTINCT user_id FROM events),
c AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2),
s AS (SELECT user_id, day, sum(n) OVER w AS n, sum(errors) OVER w AS errors FROM u CROSS JOIN d LEFT JOIN c USING (user_id, day) WINDOW w AS (PARTITION BY user_id ORDER BY day)),
f AS (SELECT CAST(user_id AS VARCHAR) AS scope_id, day, round(CAST(errors AS DOUBLE) / n, 6) AS value FROM s WHERE n >= 30)"""
GRID = """(SELECT d AS day, l AS location, CAST(h AS INTEGER) AS hour, n, CASE WHEN n IS NULL THEN 'unknown' WHEN n >= 4 THEN 'pressure' WHEN n >= 2 THEN 'elevated' ELSE 'normal' END AS state
  FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), (SELECT unnest(range(8)) AS l), (SELECT unnest(range(24)) AS h)
  LEFT JOIN (SELECT CAST(ts AS DATE) AS ud, user_id % 8 AS ul, hour(ts) AS uh, count(*) AS n FROM events GROUP BY 1, 2, 3) ON ud = d AND ul = l AND uh = h)"""

ORACLE_SQL = {
    "dedupe_key": f"WITH {BOOK} SELECT scope_id, dedupe_key FROM run2",
    "dedupe_decisions": f"WITH {BOOK} SELECT scope_id, ordinal, CASE WHEN ordinal = 1 AND dedupe_key NOT IN (SELECT dedupe_key FROM ledger WHERE status NOT IN ('resolved', 'dismissed')) THEN 'create' ELSE 'update' END AS decision FROM cand",
    "gap_upsert": f"WITH {BOOK}{UPSERTED} SELECT * FROM merged",
    "assert_gap_invariants": f"WITH {BOOK}{UPSERTED} SELECT dedupe_key FROM merged WHERE first_seen > last_seen OR {N} % 7 IN (0, 1, 3, 4) OR ({N} % 7 = 2 AND exposure_base IS NOT NULL) UNION ALL SELECT dedupe_key FROM merged WHERE {N} % 7 = 5 AND status NOT IN ('resolved', 'dismissed')",
    "suppress": f"WITH {BOOK}, q AS (SELECT scope_id FROM ledger WHERE {N} % 4 = 1 AND status NOT IN ('resolved', 'dismissed')) SELECT scope_id, CASE WHEN hit THEN 'low' ELSE confidence_band END AS confidence_band, CASE WHEN hit THEN reason_codes || ',suppressed_by_data_quality' ELSE reason_codes END AS reason_codes, hit AS suppressed FROM (SELECT *, scope_id IN (SELECT scope_id FROM q) AS hit FROM run2)",
    "correlate": f"""WITH c AS (SELECT gap_type, scope_id, gap_type || ':' || scope_id AS name, CASE WHEN {N} % 10 = 0 THEN {N} % 50 END AS k FROM (
  SELECT gap_type, scope_id FROM ({mismatch_sql()}) UNION ALL SELECT gap_type, scope_id FROM ({detection.ORACLE_SQL['det_ratio_threshold']})))
SELECT DISTINCT x.name AS a, y.name AS b FROM c x JOIN c y ON x.name < y.name AND (x.scope_id = y.scope_id OR x.k = y.k) AND NOT (x.gap_type = y.gap_type AND x.scope_id = y.scope_id)""",
    "suppress_once": f"""WITH {BOOK}, q AS (SELECT {N} AS k, {N} % 5 = 0 AS named FROM ledger WHERE {N} % 4 = 1 AND status NOT IN ('resolved', 'dismissed')),
h AS (SELECT *, {N} IN (SELECT k FROM q) AS scope, {N} % 7 IN (SELECT k % 7 FROM q WHERE named) AS source FROM run2)
SELECT scope_id, CASE WHEN scope OR source THEN 'low' ELSE confidence_band END AS confidence_band, CASE WHEN scope OR source THEN reason_codes || ',suppressed_by_data_quality' ELSE reason_codes END AS reason_codes, scope OR source AS suppressed,
  CASE WHEN scope THEN 'open data-quality gap of its scope' WHEN source THEN 'open data-quality gap of its source' END AS cap_note FROM h""",
    "correlate_windows": f"""WITH c AS ({' UNION ALL '.join(f"SELECT '{m}@{at[5:7]}:' || scope_id AS name, scope_id, '{at}' AS w FROM ({detection.rates_sql(at)}) WHERE n >= 30 AND {cond}" for at, low, high in ((FIRST_RUN, 0.15, 0.25), (SECOND_RUN, 0.1, 0.3)) for m, cond in (('source_mismatch', 'value > 0.05'), ('ratio_out_of_band', f'(value < {low} OR value > {high})')))})
SELECT DISTINCT x.name AS a, y.name AS b FROM c x JOIN c y ON x.scope_id = y.scope_id AND x.w = y.w AND x.name < y.name""",
    "gap_timeline": f"{TIMELINE} SELECT scope_id, min(day) AS first_seen, max(day) AS last_seen, count(*) - 1 AS updates, arg_max(value, day) AS observed FROM f WHERE value > 0.05 GROUP BY 1",
    "legal_transitions": f"WITH {BOOK}, n AS (SELECT status AS from_status, count(*) AS gaps FROM ledger GROUP BY 1) SELECT l.*, coalesce(gaps, 0) AS gaps FROM {LEGAL} l LEFT JOIN n USING (from_status)",
    "lifecycle_requests": f"""WITH {BOOK}, r AS (SELECT dedupe_key, scope_id, status, {STATUS}[{N} % 6 + 2] AS to_status FROM ledger),
j AS (SELECT r.*, CASE WHEN {N} % 11 = 0 THEN 'not_permitted' WHEN NOT legal THEN 'illegal_transition' WHEN {N} % 8 = 0 THEN 'version_conflict' WHEN r.to_status = 'dismissed' AND {N} % 2 <> 0 THEN 'missing_requirement'
  WHEN r.to_status = 'resolved' AND {N} % 5 <> 0 THEN 'missing_requirement' WHEN r.to_status = 'triaged' AND {N} % 4 = 0 THEN 'missing_requirement' ELSE 'applied' END AS outcome FROM r JOIN {LEGAL} l ON l.from_status = r.status AND l.to_status = r.to_status)
SELECT dedupe_key, status, to_status, outcome, CASE WHEN outcome = 'applied' THEN to_status ELSE status END AS status_after, CASE WHEN outcome = 'applied' THEN 2 ELSE 1 END AS version_after FROM j""",
    "outcome_delta": f"SELECT a.scope_id, round(b.value - a.value, 6) AS delta FROM ({detection.rates_sql(FIRST_RUN)}) a JOIN ({detection.rates_sql()}) b USING (scope_id)",
    "ledger_list": f"WITH {BOOK} SELECT scope_id, severity, last_seen FROM model WHERE status = 'triaged' ORDER BY {RANK}, last_seen DESC, scope_id LIMIT 10 OFFSET 2",
    "ledger_frontline": f"WITH {BOOK} SELECT scope_id, severity, status, confidence_band, replace(reason_codes, 'modelled_exposure,', '') AS reason_codes FROM model",
    "ledger_stale": f"WITH {BOOK} SELECT scope_id, freshness_seconds FROM model WHERE freshness_seconds IS NULL OR freshness_seconds > 21600",
    "ledger_search": f"WITH {BOOK} SELECT scope_id, title FROM model WHERE contains(lower(title || ' ' || scope_id || ' ' || severity), 'store-1')",
    "ledger_severity": f"WITH {BOOK} SELECT scope_id, status FROM model WHERE severity = 'high'",
    "open_gaps": f"WITH {BOOK} SELECT scope_id, status FROM model WHERE status NOT IN ('resolved', 'dismissed')",
    "ledger_rank": f"WITH {BOOK} SELECT location_id, scope_id, exposure_high, row_number() OVER (PARTITION BY location_id ORDER BY exposure_high DESC NULLS LAST, scope_id) AS rank FROM model",
    "topk_gaps_per_location": f"WITH {BOOK} SELECT * FROM (SELECT location_id, scope_id, exposure_high, row_number() OVER (PARTITION BY location_id ORDER BY exposure_high DESC NULLS LAST, scope_id) AS rank FROM model) WHERE rank <= 2",
    "situation_summary": f"WITH {BOOK} SELECT count(*) AS total, count(*) FILTER (freshness_seconds > 21600) AS stale, count(*) FILTER (freshness_seconds IS NULL) AS age_unknown, count(*) FILTER (owner IS NULL) AS unowned, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in book.SEVERITIES) + " FROM model",
    "exposure_envelope": f"WITH {BOOK}, e AS (SELECT status, {ENVELOPE} FROM model GROUP BY 1) SELECT status, CASE WHEN counted > 0 THEN 'range' ELSE 'none' END AS kind, CASE WHEN counted > 0 THEN lo END AS low, CASE WHEN counted > 0 THEN hi END AS high, CASE WHEN counted > 0 THEN counted END AS contributing, priced - counted AS excluded_low_confidence, without_exposure, CASE WHEN counted > 0 THEN (['low', 'medium', 'high'])[r] END AS band FROM e",
    "ledger_groups": f"WITH {BOOK}, e AS (SELECT severity, count(*) AS gaps, {ENVELOPE} FROM model GROUP BY 1) SELECT severity, {RANK} AS position, gaps, CASE WHEN counted > 0 THEN 'range' ELSE 'none' END AS kind, CASE WHEN counted > 0 THEN lo END AS low, CASE WHEN counted > 0 THEN hi END AS high FROM e",
    "dismissal_rates": f"WITH {BOOK} SELECT dismissal_reason, count(*) AS n FROM model WHERE status = 'dismissed' GROUP BY 1",
    "channel_strip": "WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS v FROM events GROUP BY 1, 2) SELECT event_type, string_agg(CAST(v AS VARCHAR), ',' ORDER BY day) AS series, arg_max(v, day) AS latest, CASE WHEN count(*) >= 2 THEN arg_max(v, day) - (list(v ORDER BY day))[-2] END AS delta FROM d GROUP BY 1",
    "pressure_grid": f"SELECT * FROM {GRID}",
    "pressure_totals": f"SELECT day, location, " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ("normal", "elevated", "pressure", "unknown")) + f" FROM {GRID} GROUP BY 1, 2",
    "source_health": f"SELECT CASE WHEN age_seconds <= 7200 THEN 'healthy' WHEN age_seconds <= 86400 THEN 'late' ELSE 'silent' END AS state, count(*) AS sources FROM {detection.AGES} GROUP BY 1",
    "quarantine_counts": "SELECT 'feed-' || (user_id % 4) AS source_key, 'out_of_range' AS flag, count(*) AS records FROM events WHERE event_type = 'error' GROUP BY 1",
    "run_summary": "SELECT 'feed-' || (user_id % 4) AS source_key, count(*) AS records_read, count(*) FILTER (event_type <> 'error') AS records_written, count(*) FILTER (event_type = 'error') AS records_quarantined, min(event_id) FILTER (event_type = 'error') AS first_rejected, CASE WHEN count(*) FILTER (event_type <> 'error') = 0 THEN 'failed' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'partial' ELSE 'succeeded' END AS outcome FROM events GROUP BY 1",
    "runs_recent": "SELECT CAST(ts AS DATE) AS started_on, count(*) AS records FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 7",
}
