"""Readings from the tables, the nine detectors over them, and the confidence and exposure arithmetic on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect, scoring
from ..operators.detect import Rule
from ..sources import overlay
from . import governed
from .governed import QUALITY

AS_OF = "2024-02-01"
MISMATCH = Rule("source_mismatch", "user")
RATIO = Rule("ratio_out_of_band", "user")
BASELINE = Rule("behind_baseline", "user", least_observations=20)
ATTRIBUTION = Rule("attribution_shortfall", "user", least_observations=5)
FUNNEL = Rule("funnel_drop", "location", least_observations=0)
LEAKAGE = Rule("financial_leakage", "brand")
COMPLETENESS = Rule("data_completeness_drop", "source", least_observations=1)
FRESHNESS = Rule("source_freshness_breach", "source", least_observations=0)
DRIFT = Rule("schema_drift", "field", least_observations=0)
STAGES = [("click", 0.80, 0.77), ("signup", 0.75, 0.68), ("purchase", 0.72, 0.52)]
DECLARED = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "int"), ("event_type", "string"), ("value", "double"), ("channel", "string")]


def age(at: str = "ts") -> F.Column:
    return (F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp(F.max(at).cast("timestamp"))).cast("long")


def error_rates(spark, sf_dir, before: str = AS_OF) -> DataFrame:
    """Share of errors in each user's events."""
    e = overlay.table(spark, sf_dir, "events").where(F.col("ts") < F.lit(before).cast("timestamp_ntz"))
    return e.groupBy(F.col("user_id").cast("string").alias("scope_id")).agg(F.round(F.count_if(F.col("event_type") == "error") / F.count("*").cast("double"), 6).alias("value"), F.count("*").alias("n"), age().alias("age_seconds"))


def halves(spark, sf_dir) -> DataFrame:
    """Share of purchases in the second half of the month, beside the first half's."""
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    share = lambda part: F.round(F.count_if(part & (F.col("event_type") == "purchase")) / F.nullif(F.count_if(part), F.lit(0)).cast("double"), 6)
    e = overlay.table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").cast("string").alias("scope_id")).agg(share(late).alias("value"), share(~late).alias("baseline_value"), F.count_if(late).alias("n"))


def purchases_by_clicks(spark, sf_dir) -> DataFrame:
    e = overlay.table(spark, sf_dir, "events")
    clicks = F.count_if(F.col("event_type") == "click")
    return e.groupBy(F.col("user_id").cast("string").alias("scope_id")).agg(F.round(F.count_if(F.col("event_type") == "purchase") / F.nullif(clicks, F.lit(0)).cast("double"), 6).alias("value"), clicks.alias("n"))


def funnels(spark, sf_dir) -> DataFrame:
    """Users' steps by location, counted so that each stage holds the next."""
    reached = [F.count_if(F.col("event_type").isin(*kinds)) for kinds in (("view", "click", "signup", "purchase"), ("click", "signup", "purchase"), ("signup", "purchase"), ("purchase",))]
    e = overlay.table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 25).cast("string").alias("scope_id")).agg(F.array(*reached).alias("counts"), F.count("*").alias("n"))


def margins(spark, sf_dir) -> DataFrame:
    """Margin and revenue of each brand in 1996, beside 1995's."""
    lines = overlay.table(spark, sf_dir, "lineitem").where("l_shipdate >= '1995-01-01' and l_shipdate < '1997-01-01'")
    parts = overlay.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_brand", (F.col("p_size") % 5).cast("string")).alias("scope_id"))
    now = F.year("l_shipdate") == 1996
    margin = lambda part: F.round(1 - 10 * F.avg(F.when(part, F.col("l_discount").cast("decimal(12,2)"))).cast("double"), 4)
    money = lambda part: (F.sum(F.when(part, F.col("l_extendedprice").cast("decimal(18,2)"))) * 100).cast("long")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("scope_id").agg(margin(now).alias("margin"), margin(~now).alias("prior_margin"), money(now).alias("revenue"), money(~now).alias("prior_revenue"), F.count_if(now).alias("n"))


def completeness(spark, sf_dir) -> DataFrame:
    q = governed.data_quality(spark, sf_dir)
    return q.groupBy(F.concat_ws("/", "organization_id", "source_key").alias("scope_id")).agg(F.round(F.sum("accepted_records") / F.sum("total_records").cast("double"), 6).alias("value"), F.sum("total_records").alias("n"))


def source_ages(spark, sf_dir) -> DataFrame:
    e = overlay.table(spark, sf_dir, "events")
    return e.groupBy(F.concat_ws("/", "event_type", (F.col("user_id") % 40).cast("string")).alias("scope_id")).agg(age().alias("age_seconds"), F.count("*").alias("n"))


def drift(spark, sf_dir) -> DataFrame:
    observed = spark.createDataFrame(overlay.table(spark, sf_dir, "events").dtypes, "field string, type string")
    return detect.schema_changes(spark.createDataFrame(DECLARED, "field string, type string"), observed)


def det_source_mismatch(spark, sf_dir):
    return detect.source_mismatch(error_rates(spark, sf_dir), MISMATCH)


def det_ratio_threshold(spark, sf_dir):
    return detect.ratio_threshold(error_rates(spark, sf_dir), RATIO, 0.2, 0.15, 0.25, 1250)


def det_baseline_comparison(spark, sf_dir):
    return detect.baseline_comparison(halves(spark, sf_dir), BASELINE)


def det_attribution(spark, sf_dir):
    return detect.attribution_comparison(purchases_by_clicks(spark, sf_dir), ATTRIBUTION)


def det_funnel_drop(spark, sf_dir):
    return detect.funnel_drop(funnels(spark, sf_dir), FUNNEL, STAGES, 4500)


def det_financial_leakage(spark, sf_dir):
    return detect.financial_leakage(margins(spark, sf_dir), LEAKAGE)


def det_completeness(spark, sf_dir):
    return detect.data_completeness(completeness(spark, sf_dir), COMPLETENESS)


def det_freshness(spark, sf_dir):
    return detect.source_freshness(source_ages(spark, sf_dir), FRESHNESS)


def det_schema_drift(spark, sf_dir):
    return detect.schema_drift(drift(spark, sf_dir), DRIFT)


def schema_diff(spark, sf_dir):
    return drift(spark, sf_dir)


def sufficiency(spark, sf_dir):
    r = halves(spark, sf_dir)
    return r.groupBy(detect.sufficient(BASELINE).alias("sufficient")).agg(F.count("*").alias("readings"))


def run_records(spark, sf_dir):
    """One record for each run, failed ones too: the second funnel has its stages in the wrong order."""
    good, bad = funnels(spark, sf_dir), funnels(spark, sf_dir).withColumn("counts", F.reverse("counts"))
    step = lambda r, rule: detect.funnel_drop(r, rule, STAGES, 4500)
    records = [
        detect.run("source_mismatch", detect.source_mismatch, error_rates(spark, sf_dir), MISMATCH)[1],
        detect.run("baseline_comparison", detect.baseline_comparison, halves(spark, sf_dir), BASELINE)[1],
        detect.run("funnel_drop", step, good, FUNNEL, detect.increasing_stages(good))[1],
        detect.run("funnel_reversed", step, bad, FUNNEL, detect.increasing_stages(bad))[1],
    ]
    out = records[0]
    for r in records[1:]:
        out = out.unionByName(r)
    return out


def components(spark, sf_dir):
    r = error_rates(spark, sf_dir)
    fit = {"sample_size": scoring.sample_size(F.col("n"), 80), "completeness": F.when(F.col("n") % 3 != 0, 1 - F.col("value")), "freshness": scoring.freshness(F.col("age_seconds"), 43200), "source_agreement": F.when(F.col("n") % 5 != 0, F.greatest(F.lit(0.0), 1 - 4.3 * F.col("value")))}
    return r, fit


def confidence_score(spark, sf_dir):
    r, fit = components(spark, sf_dir)
    s = scoring.score(fit)
    return r.select("scope_id", F.round(s, 3).alias("score"), F.when(s < 0.4, "low").when(s > 0.7, "high").otherwise("medium").alias("band"))


def confidence_caps(spark, sf_dir):
    r, fit = components(spark, sf_dir)
    low, high = F.col("n") * 10, F.col("n") * 10 + F.col("n") % 7 * F.col("n") * 12
    return r.select("scope_id", scoring.band(scoring.band_rank(fit, low=low, high=high)).alias("band"), scoring.band(scoring.band_rank(fit, attribution=True)).alias("attributed_band"))


def freshness_score(spark, sf_dir):
    return source_ages(spark, sf_dir).select("scope_id", F.round(scoring.freshness(F.col("age_seconds"), 3600), 6).alias("score"))


def exposure_product(spark, sf_dir):
    """Units times margin times share: three factors of (low, base, high), rounded half up once."""
    d = lambda x: F.lit(x).cast("decimal(18,4)")
    units = F.col("n").cast("decimal(18,4)")
    e = scoring.exposure([(units, units, units), (d("1.5"), d("2.25"), d("3.15")), (d("0.31"), d("0.5"), d("0.9"))])
    return error_rates(spark, sf_dir).select("scope_id", *[x.alias(k) for x, k in zip(e, ("low", "base", "high"), strict=True)])


QUERIES = {f.__name__: f for f in (det_source_mismatch, det_ratio_threshold, det_baseline_comparison, det_attribution, det_funnel_drop, det_financial_leakage, det_completeness, det_freshness, det_schema_drift, schema_diff, sufficiency, run_records, confidence_score, confidence_caps, freshness_score, exposure_product)}


def sql_score(parts: dict[str, str]) -> str:
    top = " + ".join(f"coalesce(({v}) * {scoring.WEIGHTS[k]}, 0.0)" for k, v in parts.items())
    low = " + ".join(f"CASE WHEN ({v}) IS NULL THEN 0.0 ELSE {scoring.WEIGHTS[k]} END" for k, v in parts.items())
    return f"(CAST({top} AS DOUBLE) / CAST({low} AS DOUBLE))"


def sql_rank(parts: dict[str, str], attribution: bool = False, wide: str = "2") -> str:
    s, weakest = sql_score(parts), "least(" + ", ".join(f"({v})" for v in parts.values()) + ", 1.0)"
    rank = f"least(CASE WHEN {s} < 0.4 THEN 0 WHEN {s} > 0.7 THEN 2 ELSE 1 END, CASE WHEN {weakest} < 0.1 THEN 0 WHEN {weakest} < 0.2 THEN 1 ELSE 2 END, {wide}, {1 if attribution else 2})"
    return f"(['low', 'medium', 'high'])[{rank} + 1]"


def sql_candidates(rule: Rule, source: str, where: str, observed: str, expected: str, level: str, parts: dict[str, str], money: list[str], reasons: str, attribution: bool = False) -> str:
    low, base, high = (f"CAST({m} AS BIGINT)" for m in money)
    return f"""SELECT '{rule.gap_type}' AS gap_type, '{rule.scope_type}' AS scope_type, scope_id, CAST({observed} AS DOUBLE) AS observed, CAST({expected} AS DOUBLE) AS expected,
  {level} AS severity, round({sql_score(parts)}, 3) AS confidence_score, {sql_rank(parts, attribution)} AS confidence_band,
  {low} AS exposure_low, {base} AS exposure_base, {high} AS exposure_high, {reasons} AS reason_codes FROM {source} WHERE {where}"""


def sql_level(x: str, a: float, b: float, op: str = ">=") -> str:
    return f"CASE WHEN {x} {op} {a} THEN 'critical' WHEN {x} {op} {b} THEN 'high' ELSE 'medium' END"


AGE = f"CAST(epoch(TIMESTAMP '{AS_OF}') - floor(epoch(max(ts))) AS BIGINT) AS age_seconds"
def rates_sql(before: str = AS_OF) -> str:
    return f"SELECT CAST(user_id AS VARCHAR) AS scope_id, round(CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*), 6) AS value, count(*) AS n, {AGE} FROM events WHERE ts < TIMESTAMP '{before}' GROUP BY 1"


def fresh(latency: float) -> str:
    return f"CASE WHEN age_seconds <= {latency} THEN 1.0 ELSE CAST({latency} AS DOUBLE) / age_seconds END"


def sample(n: str, least: int) -> str:
    return f"least(1.0, CAST({n} AS DOUBLE) / {least})"


def mismatch_sql(before: str = AS_OF) -> str:
    units = "round_even(CAST(value AS DECIMAL(18,6)) * n, 0)"
    return sql_candidates(MISMATCH, f"({rates_sql(before)})", "n >= 30 AND value > 0.05", "value", "0", sql_level("value", 0.3, 0.15), {"sample_size": sample("n", 30), "detector_fit": "1.0", "source_agreement": "greatest(0.0, 1 - value)", "freshness": fresh(86400)}, [f"{units} * {m}" for m in (150, 220, 310)], "'modelled_exposure,source_disagreement'")


HALVES = "(SELECT CAST(user_id AS VARCHAR) AS scope_id, round(CAST(count(*) FILTER (ts >= TIMESTAMP '2024-01-16' AND event_type = 'purchase') AS DOUBLE) / nullif(count(*) FILTER (ts >= TIMESTAMP '2024-01-16'), 0), 6) AS value, round(CAST(count(*) FILTER (ts < TIMESTAMP '2024-01-16' AND event_type = 'purchase') AS DOUBLE) / nullif(count(*) FILTER (ts < TIMESTAMP '2024-01-16'), 0), 6) AS base, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS n FROM events GROUP BY 1)"
FUNNELS = "(SELECT CAST(user_id % 25 AS VARCHAR) AS scope_id, count(*) FILTER (event_type IN ('view', 'click', 'signup', 'purchase')) AS c0, count(*) FILTER (event_type IN ('click', 'signup', 'purchase')) AS c1, count(*) FILTER (event_type IN ('signup', 'purchase')) AS c2, count(*) FILTER (event_type = 'purchase') AS c3 FROM events GROUP BY 1)"
STEPS = f"(SELECT scope_id, unnest([{{'i': 0, 'stage': 'click', 'expected': 0.80::DOUBLE, 'threshold': 0.77::DOUBLE, 'entered': c0, 'left': c1}}, {{'i': 1, 'stage': 'signup', 'expected': 0.75::DOUBLE, 'threshold': 0.68::DOUBLE, 'entered': c1, 'left': c2}}, {{'i': 2, 'stage': 'purchase', 'expected': 0.72::DOUBLE, 'threshold': 0.52::DOUBLE, 'entered': c2, 'left': c3}}]) AS s FROM {FUNNELS})"
WORST = f"(SELECT * FROM (SELECT scope_id, s.i AS i, s.stage AS stage, s.expected AS expected, s.entered AS entered, CAST(s.\"left\" AS DOUBLE) / s.entered AS survival, row_number() OVER (PARTITION BY scope_id ORDER BY s.expected - CAST(s.\"left\" AS DOUBLE) / s.entered DESC, s.i) AS r FROM {STEPS} WHERE CAST(s.\"left\" AS DOUBLE) / s.entered < s.threshold) WHERE r = 1)"
MARGINS = "(SELECT p_brand || '/' || (p_size % 5) AS scope_id, round(1 - 10 * CAST(sum(CAST(l_discount AS DECIMAL(12,2))) FILTER (year(l_shipdate) = 1996) AS DOUBLE) / count(*) FILTER (year(l_shipdate) = 1996), 4) AS margin, round(1 - 10 * CAST(sum(CAST(l_discount AS DECIMAL(12,2))) FILTER (year(l_shipdate) = 1995) AS DOUBLE) / count(*) FILTER (year(l_shipdate) = 1995), 4) AS prior_margin, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (year(l_shipdate) = 1996) * 100 AS BIGINT) AS revenue, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (year(l_shipdate) = 1995) * 100 AS BIGINT) AS prior_revenue, count(*) FILTER (year(l_shipdate) = 1996) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) IN (1995, 1996) GROUP BY 1)"
SHAPE = "CASE WHEN prior_revenue <= 0 THEN 'flat' WHEN revenue > prior_revenue * 1.02 THEN 'up' WHEN revenue < prior_revenue * 0.98 THEN 'down' ELSE 'flat' END"
AGES = f"(SELECT event_type || '/' || (user_id % 40) AS scope_id, {AGE}, count(*) AS n FROM events GROUP BY 1)"
DRIFTS = "(VALUES ('props', 'new_field'), ('user_id', 'type_change'), ('channel', 'removed_field')) t(scope_id, drift_kind)"
NONE = ["NULL"] * 3
DROP = "round(prior_margin - margin, 6)"
OWN = "CASE WHEN base > 0 AND (base - value) / base >= 0.15 THEN (base - value) / base END"
PEER = "CASE WHEN peers >= 5 AND median > 0 AND (median - value) / median >= 0.15 THEN (median - value) / median END"
BASED = f"(SELECT *, {OWN} AS own, {PEER} AS peer FROM (SELECT *, quantile_cont(value, 0.5) OVER () AS median, count(*) OVER () AS peers FROM {HALVES} WHERE n >= 20 AND value IS NOT NULL))"
COMPONENTS = {"sample_size": sample("n", 80), "completeness": "CASE WHEN n % 3 <> 0 THEN 1 - value END", "freshness": fresh(43200), "source_agreement": "CASE WHEN n % 5 <> 0 THEN greatest(0.0, 1 - 4.3 * value) END"}
RATES = f"({rates_sql()})"

ORACLE_SQL = {
    "det_source_mismatch": mismatch_sql(),
    "det_ratio_threshold": sql_candidates(RATIO, RATES, "n >= 30 AND (value < 0.15 OR value > 0.25)", "value", "0.2", sql_level("CASE WHEN value < 0.15 THEN (0.15::DOUBLE - value) / 0.15::DOUBLE ELSE (value - 0.25) / 0.25 END", 0.5, 0.25), {"sample_size": sample("n", 30), "detector_fit": "1.0", "freshness": fresh(86400)}, ["round_even(abs(CAST(value AS DECIMAL(18,6)) - 0.2) * n, 0) * 1250"] * 3, "'modelled_exposure,' || CASE WHEN value < 0.15 THEN 'ratio_below_band' ELSE 'ratio_above_band' END"),
    "det_baseline_comparison": sql_candidates(BASELINE, BASED, "own IS NOT NULL OR peer IS NOT NULL", "value", "CASE WHEN own IS NOT NULL AND (peer IS NULL OR own >= peer) THEN base ELSE median END", sql_level("greatest(coalesce(own, 0), coalesce(peer, 0))", 0.5, 0.3), {"sample_size": sample("n", 20), "detector_fit": "CASE WHEN own IS NOT NULL AND peer IS NOT NULL THEN 1.0 ELSE 0.7 END", "source_agreement": "CASE WHEN peer IS NOT NULL THEN least(1.0, peers / 10.0) END"}, NONE, "concat_ws(',', CASE WHEN own IS NOT NULL THEN 'below_own_baseline' END, CASE WHEN peer IS NOT NULL THEN 'below_peer_group' END)"),
    "det_attribution": sql_candidates(ATTRIBUTION, "(SELECT CAST(user_id AS VARCHAR) AS scope_id, round(CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) / nullif(count(*) FILTER (event_type = 'click'), 0), 6) AS value, count(*) FILTER (event_type = 'click') AS n FROM events GROUP BY 1)", "n >= 5 AND value < 0.8", "value", "1.0", "CASE WHEN value <= 0.5 THEN 'high' ELSE 'medium' END", {"sample_size": sample("n", 5), "detector_fit": "0.6"}, [f"round(round_even((1 - CAST(value AS DECIMAL(18,6))) * n, 0)::DECIMAL(18,0) * {s}, 0)" for s in (0.2, 0.4, 0.7)], "'attribution_limited,below_attributed_share,modelled_exposure'", True),
    "det_funnel_drop": sql_candidates(FUNNEL, WORST, "TRUE", "round(survival, 6)", "expected", sql_level("expected - survival", 0.4, 0.2), {"sample_size": sample("entered", 1), "detector_fit": "1.0"}, ["round_even((CAST(expected AS DECIMAL(18,6)) - CAST(round(survival, 6) AS DECIMAL(18,6))) * entered, 0) * 4500"] * 3, "'modelled_exposure,stage_' || stage"),
    "det_financial_leakage": sql_candidates(LEAKAGE, MARGINS, f"n >= 30 AND {DROP} >= 0.02 AND {SHAPE} <> 'down'", "margin", "prior_margin", sql_level(DROP, 0.1, 0.05), {"sample_size": sample("n", 30), "detector_fit": "1.0", "completeness": "1.0"}, [f"round(CAST(revenue AS DECIMAL(20,0)) * CAST({DROP} AS DECIMAL(10,6)), 0)"] * 3, f"'revenue_' || {SHAPE}"),
    "det_completeness": f"WITH {QUALITY} " + sql_candidates(COMPLETENESS, "(SELECT organization_id || '/' || source_key AS scope_id, round(CAST(sum(accepted_records) AS DOUBLE) / sum(total_records), 6) AS value, sum(total_records) AS n FROM dq GROUP BY 1)", "n >= 1 AND value < 0.98", "value", "1.0", sql_level("value", 0.7, 0.9, "<="), {"detector_fit": "1.0", "completeness": "value"}, NONE, "'incomplete_delivery'"),
    "det_freshness": sql_candidates(FRESHNESS, AGES, "age_seconds > 7200", "age_seconds", "3600", sql_level("age_seconds / 3600.0", 12, 4), {"detector_fit": "1.0"}, NONE, "'late_source'"),
    "det_schema_drift": sql_candidates(DRIFT, DRIFTS, "TRUE", "1", "0", "CASE drift_kind WHEN 'removed_field' THEN 'critical' WHEN 'type_change' THEN 'high' ELSE 'low' END", {"detector_fit": "1.0"}, NONE, "drift_kind"),
    "schema_diff": f"SELECT scope_id AS field, drift_kind FROM {DRIFTS}",
    "sufficiency": f"SELECT n >= 20 AS sufficient, count(*) AS readings FROM {HALVES} GROUP BY 1",
    "run_records": f"""SELECT 'source_mismatch' AS detector, count(*) AS considered, count(*) FILTER (n < 30) AS insufficient, (SELECT count(*) FROM ({mismatch_sql()})) AS candidates, 'succeeded' AS outcome FROM {RATES}
UNION ALL SELECT 'baseline_comparison', count(*), count(*) FILTER (n < 20), (SELECT count(*) FROM {BASED} WHERE own IS NOT NULL OR peer IS NOT NULL), 'succeeded' FROM {HALVES}
UNION ALL SELECT 'funnel_drop', count(*), 0, (SELECT count(*) FROM {WORST}), 'succeeded' FROM {FUNNELS}
UNION ALL SELECT 'funnel_reversed', count(*), 0, 0, 'failed' FROM {FUNNELS}""",
    "confidence_score": f"SELECT scope_id, round({sql_score(COMPONENTS)}, 3) AS score, CASE WHEN {sql_score(COMPONENTS)} < 0.4 THEN 'low' WHEN {sql_score(COMPONENTS)} > 0.7 THEN 'high' ELSE 'medium' END AS band FROM {RATES}",
    "confidence_caps": f"SELECT scope_id, {sql_rank(COMPONENTS, wide='CASE WHEN n % 7 * 1.2 > 4 THEN 0 ELSE 2 END')} AS band, {sql_rank(COMPONENTS, True)} AS attributed_band FROM {RATES}",
    "freshness_score": f"SELECT scope_id, round({fresh(3600)}, 6) AS score FROM {AGES}",
    "exposure_product": f"SELECT scope_id, CAST(round(n * 1.5 * 0.31, 0) AS BIGINT) AS low, CAST(round(n * 2.25 * 0.5, 0) AS BIGINT) AS base, CAST(round(n * 3.15 * 0.9, 0) AS BIGINT) AS high FROM {RATES}",
}
