"""What is compiled from definitions: metrics and their tests, messages, axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, templates
from ..operators import contracts
from ..sources import overlay
from . import detection, governed, metrics

TITLE = "Sources disagree at {scope}: {rate:.1%}"
SUMMARY = "Of {n:,} observations at {scope}, {rate:.2%} differ, worth {low:,.2f} to {high:,.2f} {currency}; confidence {confidence:.3f}, owner {owner}."


def sources(spark: SparkSession, sf_dir: str) -> None:
    """The governed models under the names that definitions use."""
    for name, model in (("stock_truth", governed.stock_truth), ("data_quality", governed.data_quality), ("transactions", governed.transactions)):
        model(spark, sf_dir).createOrReplaceTempView(name)


def compiled_metrics(spark, sf_dir):
    """Every live metric by its generated query."""
    sources(spark, sf_dir)
    registry, out = contracts.definitions(), None
    for m in registry.metrics.values():
        if m.valid_to is not None:
            continue
        rows = contracts.run(spark, contracts.query_sql(m), metrics.ORG)
        one = rows.select(F.lit(m.key).alias("metric_key"), F.lit(m.version).alias("version"), F.concat_ws("/", *m.grain).alias("scope"), F.round("value", 2).alias("value"), "observations")
        out = one if out is None else out.unionByName(one)
    return out


def compiled_tests(spark, sf_dir):
    """Rows that break each generated test of the live metrics."""
    sources(spark, sf_dir)
    out: DataFrame | None = None
    for m in contracts.definitions().metrics.values():
        for test in m.tests if m.valid_to is None else ():
            found = contracts.run(spark, contracts.test_sql(m, test), metrics.ORG)
            one = found.agg(F.lit(m.key).alias("metric_key"), F.lit(test).alias("test"), F.count("*").alias("violations"))
            out = one if out is None else out.unionByName(one)
    return out


def messages(spark, sf_dir):
    """Title and summary of every finding, from their templates."""
    found = detection.det_source_mismatch(spark, sf_dir).join(detection.error_rates(spark, sf_dir).select("scope_id", "n"), "scope_id")
    owner = F.when(F.col("scope_id").cast("long") % 3 != 0, F.concat(F.lit("owner-"), "scope_id"))
    values = {"scope": F.col("scope_id"), "rate": F.col("observed"), "n": F.col("n"), "low": F.col("exposure_low") / 100, "high": F.col("exposure_high") / 100, "currency": F.lit("GBP"), "confidence": F.col("confidence_score"), "owner": owner}
    return found.select("scope_id", templates.compiled(TITLE, **values).alias("title"), templates.compiled(SUMMARY, **values).alias("summary"))


def axes(spark, sf_dir):
    """The ticks of an axis over each user's values, and where the user's band begins."""
    e = overlay.table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    ticks = F.array_join(F.transform(scalars.nice_ticks(F.col("low"), F.col("high")), lambda t: t.cast("string")), " ")
    back = scalars.linear_unscale(scalars.linear_scale(F.col("high"), 0.0, 1000.0, 10.0, 20.0), 0.0, 1000.0, 10.0, 20.0)
    return e.select("user_id", ticks.alias("ticks"), F.round(scalars.band_start(F.col("user_id"), 12, 360.0), 6).alias("band"), F.round(back, 6).alias("back"))


def object_keys(spark, sf_dir):
    """Digests of content-addressed keys, and dimensions looked up in maps."""
    digest = F.sha2("props", 256)
    key = F.concat(F.lit("org/1/events/"), F.date_format("ts", "yyyy-MM-dd"), F.lit("/"), digest, F.when(F.col("event_id") % 2 == 0, ".json.gz").otherwise(""))
    dims = F.from_json("props", "map<string,string>")
    e = overlay.table(spark, sf_dir, "events")
    return e.select("event_id", (scalars.digest_of_key(key) == digest).alias("same"), scalars.required(dims, "k").cast("long").alias("k"), scalars.lookup(dims, "z").alias("z"))


QUERIES = {f.__name__: f for f in (compiled_metrics, compiled_tests, messages, axes, object_keys)}

_M = metrics.ORACLE_SQL
_METRICS = (("stock_discrepancy_rate", 2, "location_id"), ("stock_units_missing", 1, "location_id"), ("data_completeness", 1, "source_key"), ("revenue", 1, "location_id"))
_BROKEN = {"not_null": "value IS NULL", "between_0_and_1": "value < 0 OR value > 1", "non_negative": "value < 0", "denominator_min_30": "observations < 30"}


def _commas(x: str, places: int = 0) -> str:
    return f"format('{{:,.{places}f}}', CAST({x} AS DOUBLE))" if places else f"format('{{:,}}', CAST({x} AS BIGINT))"


def _fixed(x: str, places: int, less: int = 0) -> str:
    """x * 10 ** less with so many places, halves to even, as text."""
    return f"CAST(CAST(round_even(CAST({x} AS DECIMAL(28,12)) * {10**less}, {places}) AS DECIMAL(28,{places})) AS VARCHAR)"


ORACLE_SQL = {
    "compiled_metrics": " UNION ALL ".join(f"(SELECT '{k}' AS metric_key, {v} AS version, {g} AS scope, round(CAST(value AS DOUBLE), 2) AS value, observations FROM ({_M[f'metric_{k}']}))" for k, v, g in _METRICS),
    "compiled_tests": " UNION ALL ".join(
        f"(SELECT '{k}' AS metric_key, '{t}' AS test, count(*) AS violations FROM ({_M[f'metric_{k}']}) WHERE {_BROKEN[t]})" for k, v, _ in _METRICS for t in metrics.REGISTRY.get(k).tests
    ),
    "messages": f"""SELECT scope_id, 'Sources disagree at ' || scope_id || ': ' || {_fixed('observed', 1, 2)} || '%' AS title,
  'Of ' || {_commas('n')} || ' observations at ' || scope_id || ', ' || {_fixed('observed', 2, 2)} || '% differ, worth ' || {_commas('exposure_low / 100', 2)} || ' to ' || {_commas('exposure_high / 100', 2)} || ' GBP; confidence '
  || {_fixed('confidence_score', 3)} || ', owner ' || coalesce(CASE WHEN CAST(scope_id AS BIGINT) % 3 <> 0 THEN 'owner-' || scope_id END, 'unknown') || '.' AS summary
FROM ({detection.ORACLE_SQL['det_source_mismatch']}) JOIN (SELECT scope_id, n FROM {detection.RATES}) USING (scope_id)""",
    "axes": """WITH e AS (SELECT user_id, min(value) AS a, max(value) AS b FROM events GROUP BY 1),
p AS (SELECT *, (b - a) / 5 AS raw, pow(10.0, floor(log10((b - a) / 5))) AS power FROM e WHERE a < b),
s AS (SELECT *, CASE WHEN raw / power <= 1 THEN 1.0 WHEN raw / power <= 2 THEN 2.0 WHEN raw / power <= 5 THEN 5.0 ELSE 10.0 END::DOUBLE * power AS step FROM p),
t AS (SELECT user_id, string_agg(CAST(round(i * step, 9) AS VARCHAR), ' ' ORDER BY i) AS ticks FROM (SELECT *, unnest(range(CAST(floor(a / step) AS BIGINT), CAST(ceil(b / step) AS BIGINT) + 1)) AS i FROM s) GROUP BY 1)
SELECT e.user_id, coalesce(ticks, CAST(a AS VARCHAR)) AS ticks, round(e.user_id * 30.0::DOUBLE + 3, 6) AS band, round(b, 6) AS back FROM e LEFT JOIN t USING (user_id)""",
    "object_keys": "SELECT event_id, TRUE AS same, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS z FROM events",
}
