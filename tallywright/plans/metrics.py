"""The engine's metrics over the governed models, and their quality tests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.metric import Metric, Registry, catalogue, joined, query, violations
from ..operators.quantile import exact_quantile
from ..sources import overlay
from . import governed
from .governed import QUALITY, STOCK, TX

REGISTRY = Registry([
    Metric("stock_discrepancy_rate", 1, "count_if(abs(discrepancy) > 20) / nullif(count(*), 0)", "stock_truth", ("location_id",), ("variant_id",), ("location_id", "variant_id"), tests=("not_null", "between_0_and_1", "denominator_min_30"), valid_to=dt.date(2024, 1, 1)),
    Metric("stock_discrepancy_rate", 2, "count_if(abs(discrepancy) > 0) / nullif(count(*), 0)", "stock_truth", ("location_id",), ("variant_id",), ("location_id", "variant_id"), tests=("not_null", "between_0_and_1", "denominator_min_30"), valid_from=dt.date(2024, 1, 1)),
    Metric("stock_units_missing", 1, "sum(if(discrepancy > 0, discrepancy, 0))", "stock_truth", ("location_id",), ("variant_id",), ("location_id",), unit="count", tests=("non_negative",)),
    Metric("data_completeness", 1, "sum(accepted_records) / nullif(sum(total_records), 0)", "data_quality", ("source_key",), ("day",), ("source_key",), tests=("between_0_and_1",)),
    Metric("revenue", 1, "sum(amount_minor)", "transactions", ("location_id",), ("channel_id",), ("location_id", "channel_id"), unit="money", currency_policy="single", tests=("non_negative",)),
])
ORG = "1"


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 6))


def metric_stock_discrepancy_rate(spark, sf_dir):
    return rounded(query(REGISTRY.get("stock_discrepancy_rate"), governed.stock_truth(spark, sf_dir), ORG))


def metric_superseded_version(spark, sf_dir):
    return rounded(query(REGISTRY.get("stock_discrepancy_rate", 1), governed.stock_truth(spark, sf_dir), ORG))


def metric_stock_units_missing(spark, sf_dir):
    return query(REGISTRY.get("stock_units_missing"), governed.stock_truth(spark, sf_dir), ORG).withColumn("value", F.round("value", 2))


def metric_data_completeness(spark, sf_dir):
    return rounded(query(REGISTRY.get("data_completeness"), governed.data_quality(spark, sf_dir), ORG))


def metric_revenue(spark, sf_dir):
    return query(REGISTRY.get("revenue"), governed.transactions(spark, sf_dir), ORG).withColumn("value", F.col("value").cast("long"))


def metric_global(spark, sf_dir):
    return query(REGISTRY.get("revenue"), governed.transactions(spark, sf_dir), ORG, grain=()).withColumn("value", F.col("value").cast("long"))


def metric_filtered(spark, sf_dir):
    return query(REGISTRY.get("revenue"), governed.transactions(spark, sf_dir), ORG, filters={"channel_id": "BUILDING"}).withColumn("value", F.col("value").cast("long"))


def metric_grain_override(spark, sf_dir):
    return query(REGISTRY.get("revenue"), governed.transactions(spark, sf_dir), ORG, grain=("channel_id",)).withColumn("value", F.col("value").cast("long"))


def metric_join_path(spark, sf_dir):
    """A metric grouped by a column of a joined source: revenue by the name of its location."""
    names = overlay.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("location_id"), F.col("n_name").alias("location_name"))
    metric = Metric("revenue_by_name", 1, "sum(amount_minor)", "transactions", ("location_name",), unit="money", currency_policy="single", joins=(("locations", "location_id"),))
    rows = joined(metric, {"transactions": governed.transactions(spark, sf_dir), "locations": names})
    return query(metric, rows, ORG).withColumn("value", F.col("value").cast("long"))


def metric_rollup(spark, sf_dir):
    """Revenue by location and channel with subtotals."""
    rows = governed.transactions(spark, sf_dir).where(F.col("organization_id") == ORG)
    return rows.rollup("location_id", "channel_id").agg(F.sum("amount_minor").alias("value"), F.count("*").alias("observations"))


def metric_catalogue(spark, sf_dir):
    """What may be shown of each metric, and how many rows the organization has to compute it from."""
    sources = {"stock_truth": governed.stock_truth, "data_quality": governed.data_quality, "transactions": governed.transactions}
    counts = None
    for name, of in sources.items():
        one = of(spark, sf_dir).where(F.col("organization_id") == ORG).agg(F.lit(name).alias("source"), F.count("*").alias("records"))
        counts = one if counts is None else counts.unionByName(one)
    source = spark.createDataFrame([(m.key, m.version, m.source) for m in REGISTRY.metrics.values()], "metric_key string, version int, source string")
    return catalogue(spark, REGISTRY).join(source, ["metric_key", "version"]).join(counts, "source").drop("source")


def quality_not_null(spark, sf_dir):
    """With the values of odd numbers of observations lost."""
    lost = F.when(F.col("observations") % 2 == 0, F.col("value"))
    return violations("not_null", metric_stock_discrepancy_rate(spark, sf_dir).withColumn("value", lost))


def quality_between(spark, sf_dir):
    return violations("between_0_and_1", metric_stock_units_missing(spark, sf_dir))


def quality_non_negative(spark, sf_dir):
    """With the sign of odd numbers of observations turned."""
    turned = F.when(F.col("observations") % 2 == 1, -F.col("value")).otherwise(F.col("value"))
    return violations("non_negative", metric_stock_units_missing(spark, sf_dir).withColumn("value", turned))


def by_variant(spark, sf_dir):
    return rounded(query(REGISTRY.get("stock_discrepancy_rate"), governed.stock_truth(spark, sf_dir), ORG, grain=("variant_id",)))


def quality_sufficiency(spark, sf_dir):
    return violations("denominator_min_30", by_variant(spark, sf_dir))


def daily_completeness(spark, sf_dir):
    return rounded(query(REGISTRY.get("data_completeness"), governed.data_quality(spark, sf_dir), ORG, grain=("source_key", "day")))


def quality_monotonic(spark, sf_dir):
    return violations("monotonic_non_decreasing", daily_completeness(spark, sf_dir), "day", ("source_key",))


def valid_on(spark, sf_dir):
    """Orders by the version of each metric that is valid on their day."""
    rows = [(m.key, m.version, m.valid_from, m.valid_to) for m in REGISTRY.metrics.values()]
    versions = spark.createDataFrame(rows, "metric_key string, version int, valid_from date, valid_to date")
    # orders are of the nineties; 28 years on their days fall on both sides of the versions' limits
    days = overlay.table(spark, sf_dir, "orders").groupBy(F.add_months(F.to_date("o_orderdate"), 12 * 28).alias("day")).agg(F.count("*").alias("n"))
    valid = (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    return days.join(F.broadcast(versions), valid).groupBy("metric_key", "version").agg(F.sum("n").alias("orders"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def own_baseline(spark, sf_dir):
    """Each source's completeness beside the mean of its seven days before."""
    before = Window.partitionBy("source_key").orderBy("day").rowsBetween(-7, -1)
    return daily_completeness(spark, sf_dir).select("source_key", "day", "value", F.round(F.avg("value").over(before), 6).alias("baseline_value"))


def monthly_revenue(spark, sf_dir):
    return governed.transactions(spark, sf_dir).groupBy("location_id", F.date_trunc("month", "occurred_at").cast("date").alias("month")).agg(F.sum("amount_minor").alias("revenue"))


def prior_period(spark, sf_dir):
    """Monthly revenue beside the same month of the year before; gaps stay null."""
    now = monthly_revenue(spark, sf_dir)
    then = now.select("location_id", F.add_months("month", 12).alias("month"), F.col("revenue").alias("prior_revenue"))
    return now.join(then, ["location_id", "month"], "left")


def window_delta(spark, sf_dir):
    """Change to the month before, absolute and in percent; null where there is none."""
    order = Window.partitionBy("location_id").orderBy("month")
    prior = F.lag("revenue").over(order)
    return monthly_revenue(spark, sf_dir).select("location_id", "month", "revenue", (F.col("revenue") - prior).alias("absolute_delta"), F.round((F.col("revenue") - prior).cast("double") / F.nullif(prior, F.lit(0)) * 100, 4).alias("percentage_delta"))


def peer_median(spark, sf_dir, least: int = 5):
    """Exact median of the locations' rates, if there are enough of them."""
    n, median = exact_quantile(metric_stock_discrepancy_rate(spark, sf_dir), "value", 0.5)
    return spark.createDataFrame([(n, round(median, 6) if n >= least else None)], "peers long, median double")


def exposure_quartiles(spark, sf_dir):
    q = F.expr("percentile(discrepancy, array(0.25, 0.5, 0.75))")
    quartiles = governed.stock_truth(spark, sf_dir).where("discrepancy > 0").groupBy("location_id").agg(q.alias("q"))
    return quartiles.select("location_id", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p25", "median", "p75"))])


QUERIES = {f.__name__: f for f in (metric_stock_discrepancy_rate, metric_superseded_version, metric_stock_units_missing, metric_data_completeness, metric_revenue, metric_global, metric_filtered, metric_grain_override, metric_join_path, metric_rollup, metric_catalogue, quality_not_null, quality_between, quality_non_negative, quality_sufficiency, quality_monotonic, valid_on, own_baseline, prior_period, window_delta, peer_median, exposure_quartiles)}

SDR = f"WITH {STOCK} SELECT location_id, round(CAST(count(*) FILTER (abs(discrepancy) > 0) AS DOUBLE) / count(*), 6) AS value, count(*) AS observations FROM truth WHERE organization_id = '1' GROUP BY 1"
SUM = f"WITH {STOCK} SELECT location_id, round(sum(CASE WHEN discrepancy > 0 THEN discrepancy ELSE 0 END), 2) AS value, count(*) AS observations FROM truth WHERE organization_id = '1' GROUP BY 1"
DAYS = f"WITH {QUALITY}, d AS (SELECT source_key, day, round(CAST(sum(accepted_records) AS DOUBLE) / sum(total_records), 6) AS value, count(*) AS observations FROM dq WHERE organization_id = '1' GROUP BY 1, 2)"
REV = "CAST(sum(amount_minor) AS BIGINT) AS value, count(*) AS observations FROM tx WHERE organization_id = '1'"
MONTHS = f"WITH {TX}, m AS (SELECT location_id, CAST(date_trunc('month', occurred_at) AS DATE) AS month, CAST(sum(amount_minor) AS BIGINT) AS revenue FROM tx GROUP BY 1, 2)"
VERSIONS = ", ".join(f"('{m.key}', {m.version}, DATE '{m.valid_from}', CAST({f"'{m.valid_to}'" if m.valid_to else 'NULL'} AS DATE))" for m in REGISTRY.metrics.values())
ORACLE_SQL = {
    "metric_stock_discrepancy_rate": SDR,
    "metric_superseded_version": SDR.replace("> 0)", "> 20)"),
    "metric_stock_units_missing": SUM,
    "metric_data_completeness": f"WITH {QUALITY} SELECT source_key, round(CAST(sum(accepted_records) AS DOUBLE) / sum(total_records), 6) AS value, count(*) AS observations FROM dq WHERE organization_id = '1' GROUP BY 1",
    "metric_revenue": f"WITH {TX} SELECT location_id, {REV} GROUP BY 1",
    "metric_global": f"WITH {TX} SELECT {REV}",
    "metric_filtered": f"WITH {TX} SELECT location_id, {REV} AND channel_id = 'BUILDING' GROUP BY 1",
    "metric_grain_override": f"WITH {TX} SELECT channel_id, {REV} GROUP BY 1",
    "metric_join_path": f"WITH {TX} SELECT n_name AS location_name, CAST(sum(amount_minor) AS BIGINT) AS value, count(*) AS observations FROM tx JOIN nation ON CAST(n_nationkey AS VARCHAR) = location_id WHERE organization_id = '1' GROUP BY 1",
    "metric_rollup": f"WITH {TX} SELECT location_id, channel_id, {REV} GROUP BY ROLLUP (location_id, channel_id)",
    "metric_catalogue": f"""WITH {STOCK}, {QUALITY}, {TX.strip()}, n AS (SELECT 'stock_truth' AS source, count(*) AS records FROM truth WHERE organization_id = '1' UNION ALL SELECT 'data_quality', count(*) FROM dq WHERE organization_id = '1'
  UNION ALL SELECT 'transactions', count(*) FROM tx WHERE organization_id = '1')
SELECT metric_key, version, unit, grain, dimensions, tests, certified, records FROM (VALUES
      ('stock_discrepancy_rate', 1, 'ratio', 'location_id', 'variant_id', 'between_0_and_1,denominator_min_30,not_null', TRUE, 'stock_truth'),
      ('stock_discrepancy_rate', 2, 'ratio', 'location_id', 'variant_id', 'between_0_and_1,denominator_min_30,not_null', TRUE, 'stock_truth'),
      ('stock_units_missing', 1, 'count', 'location_id', 'variant_id', 'non_negative', TRUE, 'stock_truth'),
      ('data_completeness', 1, 'ratio', 'source_key', 'day', 'between_0_and_1', TRUE, 'data_quality'),
      ('revenue', 1, 'money', 'location_id', 'channel_id', 'non_negative', TRUE, 'transactions')) t(metric_key, version, unit, grain, dimensions, tests, certified, source) JOIN n USING (source)""",
    "quality_not_null": f"SELECT location_id, CAST(NULL AS DOUBLE) AS value, observations FROM ({SDR}) WHERE value IS NULL OR observations % 2 = 1",
    "quality_between": f"SELECT * FROM ({SUM}) WHERE value < 0 OR value > 1",
    "quality_non_negative": f"SELECT location_id, CASE WHEN observations % 2 = 1 THEN -value ELSE value END AS value, observations FROM ({SUM}) WHERE CASE WHEN observations % 2 = 1 THEN -value ELSE value END < 0",
    "quality_sufficiency": f"SELECT * FROM ({SDR.replace('SELECT location_id, round', 'SELECT variant_id, round')}) WHERE observations < 30",
    "quality_monotonic": f"{DAYS} SELECT source_key, day, value, observations FROM (SELECT *, lag(value) OVER (PARTITION BY source_key ORDER BY day) AS b FROM d) WHERE value < b",
    "valid_on": f"""WITH v AS (SELECT * FROM (VALUES {VERSIONS}) t(metric_key, version, valid_from, valid_to)), d AS (SELECT CAST(CAST(o_orderdate AS DATE) + INTERVAL 336 MONTH AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
SELECT metric_key, version, CAST(sum(n) AS BIGINT) AS orders, min(day) AS first_day, max(day) AS last_day FROM d JOIN v ON day >= valid_from AND (valid_to IS NULL OR day < valid_to) GROUP BY 1, 2""",
    "own_baseline": f"{DAYS} SELECT source_key, day, value, round(avg(value) OVER (PARTITION BY source_key ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS baseline_value FROM d",
    "prior_period": f"{MONTHS} SELECT n.location_id, n.month, n.revenue, p.revenue AS prior_revenue FROM m n LEFT JOIN m p ON p.location_id = n.location_id AND CAST(p.month + INTERVAL 12 MONTH AS DATE) = n.month",
    "window_delta": f"{MONTHS} SELECT location_id, month, revenue, revenue - b AS absolute_delta, round(CAST(revenue - b AS DOUBLE) / nullif(b, 0) * 100, 4) AS percentage_delta FROM (SELECT *, lag(revenue) OVER (PARTITION BY location_id ORDER BY month) AS b FROM m)",
    "peer_median": f"SELECT count(value) AS peers, round(CASE WHEN count(value) >= 5 THEN quantile_cont(value, 0.5) END, 6) AS median FROM ({SDR})",
    "exposure_quartiles": f"WITH {STOCK} SELECT location_id, round(quantile_cont(discrepancy, 0.25), 4) AS p25, round(quantile_cont(discrepancy, 0.5), 4) AS median, round(quantile_cont(discrepancy, 0.75), 4) AS p75 FROM truth WHERE discrepancy > 0 GROUP BY 1",
}
