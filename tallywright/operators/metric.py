"""Metric definitions: one definition gives the query, its quality tests and the catalogue."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a measure may never hold, and the functions it may call.
FORBIDDEN = re.compile(r";|--|/\*|\b(insert|update|delete|drop|truncate|alter|create|grant|revoke|union|select|system|attach|file|url)\b", re.I)
FUNCTIONS = frozenset("count count_if sum avg min max if nullif coalesce abs round least greatest".split())
#: Names of the quality tests: fixed values of the contract.
TESTS = ("not_null", "between_0_and_1", "non_negative", "denominator_min_30", "monotonic_non_decreasing")


class DisallowedFilter(ValueError):
    """A filter or grain that the definition doesn't allow."""


@dataclass(frozen=True)
class Metric:
    key: str
    version: int
    measure: str
    source: str
    grain: tuple[str, ...]
    dimensions: tuple[str, ...] = ()
    filters: tuple[str, ...] = ()
    unit: str = "ratio"
    currency_policy: str | None = None
    tests: tuple[str, ...] = ()
    owner: str = "analytics"
    valid_from: dt.date = dt.date(2020, 1, 1)
    valid_to: dt.date | None = None
    joins: tuple[tuple[str, str], ...] = field(default=())  # (other source, shared column)

    def __post_init__(self) -> None:
        if FORBIDDEN.search(self.measure):
            raise ValueError(f"{self.key}: not a single expression")
        if unknown := {f.lower() for f in re.findall(r"(\w+)\s*\(", self.measure)} - FUNCTIONS:
            raise ValueError(f"{self.key}: {sorted(unknown)} may not be called")
        if outside := set(self.filters) - set(self.dimensions) - set(self.grain):
            raise ValueError(f"{self.key}: filters {sorted(outside)} are no dimensions")
        if self.unit == "money" and not self.currency_policy:
            raise ValueError(f"{self.key}: money needs a currency policy")
        if self.unit == "ratio" and "between_0_and_1" not in self.tests:
            raise ValueError(f"{self.key}: a ratio declares its bounds")
        if outside := set(self.tests) - set(TESTS):
            raise ValueError(f"{self.key}: unknown tests {sorted(outside)}")

    @property
    def certified(self) -> bool:
        return bool(self.tests and self.owner)

    def query_hash(self, grain: tuple[str, ...] | None = None) -> str:
        return hashlib.sha256("|".join((self.key, str(self.version), self.measure, self.source, ",".join(grain or self.grain))).encode()).hexdigest()

    def valid_on(self, day: dt.date) -> bool:
        return self.valid_from <= day and (self.valid_to is None or day < self.valid_to)


class Registry:
    def __init__(self, metrics: list[Metric]):
        self.metrics: dict[tuple[str, int], Metric] = {}
        for m in metrics:
            if (m.key, m.version) in self.metrics:
                raise ValueError(f"{m.key} version {m.version} is defined twice")
            self.metrics[m.key, m.version] = m
        for key in {m.key for m in metrics}:
            if sum(m.valid_to is None for m in metrics if m.key == key) != 1:
                raise ValueError(f"{key}: exactly one version is live")

    def get(self, key: str, version: int | None = None) -> Metric:
        if version is not None:
            return self.metrics[key, version]
        return next(m for m in self.metrics.values() if m.key == key and m.valid_to is None)


def query(metric: Metric, model: DataFrame, organization_id: str, grain: tuple[str, ...] | None = None, filters: dict[str, str] | None = None, source_time: str | None = None) -> DataFrame:
    """The grouped metric: grain columns, value, observations. The tenant is always bound and never returned."""
    if not organization_id:
        raise ValueError("a metric query without an organization is refused")
    grain = metric.grain if grain is None else grain
    if bad := set(grain) - set(metric.grain) - set(metric.dimensions):
        raise DisallowedFilter(f"{metric.key}: can't be grouped by {sorted(bad)}")
    if bad := set(filters or {}) - set(metric.filters):
        raise DisallowedFilter(f"{metric.key}: can't be filtered by {sorted(bad)}")
    rows = model.where(F.col("organization_id") == F.lit(organization_id))
    for name, value in (filters or {}).items():
        rows = rows.where(F.col(name) == F.lit(value))
    aggregates = [F.expr(metric.measure).cast("double").alias("value"), F.count("*").alias("observations")]
    if source_time:
        aggregates.append(F.max(source_time).alias("source_max_timestamp"))
    return rows.groupBy(*grain).agg(*aggregates) if grain else rows.agg(*aggregates)


def joined(metric: Metric, sources: dict[str, DataFrame]) -> DataFrame:
    """The metric's source with its declared joins, in their order: each on one shared column, rows without a match kept."""
    rows = sources[metric.source]
    for other, column in metric.joins:
        if column not in rows.columns or column not in sources[other].columns:
            raise ValueError(f"{metric.key}: {other} can't be joined on {column}")
        rows = rows.join(sources[other], column, "left")
    return rows


def violations(test: str, result: DataFrame, order: str | None = None, per: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a metric's result that break a test; none when it holds."""
    if test == "not_null":
        return result.where("value is null")
    if test == "between_0_and_1":
        return result.where("value < 0 or value > 1")
    if test == "non_negative":
        return result.where("value < 0")
    if test == "denominator_min_30":
        return result.where("observations < 30")
    if test == "monotonic_non_decreasing":
        before: Column = F.lag("value").over(Window.partitionBy(*per).orderBy(order))
        return result.withColumn("_before", before).where("value < _before").drop("_before")
    raise ValueError(test)


def catalogue(spark: SparkSession, registry: Registry) -> DataFrame:
    """What may be shown of each metric: everything but its formula."""
    rows = [(m.key, m.version, m.unit, ",".join(m.grain), ",".join(m.dimensions), ",".join(sorted(m.tests)), m.certified) for m in registry.metrics.values()]
    return spark.createDataFrame(rows, "metric_key string, version int, unit string, grain string, dimensions string, tests string, certified boolean")
