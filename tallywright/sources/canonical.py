"""The canonical catalogue: the schemas of all facts and dimensions, tables made from them, and loads that replace whole partitions.

Facts are parted by organization and month, so a tenant's question about a month reads that month of that tenant. A load
overwrites the partitions it has rows for and no others, so a load that runs again changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names and types of the canonical tables. "?" marks what may be null.
LINEAGE = "organization_id string, source_key string, source_connection_id string, source_record_id string, lineage_ref string, mapping_version int, occurred_at timestamp_ntz, ingested_at timestamp_ntz, received_at? timestamp_ntz, data_quality_flags array<string>"
FACTS = {
    "fact_transaction": ("transaction_id string, location_id string, channel_id string, campaign_id? string, anonymous_subject_id? string, amount_minor bigint, currency string, line_count int", "location_id, occurred_at, source_key, source_record_id", 2555),
    "fact_transaction_line": ("transaction_id string, line_number int, location_id string, product_variant_id string, quantity decimal(18,4), unit_amount_minor bigint, unit_cost_minor? bigint, currency string", "location_id, occurred_at, transaction_id, line_number", 2555),
    "fact_inventory_snapshot": ("location_id string, product_variant_id string, system_quantity decimal(18,4)", "location_id, product_variant_id, occurred_at", 1095),
    "fact_stock_check": ("check_id string, location_id string, product_variant_id string, staff_member_id? string, observed_quantity decimal(18,4)", "location_id, product_variant_id, occurred_at, check_id", 1095),
    "fact_footfall_observation": ("location_id string, counter_id string, interval_seconds int, visitor_count bigint", "location_id, occurred_at, counter_id", 1095),
    "fact_service_request": ("request_id string, location_id string, product_variant_id? string, anonymous_subject_id? string, request_type string, fulfilment_status string, unmet_reason? string", "location_id, occurred_at, request_id", 1095),
}
OTHERS = {
    "fact_metric_observation": ("organization_id string, metric_key string, metric_version int, grain string, dimension_key string, window_start timestamp_ntz, window_end timestamp_ntz, value? decimal(38,10), denominator? decimal(38,10), occurred_at timestamp_ntz, ingested_at timestamp_ntz, lineage_ref string, data_quality_flags array<string>", "metric_key, metric_version, grain, dimension_key, window_start", 1095),
    "quarantine_record": ("organization_id string, run_id string, source_key string, resource string, source_record_id string, lineage_ref string, mapping_version int, reason_flags array<string>, occurred_at timestamp_ntz, ingested_at timestamp_ntz", "source_key, occurred_at, source_record_id", 365),
}
DIMENSIONS = {
    "dim_location": ("organization_id string, location_id string, name string, region? string, floor_area_sqm? decimal(18,2), valid_from timestamp_ntz, valid_to? timestamp_ntz, updated_at timestamp_ntz", "location_id, valid_from"),
    "dim_product_variant": ("organization_id string, product_variant_id string, product_id string, sku string, name string, cost_price_minor? bigint, currency? string, valid_from timestamp_ntz, valid_to? timestamp_ntz, updated_at timestamp_ntz", "product_variant_id, valid_from"),
    "dim_channel": ("organization_id string, channel_id string, name string, kind string, updated_at timestamp_ntz", "channel_id"),
    "dim_source": ("organization_id string, source_key string, connector_version string, name string, expected_cadence_seconds? bigint, updated_at timestamp_ntz", "source_key"),
}


MODE = "spark.sql.sources.partitionOverwriteMode"


@dataclass(frozen=True)
class Table:
    """columns: name, type, whether it may be null; key: what a later version replaces; version: which one wins."""

    name: str
    columns: tuple[tuple[str, str, bool], ...]
    key: tuple[str, ...]
    version: str
    ttl_days: int | None

    @property
    def partitions(self) -> tuple[str, ...]:
        return ("organization_id", "month") if self.version == "ingested_at" else ()

    def statement(self, database: str, folder: str) -> str:
        own = [f"{c} {t}" for c, t, _ in self.columns if c not in self.partitions]
        columns = ", ".join(own + [f"{p} string" for p in self.partitions])
        by = f" PARTITIONED BY ({', '.join(self.partitions)})" if self.partitions else ""
        return f"CREATE TABLE IF NOT EXISTS {database}.{self.name} ({columns}) USING parquet{by} LOCATION '{folder}/{self.name}'"


def _columns(text: str) -> tuple[tuple[str, str, bool], ...]:
    named = [c.split(" ", 1) for c in text.replace("(18,", "(18;").replace("(38,", "(38;").split(", ")]
    return tuple((n.rstrip("?"), t.replace(";", ","), n.endswith("?")) for n, t in named)


def registry() -> dict[str, Table]:
    """All tables by name."""
    keyed = lambda k: ("organization_id", *k.split(", "))
    tables = [Table(n, _columns(f"{LINEAGE}, {own}"), keyed(key), "ingested_at", days) for n, (own, key, days) in FACTS.items()]
    tables += [Table(n, _columns(own), keyed(key), "ingested_at", days) for n, (own, key, days) in OTHERS.items()]
    tables += [Table(n, _columns(own), keyed(key), "updated_at", None) for n, (own, key) in DIMENSIONS.items()]
    return {t.name: t for t in tables}


def create(spark: SparkSession, database: str, folder: str) -> list[str]:
    """Makes what isn't there; returns the statements, which may be run any number of times."""
    made = [f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{folder}'", *[t.statement(database, folder) for t in registry().values()]]
    for statement in made:
        spark.sql(statement)
    return made


def shaped(rows: DataFrame, table: Table) -> DataFrame:
    """rows as the table has them; columns that may be null can lack, others can't, and a null where none may be is an error."""
    given = {c.lower() for c in rows.columns}
    if lacking := [c for c, _, optional in table.columns if not optional and c not in given]:
        raise ValueError(f"{table.name} lacks {', '.join(lacking)}")

    def one(name: str, kind: str, optional: bool):
        c = (F.col(name) if name in given else F.lit(None)).cast(kind)
        return (c if optional else F.coalesce(c, F.raise_error(F.lit(f"{table.name}.{name} is null")).cast(kind))).alias(name)

    out = rows.select(*[one(*c) for c in table.columns])
    if not table.partitions:
        return out
    own = [c for c, _, _ in table.columns if c not in table.partitions]
    return out.select(*own, "organization_id", F.date_format("occurred_at", "yyyyMM").alias("month"))


def load(rows: DataFrame, database: str, name: str) -> None:
    """Replaces the partitions (the whole of a dimension) that rows belong to."""
    spark, table = rows.sparkSession, registry()[name]
    before = spark.conf.get(MODE)
    spark.conf.set(MODE, "dynamic")
    try:
        made = shaped(rows, table)
        made = made.hint("rebalance", *table.partitions) if table.partitions else made  # few files a partition, large ones split
        made.write.mode("overwrite").insertInto(f"{database}.{name}")
    finally:
        spark.conf.set(MODE, before)


def latest(spark: SparkSession, database: str, name: str) -> DataFrame:
    """The last version of each key."""
    from ..operators.latest import latest_wins

    table = registry()[name]
    return latest_wins(spark.table(f"{database}.{name}"), list(table.key), table.version)
