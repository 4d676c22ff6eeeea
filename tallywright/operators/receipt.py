"""What arrives and how it is kept: signed deliveries, pages to ask for, raw objects, audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signing import hmac_sha256
from .ingest import reasons

# The tolerance, and below the wording of refusals.
TOLERANCE_SECONDS = 300


def webhook_refusal(key: bytes, timestamp: Column, body: Column, signature: Column, now: Column) -> Column:
    """Why a delivery is refused, or null. The signature covers timestamp and body; too early is as wrong as too late."""
    sent = F.when(timestamp.rlike("^[+-]?[0-9]{1,12}$"), timestamp.try_cast("long"))
    expected = hmac_sha256(key, F.encode(F.concat(timestamp, F.lit("."), body), "UTF-8"))
    return (
        F.when(sent.isNull() | now.isNull(), "timestamp is not a unix time")
        .when(F.abs(now - sent) > TOLERANCE_SECONDS, "timestamp outside tolerance")
        .when(~F.coalesce(signature == expected, F.lit(False)), "signature mismatch")
    )


def rest_reasons(record_id: Column, occurred_at: Column, payload: Column, as_of: Column) -> Column:
    """Why a fetched record is refused: no identifier, a time to come, no fields."""
    empty = payload.isNull() | payload.isin("", "{}", "null")
    return reasons(F.when(record_id.isNull() | (record_id == ""), "missing_required:source_record_id"), F.when(occurred_at > as_of, "future_dated:occurred_at"), F.when(empty, "missing_required:payload"))


def raw_puts(puts: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """Outcome of each put: the first of a key is stored, equal bytes are there already, other bytes are a conflict.

    The first of a key is an aggregate, combined before the shuffle, so a key with many puts is no burden.
    """
    digest = F.sha2(F.col(content), 256)
    rows = puts.select(key, order, digest.alias("sha256"))
    first = rows.groupBy(key).agg(F.min(F.struct(order, "sha256")).alias("_first"))
    outcome = F.when(F.col(order) == F.col(f"_first.{order}"), "stored").when(F.col("sha256") == F.col("_first.sha256"), "already_there").otherwise("conflict")
    return rows.join(first, key).withColumn("outcome", outcome).drop("_first")


def audit_records(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """What changed: one row for each record that is new, gone or different, with both snapshots as JSON with sorted keys."""
    shot = lambda: F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    both = before.select(key, shot().alias("before")).join(after.select(key, shot().alias("after")), key, "full_outer")
    action = F.when(F.col("before").isNull(), "created").when(F.col("after").isNull(), "deleted").otherwise("updated")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("action", action)


def next_version(versions: DataFrame, *keys: str) -> DataFrame:
    return versions.groupBy(*keys).agg((F.max("version") + 1).alias("next_version"))


def validate_then_map(validation: Column, mapping: Column) -> Column:
    """Mapping has a say only where validation found nothing."""
    return F.when(F.size(validation) == 0, mapping).otherwise(validation)
