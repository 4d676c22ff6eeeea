"""JSON documents as variants: the kind of a value, a dump with sorted keys at every depth, and the fields that documents have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kind(value: Column) -> Column:
    """boolean, integer, number, string, array, object or null, of a variant; a variant that isn't there is null."""
    named = F.schema_of_variant(value)
    return (
        F.when(named.isNull() | (named == "VOID"), "null")
        .when(named == "BOOLEAN", "boolean")
        .when(named == "BIGINT", "integer")
        .when(named == "STRING", "string")
        .when(named.startswith("ARRAY"), "array")
        .when(named.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def canonical(text: Column) -> Column:
    """The document with sorted keys at every depth and no blanks; null for what is no JSON."""
    return F.to_json(F.try_parse_json(text))


def identity(natural: Column, text: Column) -> Column:
    """A natural id, or the digest of the canonical document; of what is no JSON, of its text."""
    return F.coalesce(F.nullif(natural, F.lit("")), F.concat(F.lit("sha256:"), F.sha2(F.coalesce(canonical(text), text), 256)))


def fields(documents: DataFrame, text: str, order: str) -> DataFrame:
    """field, type of the first document (by order) that has it, documents with it, and the schema that fits all its values."""
    parsed = documents.select(F.col(order).alias("_at"), F.try_parse_json(F.col(text)).alias("_v"))
    found = parsed.lateralJoin(documents.sparkSession.tvf.variant_explode(F.col("_v").outer())).where("key is not null")
    return found.groupBy(F.col("key").alias("field")).agg(F.min_by(kind(F.col("value")), "_at").alias("type"), F.count("*").alias("documents"), F.schema_of_variant_agg("value").alias("fits"))
