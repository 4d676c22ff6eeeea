"""Validation and mapping of delivered records: rows to staging, every rejected record with all its reasons to quarantine."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def reasons(*found: Column) -> Column:
    """The reasons that apply, none hiding another."""
    return F.filter(F.array(*found), lambda r: r.isNotNull())


def required(names: tuple[str, ...]) -> list[Column]:
    return [F.when(blank(F.col(n)), f"missing_required:{n}") for n in names]


def timestamps(name: str, as_of: str) -> list[Column]:
    c = F.col(name)
    parsed = scalars.to_timestamp(c)
    return [F.when(~blank(c) & parsed.isNull(), f"type_coerced:{name}"), F.when(parsed > F.lit(as_of).cast("timestamp"), f"future_dated:{name}")]


def quantities(name: str) -> list[Column]:
    c = F.col(name)
    parsed = scalars.to_decimal(c)
    return [F.when(~blank(c) & parsed.isNull(), f"type_coerced:{name}"), F.when(parsed < 0, f"out_of_range:{name}")]


def amounts(name: str) -> list[Column]:
    c = F.col(name)
    parsed = scalars.to_int(c)
    return [F.when(~blank(c) & parsed.isNull(), f"type_coerced:{name}"), F.when(parsed < 0, f"negative_amount:{name}")]


def currencies(name: str) -> list[Column]:
    c = F.col(name)
    return [F.when(~blank(c) & ~c.rlike("^[A-Za-z]{3}$"), f"currency_mismatch:{name}")]


@dataclass(frozen=True)
class Mapping:
    """target column -> source field; transforms by target, applied in order until one fails."""

    columns: dict[str, str]
    transforms: dict[str, tuple[str, ...]] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    version: int = 1

    def __post_init__(self) -> None:
        if unknown := {t for ts in self.transforms.values() for t in ts} - set(scalars.TRANSFORMS):
            raise ValueError(f"unknown transforms {sorted(unknown)}")
        if unknown := (set(self.transforms) | set(self.required)) - set(self.columns):
            raise ValueError(f"not mapped: {sorted(unknown)}")


def apply_mapping(records: DataFrame, mapping: Mapping) -> DataFrame:
    """Mapped columns and why: an array of reasons, empty for a good row. Fields that records lack are schema drift."""
    columns, found = [], []
    for target, source in mapping.columns.items():
        if source not in records.columns:
            columns.append(F.lit(None).cast("string").alias(target))
            found.append(F.lit(f"schema_drift:{source}"))
            continue
        value = F.col(source)
        for name in mapping.transforms.get(target, ()):
            after = scalars.TRANSFORMS[name](value)
            if name in scalars.PARSERS:
                found.append(F.when(value.isNotNull() & after.isNull(), f"type_coerced:{target}"))
            value = after
        if target in mapping.required:
            found.append(F.when(blank(F.col(source)), f"missing_required:{target}"))
        columns.append(value.alias(target))
    return records.select("*", *[c.alias(f"_m_{t}") for c, t in zip(columns, mapping.columns, strict=True)], reasons(*found).alias("why")).select(*[F.col(f"_m_{t}").alias(t) for t in mapping.columns], "why")


def split(mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(staging rows, quarantined rows)."""
    return mapped.where(F.size("why") == 0).drop("why"), mapped.where(F.size("why") > 0)


def diff_mappings(before: Mapping, after: Mapping) -> dict[str, list[str]]:
    same = set(before.columns) & set(after.columns)
    return {
        "added": sorted(set(after.columns) - set(before.columns)),
        "removed": sorted(set(before.columns) - set(after.columns)),
        "changed": sorted(c for c in same if before.columns[c] != after.columns[c] or before.transforms.get(c) != after.transforms.get(c)),
        "required": sorted(set(before.required) ^ set(after.required)),
    }
