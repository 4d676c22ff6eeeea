"""Exact quantiles by refining a histogram: each round counts the values by cell and looks only into the one that holds the rank.

Counts are combined before the shuffle and a round returns at most ``CELLS`` rows, so no task and no driver ever holds the values, as an
exact percentile in one group would.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 1024


def exact_quantile(rows: DataFrame, column: str, share: float) -> tuple[int, float | None]:
    """How many values there are (null and NaN are none), and the value at that share of the ranks, between two values in proportion."""
    values = rows.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return 0, None
    place = share * (n - 1)
    rank, rest = math.floor(place), place - math.floor(place)
    inside, before, size = values, 0, n  # the values in question, those below them, their number
    while low < high:
        cell = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(high - low) * CELLS), F.lit(CELLS - 1))
        counted = sorted(tuple(r) for r in inside.groupBy(cell.alias("cell")).agg(F.count("*"), F.min("v"), F.max("v")).collect())
        for chosen, size, own_low, own_high in counted:
            if rank < before + size:
                break
            before += size
        inside, low, high = inside.where((F.col("v") >= own_low) & (F.col("v") <= own_high)), own_low, own_high
    if not rest or rank + 1 < before + size:
        return n, low
    above = values.where(F.col("v") > low).agg(F.min("v")).first()[0]
    return n, low + rest * (above - low)
