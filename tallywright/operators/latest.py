"""Latest-version-wins: one row per natural key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_wins(df: DataFrame, keys: Sequence[str], version: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The row of each key with the greatest version; equal versions are told apart by tiebreak, greatest first.

    One shuffle on the keys. Filters on key columns still reach the scan, since they are the window's partition columns.
    """
    order = [F.col(c).desc_nulls_last() for c in (version, *tiebreak)]
    ranked = df.withColumn("_version_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_version_rank = 1").drop("_version_rank")
