"""As-of join: for each left row the last right row at or before it, within equal keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_left(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], tiebreak: str | None = None, slice_seconds: int | None = None) -> DataFrame:
    """left with right_time and values of the latest right row whose time isn't after left_time; unmatched rows keep nulls.

    Both sides are unioned and sorted once by (keys, time); a running last() carries the right side forward. That is one
    shuffle and a linear pass, where a range condition would compare every pair of a key. With slice_seconds a key is parted
    by time, so that a hot key is many tasks' work: what a slice begins with is the last right row before it, found from
    one row for each key and slice.
    """
    carried = F.struct(F.col(right_time).alias("at"), *[F.col(v) for v in values])
    l = left.select(*keys, F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"), F.struct(*[F.col(c) for c in left.columns]).alias("_left"))
    tie = F.col(tiebreak).cast("long") if tiebreak else F.lit(None).cast("long")
    r = right.select(*keys, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), tie.alias("_tie"), carried.alias("_right"))
    both = l.unionByName(r, allowMissingColumns=True)
    if slice_seconds:
        both = both.withColumn("_slice", F.floor(F.unix_micros(F.col("_time").cast("timestamp")) / (slice_seconds * 1_000_000)))
        keys = [*keys, "_slice"]
        ends = both.groupBy(*keys).agg(F.max_by("_right", F.when(F.col("_side") == 0, F.struct("_time", "_tie"))).alias("_right"))
        earlier = Window.partitionBy(*keys[:-1]).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        begin = ends.withColumn("_right", F.last("_right", ignorenulls=True).over(earlier)).where("_right is not null")
        both = both.unionByName(begin.withColumn("_side", F.lit(0)), allowMissingColumns=True)  # without a time: before all others
    upto = Window.partitionBy(*keys).orderBy("_time", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = both.withColumn("_last", F.last("_right", ignorenulls=True).over(upto)).where("_side = 1")
    return joined.select("_left.*", F.col("_last.at").alias(right_time), *[F.col(f"_last.{v}").alias(v) for v in values])
