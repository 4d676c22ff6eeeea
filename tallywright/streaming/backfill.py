"""Backfill by windows: one child run for each window, one after another; a window that fails is kept apart and the others go on.

A child's rows replace its own window in the table (dynamic partition overwrite) once it has succeeded as a whole, so a window can be run
again, and one that fails leaves what was there before.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

OUTCOMES = "window_start timestamp_ntz, window_end timestamp_ntz, outcome string, records long, error string"


def windows(start: dt.datetime, end: dt.datetime, step: dt.timedelta = dt.timedelta(days=1)) -> list[tuple[dt.datetime, dt.datetime]]:
    """Half-open windows from start to end, the last one clipped."""
    out = []
    while start < end:
        out.append((start, min(start + step, end)))
        start += step
    return out


def run(source: DataFrame, time: str, spans: list[tuple[dt.datetime, dt.datetime]], child: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """What became of each window; the children's rows are in folder/rows, by window_start.

    Every child reads its window of the source by a filter on time, which reaches the scan.
    """
    spark, told = source.sparkSession, []
    for low, high in spans:
        part = source.where((F.col(time) >= F.lit(low).cast("timestamp_ntz")) & (F.col(time) < F.lit(high).cast("timestamp_ntz")))
        name = low.strftime("%Y%m%dT%H%M%S")
        try:
            counts = Observation()
            rows = child(part).observe(counts, F.count("*").alias("n")).withColumn("window", F.lit(name))
            rows.write.partitionBy("window").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/rows")
            told.append((low, high, "succeeded", counts.get["n"], None))
        except PySparkException as e:
            told.append((low, high, "failed", 0, str(e).strip().split("\n")[0][:200]))
    return spark.createDataFrame(told, OUTCOMES)


def overall(outcomes: DataFrame) -> DataFrame:
    """succeeded, failed or partial; how many windows and records; the first error."""
    failed = F.count_if(F.col("outcome") == "failed")
    kind = F.when(failed == 0, "succeeded").when(failed == F.count("*"), "failed").otherwise("partial")
    return outcomes.agg(kind.alias("outcome"), F.count("*").alias("windows"), failed.alias("failed_windows"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.min_by("window_start", F.when(F.col("outcome") == "failed", F.col("window_start"))).alias("first_failed"))
