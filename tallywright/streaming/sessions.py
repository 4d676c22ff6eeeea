"""Late rows and sessions: rows behind the watermark go to a table of their own, the others become sessions, evicted as they close.

The high-water mark of a micro-batch is the latest time of the batches before it, kept with them as data, less the delay. A row
below it is late; so which rows are late depends on how they came, and a batch that runs again decides the same. Sessions are a
second stream over what was on time, with the same watermark: the engine drops none of its rows, and puts a session out once
(append mode) when the watermark passes its end, freeing its state. ``close`` ends those that are open when the input is over.

No row is lost: the rows of all sessions and the late ones are all rows. Rows without a time are late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MARK = "batch long, high timestamp"
#: A user that no row has; its one row moves the watermark past every session.
NOBODY = -1


def split(stream: DataFrame, folder: str, time: str, delay: str) -> None:
    """Writes rows/batch=<n>/late=<true or false> and marks, until the stream's input has been read."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks = _read(spark, MARK, f"{folder}/marks")
        high = marks.where(F.col("batch") < number).agg(F.max("high")).first()[0] if marks is not None else None
        late = F.col(time).isNull() if high is None else F.col(time).isNull() | (F.col(time) < F.lit(high) - F.expr(f"INTERVAL {delay}"))
        batch.withColumn("late", late).write.partitionBy("late").mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        own = batch.agg(F.max(time)).first()[0]
        spark.createDataFrame([(number, own)], MARK).coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/mark={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/split-state").trigger(availableNow=True).start().awaitTermination()


def _read(spark: SparkSession, schema: str | StructType, *paths: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(*paths)
    except AnalysisException:  # nothing has been written there
        return None


def rows(spark: SparkSession, folder: str, schema: StructType, late: bool) -> DataFrame:
    found = _read(spark, schema, f"{folder}/rows/batch=*/late={str(late).lower()}")
    return spark.createDataFrame([], schema) if found is None else found


def sessions(spark: SparkSession, folder: str, schema: StructType, key: str, time: str, delay: str, gap: str) -> None:
    """Appends the sessions that have closed; call again after more rows, or after close().

    What has come since the last call is one micro-batch: a part of a batch alone could move the watermark past rows of the rest.
    """
    on_time = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/rows/batch=*/late=false")
    counted = on_time.withWatermark(time, delay).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.min(time).alias("started_at"), F.max(time).alias("ended_at"))
    out = counted.select(key, "started_at", "ended_at", "n").writeStream.format("parquet").outputMode("append").option("path", f"{folder}/sessions")
    out.option("checkpointLocation", f"{folder}/session-state").trigger(availableNow=True).start().awaitTermination()


def close(spark: SparkSession, folder: str, schema: StructType, key: str, time: str, delay: str, gap: str) -> None:
    """One row of nobody's, so late that every session has ended."""
    high = spark.read.schema(MARK).parquet(f"{folder}/marks").agg(F.max("high").alias("high"))
    end = F.col("high") + F.expr(f"INTERVAL {delay}") + F.expr(f"INTERVAL {gap}") + F.expr("INTERVAL 1 DAY")
    given = {key: F.lit(NOBODY), time: end}
    row = high.where("high is not null").select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    row.coalesce(1).write.mode("overwrite").parquet(f"{folder}/rows/batch=closing/late=false")
