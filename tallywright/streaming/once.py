"""Structured Streaming runs that end when the input is read, with results in a shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def working_dir(spark: SparkSession) -> str:
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (there or f"file://{tempfile.mkdtemp(prefix='tallywright-')}").rstrip("/") + f"/stream-{uuid.uuid4().hex}"


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything the stream puts out. A batch that runs again overwrites its own folder, so replays change nothing."""
    spark, top = stream.sparkSession, working_dir(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        target = f"{top}/out" if mode == "complete" else f"{top}/out/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/out").select(*stream.columns)
