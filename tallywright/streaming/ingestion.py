"""Resumable ingestion: a stream of delivered records is validated, mapped, and written to staging or quarantine, batch by batch.

Each micro-batch is one pass: one write, parted by verdict, holds the staged rows and the quarantined records, and observed counts
say how many there were. A batch's folder carries its number and is overwritten if the batch runs again; its run record is written
after it; the stream's checkpoint comes last. So a run that is stopped anywhere goes on where it was, without loss or copies.

Edge cases: a record that validation refuses is never mapped, and has all its reasons; an empty batch leaves a run record of zeros;
a batch that was written but not checkpointed is written again over itself, even if it failed half-way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest, receipt

STAGED, QUARANTINED = "staged", "quarantined"
RUN = "batch long, records_read long, records_written long, records_quarantined long, first_rejected string"


@dataclass(frozen=True)
class Job:
    """What to do with a resource's records: its checks, its mapping, and where everything goes.

    checks gives an array of reasons from a DataFrame of the payload's fields; mapping.version is kept with every rejection.
    """

    folder: str
    fields: tuple[str, ...]
    checks: Callable[[], Column]
    mapping: ingest.Mapping

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"


def decided(records: DataFrame, job: Job) -> DataFrame:
    """record_id, raw_ref, payload, the mapped columns, why (reasons) and verdict; validation speaks before mapping."""
    rows = records.select("record_id", F.col("path").alias("raw_ref"), "payload", *[F.element_at("payload", f).alias(f) for f in job.fields])
    checked = rows.withColumn("_checks", job.checks())
    carried = {"record_id": "record_id", "_checks": "_checks", "raw_ref": "raw_ref", "payload": "payload"}
    mapping = ingest.Mapping({**job.mapping.columns, **carried}, job.mapping.transforms, job.mapping.required, job.mapping.version)
    mapped = ingest.apply_mapping(checked, mapping)
    why = receipt.validate_then_map(F.col("_checks"), F.col("why"))
    verdict = F.when(F.size("why") == 0, STAGED).otherwise(QUARANTINED)
    return mapped.withColumn("why", why).drop("_checks").withColumns({"mapping_version": F.lit(job.mapping.version), "verdict": verdict})


def write_batch(batch: DataFrame, number: int, job: Job, fail_at: Callable[[str, int], None] | None = None) -> None:
    """One batch: its rows in one write, then its counts. fail_at is told each step, for tests of restarts."""
    counts = Observation()
    rows = decided(batch, job)
    refused = F.col("verdict") == QUARANTINED
    watched = rows.observe(counts, F.count("*").alias("read"), F.count_if(~refused).alias("written"), F.count_if(refused).alias("quarantined"), F.min(F.when(refused, F.col("record_id"))).alias("first"))
    kept = F.when(refused, F.col("payload")).alias("payload")
    own = [F.when(~refused, F.col(c)).alias(c) for c in job.mapping.columns]
    watched.select("verdict", "record_id", "raw_ref", kept, *own, "why", "mapping_version").write.partitionBy("verdict").mode("overwrite").parquet(job.path(f"rows/batch={number}"))
    if fail_at:
        fail_at("rows written", number)
    got = counts.get
    record = [(number, got["read"], got["written"], got["quarantined"], got["first"])]
    batch.sparkSession.createDataFrame(record, RUN).coalesce(1).write.mode("overwrite").parquet(job.path(f"runs/run={number}"))
    if fail_at:
        fail_at("run written", number)


def start(records: DataFrame, job: Job, fail_at: Callable[[str, int], None] | None = None) -> StreamingQuery:
    """Starts (or resumes) the job on a stream of record_id, path and payload; it ends when what is there has been read."""
    writer = records.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, job, fail_at))
    return writer.option("checkpointLocation", job.path("state")).trigger(availableNow=True).start()


def _stored(spark: SparkSession, job: Job, verdict: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", job.path("rows")).parquet(job.path(f"rows/batch=*/verdict={verdict}"))
    except AnalysisException:  # no batch has such a row
        return None


def staging(spark: SparkSession, job: Job) -> DataFrame | None:
    """The staged rows of all batches: mapped columns, record_id, raw_ref, mapping_version."""
    rows = _stored(spark, job, STAGED)
    return rows if rows is None else rows.select(*job.mapping.columns, "record_id", "raw_ref", "mapping_version")


def quarantine(spark: SparkSession, job: Job) -> DataFrame | None:
    """Every refused record with all its reasons, its payload and where it came from."""
    rows = _stored(spark, job, QUARANTINED)
    return rows if rows is None else rows.select("record_id", "raw_ref", "payload", "why", "mapping_version")


def runs(spark: SparkSession, job: Job) -> DataFrame:
    return spark.read.schema(RUN).parquet(job.path("runs"))


def summary(spark: SparkSession, job: Job) -> DataFrame:
    """The run as a whole: sums, and whether all, some or none of what was read has been written."""
    of = runs(spark, job).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("records_read", "records_written", "records_quarantined")])
    outcome = F.when(F.col("records_quarantined") == 0, "succeeded").when(F.col("records_written") == 0, "failed").otherwise("partial")
    return of.withColumn("outcome", outcome)
