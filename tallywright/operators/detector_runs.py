"""Detector runs in one pass: readings are counted, judged and turned into candidates with evidence by the job that writes them.

A run's candidates go to a folder of its own; its record, written last, holds the observed counts and decides whether they count. A
reading that breaks the detector's assumptions, a candidate that breaks an invariant, or a plan that can't be made fails the run:
its candidates stay unpublished, and the record says why. Disabled detectors leave a record too. A run's id follows from its
configuration and window, so a run that is done again replaces itself.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.signing import fingerprint
from .detect import COLUMNS, Rule, sufficient
from .ledger import candidate_faults

RUNS = (
    "run_id string, detector string, rule_id string, rule_version int, config_fingerprint string, window_start string, window_end string, readings_considered long, "
    "insufficient_readings long, candidates_produced long, outcome string, errors array<string>, skipped_reason string, query_hashes array<string>, thresholds string, duration_ms long"
)
#: Thresholds of which the first must not be above the second.
ASCENDING = (("lower", "upper"), ("high", "critical"), ("threshold", "high"))


@dataclass(frozen=True)
class Config:
    """One version of a detector's configuration; thresholds are the detector's own arguments."""

    detector: str
    rule: Rule
    metric_key: str
    query: str
    window_start: str
    window_end: str
    thresholds: dict = field(default_factory=dict)
    falling: bool = False
    version: int = 1
    metric_version: int = 1
    pack_key: str = "retail"
    unit: str = "ratio"
    currency: str = "GBP"
    sensitivity: str = "internal"
    enabled: bool = True

    def __post_init__(self) -> None:
        t = self.thresholds
        wrong = [f"{a} is above {b}" for a, b in ASCENDING if a in t and b in t and t[a] is not None and t[b] is not None and (t[a] > t[b]) != (self.falling and a != "lower") and t[a] != t[b]]
        wrong += [what for failed, what in ((self.version < 1, "version is below 1"), (not self.pack_key, "no pack"), (self.rule.least_observations < 0, "least_observations is negative"), (self.window_start >= self.window_end, "the window is empty")) if failed]
        if wrong:
            raise ValueError(f"{self.detector}: {'; '.join(wrong)}")

    @classmethod
    def of(cls, settings: dict) -> Config:
        """From plain settings; a misspelt one is an error, not a default."""
        if unknown := set(settings) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return cls(**settings)

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()

    @property
    def query_hash(self) -> str:
        return hashlib.sha256(f"{self.metric_key}|{self.metric_version}|{self.query}".encode()).hexdigest()

    @property
    def run_id(self) -> str:
        return f"{self.detector}-{self.fingerprint[:16]}"


def with_evidence(candidates: DataFrame, c: Config) -> DataFrame:
    """Candidates with what they rest on, and a digest of everything that a replay must give again."""
    evidence = F.struct(
        F.lit(c.metric_key).alias("metric_key"), F.lit(c.metric_version).alias("metric_version"), F.lit(c.query_hash).alias("query_hash"),
        F.create_map(F.col("scope_type"), F.col("scope_id")).alias("dimensions"), F.lit(c.window_start).alias("window_start"), F.lit(c.window_end).alias("window_end"),
        F.lit(c.window_end).alias("captured_at"), F.lit(c.sensitivity).alias("sensitivity"),
    )
    rows = candidates.withColumn("evidence", F.array(evidence))
    told = F.array_join(F.array_sort(F.transform("evidence", lambda e: F.concat(e["metric_key"], F.lit("@v"), e["metric_version"].cast("string"), F.lit(":"), e["query_hash"]))), ",")
    currency = F.when(F.col("exposure_base").isNotNull(), c.currency)
    parts = [
        F.col("gap_type"), F.col("scope_type"), F.col("scope_id"), F.lit(c.metric_key), F.lit(c.metric_version), F.col("observed"), F.col("expected"), F.lit(c.unit), F.col("severity"),
        F.col("confidence_score"), F.col("confidence_band"), F.col("exposure_low"), F.col("exposure_base"), F.col("exposure_high"), currency, F.col("reason_codes"), told, F.lit(c.window_start), F.lit(c.window_end),
    ]
    return rows.withColumn("fingerprint", fingerprint(*parts))


def run(spark: SparkSession, config: Config, detect: Callable[..., DataFrame], readings: DataFrame, folder: str, invalid: Column | None = None) -> str:
    """Runs a detector over readings (scope_id, n, and what it needs); returns the run's outcome. invalid: which readings fail the run."""
    began = time.monotonic()
    if not config.enabled:
        return _record(spark, config, folder, "skipped", skipped="detector disabled")
    read, made = Observation(), Observation()
    wrong = F.count_if(F.coalesce(invalid, F.lit(False)) if invalid is not None else F.lit(False))
    watched = readings.observe(read, F.count("*").alias("considered"), F.count_if(~sufficient(config.rule)).alias("insufficient"), wrong.alias("invalid"))
    try:
        found = with_evidence(detect(watched, config.rule, **config.thresholds), config)
        fault = F.array_join(candidate_faults(found), ",")
        hashes = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("evidence", lambda e: e["query_hash"])))))
        found = found.observe(made, F.count("*").alias("candidates"), F.max(fault).alias("fault"), hashes.alias("hashes"))
        found.write.mode("overwrite").parquet(f"{folder}/candidates/run_id={config.run_id}")
    except PySparkException as e:  # a run that fails must not look like one that found nothing, nor take others with it
        first = str(e).strip().split("\n")[0]
        return _record(spark, config, folder, "failed", errors=[f"{type(e).__name__}: {first}"], began=began)
    counts, out = read.get, made.get
    errors = [f"{counts['invalid']} invalid readings"] if counts["invalid"] else []
    errors += [f"invalid candidates: {out['fault']}"] if out["fault"] else []
    own = (counts["considered"], counts["insufficient"], 0 if errors else out["candidates"])
    return _record(spark, config, folder, "failed" if errors else "succeeded", own, errors, [] if errors else list(out["hashes"] or []), began=began)


def _record(spark: SparkSession, c: Config, folder: str, outcome: str, counts: tuple = (0, 0, 0), errors: list | None = None, hashes: list | None = None, skipped: str | None = None, began: float | None = None) -> str:
    took = int(1000 * (time.monotonic() - began)) if began is not None else 0
    row = (c.run_id, c.detector, c.rule.rule_id, c.version, c.fingerprint, c.window_start, c.window_end, *counts, outcome, errors or [], skipped, hashes or [], json.dumps(c.thresholds, sort_keys=True), took)
    spark.createDataFrame([row], RUNS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/runs/run={c.run_id}")
    return outcome


def records(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each run, failed and skipped ones too."""
    return spark.read.schema(RUNS).parquet(f"{folder}/runs")


def published(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """The candidates of the runs that succeeded."""
    found = spark.read.parquet(f"{folder}/candidates")
    succeeded = records(spark, folder).where("outcome = 'succeeded'").select("run_id", "detector")
    return found.join(succeeded, "run_id").select("detector", *COLUMNS, *more)
