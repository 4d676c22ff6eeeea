"""Helpers shared by the operators of this package: shared storage, tables, distributed ranks."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if there:
        return there
    spark.conf.set("spark.checkpoint.dir", there := f"file://{tempfile.mkdtemp(prefix='tallywright-')}")
    return there


#: Lets Spark remove the shuffle files of an action as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Within it, each action's shuffle files go when the action ends: its result is in the shared folder then."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """A copy of df as a Parquet table in the shared folder: what follows neither repeats its work nor depends on one executor."""
    path = f"{shared_dir(spark := df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with cleaned_up(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """The same, for steps without a name of their own."""
    return written(df, "kept")


def identity(text: Column, name: str = "h") -> list[Column]:
    """Two 64-bit hashes, by which equal texts are recognised."""
    return [F.xxhash64(text).alias(f"{name}1"), F.xxhash64(F.lit("2"), text).alias(f"{name}2")]


#: What identifies a row of documents: rows with the same doc_id, or none, differ in their text or are copies of each other.
KEY = ["_key_doc", "_key_t1", "_key_t2"]


def with_key(docs: DataFrame) -> DataFrame:
    """docs with the columns KEY: doc_id as a long, and two hashes of the text."""
    return docs.select("*", F.col("doc_id").cast("long").alias(KEY[0]), *identity(F.col("text"), "_key_t"))


def sheltered(docs: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with all columns but those used under names that nothing else has; and what gives them their own names back."""
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c not in used}
    return docs.withColumnsRenamed(names), {v: k for k, v in names.items()}


def joined(rows: DataFrame, others: DataFrame, how: str) -> DataFrame:
    """Joins rows, which have KEY, with others, which have it as __doc, __t1 and __t2."""
    same = F.col(KEY[0]).eqNullSafe(F.col("__doc")) & (F.col(KEY[1]) == F.col("__t1")) & (F.col(KEY[2]) == F.col("__t2"))
    out = rows.join(others, same, how)
    return out if how == "left_anti" else out.drop("__doc", "__t1", "__t2")


#: Bytes of a batch of rows for Python: the JVM and each worker hold several, beside the heap. Spark's own limit is a number of rows and so much, whatever the texts' lengths.
BATCH, BYTES, USUAL = "spark.sql.execution.arrow.maxBytesPerBatch", "12m", "67108864b"
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, unless they find it as the driver does (by PYTHONPATH or the working folder). Batches are BYTES unless set otherwise."""
    if spark.conf.get(BATCH, USUAL) == USUAL:
        spark.conf.set(BATCH, BYTES)
    top = Path(__file__).resolve().parents[2]
    known = [Path(p or ".").resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    context = spark.sparkContext
    if top in known or context.applicationId in _SHIPPED:
        return
    context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/tallywright", "zip", top, "tallywright"))
    _SHIPPED.add(context.applicationId)


def tidy() -> None:
    """Gives the system back what memory this process has free: allocators keep it, and a Python worker lives on through the stages that follow."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


#: What an operator keeps in a Python worker between its tasks: its name and tables, those of one operator at a time.
_TABLES: dict[str, dict] = {}


def tables_of(operator: str) -> dict:
    """This worker's tables of an operator; those of any other are let go, as workers outlive the stages they were made for."""
    if operator not in _TABLES:
        held = bool(_TABLES)
        _TABLES.clear()
        if held:
            tidy()
        _TABLES[operator] = {}
    return _TABLES[operator]


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, and tidy() when a task ends."""

    def tidily(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            tidy()

    return tidily


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, classes: list[str], order: list[str], name: str = "rank", rows: int | None = None, rows_per_task: int = 500_000, attach: DataFrame | None = None) -> DataFrame:
    """Adds a gapless rank from 0 within each class, in parts.

    A class may hold any share of the rows, so no task takes a whole class: rows are dealt into salts by a hash of
    their order columns, ranked within (class, salt), and shifted by the counts of the salts before theirs. Equal
    rows (same classes and order columns) share a salt; which of them comes first doesn't matter. ``attach``: a table with
    one row a class, whose other columns come along.
    """
    n = df.count() if rows is None else rows
    salts = max(1, -(-n // rows_per_task), df.sparkSession.sparkContext.defaultParallelism)
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = (
        dealt.groupBy(*classes, "_salt")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy(*classes).orderBy("_salt")) - F.col("_n"))
        .select(*[F.col(c).alias(f"_{c}") for c in classes], F.col("_salt").alias("__salt"), "_before")
    )
    if attach is not None:
        known = attach.withColumnsRenamed({c: f"_of_{c}" for c in classes})
        match = F.lit(True)
        for c in classes:
            match = match & F.col(f"_{c}").eqNullSafe(F.col(f"_of_{c}"))
        before = before.join(known, match).drop(*[f"_of_{c}" for c in classes])
    inside = Window.partitionBy(*classes, "_salt").orderBy(*order)
    same: Column = F.col("_salt") == F.col("__salt")
    for c in classes:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return (
        dealt.withColumn("_in", F.row_number().over(inside) - 1)
        .join(before, same)
        .withColumn(name, (F.col("_before") + F.col("_in")).cast("long"))
        .drop("_salt", "__salt", "_before", "_in", "_n", *[f"_{c}" for c in classes])
    )
