"""Delivered files: CSV with all its irregularities, and JSON pages."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents

DELIMITERS = ",;\t|"


def sniff(text: str) -> str:
    """The delimiter that the first line has most of; a comma if it has none."""
    head = text[:8192].split("\n", 1)[0]
    best = max(DELIMITERS, key=head.count)
    return best if head.count(best) else ","


def header(names: list[str]) -> list[str]:
    """Trimmed names; blank ones are numbered, repeated ones get a suffix."""
    out: list[str] = []
    for i, name in enumerate(names):
        name = name.strip() or f"column_{i + 1}"
        n, unique = 1, name
        while unique in out:
            n += 1
            unique = f"{name}_{n}"
        out.append(unique)
    return out


def parse(content: bytes) -> Iterator[tuple[int, dict[str, str | None]]]:
    """(row number from 1, fields) of a CSV file: blank rows don't count, short rows end in nulls, long ones keep what they have."""
    text = content.decode("utf-8-sig", "replace")
    rows = csv.reader(io.StringIO(text), delimiter=sniff(text))
    names = header(next(rows, []))
    number = 0
    for row in rows:
        if not any(v.strip() for v in row):
            continue
        number += 1
        fields = dict(zip(names, [*row, *[None] * (len(names) - len(row))], strict=False))
        yield number, fields | {f"column_{i + 1}": row[i] for i in range(len(names), len(row))}


def csv_records(files: DataFrame) -> DataFrame:
    """record_id (sha256 of the file, row), path, payload of every row; files: path, content. One file is one task's work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                sha = hashlib.sha256(content).hexdigest()
                out = [(f"{sha}:{n}", path, fields) for n, fields in parse(bytes(content))]
                yield pd.DataFrame(out, columns=["record_id", "path", "payload"])

    return files.select("path", "content").mapInPandas(run, "record_id string, path string, payload map<string,string>")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files below a folder."""
    return csv_records(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path))


def json_records(pages: DataFrame, id_field: str) -> DataFrame:
    """record_id and payload (JSON) of the items of pages shaped {"data": [...]}: the natural id, or the digest of the canonical item."""
    item = F.explode(F.from_json(F.get_json_object("page", "$.data"), "array<string>")).alias("payload")
    natural = F.get_json_object("payload", f"$.{id_field}")
    return pages.select(item).select(documents.identity(natural, F.col("payload")).alias("record_id"), "payload")
