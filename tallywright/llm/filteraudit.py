"""Filter interaction audit: what five filters remove in each of their 120 orders.

The filters, on whole texts (words are maximal runs without ASCII white space, case-sensitive), fail a document
A: of under 50 words; B: with 100 * distinct words < 65 * words; C: with 100 * letters A-Z > 5 * code points; D: that holds any of
``#$%&*|``; E: whose text is identical to that of a smaller doc_id, in the whole table.

E routes documents by the xxhash of their text. A chain of each fingerprint holds full texts, each with its least doc_id; a document
that is not the least is let go with its bit set. Chains are kept on both sides of the one shuffle: a map task routes one
document of each text it has met, so a text that a third of all rows share reaches its partition once from each task.
A map task lets its chains go when they hold ``HELD`` characters, and there are as many
partitions as keep those of each below ``PARTITION`` bytes. Documents become rows of (doc_id, part, mask of failures);
labels are joined to those, and combineByKey merges the masks' counts by part, from which every order follows.

Edge cases: a null text is empty; a null source is the part of the empty string; a document without doc_id is smaller than none and
larger than none; rows of one doc_id and text don't fail E for each other and count each; a document is good (or
toxic) if any of its labels says so, and neither without one; long texts are worked on whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
MASKS = np.arange(1 << len(FILTERS))
HELD = 32 << 20
#: Bytes of text for each partition of chains, on average.
PARTITION = 64 << 20
CAPITALS, SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
MASKED = "doc_id long, part string, mask int, rows long"
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

#: doc_id, part, mask; and how many such rows.
Row = tuple[int | None, str, int]


def mask(text: str) -> int:
    """The bits of the filters A to D that a text fails."""
    raw = text.encode()
    words = raw.split()
    fails = {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 5 * len(text),
        "D": len(raw) > len(raw.translate(None, SYMBOLS)),
    }
    return sum(BIT[f] for f, failed in fails.items() if failed)


class Chains:
    """Collision chains: the texts of each fingerprint, each with its least doc_id and that one's rows."""

    def __init__(self) -> None:
        self.of: dict[int, list[list]] = {}
        self.held = 0

    def put(self, fingerprint: int, text: str, rows: dict[Row, int]) -> dict[Row, int]:
        """Takes rows of one doc_id; returns those, of it or held before, that are not the least: they fail E."""
        doc_id = next(iter(rows))[0]
        chain = self.of.setdefault(fingerprint, [])
        entry = next((e for e in chain if e[0] == text), None)
        if entry is None:
            chain.append([text, doc_id, dict(rows)])
            self.held += len(text) + 64
            return {}
        if doc_id == entry[1]:
            for row, n in rows.items():
                entry[2][row] = entry[2].get(row, 0) + n
            return {}
        gone = rows
        if doc_id < entry[1]:
            gone = entry[2]
            entry[1:] = doc_id, dict(rows)
        return {(d, part, m | BIT["E"]): n for (d, part, m), n in gone.items()}

    def release(self) -> Iterator[tuple[int, str, dict[Row, int]]]:
        for fingerprint, chain in self.of.items():
            for text, _, rows in chain:
                yield fingerprint, text, rows
        self.__init__()


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of all five filters and rows, the number of rows (repeated ones may come in several)."""
    spark = docs.sparkSession
    ship(spark)
    read = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit(""))).rdd
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION))

    def settled(rows: dict[Row, int], fingerprint: int) -> tuple:
        """Rows whose masks are final go to any partition."""
        return hash((fingerprint, next(iter(rows)))), (None, rows)

    def route(rows: Iterable) -> Iterator[tuple]:
        import xxhash

        chains = Chains()
        for doc_id, text, part in rows:
            fingerprint, row = xxhash.xxh3_64_intdigest(text.encode()), {(doc_id, part, mask(text)): 1}
            gone = row if doc_id is None else chains.put(fingerprint, text, row)
            if gone:
                yield settled(gone, fingerprint)
            if chains.held > HELD:
                yield from ((f, (t, r)) for f, t, r in chains.release())
        yield from ((f, (t, r)) for f, t, r in chains.release())

    def resolve(routed: Iterable) -> Iterator[tuple]:
        chains = Chains()
        for fingerprint, (text, rows) in routed:
            for row, n in (rows if text is None else chains.put(fingerprint, text, rows)).items():
                yield *row, n
        for _, _, rows in chains.release():
            for row, n in rows.items():
                yield *row, n

    routed: RDD = read.mapPartitions(route).partitionBy(partitions, lambda fingerprint: fingerprint)
    return spark.createDataFrame(routed.mapPartitions(resolve), MASKED, verifySchema=False)


def orders() -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """Each order and step: the masks that an earlier filter removes, and those that its filter fails."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, f in enumerate(order, 1):
            out.append((order, step, MASKS & before > 0, MASKS & BIT[f] > 0))
            before |= BIT[f]
    return out


def report(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """The rows of a part from its counts by mask: of all documents, the good and the toxic ones."""
    every, good, toxic = counts
    failing = np.array([int(m).bit_count() for m in MASKS])
    share = np.where(failing > 0, factorial(len(FILTERS)) // np.maximum(failing, 1), 0)
    for order, step, earlier, fails in orders():
        here = fails & ~earlier
        yield (
            part,
            order,
            step,
            *(int(x.sum()) for x in (every[~earlier & ~fails], every[here], every[fails & earlier], every[fails & (failing == 1)], good[here], toxic[here], (every * share)[fails])),
        )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    spark = docs.sparkSession
    of = masks(docs).groupBy("doc_id", "part", "mask").agg(F.sum("rows").alias("rows"))
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    known = of.join(flags, "doc_id", "left").select("part", "mask", "rows", F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0)))

    def one(row: tuple) -> np.ndarray:
        return add(np.zeros((3, len(MASKS)), "i8"), row)

    def add(counts: np.ndarray, row: tuple) -> np.ndarray:
        m, n, good, toxic = row
        counts[:, m] += (n, n * good, n * toxic)
        return counts

    counts = known.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(one, add, np.add)
    return spark.createDataFrame(counts.flatMap(lambda x: report(*x)), AUDIT, verifySchema=False)
