"""Sharding by histogram sort.

Documents are cut into shards of nearly equal bytes, in ascending doc_id order. Nothing is sampled and nothing is sorted
to find the cuts: each round counts the exact bytes of every cell of a grid of candidate keys, keeps the cells that hold
a cut, and refines only those, until every cut is as near its target as a boundary between two keys can be (or within
``tolerance``). Then the rows are exchanged once, into cells that are already balanced.

Rows of one key that hold more than a cut can pass over are parted by a number that each row has.

Edge cases: a null text has 8 bytes and checksum 0; a null doc_id counts as the smallest key; rows that share a doc_id
may lie in several shards, next to each other; an empty table gives no rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep

#: Cells of one round's grid, at most; what the driver holds of a round.
CELLS = 8192


def sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


#: Below every tie.
LEAST = -(2**63)


def splitters(rows: DataFrame, key: Column, size: Column, parts: int, tolerance: float = 0.0, tie: Column | None = None) -> list:
    """parts - 1 ascending keys; part i holds the keys from splitter i - 1 (inclusive) to splitter i.

    A splitter is the key boundary whose bytes below come nearest to i / parts of all bytes, the lower one on a tie.
    ``tolerance``: share of a part's bytes that is near enough to stop refining. With ``tie``, a long that no two rows share, the
    rows of one key may be parted too, and splitters are pairs (key, tie).
    """
    low, high, total = rows.agg(F.min(key), F.max(key), F.sum(size)).first()
    if low is None or parts < 2:
        return [0 if tie is None else (0, LEAST)] * (parts - 1)
    found, split = _refined(rows, key, size, {None: (0, list(range(1, parts)))}, (low, high), total, parts, tolerance, tie is not None)
    if tie is None:
        return [found[s] for s in range(1, parts)]
    cuts = {s: (c, LEAST) for s, c in found.items()}
    if split:
        inside = rows.where(key.isin(list(split)))
        span = inside.agg(F.min(tie), F.max(tie)).first()
        for c, at in split.items():
            own, _ = _refined(inside.where(key == c), tie, size, {None: at}, span, total, parts, tolerance, False)
            cuts |= {s: (c, t) for s, t in own.items()}
    return [cuts[s] for s in range(1, parts)]


def _refined(rows: DataFrame, key: Column, size: Column, cells: dict, span: tuple[int, int], total: int, parts: int, tolerance: float, ties: bool) -> tuple[dict[int, int], dict[int, tuple[int, list[int]]]]:
    """The splitters by number; and, with ties, for keys of several rows the bytes below them and the splitters inside.

    cells: the one cell to begin with, its bytes below and its splitters.
    """
    low, high = span
    near, found, split = tolerance * total / parts, {}, {}
    shift = max(0, (high - low + 1).bit_length() - CELLS.bit_length() + 2)
    at, up = rows, None
    while True:
        counted = sorted(tuple(r) for r in at.groupBy(F.shiftright(key, shift).alias("cell")).agg(F.sum(size), F.count("*")).collect())
        groups = [(below, wanted, [x for x in counted if up is None or x[0] >> up == parent]) for parent, (below, wanted) in cells.items()]
        cells = {}
        for below, wanted, inside in groups:
            ends = list(accumulate((b for _, b, _ in inside), initial=below))
            i = 0
            for s in wanted:  # both ascend
                target = total * s
                while i < len(inside) - 1 and ends[i + 1] * parts <= target:
                    i += 1
                c = inside[i][0]
                to_low, to_high = target - ends[i] * parts, ends[i + 1] * parts - target
                if min(to_low, to_high) <= near * parts or shift == 0 and not (ties and inside[i][2] > 1):
                    found[s] = c << shift if to_low <= to_high else min((c + 1) << shift, 2**63 - 1)
                elif shift == 0:
                    split.setdefault(c, (ends[i], []))[1].append(s)
                else:
                    cells.setdefault(c, (ends[i], []))[1].append(s)
        if not cells:
            return found, split
        at = rows.where(F.shiftright(key, shift).isin(list(cells)))
        before, shift = shift, max(0, shift - max(1, (CELLS // len(cells)).bit_length() - 1))
        up = before - shift


def part_of(key: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the key."""
    if len(cuts) > 64:
        return F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= key))
    return sum(((key >= F.lit(c).cast("long")).cast("int") for c in cuts), F.lit(0))


def pair_part_of(key: Column, tie: Column, cuts: list[tuple[int, int]]) -> Column:
    """The same for cuts that are pairs."""
    pairs = F.array(*[F.struct(F.lit(c).cast("long").alias("k"), F.lit(t).cast("long").alias("t")) for c, t in cuts])
    return F.size(F.filter(pairs, lambda c: (c.k < key) | ((c.k == key) & (c.t <= tie))))


def histogram_shards(docs: DataFrame, shards: int = 24, tolerance: float = 0.0, rows_per_cell: int = 1_000_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; law is always ``bytes``.

    Rows are numbered as they are written, which parts the rows of one doc_id. Every shard is cut further into cells of about
    rows_per_cell rows, so that the exchange and the sort that gives slots never put a whole shard into one task.
    """
    rows = keep(sized(docs).withColumn("_tie", F.monotonically_increasing_id()))
    n, low = rows.agg(F.count("*"), F.min("doc_id")).first()
    key, tie = F.coalesce(F.col("doc_id"), F.lit(low if low is not None else 0).cast("long")), F.col("_tie")
    cells = max(1, -(-n // (shards * rows_per_cell)))
    cuts = splitters(rows, key, F.col("size"), shards, tolerance, tie)
    placed = rows.withColumn("_key", key).withColumn("shard", pair_part_of(F.col("_key"), tie, cuts) if cuts else F.lit(0))
    if cells == 1:
        placed = placed.withColumn("_cell", F.lit(0))
    else:
        fine = sorted(set(splitters(rows, key, F.col("size"), shards * cells, 0.05, tie)))
        ends = [(LEAST, LEAST), *cuts, (2**63 - 1, 2**63 - 1)]
        inner = [[f for f in fine if a < f < b] for a, b in zip(ends, ends[1:])]
        cell = F.lit(0)
        for i, own in enumerate(inner):
            cell = F.when(F.col("shard") == i, pair_part_of(F.col("_key"), tie, own) if own else F.lit(0)).otherwise(cell)
        placed = placed.withColumn("_cell", cell)
    before = (
        placed.groupBy("shard", "_cell")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("shard").orderBy("_cell")) - F.col("_n"))
        .drop("_n")
    )  # a row for each cell
    slot = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("_key", "_tie")) - 1
    return (
        placed.withColumn("_slot", slot)
        .join(before, ["shard", "_cell"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + F.col("_slot")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
