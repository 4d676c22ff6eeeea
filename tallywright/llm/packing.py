"""Bulk-synchronous best-fit packing of token sequences.

Documents are encoded once; longer ones are cut into pieces of ``capacity`` ids, a shorter piece first. Pieces are
range-sorted by length and ranked within it, by Spark. Bands of lengths follow each other, longest first. A superstep
sweeps gaps and waiting pieces upwards by size: each gap takes the longest piece still waiting that it holds (its
predecessor; the piece has its successor). Where several ask for one gap, ranks decide: in an upward sweep waiting pieces
form a stack, so a piece's and a gap's height on it follow from counts by size and from their rank, and the two that meet
are neighbours at one height. Matching is a window over heights. Gaps then shrink and get their rank among gaps of the new
room, which follows from their old rank, as gaps of one room that take pieces of one length are neighbours before and
after. The next superstep begins, until a band's sweep places little; what waits then opens sequences, longest first, in
the same superstep.

The driver sees counts by length and room, at most a few times ``capacity`` numbers, and no piece or gap. A height holds
at most one piece and one gap of each size, so no window's group grows with the input. A superstep is one shuffle by
height and one table; places within a sequence are known when a piece is placed.

Edge cases: a null text is empty and has just the end id; equal rows are packed each for itself; an empty table gives no
rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep, ranked, ship, tables_of, tidied
from .tokens import encoder

#: Lengths above capacity / (HARMONICS + 1) have bands of their own by how many fill a sequence; shorter ones share bands.
HARMONICS, SHARED = 6, 4
#: A band sweeps on while a sweep places at least one in so many of the pieces that wait.
LITTLE = 64
#: A rank among pieces of one length has so many bits at most.
BITS = 48


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    end = np.array([end_id], "<u4").tobytes()

    ship(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer_path).encode_all
        for batch in batches:
            out = []
            for row, own in enumerate(encode(batch["text"])):
                ids = own + end
                n = len(ids) // 4
                a, b, k = 0, n % capacity or capacity, 0
                while a < n:
                    out.append((row, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                    a, b, k = b, b + capacity, k + 1
            made = pd.DataFrame(out, columns=["row", "piece", "start", "length", "ids_crc32"])
            made.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy()[made.pop("row")])
            yield made.astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(tidied(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]
PLACE = [*PIECE, "sequence_id", "offset", "room", "_gap"]


def bands(capacity: int) -> list[tuple[int, int]]:
    """(shortest length, longest), longest first."""
    out = [(capacity // (j + 1) + 1, capacity // j) for j in range(1, HARMONICS + 1)]
    high = capacity // (HARMONICS + 1)
    while high:
        out.append((high // SHARED + 1, high))
        high //= SHARED
    return [b for b in out if b[0] <= b[1]]


def figures(names: str, find: Callable[..., Iterable[np.ndarray]]) -> Callable[..., Column]:
    """Whole numbers, as a struct, that find has for columns of whole numbers, in numpy.

    What it looks up goes to the tasks with it: constants are written out in a plan's text, which stays with the driver for each superstep anew, and so does what is broadcast.
    """

    def found(*keys: pd.Series) -> pd.DataFrame:
        tables_of("figures")  # the texts are encoded by now: workers need no tokenizer any more
        return pd.DataFrame(dict(zip(names.split(), find(*[k.to_numpy() for k in keys]))))

    # else filters repeat it below themselves, and each pandas function of a task in a row has a worker of its own
    return F.pandas_udf(found, ", ".join(f"{n} long" for n in names.split())).asNondeterministic()


def by_size(names: str, values: dict[int, tuple[int, ...]], most: int) -> Callable[..., Column]:
    """The figures values[size] of a size from 0 to most; 0 where there are none."""
    table = np.zeros((len(names.split()), most + 1), np.int64)
    for size, own in values.items():
        table[:, size] = own
    return figures(names, lambda size: table[:, size])


def shifted(moved: dict[tuple[int, int], tuple[int, int]], most: int) -> Callable[..., Column]:
    """The number that moved has for (room, length)."""
    keys = np.array([r * (most + 1) + x for r, x in sorted(moved)], np.int64)
    shifts = np.array([moved[k][1] for k in sorted(moved)], np.int64)
    return figures("shift", lambda room, length: [shifts[np.searchsorted(keys, room * (most + 1) + length)]])


def sweep(lengths: dict[int, int], rooms: dict[int, int]) -> tuple[dict, dict, Counter, dict]:
    """The upward sweep by counts.

    length -> (height of rank 0, pieces no gap takes), room -> (height of rank 0, gaps that take one), room -> gaps after,
    and (room, length or 0 for none) -> (room after, number that turns a gap's rank into that after). A length's pieces rise from its height by rank, a room's gaps fall from theirs.
    """
    stack, depth = [], 0
    first, takes, after, moved = {}, {}, Counter(), {}
    left = dict(lengths)

    def move(room: int, length: int, rank: int, number: int) -> None:
        moved[room, length] = (room - length, after[room - length] - rank)
        after[room - length] += number

    for size in sorted({*lengths, *rooms}):
        if n := lengths.get(size, 0):
            first[size] = depth
            stack.append(size)
            depth += n
        gaps = rooms.get(size, 0)
        meet = min(gaps, depth)
        takes[size] = (depth - 1, meet)
        depth -= meet
        rank = 0
        while rank < meet:
            most = min(meet - rank, left[x := stack[-1]])
            left[x] -= most
            move(size, x, rank, most)
            rank += most
            if not left[x]:
                stack.pop()
        if gaps > meet:
            move(size, 0, meet, gaps - meet)
    after = Counter({r: n for r, n in after.items() if r and n})
    return {x: (first[x], left[x]) for x in first}, {r: takes[r] for r in rooms}, after, moved


def matched(pieces: DataFrame, gaps: DataFrame, counts: dict[int, int], swept: tuple[dict, dict, Counter, dict], capacity: int) -> DataFrame:
    """One row a gap, with the columns PLACE: the piece it takes, or nulls, and the room left."""
    heights, takes, _, moved = swept
    of_length = by_size("height waits counted", {x: (h, u, counts[x]) for x, (h, u) in heights.items()}, capacity)
    up = pieces.withColumn("_of", of_length("length")).where("_rank >= _of.waits AND _rank < _of.counted")
    asks = up.select((F.col("_of.height") + F.col("_rank")).alias("_at"), F.col("length").alias("_size"), F.lit(0).alias("_kind"), F.struct(*PIECE).alias("_p"))
    of_room = by_size("height takes known shift", {r: (h, n, 1, moved.get((r, 0), (0, 0))[1]) for r, (h, n) in takes.items()}, capacity)
    down = gaps.withColumn("_of", of_room("room")).where("_of.known = 1")
    offers = down.where("_gap < _of.takes").select((F.col("_of.height") - F.col("_gap")).alias("_at"), F.col("room").alias("_size"), F.lit(1).alias("_kind"), "sequence_id", "_gap")
    together = asks.unionByName(offers, allowMissingColumns=True)
    pairs = together.withColumn("_p", F.lag("_p").over(Window.partitionBy("_at").orderBy("_size", "_kind"))).where("_kind = 1")
    met = pairs.select("_p.*", "sequence_id", F.col("_size").alias("_was"), "_gap")
    met = met.withColumn("_shift", shifted(moved, capacity)("_was", "length")["shift"])
    # no task has two pandas functions in a row: each would have a worker of its own, and those stay
    kept = down.where("_gap >= _of.takes").select("sequence_id", F.col("room").alias("_was"), "_gap", F.col("_of.shift").alias("_shift"))
    rows = met.unionByName(kept, allowMissingColumns=True)
    by = F.coalesce("length", F.lit(0))
    return rows.select(*PIECE, "sequence_id", (capacity - F.col("_was")).alias("offset"), (F.col("_was") - by).alias("room"), (F.col("_gap") + F.col("_shift")).alias("_gap"))


def groups(waiting: dict[int, int], capacity: int, sequence: int, rooms: Counter) -> list[tuple[int, ...]]:
    """Runs of waiting pieces that open sequences: (length, first rank, pieces, first sequence, pieces a sequence, offset, room left, rank of the first gap).

    Full groups of one length, and groups of what is left of the lengths that follow each other. The room is 0 in runs that go on
    with a group: its first piece has its gap. The new gaps are added to ``rooms``.
    """
    runs, fill, begun = [], 0, None

    def close(run: list[int], number: int) -> None:
        run[7] = rooms[run[6]]
        rooms[run[6]] += number

    for x in sorted(waiting, reverse=True):
        n, at = waiting[x], 0
        if begun and (fits := min(n, (capacity - fill) // x)):
            runs.append([x, 0, fits, begun[3], fits, fill, 0, 0])
            fill, at = fill + fits * x, fits
        if at == n:
            continue
        if begun:
            begun[6] = capacity - fill
            close(begun, 1)
            begun = None
        each = capacity // x
        if full := (n - at) // each:
            runs.append([x, at, full * each, sequence, each, 0, capacity - each * x, 0])
            close(runs[-1], full)
            sequence, at = sequence + full, at + full * each
        if at < n:
            begun, fill = [x, at, n - at, sequence, n - at, 0, 0, 0], (n - at) * x
            runs.append(begun)
            sequence += 1
    if begun:
        begun[6] = capacity - fill
        close(begun, 1)
    del rooms[0]
    return [tuple(run) for run in runs]


def run_of(runs: list[tuple[int, ...]]) -> Callable[..., Column]:
    """Sequence, offset, room and rank of the gap for (length, rank) of a piece of ``runs``; sequence -1 for others, room 0 where a piece has no gap."""
    x, first, n, sequence, each, offset, room, gaps = np.array(sorted(runs), np.int64).T
    begin = (x << BITS) + first

    def find(length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        k = np.maximum(np.searchsorted(begin, (length << BITS) + rank, "right") - 1, 0)
        at = rank - first[k]
        own = (x[k] == length) & (at >= 0) & (at < n[k])
        group, place = at // each[k], at % each[k]
        return np.where(own, sequence[k] + group, -1), offset[k] + place * x[k], np.where(place == 0, room[k], 0), gaps[k] + group

    return figures("sequence offset room gap", find)


def opened(pieces: DataFrame, runs: list[tuple[int, ...]]) -> DataFrame:
    """The pieces of ``runs``, with the columns PLACE; a sequence's first piece has its gap."""
    rows = pieces.withColumn("_of", run_of(runs)("length", "_rank")).where("_of.sequence >= 0")
    new = F.col("_of.room") > 0
    gap = [F.when(new, F.col("_of.room")).alias("room"), F.when(new, F.col("_of.gap")).alias("_gap")]
    return rows.select(*PIECE, F.col("_of.sequence").alias("sequence_id"), F.col("_of.offset").alias("offset"), *gap)


def supersteps(counts: dict[int, int], capacity: int) -> Iterator[tuple]:
    """(band, waiting before, sweep or None, runs that open sequences) by counts alone, in their order."""
    rooms: Counter = Counter()
    sequences = 0
    for low, high in bands(capacity):
        waiting = {x: n for x, n in counts.items() if low <= x <= high}
        least = min((x for x in counts if x <= high), default=0)
        while waiting:
            rooms = Counter({r: n for r, n in rooms.items() if r >= least})
            total = sum(waiting.values())
            before, swept = waiting, sweep(waiting, rooms)
            waiting, rooms = {x: u for x, (_, u) in swept[0].items() if u}, Counter(swept[2])
            met = total - sum(waiting.values())
            runs = []
            if waiting and met * LITTLE < total:
                runs = groups(waiting, capacity, sequences, rooms)
                sequences = max(sequences, *(s + -(-n // each) for _, _, n, s, each, *_ in runs))
                waiting = {}
            yield (low, high), before, swept, runs


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = keep(pieces(docs, tokenizer_path, end_id, capacity))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    by_length = ranked(cut, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "_rank", rows=sum(counts.values()))
    cut = keep(by_length.repartitionByRange("length", "_rank").sortWithinPartitions("length", "_rank"))
    nothing = cut.where("false").select(*PIECE, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    gaps, placed = None, [nothing]
    for band, waiting, swept, runs in supersteps(counts, capacity):
        rows = cut.where(F.col("length").between(*band))
        parts = [matched(rows, gaps, waiting, swept, capacity)] if gaps is not None else []
        parts += [opened(rows, runs)] if runs else []
        step = keep(reduce(DataFrame.unionByName, parts))
        placed.append(step.where("length IS NOT NULL").select(*nothing.columns))
        gaps = step.where("room > 0").select("sequence_id", "room", "_gap")
    return reduce(DataFrame.unionByName, placed)
