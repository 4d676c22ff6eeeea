"""Near-duplicate documents: fast similarity sketching, banding, exact verification, components.

A document's set holds its distinct shingles of ``WORDS`` words (lower case A-Z, parted by ASCII white space), as 64-bit hashes;
with fewer words the whole sequence is its one shingle. Documents with equal sets are one class, found by a 128-bit
digest, and only classes go on. A sketch has T coordinates filled in rounds: in round i every element draws a coordinate
and a value in [i, i + 1), and a coordinate keeps the smallest value; a document stops after the first round that leaves
no coordinate empty. From round T on all elements draw coordinate i - T, so 2T rounds fill every coordinate of any
set. Long sets need one round, and agreement of sketches is concentrated about the Jaccard similarity as for independent
hashes. Bands give the candidates: 21 of 5 coordinates from a similarity of 0.85 on, 23 of 4 below that; at 0.85 and at 0.8
respectively a pair shares no band once in 200,000.

Edge cases: a null text, or one without words, has an empty set and is linked with nothing; very long texts are one set each;
equal rows share a class, ties go to the smallest doc_id; a null doc_id is a document too, is never the id of a component
that has another, and is kept if its component has none; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import PRIME, mixed, salts, slices_hash
from .linking import COMMON, link
from .shared import KEY, identity, joined, keep, sheltered, ship, tidied, with_key, written

WORDS = 5
ROWS, BANDS = 5, 21
T = ROWS * BANDS
#: Coordinates a band, and bands, where less than 85 percent is asked: a pair at 80 is missed as rarely as one at 85 otherwise.
WIDE = 4, 23
#: Bytes of text that are worked on together.
CHUNK = 1 << 20
EMPTY = np.uint64(2**64 - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending: all of them, and the bounds of each text's.

    data: UTF-8 bytes of texts one after another; offsets: where each begins, and the end.
    """
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], word[:-1])) & ~first[:-1]
    after = np.concatenate((word[1:], [False])) & ~first[1:]
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    words = slices_hash(low, start, end)
    cuts = np.searchsorted(start, offsets)
    n_words = np.diff(cuts)
    made = np.maximum(n_words - WORDS + 1, np.minimum(n_words, 1))
    bounds = np.concatenate(([0], np.cumsum(made)))
    text = np.repeat(np.arange(len(made)), made)
    at = cuts[text] + np.arange(len(text)) - bounds[text]
    size = np.minimum(n_words, WORDS)[text].astype("u8")
    h = size * PRIME
    padded = np.concatenate((words, np.zeros(WORDS, "u8")))
    for k in range(WORDS):
        h = mixed(h ^ np.where(k < size, padded[at + k], np.uint64(0))) * PRIME + np.uint64(k)
    h = mixed(h)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[bounds[:-1][made > 0]] = True
    kept = np.concatenate(([0], np.cumsum(new)))
    return h[new], kept[bounds]


SALTS = salts(2 * T)
BAND_SALTS = salts(max(BANDS, WIDE[1]) + 7)[7:]


def shape(percent: int) -> tuple[int, int]:
    """Coordinates a band, and bands."""
    return (ROWS, BANDS) if percent >= 85 else WIDE


def sketches(elements: np.ndarray, bounds: np.ndarray, t: int = T) -> np.ndarray:
    """t coordinates for each set, T at most; all EMPTY for an empty one."""
    sizes = np.diff(bounds)
    n = len(sizes)
    out = np.full(n * t, EMPTY, "u8")
    owner = np.repeat(np.arange(n), sizes)
    for i in range(2 * t):
        v = mixed(elements ^ SALTS[i])
        value = (np.uint64(i) << np.uint64(32)) | (v & np.uint64(0xFFFFFFFF))
        column = ((v >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype("i8") if i < t else i - t
        np.minimum.at(out, owner * t + column, value)
        open_sets = (out.reshape(n, t) == EMPTY).any(1)
        going = open_sets[owner]
        if not going.any():
            break
        if not going.all():
            elements, owner = elements[going], owner[going]
    return out.reshape(n, t)


def bands(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n = sketch.shape[1] // rows
    h = np.zeros((len(sketch), n), "u8") + BAND_SALTS[:n]
    parts = sketch.reshape(len(sketch), n, rows)
    for k in range(rows):
        h = mixed(h ^ parts[:, :, k]) * PRIME
    return mixed(h).view("i8")


def text_chunks(batch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes and offsets of chunks of a batch's column ``text`` (string or large string)."""
    import pyarrow as pa

    column = batch.column("text").fill_null("")
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, "i8")[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, "u1") if data is not None else np.zeros(0, "u1")
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def sketch_rows(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, t1 and t2 (two hashes of the text), n_shingles, digest (null for an empty set), bands."""
    ship(docs.sparkSession)
    size, number = shape(percent)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for a, b, data, offsets in text_chunks(batch):
                elements, bounds = shingle_sets(data, offsets)
                n = np.diff(bounds)
                keys = bands(sketches(elements, bounds, size * number), size)
                raw = elements.astype("<u8").tobytes()
                digest = [hashlib.blake2b(raw[8 * x : 8 * y], digest_size=16).digest() if y > x else None for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * number + 1, number, dtype="i4")), pa.array(keys.ravel()))
                same = [batch.column(c).slice(a, b - a) for c in ("doc_id", "t1", "t2")]
                columns = [*same, pa.array(n.astype("i8")), pa.array(digest, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t1", "t2", "n_shingles", "digest", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *identity(F.col("text"), "t"), "text")
    return rows.mapInArrow(tidied(run), "doc_id long, t1 long, t2 long, n_shingles long, digest binary, bands array<long>")


def set_rows(docs: DataFrame) -> DataFrame:
    """digest, set (ascending little-endian 64-bit hashes) of each row of docs with shingles."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for _, _, data, offsets in text_chunks(batch):
                elements, bounds = shingle_sets(data, offsets)
                raw = elements.astype("<u8").tobytes()
                sets = [raw[8 * x : 8 * y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if y > x]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["digest", "set"])

    return docs.select("text").mapInArrow(tidied(run), "digest binary, set binary")


def similar(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets set_a and set_b have 100 * intersection >= percent * union."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            good = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if len(u) > len(v):
                    u, v = v, u
                at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                both = int((v[at] == u).sum())
                good.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], names=["a", "b"])

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(tidied(run), "a long, b long")


#: Slots of the table of frequencies that orders elements: a fixed size, whatever the corpus.
SLOTS = 1 << 20


def frequencies(sets: DataFrame) -> np.ndarray:
    """How many sets have an element of each slot."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(SLOTS, "i8")
        for batch in batches:
            for x in batch.column("set"):
                np.add.at(total, (np.frombuffer(x.as_buffer(), "<u8") % np.uint64(SLOTS)).astype("i8"), 1)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(total[slot], pa.int64())], names=["slot", "n"])

    rows = sets.select("set").mapInArrow(tidied(count), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros(SLOTS, "i4")
    for r in rows.toArrow().to_batches():
        out[r.column(0).to_numpy()] = np.minimum(r.column(1).to_numpy(), 2**31 - 1)
    return out


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """key, node, size, place: each set's first elements in the order of (frequency of the slot, element)."""
    spark = sets.sparkSession
    known = spark.sparkContext.broadcast(frequencies(sets))  # SLOTS numbers

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        frequency = known.value
        for batch in batches:
            keys, nodes, sizes, places = [], [], [], []
            for node, x in zip(batch.column("node").to_pylist(), batch.column("set"), strict=True):
                e = np.frombuffer(x.as_buffer(), "<u8")
                n = len(e)
                k = min(n, n - -(-percent * n // 100) + COMMON)
                first = np.lexsort((e, frequency[(e % np.uint64(SLOTS)).astype("i8")]))[:k]
                keys.append(e[first].view("i8"))
                nodes.append(np.full(k, node))
                sizes.append(np.full(k, n))
                places.append(np.arange(k))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype("i8")) for c in (keys, nodes, sizes, places)], names=["key", "node", "size", "place"])

    return sets.select("node", "set").mapInArrow(tidied(run), "key long, node long, size long, place long")


def grouped(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, t1, t2, n_shingles, root (a number of the component; null for an empty set), component_id."""
    rows = written(sketch_rows(docs, percent).withColumn("row", F.monotonically_increasing_id()), "sketches")
    classes = keep(
        rows.where(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(
            F.min("row").alias("node"),
            F.min("doc_id").alias("least"),
            F.min_by(F.struct("doc_id", "t1", "t2"), "row").alias("one"),
            F.first("n_shingles").alias("size"),
            F.first("bands").alias("bands"),
        )
    )
    members = classes.select("node", F.explode("bands").alias("key"))

    def load(nodes: DataFrame) -> DataFrame:
        """Sets are made again, from the whole texts of the documents that may have links."""
        ones = keep(nodes.join(classes.select("node", "one", "digest"), "node"))
        wanted = ones.select(F.col("one.doc_id").alias("__doc"), F.col("one.t1").alias("__t1"), F.col("one.t2").alias("__t2"))
        named = joined(with_key(docs.select("doc_id", "text")), wanted, "left_semi")
        made = set_rows(named).join(ones.select("node", "digest"), "digest").dropDuplicates(["node"])
        return written(made.select("node", "set", F.expr("octet_length(set) div 8").alias("size")), "sets")

    def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        sizes = sets.select("node", "size")
        of_a = sizes.select(F.col("node").alias("a"), F.col("size").alias("s"))
        of_b = sizes.select(F.col("node").alias("b"), F.col("size").alias("t"))
        near = F.least("s", "t") * 100 >= F.greatest("s", "t") * percent
        able = pairs.join(of_a, "a").join(of_b, "b").where(near).select("a", "b")
        with_a = able.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
        return similar(with_a.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b"), percent)

    linked = link(members, load, verify, lambda sets: prefixes(sets, percent), percent)
    labelled = classes.select("digest", "node", "least").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = keep(labelled.join(smallest, "root").select(F.col("digest").alias("_digest"), "root", "component_id"))
    out = rows.select("doc_id", "t1", "t2", "n_shingles", "digest").join(of_class, F.col("digest") == F.col("_digest"), "left")
    return out.select("doc_id", "t1", "t2", "n_shingles", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return grouped(docs, percent).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of docs for each component, that of the smallest doc_id (nulls last, ties by the text's hash); all rows with an empty set."""
    rows = keep(grouped(docs, percent).where("root is not null").select("root", "doc_id", "t1", "t2"))
    at = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t1", "t2")
    first = rows.groupBy("root").agg(F.min(at).alias("first"))
    judged = rows.join(first, "root").withColumn("stays", at == F.col("first"))
    by_key = judged.groupBy("doc_id", "t1", "t2").agg(F.min("stays").alias("stays"), F.count("*").alias("n"))
    changed = keep(by_key.where("not stays or n > 1").withColumnsRenamed({"doc_id": "__doc", "t1": "__t1", "t2": "__t2"}))
    own, names = sheltered(docs, "doc_id", "text")
    keyed = with_key(own)
    out = joined(keyed, changed, "left_anti")
    copies = changed.where("stays").drop("stays", "n")
    if not copies.isEmpty():
        out = out.unionByName(joined(keyed, copies, "inner").dropDuplicates(KEY))
    return out.drop(*KEY).withColumnsRenamed(names).select(*[F.col(f"`{c}`") for c in docs.columns])
