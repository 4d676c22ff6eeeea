"""Token files: independent zstandard frames, a document index, and a trailing seek table with a checksum per frame.

File layout, all little-endian:

* data frames, each an ordinary zstandard frame of whole consecutive documents: uint32 number of documents, then per
  document int64 doc_id, uint8 1 if the doc_id is not null, uint32 number of ids; then the ids, 2 or 4 bytes each;
* a skippable frame (magic 0x184D2A50) with the index: uint8 bytes per id, then per data frame int64 first doc_id, uint32
  documents, uint64 ids;
* a skippable frame (magic 0x184D2A5E) with the seek table of the public seekable format: per data frame uint32
  compressed size, uint32 raw size, uint32 low half of the raw bytes' xxh64; then uint32 number of frames, uint8
  descriptor (0x80: with checksums), magic 0x8F92EAB1.

A reader takes the table and the index from the end of the file and decompresses only the frames that can hold the
documents asked for. Documents ascend by doc_id within a file and from file to file; nulls come first.

Edge cases: a null or empty text has just the end id; equal doc_ids are all written, in the order of their texts; an empty
table gives no files; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import keep, shared_dir, ship
from .sharding import part_of, sized, splitters
from .tokens import encoder

INDEX_MAGIC, SEEK_MAGIC, END_MAGIC, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
DOC = np.dtype([("doc_id", "<i8"), ("valid", "u1"), ("n", "<u4")])
ENTRY = np.dtype([("packed", "<u4"), ("raw", "<u4"), ("sum", "<u4")])
INDEX = np.dtype([("first", "<i8"), ("docs", "<u4"), ("ids", "<u8")])
FOOTER = struct.Struct("<IBI")


def _checksum(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class Writer:
    """Writes one file; put() takes documents in ascending order."""

    def __init__(self, out, width: int, frame_bytes: int, level: int = 3):
        import zstandard

        self.out, self.width, self.most = out, width, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.entries, self.index, self.docs, self.ids, self.size = [], [], [], [], 0

    def put(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, len(ids)))
        self.ids.append(ids.astype(f"<u{self.width}").tobytes())
        self.size += len(self.ids[-1])
        if self.size >= self.most:
            self.flush()

    def flush(self) -> None:
        if not self.docs:
            return
        docs = np.array(self.docs, DOC)
        raw = struct.pack("<I", len(docs)) + docs.tobytes() + b"".join(self.ids)
        packed = self.pack(raw)
        self.out.write(packed)
        self.entries.append((len(packed), len(raw), _checksum(raw)))
        self.index.append((docs["doc_id"][0], len(docs), int(docs["n"].sum(dtype="u8"))))
        self.docs, self.ids, self.size = [], [], 0

    def close(self) -> tuple[int, int]:
        """Numbers of documents and of ids."""
        self.flush()
        index, entries = np.array(self.index, INDEX), np.array(self.entries, ENTRY)
        body = bytes([self.width]) + index.tobytes()
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        body = entries.tobytes() + FOOTER.pack(len(entries), WITH_CHECKSUMS, END_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(body)) + body)
        return int(index["docs"].sum()), int(index["ids"].sum())


def read_file(source, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids of the file before it, ids) of all documents, or of those wanted; other frames are never read."""
    import zstandard

    unpack, end = zstandard.ZstdDecompressor().decompress, source.size()

    def part(at: int, n: int) -> bytes:
        source.seek(at)
        return source.read(n)

    frames, descriptor, magic = FOOTER.unpack(part(end - FOOTER.size, FOOTER.size))
    if magic != END_MAGIC or descriptor != WITH_CHECKSUMS:
        raise ValueError("not a token file")
    at = end - FOOTER.size - frames * ENTRY.itemsize
    entries = np.frombuffer(part(at, frames * ENTRY.itemsize), ENTRY)
    size = frames * INDEX.itemsize
    index_raw = part(at - 8 - size - 1, size + 1)
    width, index = index_raw[0], np.frombuffer(index_raw, INDEX, offset=1)
    places = np.concatenate(([0], np.cumsum(entries["packed"], dtype="i8")))
    starts = np.concatenate(([0], np.cumsum(index["ids"], dtype="i8")))
    chosen = range(frames)
    if wanted is not None and frames:
        w = np.array(sorted(wanted), "i8")
        last = np.searchsorted(index["first"], w, "right") - 1
        first = np.maximum(np.searchsorted(index["first"], w, "left") - 1, 0)  # equal doc_ids may begin in the frame before
        chosen = sorted({f for a, b in zip(first, last, strict=True) for f in range(a, b + 1)})
    for f in chosen:
        raw = unpack(part(int(places[f]), int(entries["packed"][f])), max_output_size=int(entries["raw"][f]))
        if _checksum(raw) != entries["sum"][f]:
            raise ValueError(f"frame {f} is damaged")
        (n,) = struct.unpack_from("<I", raw)
        docs = np.frombuffer(raw, DOC, n, 4)
        ids = np.frombuffer(raw, f"<u{width}", offset=4 + n * DOC.itemsize)
        to = np.cumsum(docs["n"], dtype="i8")
        for (doc_id, valid, k), b in zip(docs.tolist(), to.tolist(), strict=True):
            if wanted is None or (valid and doc_id in wanted):
                yield doc_id if valid else None, int(starts[f]) + b - k, ids[b - k : b]


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None, file_bytes: int = 64 << 20, frame_bytes: int = 32 << 10, most_files: int = 4096) -> list[tuple[str, int, int]]:
    """Writes docs as files below folder; returns (path, documents, ids) of each file, in ascending order of doc_ids.

    Files are cut by exact bytes of text, one task writes each, and a file appears under its name only once it is whole,
    so a task that runs again writes the same file again. The list has at most most_files entries.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    rows = keep(sized(docs).select("doc_id", "size"))
    total, low = rows.agg(F.sum("size"), F.min("doc_id")).first()
    if total is None:
        return []
    files = min(most_files, max(spark.sparkContext.defaultParallelism, -(-total // file_bytes)))
    low = F.lit(low if low is not None else 0).cast("long")
    cuts = splitters(rows, F.coalesce("doc_id", low), F.col("size"), files, 0.05)
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_file", part_of(F.coalesce("doc_id", low), cuts))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        fs, top = FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        fs.create_dir(top, recursive=True)
        encode, open_file, done = encoder(tokenizer_path).encode_all, None, []
        width = 2 if encoder(tokenizer_path).vocabulary <= 1 << 16 else 4
        end = np.array([end_id], "<u4")

        def finish() -> None:
            number, stream, writer, temporary = open_file
            n_docs, n_ids = writer.close()
            stream.close()
            path = f"{top}/part-{number:05d}.ztok"
            fs.move(temporary, path)
            done.append((number, path, n_docs, n_ids))

        for batch in batches:
            for number, doc_id, ids in zip(batch["_file"], batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None), encode(batch["text"]), strict=True):
                if open_file is None or open_file[0] != number:
                    if open_file:
                        finish()
                    temporary = f"{top}/.{number:05d}-{uuid.uuid4().hex}"
                    stream = fs.open_output_stream(temporary)
                    open_file = (number, stream, Writer(stream, width, frame_bytes), temporary)
                open_file[2].put(None if doc_id is None else int(doc_id), np.concatenate((np.frombuffer(ids, "<u4"), end)))
        if open_file:
            finish()
        yield pd.DataFrame(done, columns=["number", "path", "docs", "ids"])

    made = placed.repartitionById(files, "_file").sortWithinPartitions("_file", F.col("doc_id").asc_nulls_first(), "text").mapInPandas(write, "number int, path string, docs long, ids long")
    return [(r["path"], r["docs"], r["ids"]) for r in sorted(made.collect(), key=lambda r: r["number"])]


def read_token_files(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32; one task for each file."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    base, listed = 0, []
    for i, (path, _, ids) in enumerate(files):
        listed.append((i, path, base))
        base += ids
    at = shared_dir(spark)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(at if "://" in at else f"file://{at}")
        for batch in batches:
            for path, before in zip(batch["path"], batch["before"], strict=True):
                with fs.open_input_file(path) as source:
                    out = [(doc_id, before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc_id, start, ids in read_file(source)]
                frame = pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield frame.astype({"doc_id": "Int64"})

    rows = spark.createDataFrame(listed, "number int, path string, before long")
    return rows.repartitionById(max(1, len(listed)), "number").mapInPandas(read, schema)
