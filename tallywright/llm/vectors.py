"""Vectors in blocks: a stated query set against all rows, each pair of blocks one row of work.

Edge cases shared by the searches: rows whose vec_id is null, whose vector is null, empty or holds null or non-finite components, or
whose vector's length isn't the most frequent one (the longer on a tie) take no part; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep, ship

BLOCK_TYPE = "block int, rows binary, ids binary, vectors binary"


def usable(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """row (a number of its own for each row), vec_id, vector (doubles); and the vectors' length."""
    ship(embeddings.sparkSession)
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & fine)
    rows = keep(rows.withColumn("row", F.monotonically_increasing_id()))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    length = lengths[0]["n"] if lengths else 0
    return rows.where(F.size("vector") == length), length


def blocks(rows: DataFrame, size: int, shape: Callable[[np.ndarray], np.ndarray]) -> tuple[DataFrame, int]:
    """Rows dealt evenly into blocks of about size rows; shape turns a matrix of doubles into what is kept of it. Returns the number of blocks too."""
    number = max(1, -(-rows.count() // size))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        parts = [b for b in batches if len(b)]
        if parts:
            b = pd.concat(parts)
            made = shape(np.array(b["vector"].tolist(), "f8"))
            yield pd.DataFrame({"block": [TaskContext.get().partitionId()], "rows": [b["row"].to_numpy("i8").tobytes()], "ids": [b["vec_id"].to_numpy("i8").tobytes()], "vectors": [made.tobytes()]})

    return keep(rows.repartition(number).mapInPandas(pack, BLOCK_TYPE)), number


def search(queries: DataFrame, candidates: DataFrame, n_candidates: int, build: Callable, find: Callable, score_type: str, top: int) -> DataFrame:
    """query_id, rank, vec_id, score: the top of all candidates for each query row.

    build(candidate rows, ids, vectors) makes a block's index; find(index, query rows, query vectors) yields (number of the
    query, ids, scores), its best ones of that block. Each query block meets each candidate block once, by an equality join
    on the candidate block's number. The join sorts by it, so a task builds the index of a block once and all query blocks
    stream through it; it holds one index at a time.
    """
    q = queries.select(F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1))).alias("block"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built, index = None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.block != built:
                    built, index = r.block, build(np.frombuffer(r.rows, "i8"), np.frombuffer(r.ids, "i8"), r.vectors)
                q_rows, q_ids = np.frombuffer(r.q_rows, "i8"), np.frombuffer(r.q_ids, "i8")
                parts = list(find(index, q_rows, r.q_vectors))
                if parts:
                    n = [len(ids) for _, ids, _ in parts]
                    at = np.repeat([i for i, _, _ in parts], n)
                    yield pd.DataFrame({"q_row": q_rows[at], "query_id": q_ids[at], "vec_id": np.concatenate([i for _, i, _ in parts]), "score": np.concatenate([s for _, _, s in parts])})

    best = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    found = q.join(candidates.hint("merge"), "block").mapInPandas(run, f"q_row long, query_id long, vec_id long, score {score_type}")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def best_of(ids: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """Places of the top scores, ties to smaller ids."""
    if len(scores) > top:
        least = np.partition(scores, len(scores) - top)[len(scores) - top]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:top]
