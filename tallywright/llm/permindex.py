"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of rows. Every row is represented by its ``prefix`` nearest pivots in order, and posted in those
pivots' inverted files with the pivot's place in its order. A query walks the files of its own nearest pivots; what two
orders share in them gives their footrule distance, with a pivot that is missing counted as standing just behind the prefix. The
rows of each block with the smallest footrule, ``share`` of them, are reranked by exact cosine in double precision, and Spark merges the blocks.

share and the block size set the recall; tests measure it against brute force.

Edge cases: see vectors.py; zero vectors take no part; fewer rows than top give all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best_of, blocks, search, usable


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; tiny and huge components neither vanish nor overflow in the squares."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(1, keepdims=True))


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The prefix nearest pivots of each unit vector, nearest first."""
    near = vectors @ pivots.T
    prefix = min(prefix, len(pivots))
    first = np.argpartition(-near, prefix - 1, 1)[:, :prefix]
    return np.take_along_axis(first, np.argsort(-np.take_along_axis(near, first, 1), 1, kind="stable"), 1)


class Files:
    """Inverted files of a block: for each pivot the rows that have it in their prefix, and at which place."""

    def __init__(self, order: np.ndarray, pivots: int):
        n, self.prefix = order.shape
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        cuts = np.searchsorted(flat[by_pivot], np.arange(pivots + 1))
        self.rows = [by_pivot[a:b] // self.prefix for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.places = [(by_pivot[a:b] % self.prefix).astype("i4") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.n = n

    def nearest(self, order: np.ndarray, count: int) -> np.ndarray:
        """The count rows with the smallest footrule distance.

        The footrule is a constant minus twice the sum, over shared pivots, of prefix - max(place in one, place in the other).
        """
        shared = np.zeros(self.n, "i4")
        for place, pivot in enumerate(order.tolist()):
            shared[self.rows[pivot]] += self.prefix - np.maximum(self.places[pivot], place)
        return np.argpartition(-shared, count - 1)[:count] if count < self.n else np.arange(self.n)


def nearest(embeddings: DataFrame, every: int = 50, top: int = 5, pivots: int = 256, prefix: int = 64, share: float = 0.1, least: int = 300, block_rows: int = 8192, query_rows: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score for each row whose vec_id is divisible by every.

    Of each block, share of its rows and least of them at any rate are reranked.
    """
    rows, length = usable(embeddings)
    rows = rows.where(F.exists("vector", lambda v: v != 0))
    chosen = np.array([r["vector"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(pivots).collect()], "f8").reshape(-1, length or 1)
    norm = np.linalg.norm(chosen, axis=1, keepdims=True)
    centres = chosen / np.where(norm > 0, norm, 1)
    plain = lambda vectors: vectors.astype("<f8")
    all_blocks, n = blocks(rows, block_rows, plain)
    queries, _ = blocks(rows.where(F.col("vec_id") % every == 0), query_rows, plain)

    def build(rows: np.ndarray, ids: np.ndarray, vectors: bytes) -> tuple:
        units = unit(np.frombuffer(vectors, "<f8").reshape(-1, length))
        return rows, ids, units, Files(orders(units, centres, prefix), len(centres))

    def find(index: tuple, q_rows: np.ndarray, q_vectors: bytes) -> Iterator:
        c_rows, c_ids, units, files = index
        asked = unit(np.frombuffer(q_vectors, "<f8").reshape(-1, length))
        q_orders = orders(asked, centres, prefix)
        count = min(len(c_rows), max(least, int(np.ceil(share * len(c_rows)))))
        for i in range(len(asked)):
            near = files.nearest(q_orders[i], count)
            near = near[c_rows[near] != q_rows[i]]
            if len(near):
                score = (units[near] * asked[i]).sum(1)  # row by row in one order: equal vectors have equal scores
                best = best_of(c_ids[near], score, top)
                yield i, c_ids[near[best]], score[best]

    return search(queries, all_blocks, n, build, find, "double", top)
