"""Exact top-k search by MaxScore.

A vector's components become whole numbers; each dimension is two terms, one for its positive and one for its negative
weights, and a block of rows is a shard with one posting column a term. A query's terms with positive contributions are
sorted by their bound in the shard (query weight times the largest posting weight). While a query runs it knows a score that ``top``
rows of the shard reach. Terms whose bounds together, from the smallest up, stay below it are non-essential: a row found
in none of the other, essential terms cannot compete. Essential postings are traversed; the others are probed only for
rows whose score so far plus the bounds left still reaches the threshold. Shards' results are merged by Spark.

Edge cases: see vectors.py; fewer rows than top give all; an empty table gives no rows. Weights are 64-bit; where a score might
not fit 64 bits the search fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best_of, blocks, search, usable


class Shard:
    """Postings by term, impact bounds, and rows in posting order."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, weights: np.ndarray):
        self.rows, self.ids, self.weights = rows, ids, weights
        self.columns = np.ascontiguousarray(weights.T)
        self.high, self.low = weights.max(0).astype("i8"), weights.min(0).astype("i8")
        # the rows of the greatest impact of each term, from which a query's first threshold comes
        n = min(len(rows), 48)
        order = np.argpartition(self.columns, (n - 1, len(rows) - n), 1) if n < len(rows) else np.tile(np.arange(len(rows)), (weights.shape[1], 1))
        self.least, self.most = order[:, :n], order[:, -n:]

    def top(self, own: int, query: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the best rows but row own."""
        q = query.astype("i8")
        bound = np.maximum(q * np.where(q > 0, self.high, self.low), 0)
        terms = np.argsort(-bound, kind="stable")
        left = np.concatenate((np.cumsum(bound[terms][::-1])[::-1], [0]))
        seeds = np.unique(np.concatenate([(self.most if q[d] > 0 else self.least)[d] for d in terms[:4]]))
        seeds = seeds[self.rows[seeds] != own]
        threshold = -(2**62)
        if len(seeds) >= top:
            scores = self.weights[seeds].astype("i8") @ q
            threshold = np.partition(scores, len(scores) - top)[len(scores) - top]
        live, score = None, np.zeros(len(self.rows), "i8")
        for i, d in enumerate(terms.tolist()):
            if q[d] == 0:
                continue
            if live is None:
                # essential: rows not met yet may still reach the threshold through this term
                score += q[d] * self.columns[d]
                if i % 6 == 5 or left[i + 1] < threshold:
                    able = score + left[i + 1] >= threshold
                    if left[i + 1] < threshold or np.count_nonzero(able) * 3 < len(able):
                        live = np.flatnonzero(able)
                        score = score[live]
            else:
                score += q[d] * self.columns[d][live]
                if i % 4 == 3:
                    able = score + left[i + 1] >= threshold
                    live, score = live[able], score[able]
        if live is None:
            live = np.arange(len(self.rows))
        other = self.rows[live] != own
        live, score = live[other], score[other]
        best = best_of(self.ids[live], score, top)
        return self.ids[live[best]], score[best]


def whole_numbers(scale: float):
    def made(vectors: np.ndarray) -> np.ndarray:
        weights = np.floor(scale * vectors)
        if weights.size and weights.shape[1] * float(np.abs(weights).max()) ** 2 >= 2**63:
            raise ValueError("scores of such large components don't fit 64 bits")
        return weights.astype("<i8")

    return made


def search_top(embeddings: DataFrame, every: int = 20, top: int = 20, scale: float = 64.0, shard_rows: int = 8192, query_rows: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score for each row whose vec_id is divisible by every."""
    rows, length = usable(embeddings)
    shards, n = blocks(rows, shard_rows, whole_numbers(scale))
    queries, _ = blocks(rows.where(F.col("vec_id") % every == 0), query_rows, whole_numbers(scale))

    def build(rows: np.ndarray, ids: np.ndarray, weights: bytes) -> Shard:
        return Shard(rows, ids, np.frombuffer(weights, "<i8").reshape(-1, length))

    def find(shard: Shard, q_rows: np.ndarray, q_weights: bytes) -> Iterator:
        for i, query in enumerate(np.frombuffer(q_weights, "<i8").reshape(-1, length)):
            yield (i, *shard.top(q_rows[i], query, top))

    return search(queries, shards, n, build, find, "long", top)
