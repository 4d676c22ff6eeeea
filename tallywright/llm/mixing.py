"""Mixing sources to target weights by entropy balancing.

Each document gets a rate between 0 and ``most_copies``: the rates closest to one (in relative entropy) whose words add up to
the target of each source. The optimum has the form rate = min(most_copies, exp(lambda * size / mean size)), and lambda, one for
each source, solves the convex dual. Newton steps, kept inside a bracket, find all lambdas at once: one distributed
aggregate an iteration over the counts of documents by (source, size) gives every source's gradient and curvature.

Rates become copies without chance. Classes of equal (source, size) are taken by falling size; each gets the whole copies
that bring the words taken so far nearest to the words due so far, so what long documents miss short ones make up for.
Inside a class copies are dealt by rank. Reruns agree.

Edge cases: a null text has size 0; the null source is the last one; sources whose sizes are all 0 get target 0, and their
documents one copy each; equal rows are rounded each for itself; an empty table gives no rows; columns with the names of
results are replaced.

The number of sources is configuration-sized: one row each on the driver, ``most_sources`` at most, else an error.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import keep, ranked, sheltered, ship

WORD = r"[^\x20\x09-\x0D]+"
RESULTS = ("size", "source_size", "target", "rate", "copies")


def targets(sizes: list[int], weights: Sequence[float], most_copies: float) -> list[float]:
    """Shares of the sum of sizes by weight, stopping at most_copies times each size, the excess reshared by weight."""
    total, capped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(most_copies * sizes[i] for i in capped)
        all_weight = sum(weights[i] for i in free)
        above = {i for i in free if left * weights[i] / all_weight > most_copies * sizes[i]}
        if not above:
            return [float(most_copies * sizes[i]) if i in capped else left * weights[i] / all_weight for i in range(len(sizes))]
        capped |= above
        if len(capped) == len(sizes):
            return [float(most_copies * s) for s in sizes]


def with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.expr(f"regexp_count(text, r'{WORD}')"), F.lit(0)).cast("long"))


def lambdas(counts: DataFrame, aims: list[tuple[str | None, int, int, float]], most_copies: float, tolerance: float = 1e-7, most_steps: int = 80) -> list[float | None]:
    """The dual's optimum for each of aims (source, size, documents, target); null where every rate is at its bound or no words count."""
    spark = counts.sparkSession
    mean = [s / n if n else 0.0 for _, s, n, _ in aims]
    at, low, high = [0.0] * len(aims), [-math.inf] * len(aims), [math.inf] * len(aims)
    solved: list[float | None] = [None] * len(aims)
    open_ones = [i for i, (_, s, _, t) in enumerate(aims) if s and t < most_copies * s * (1 - 1e-12)]
    for _ in range(most_steps):
        if not open_ones:
            break
        state = spark.createDataFrame([(aims[i][0], i, at[i], mean[i]) for i in open_ones], "_source string, _i int, _lambda double, _mean double")
        x = F.col("size") / F.col("_mean")
        rate = F.least(F.exp(F.least(F.col("_lambda") * x, F.lit(50.0))), F.lit(float(most_copies)))
        words = F.col("n") * F.col("size") * rate
        sums = (
            counts.join(F.broadcast(state), F.col("source").eqNullSafe(F.col("_source")))  # one row a source
            .groupBy("_i")
            .agg(F.sum(words).alias("g"), F.sum(F.when(rate < most_copies, words * x).otherwise(0.0)).alias("h"))
        )
        for i, g, h in sums.collect():
            off = g - aims[i][3]
            if abs(off) <= max(0.25, tolerance * aims[i][3]):
                solved[i] = at[i]
                continue
            low[i], high[i] = (low[i], at[i]) if off > 0 else (at[i], high[i])
            step = at[i] - off / h if h > 0 else math.nan
            if not low[i] < step < high[i]:
                a, b = low[i], high[i]
                step = a + max(1.0, abs(a)) if math.isinf(b) else b - max(1.0, abs(b)) if math.isinf(a) else (a + b) / 2
            at[i] = step
            if step in (low[i], high[i]):
                solved[i] = step
        open_ones = [i for i in open_ones if solved[i] is None]
    if open_ones:
        raise RuntimeError(f"rates of {len(open_ones)} sources did not settle in {most_steps} steps")
    return solved


def whole_copies(one: pd.DataFrame, most_copies: int) -> pd.DataFrame:
    """Adds _whole to the classes of one source: as many rows as it has different sizes."""
    one = one.sort_values("size", ascending=False)
    due, taken, out = 0.0, 0, []
    for size, n, rate in zip(one["size"].tolist(), one["n"].tolist(), one["rate"].tolist(), strict=True):
        due += n * size * rate
        whole = min(max(round((due - taken) / size) if size else round(n * rate), 0), most_copies * n)
        taken += whole * size
        out.append(whole)
    return one.assign(_whole=out)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most_copies: int = 3, most_sources: int = 1_000_000) -> DataFrame:
    """All columns of docs (doc_id, text or size, source needed), and size, source_size, target, rate, copies."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs if "size" in docs.columns and "text" not in docs.columns else with_size(docs.drop(*RESULTS))
    counts = keep(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    per_source = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s"), F.sum("n").alias("n"))
    found = sorted(((r["source"], r["s"], r["n"]) for r in per_source.limit(most_sources + 1).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    if len(found) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    goals = targets([s for _, s, _ in found], [weights[i % len(weights)] for i in range(len(found))], most_copies) if found else []
    aims = [(*f, t) for f, t in zip(found, goals, strict=True)]
    solved = lambdas(counts, aims, most_copies)
    params = spark.createDataFrame(
        [(i, name, s, float(t), s / n if s else 1.0, v) for i, ((name, s, n, t), v) in enumerate(zip(aims, solved, strict=True))], "_i int, _source string, source_size long, target double, _mean double, _lambda double"
    )
    bound = F.when(F.col("source_size") > 0, float(most_copies)).otherwise(1.0)
    rate = F.when(F.col("_lambda").isNull(), bound).otherwise(F.least(F.exp(F.least(F.col("_lambda") * F.col("size") / F.col("_mean"), F.lit(50.0))), F.lit(float(most_copies))))
    rated = counts.join(F.broadcast(params), F.col("source").eqNullSafe(F.col("_source"))).select("_i", "source", "size", "n", rate.alias("rate"), "source_size", "target")
    classes = rated.groupBy("_i").applyInPandas(lambda one: whole_copies(one, most_copies), StructType([*rated.schema.fields, StructField("_whole", LongType())])).drop("_i")
    order = [c for c in ("doc_id", "text") if c in rows.columns]
    total = sum(n for _, _, n in found)
    dealt = ranked(rows, ["source", "size"], order, "_rank", rows=total, attach=classes.withColumnRenamed("n", "_docs"))
    up_to = "cast({} as decimal(19, 0)) * cast(_whole as decimal(19, 0)) div _docs"  # exact, and too large for a long before the division
    copies = F.expr(up_to.format("_rank + 1")) - F.expr(up_to.format("_rank"))
    return dealt.withColumn("copies", copies.cast("int")).drop("_rank", "_whole", "_docs")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The columns of docs, each row as often as its copies say."""
    own, names = sheltered(docs, "doc_id", "text", "source")
    mixed = mix(own, **options)
    out = mixed.where(F.col("copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.drop("_copy", *RESULTS).withColumnsRenamed(names).select(*[F.col(f"`{c}`") for c in docs.columns])
