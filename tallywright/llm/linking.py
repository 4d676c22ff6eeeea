"""From buckets of candidates to components, without all pairs of a bucket and without losing a link.

1. The members of a bucket are put in the order of their sizes and parted where a size is too far above the one before it for
   any link across. In each such group every member is verified against ``PIVOTS`` pivots: the members whose buckets are the fullest,
   which of a group of copies are nearest to the others. A hot bucket is dealt into groups of about ``MOST`` members
   instead, and its pivots are verified against one of them. The links found are joined to components.
2. Members of one component need no more comparing. For the members not yet compared with each other (other than pivots) of
   groups that still hold several components the exact prefix filter takes over: all elements are put in one order, rare ones
   first, and two sets as similar as asked share ``COMMON`` elements (or all they must share, if that is fewer) among the first of
   both, at places that leave enough elements for the overlap they need. Only pairs that meet so, in different
   components, are verified.

A pair that banding has made a candidate is thus verified, already joined, or proved not to be similar; and a bucket of n copies costs n
comparisons, not n * n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import keep

#: Members of a bucket from which on it is hot.
MOST = 100_000
PIVOTS = 8
#: Elements that the prefixes of two linked sets have in common.
COMMON = 4


def overlap(a: str, b: str, percent: int) -> Column:
    """The least intersection of sets of sizes a and b at that similarity."""
    return F.ceil(percent * (F.col(a) + F.col(b)) / (100 + percent))


def prefix_size(size: Column, percent: int) -> Column:
    """So many first elements of a set hold COMMON of those it shares with any set that similar, or all."""
    return size - F.ceil(percent * size / 100) + COMMON


def groups(members: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """key, group, n, node, hot: groups within buckets of n members (key, node, n)."""
    sized = members.join(sizes, "node").withColumn("hot", F.col("n") > MOST)
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / MOST))
    ascending = Window.partitionBy("key", "part").orderBy("size", "node")
    apart = F.lag("size").over(ascending) * 100 < F.col("size") * percent
    marked = sized.withColumn("part", part).withColumn("gap", F.when(~F.col("hot") & apart, 1).otherwise(0))
    group = F.when(F.col("hot"), F.col("part")).otherwise(F.sum("gap").over(ascending))
    return marked.select("key", group.alias("group"), "n", "node", "hot")


def link(
    members: DataFrame,
    load: Callable[[DataFrame], DataFrame],
    verify: Callable[[DataFrame, DataFrame], DataFrame],
    prefix: Callable[[DataFrame], DataFrame],
    percent: int,
) -> DataFrame:
    """node, root of all nodes that have a link.

    members: key, node; load(nodes) gives their sets and the sets' sizes; verify(pairs, sets) keeps the pairs (a, b) that are linked;
    prefix(sets) gives key, node, size, place of the first elements of each set in one order of all elements.
    """
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keep(members.select("key", "node").join(shared, "key"))
    sets = load(shared.select("node").distinct())
    inside = keep(groups(shared, sets.select("node", "size"), percent))
    weight = inside.groupBy("node").agg(F.sum("n").alias("w"))
    fullest = Window.partitionBy("key", "group").orderBy(F.desc("w"), F.desc("node"))
    rows = keep(inside.join(weight, "node").select("key", "group", "node", "hot", F.row_number().over(fullest).alias("rank")))
    pivots = rows.where(F.col("rank") <= PIVOTS).select("key", "group", F.col("node").alias("pivot"), F.col("rank").alias("of"), "hot")
    within = rows.join(pivots.drop("hot"), ["key", "group"]).where("rank > of").select("node", "pivot")
    hot = pivots.where("hot and of = 1")
    among = hot.join(hot.groupBy("key").agg(F.max("pivot").alias("top")), "key").select(F.col("pivot").alias("node"), F.col("top").alias("pivot"))
    compared = within.unionByName(among.where("node <> pivot"))
    tested = keep(compared.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct())
    linked = keep(verify(tested, sets))
    found = keep(components(linked))

    # all members have been compared with their group's pivots: what is open is among the others, and across a hot bucket
    others = rows.where(F.col("hot") | (F.col("rank") > PIVOTS)).withColumn("group", F.when(F.col("hot"), -1).otherwise(F.col("group")))
    others = others.select("key", "group", "node").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = others.groupBy("key", "group").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    open_nodes = others.join(several.select("key", "group"), ["key", "group"], "left_semi")
    open_nodes = keep(open_nodes.select("node", "root").distinct())
    if open_nodes.isEmpty():
        return found
    first = keep(prefix(sets.join(open_nodes.select("node"), "node", "left_semi")).join(open_nodes, "node"))
    counted = first.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = counted.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"))
    met = keep(first.join(main.where("roots > 1").select("key", "main"), "key"))
    # of each element: those outside its largest component against all others that have it
    outside = met.where("root <> main").select("key", *[F.col(c).alias(f"x_{c}") for c in ("node", "size", "place", "root")])
    needed = overlap("x_size", "size", percent)
    enough = F.least(F.col("x_size") - F.col("x_place"), F.col("size") - F.col("place")) > needed - COMMON
    across = (
        outside.join(met, "key")
        .where((F.col("x_root") != F.col("root")) & ((F.col("root") == F.col("main")) | (F.col("x_node") < F.col("node"))) & enough)
        .groupBy(F.greatest("x_node", "node").alias("a"), F.least("x_node", "node").alias("b"))
        .agg(F.count("*").alias("common"), F.min(needed).alias("needed"))
        .where(F.col("common") >= F.least("needed", F.lit(COMMON)))
        .select("a", "b")
        .join(tested, ["a", "b"], "left_anti")
    )
    more = keep(verify(keep(across), sets))
    if more.isEmpty():
        return found
    return keep(components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))
