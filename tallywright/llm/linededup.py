"""Fuzzy line deduplication by MinHash, with DataFrame operations only.

Lines are compared by their lower-case, trimmed form; blank lines (nothing but white space) always stay. Every distinct
line is written once, with a number; all that follows works on those. A line's set holds its distinct shingles of ``K``
code points (a shorter line is one shingle). Its signature is made of all of them: ``BANDS`` fixed points lie evenly on the ring
of 64-bit hashes, and the band of a point is the first ``ROWS`` hashes at or after it. Two lines agree in a band if the first ``ROWS``
of both lines' hashes together are shared, with the probability of nearly their similarity to the power of ``ROWS``, whatever their lengths. In a
line of few shingles one hash holds a long arc of the ring, and bands are the same. So lines of at most ``FEW`` different
shingles, and those that can be as similar as asked to one of them, have bands of their own, of ``OWN_ROWS``: two for each number, the least and
the greatest of the shingles' hashes with that number as seed. At similarity 0.8 a pair shares no band once in 200,000, whatever its size (a test counts 50,000
pairs each of 4 to 64 shared shingles). Candidates are verified on their full sets, links are joined by distributed
union-find, and of each component the first line (smallest doc_id, then row, then line number) stays.

Lines that are somewhat alike, as those that quote one passage, meet in a band too, in a number of pairs that grows with the square of the lines:
that is why a band has five rows, and why pairs are verified in rounds. Band keys are shuffled once. A key that a large share of the lines has is dealt into parts (see ``hot_keys``), so that no
task gets a whole hot bucket.

Edge cases: a null text has no lines; lines part at line feeds; blank lines are kept, each its own component; lines of
any length are one set each; rows with the same doc_id, or none, are documents of their own, in an arbitrary order; null
doc_ids come last; an empty table gives no rows; columns other than doc_id and text are ignored, and pass through in
deduplicated(), where of equal rows (same doc_id and text) with lines that are not blank one stays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linking import link, prefix_size
from .shared import KEY, identity, joined, keep, sheltered, with_key, written

#: Code points of a shingle.
K = 8
ROWS, BANDS = 5, 31
OWN_ROWS, OWN_BANDS = 3, 18
#: Lines of at most so many different shingles are signed by themselves.
FEW = 64
#: The points of the ring of hashes, ascending.
POINTS = [(i << 64) // BANDS - (1 << 63) for i in range(BANDS)]


def takes_part(line: Column) -> Column:
    return F.ltrim(line, F.lit(" \t\n\x0b\f\r")) != ""


def numbered_lines(docs: DataFrame) -> DataFrame:
    """Every line of every row: row, doc_id, t1 and t2 (two hashes of the row's text), line_no (from 0), line (normal form)."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *identity(F.col("text"), "t"),
        F.monotonically_increasing_id().alias("row"),
        F.split(F.lower("text"), "\n").alias("lines"),
    )
    split = rows.select("row", "doc_id", "t1", "t2", F.posexplode("lines").alias("line_no", "line"))
    return split.withColumn("line", F.trim("line"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once however often it is used."""
    return F.transform(F.array(value), use)[0]


def hashes(line: Column) -> Column:
    """The hashes of all shingles of a line, in UTF-16, repeated ones too."""

    def shingles(b: Column, width: int) -> Callable[[Callable[[Column], Column]], Column]:
        """b: the line where each code point has so many bytes."""
        starts = F.sequence(F.lit(1), F.greatest(F.length(b) - K * width, F.lit(0)) + 1, F.lit(width))
        return lambda use: F.transform(starts, lambda i: F.xxhash64(use(F.substring(b, i, F.lit(K * width)))))

    def cut(b: Column) -> Column:
        # letters outside the basic plane take four bytes: such a line is cut in UTF-32, where all do
        wide = bound(F.encode(line, "UTF-32"), lambda c: shingles(c, 4)(lambda x: F.encode(F.decode(x, "UTF-32"), "UTF-16BE")))
        return F.when(F.length(b) == 2 * F.length(line), shingles(b, 2)(lambda x: x)).otherwise(wide)

    return bound(F.encode(line, "UTF-16BE"), cut)


def band_keys(lines: DataFrame, percent: int = 80) -> DataFrame:
    """node, key: BANDS or OWN_BANDS rows for each row of lines (node, line), and both for sets between FEW and what may be like one of FEW.

    On the ring, the place of a point among the sorted hashes and points, less the points before it, tells how many hashes lie before it.
    """
    points = F.array(*[F.lit(p) for p in POINTS])
    band = F.col("band")

    def own(number: Column) -> Column:
        """The keys of two bands."""
        ends = lambda p: [F.slice(p, 1, OWN_ROWS), F.slice(F.reverse(p), 1, OWN_ROWS)]
        seeded = F.sort_array(F.transform("ring", lambda h: F.xxhash64(h, number)))
        return bound(seeded, lambda p: F.array(*[F.xxhash64(2 * number + BANDS + k, end) for k, end in enumerate(ends(p))]))

    def following(r: int) -> Column:
        return F.element_at("ring", (F.pmod(F.col("before") + r, F.col("n")) + 1).cast("int"))

    ordered = lines.select("node", F.sort_array(F.array_distinct(hashes(F.col("line")))).alias("ring")).withColumn("n", F.size("ring"))
    few = F.when(F.col("n") * percent <= 100 * FEW, F.flatten(F.transform(F.sequence(F.lit(0), F.lit(OWN_BANDS // 2 - 1)), own))).otherwise(F.array().cast("array<long>"))
    merged = ordered.select("node", "ring", "n", few.alias("own"), F.sort_array(F.concat("ring", points)).alias("both"))
    # no lambdas from here on: where there is one, Spark writes rows, and each band's would hold copies of the arrays
    banded = merged.select("node", "ring", "n", "own", "both", F.explode(F.sequence(F.lit(0), F.lit(BANDS + OWN_BANDS - 1))).alias("band"))
    banded = banded.where(((band < BANDS) & (F.col("n") > FEW)) | ((band >= BANDS) & (F.size("own") > 0)))
    before = F.when(band < BANDS, F.array_position("both", F.element_at(points, band + 1)) - 1 - band)
    placed = banded.select("node", "ring", "n", "own", "band", before.alias("before"))
    key = F.when(band < BANDS, F.xxhash64("band", *[following(r) for r in range(ROWS)])).otherwise(F.element_at("own", band - BANDS + 1))
    return placed.select("node", key.alias("key"))


#: One line of so many tells which keys are hot; a key is if it has one line of HOT or more.
ONE_OF, HOT = 64, 1000


def hot_keys(lines: DataFrame, percent: int = 80) -> DataFrame:
    """key, parts: band keys that so large a share of all lines has that their members must be dealt into parts.

    Found on a sample of lines, as it only decides how rows are spread: which pairs are linked doesn't depend on it. The share a
    key must have bounds the table to 2 * (BANDS + OWN_BANDS) * HOT rows, whatever the corpus.
    """
    sample = lines.where(F.pmod(F.xxhash64("node"), F.lit(ONE_OF)) == 0)
    n = sample.count()
    counts = band_keys(sample, percent).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= 8 + n / HOT)
    return keep(counts.select("key", F.ceil(F.col("n") * HOT / max(n, 1)).alias("parts")))


def shared_keys(lines: DataFrame, percent: int = 80) -> DataFrame:
    """key, node: the members of all buckets that more than one line is in."""
    dealt = band_keys(lines, percent).join(F.broadcast(hot_keys(lines, percent)), "key", "left")  # 2 * (BANDS + OWN_BANDS) * HOT rows at most
    hot = F.col("parts").isNotNull()
    part = F.when(hot, F.xxhash64("key", F.pmod(F.xxhash64("node"), "parts"))).otherwise(F.col("key"))
    others = F.count("*").over(Window.partitionBy("part"))  # one long, so that the sort is by radix
    # of a key that isn't hot the part is the key, which goes through the shuffle once
    counted = dealt.select(part.alias("part"), "node", F.when(hot, F.col("key")).alias("hot")).withColumn("n", others)
    return counted.where(F.col("hot").isNotNull() | (F.col("n") > 1)).select(F.coalesce("hot", "part").alias("key"), "node")


#: Lines of a corpus for each pair that is verified at once: a pair takes a line's text through the shuffle, so a round takes half as much as all lines do.
LINES_A_PAIR = 2


def similar_in_rounds(pairs: DataFrame, texts: DataFrame, percent: int, most: int) -> DataFrame:
    """similar() on at most about so many pairs at once, whose shuffle files go before the next round; pairs are a table."""
    rounds = max(1, -(-pairs.count() // max(1, most)))
    if rounds == 1:
        return similar(pairs, texts, percent)
    part = F.pmod(F.xxhash64("a", "b"), F.lit(rounds))
    return reduce(DataFrame.unionByName, [keep(similar(pairs.where(part == i), texts, percent)) for i in range(rounds)])


def similar(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their lines' shingles.

    Lines travel as text, which packs far better than hashes of their shingles; sets are made beside each other, in pairs.
    """
    sizes = texts.select("node", "size")
    of_a = pairs.join(sizes.select(F.col("node").alias("a"), F.col("size").alias("n_a")), "a")
    of_both = of_a.join(sizes.select(F.col("node").alias("b"), F.col("size").alias("n_b")), "b")
    able = of_both.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    with_x = able.join(texts.select(F.col("node").alias("a"), F.col("line").alias("x")), "a")
    with_y = with_x.join(texts.select(F.col("node").alias("b"), F.col("line").alias("y")), "b")
    both = F.size(F.array_intersect(hashes(F.col("x")), hashes(F.col("y"))))
    return with_y.where((100 + percent) * both >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")


#: Slots of the table of frequencies that is broadcast: a fixed size, whatever the corpus.
SLOTS = 1 << 20


def prefixes(texts: DataFrame, percent: int) -> DataFrame:
    """key, node, size, place: each line's first shingles in the order of (frequency of the slot, hash)."""
    slot = F.pmod("key", F.lit(SLOTS)).alias("slot")
    keys = texts.select(F.explode(hashes(F.col("line"))).alias("key"))
    counts = keep(keys.groupBy(slot).agg(F.count("*").alias("f")))  # SLOTS rows at most
    placed = texts.repartition("node").select("node", "size", "line")
    elements = placed.select("node", "size", F.explode(F.array_distinct(hashes(F.col("line")))).alias("key"))
    own = Window.partitionBy("node").orderBy("f", "key")  # one line's shingles, which already lie together
    ordered = elements.withColumn("slot", slot).join(F.broadcast(counts), "slot")
    ranked = ordered.withColumn("place", F.row_number().over(own).cast("long") - 1)
    return ranked.where(F.col("place") < prefix_size(F.col("size"), percent)).select("key", "node", "size", "place")


def linked_lines(lines: DataFrame, percent: int) -> DataFrame:
    """node, root of the lines (node, line) that have a link."""

    def load(nodes: DataFrame) -> DataFrame:
        """The lines that may have links, and the sizes of their sets."""
        size = F.size(F.array_distinct(hashes(F.col("line"))))
        return written(lines.join(nodes, "node", "left_semi").select("node", "line", size.cast("long").alias("size")), "candidates")

    def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        return similar_in_rounds(pairs, texts, percent, n // LINES_A_PAIR)

    n = lines.count()
    members = written(shared_keys(lines, percent), "buckets")
    return link(members, load, verify, lambda texts: prefixes(texts, percent), percent)


def components_of_lines(docs: DataFrame, percent: int) -> DataFrame:
    """row, doc_id, t1, t2, line_no, full (not blank), first (line of its component), kept."""
    of_row = ["row", "doc_id", "t1", "t2", "line_no"]
    lines = numbered_lines(docs)
    everywhere = written(lines.select(*of_row, takes_part(F.col("line")).alias("full"), *identity(F.col("line"))), "occurrences")
    distinct = lines.select("line").where(takes_part(F.col("line"))).distinct()
    distinct = written(distinct.select(F.monotonically_increasing_id().alias("node"), *identity(F.col("line")), "line"), "lines")
    linked = linked_lines(distinct.select("node", "line"), percent)

    ids = distinct.select("node", "h1", "h2")
    roots = ids.select(F.col("node").alias("root"), F.col("h1").alias("r1"), F.col("h2").alias("r2"))
    fuzzy = keep(linked.where("node <> root").join(ids, "node").join(roots, "root").select("h1", "h2", "r1", "r2"))
    # a blank line has a key of its own, so that they don't meet
    own_key = [F.when(F.col("full"), F.coalesce(f"r{i}", f"h{i}")).otherwise(F.xxhash64("row", "line_no")).alias(f"r{i}") for i in (1, 2)]
    keyed = everywhere.join(fuzzy, ["h1", "h2"], "left").select(*of_row, "full", *own_key)
    at = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "line_no")
    first = keyed.where("full").groupBy("r1", "r2").agg(F.min(at).alias("first"))
    own = F.when(F.col("full"), F.col("first")).otherwise(at)
    return keyed.join(first, ["r1", "r2"], "left").select(*of_row, "full", own.alias("first"), (own == at).alias("kept"))


def line_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, line_no, component_doc, component_line (of the line that stays), kept."""
    first = [F.col("first.doc_id").alias("component_doc"), F.col("first.line_no").alias("component_line")]
    return components_of_lines(docs, percent).select("doc_id", "line_no", *first, "kept")


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs without the lines that don't stay; a document that had lines and keeps none but blank ones goes."""
    found = components_of_lines(docs, percent)
    by_row = found.groupBy("doc_id", "t1", "t2").agg(
        F.collect_set(F.when(F.col("kept"), F.col("line_no"))).alias("__stay"),  # at most one document's lines
        (F.max("line_no") + 1).alias("__lines"),
        (F.max("full") & (F.sum(F.when(F.col("line_no") == 0, 1)) > 1)).alias("__copied"),
    )
    changed = by_row.where((F.size("__stay") < F.col("__lines")) | F.col("__copied"))
    changed = written(changed.withColumnsRenamed({"doc_id": "__doc", "t1": "__t1", "t2": "__t2"}), "changed")

    rows, names = sheltered(docs, "doc_id", "text")
    rows = with_key(rows)
    copies = changed.where("__copied")
    single = joined(rows, copies, "inner").dropDuplicates(KEY)
    rows = joined(rows, changed.where("not __copied"), "left")
    if not copies.isEmpty():
        rows = joined(rows, copies.select(*[f"__{k}" for k in ("doc", "t1", "t2")]), "left_anti").unionByName(single)
    parts = F.split("text", "\n")
    left = F.array_join(F.transform(F.array_sort("__stay"), lambda i: F.element_at(parts, i + 1)), "\n")
    cleaned = rows.withColumn("text", F.when(F.col("__stay").isNull(), F.col("text")).otherwise(left))
    stay = cleaned.where(F.col("__stay").isNull() | F.col("text").rlike(r"\S")).drop(*KEY, "__stay", "__lines", "__copied")
    return stay.withColumnsRenamed(names).select(*[F.col(f"`{c}`") for c in docs.columns])
