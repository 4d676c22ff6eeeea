"""Files as clients deliver them, written by Spark from the tables: CSV by day, and pages of an interface by number or cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.once import working_dir

MOST_ROWS = 200_000


def write_csv(rows: DataFrame, folder: str, day: str, separator: str = ",") -> str:
    """A folder for each value of ``day``, with files of at most MOST_ROWS rows; every file has a header."""
    out = rows.write.partitionBy(day).option("header", True).option("sep", separator).option("maxRecordsPerFile", MOST_ROWS)
    out.option("nullValue", "").option("emptyValue", "").mode("append").csv(folder)
    return folder


def write_pages(items: DataFrame, folder: str, order: list[str], size: int, cursors: bool = False) -> str:
    """Pages of ``size`` items (column ``item``, JSON) in that order: one folder page=<key> with one document each, an empty page at the end.

    Keys are numbers from 1; with cursors they are ``first`` and then the cursor that the page before names in ``next``.
    """
    spark = items.sparkSession
    numbered = ranked(items, order).select("item", (F.floor(F.col("rank") / size) + 1).alias("number"), (F.col("rank") % size).alias("place"))
    pages = numbered.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("place", "item"))).alias("items"))  # a page's items
    last = numbered.agg(F.coalesce(F.max("number"), F.lit(0)).alias("n"))
    end = last.select((F.col("n") + 1).alias("number"), F.lit(None).cast(pages.schema["items"].dataType).alias("items"))
    data = F.concat(F.lit('{"data":['), F.array_join(F.transform(F.coalesce("items", F.array()), lambda x: x["item"]), ","), F.lit("]"))
    name = lambda n: F.substring(F.sha2(n.cast("string"), 256), 1, 16)
    following = F.when(F.col("items").isNotNull(), F.concat(F.lit(',"next":"'), name(F.col("number") + 1), F.lit('"'))).otherwise(F.lit(""))
    key = F.when(F.col("number") == 1, "first").otherwise(name(F.col("number"))) if cursors else F.col("number").cast("string")
    document = F.concat(data, following if cursors else F.lit(""), F.lit("}"))
    both = pages.unionByName(end).select(key.alias("page"), document.alias("value"))
    both.repartition(max(1, spark.sparkContext.defaultParallelism), "page").write.partitionBy("page").mode("append").text(folder)
    return folder


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rank from 0 in that order: rows are range-partitioned, ranked in their partition and shifted by the partitions before.

    Rows are written with the number of their partition: read twice from a plan, they could be dealt out in two ways.
    """
    spark, path = rows.sparkSession, f"{working_dir(rows.sparkSession)}/ranges"
    spread = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    spread.write.parquet(path)
    dealt = spark.read.schema(spread.schema).parquet(path)
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    return inside.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_in") - 1).drop("_part", "_in", "_before")
