"""A training-corpus pipeline over the table ``documents``: every stage is an operator of tallywright.llm.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next stage's
docs. All but the last return the columns of documents.

Edge cases: ``language`` drops null texts and those without a letter; ``lines`` keeps texts without lines to compare and, of rows
with one doc_id (or none) and one text, a single one; ``near_duplicates`` keeps one row of each component and all without words;
``mixture`` never takes a document of size 0 out of or into the mix more than once; ``sequences`` packs an empty text as its end id. Texts of
any length are worked on whole, rows that share a doc_id are documents of their own, equal ones are interchangeable; an empty table
stays empty through all stages; columns of other names pass through all but the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import langid, linededup, minhash, mixing, packing
from tallywright.llm.queries import tokenizer_file
from tallywright.llm.shared import sheltered, table, written

#: A text of this many letters or more is rejected if not even its best language explains it: more phrases for each letter or blank
#: than LEAST_KNOWN. Texts of a learned language need about a third of that.
LONG_ENOUGH, LEAST_KNOWN = 50, 0.6


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and texts in no learned language."""
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    own, names = sheltered(docs, "text")
    found = langid.identify(own, model)
    unknown = (F.col("lang_pred") == langid.UND) | ((F.col("lang_letters") >= LONG_ENOUGH) & (F.col("lang_rate") > LEAST_KNOWN))
    kept = found.where(~unknown).drop(*langid.MADE).withColumnsRenamed(names)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one line of each group of equal or nearly equal lines; documents left without any go."""
    return linededup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, of a similarity of 0.8 or more."""
    return minhash.deduplicated(docs, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources meet their target weights."""
    return mixing.repeated(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 1024."""
    return packing.pack(docs, tokenizer_file())


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("sequences", sequences)]

#: SQL can't express the models and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
