"""The registered queries of this package: thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, pii
from .filteraudit import audit
from .langid import language_of
from .linededup import line_components
from .maxscore import search_top
from .minhash import near_duplicates
from .mixing import mix, with_size
from .packing import pack
from .permindex import nearest
from .sharding import histogram_shards
from .shared import keep, table
from .tokenfile import read_token_files, write_token_files
from .whitening import whitened


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = pii.fit(pii.labelled_table(spark))
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), field))


def op2_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards(table(spark, sf_dir, "documents"))


def op3_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_top(table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(spark, write_token_files(table(spark, sf_dir, "documents"), tokenizer_file()))


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of(table(spark, sf_dir, "documents"))


def op8_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(keep(with_size(docs).drop("text")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "rate", "copies")


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_components(table(spark, sf_dir, "documents"))


def op10_fast_similarity_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file()).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op12_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_personal_data": op1_personal_data,
    "op2_histogram_sort": op2_histogram_sort,
    "op3_maxscore": op3_maxscore,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_token_files": op5_token_files,
    "op6_permutation_index": op6_permutation_index,
    "op7_language_id": op7_language_id,
    "op8_entropy_balancing": op8_entropy_balancing,
    "op9_fuzzy_lines": op9_fuzzy_lines,
    "op10_fast_similarity_sketch": op10_fast_similarity_sketch,
    "op11_prefix_bpe": op11_prefix_bpe,
    "op12_jacobi_whitening": op12_jacobi_whitening,
    "op13_filter_audit": op13_filter_audit,
}

#: For the queries that DuckDB can express.
ORACLE_SQL: dict[str, str] = {
    "op10_fast_similarity_sketch": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:least(i + 4, len(ws))], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS i FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.reached) AS component_id, w.doc_id = min(r.reached) AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id, n.n
""",
    "op3_maxscore": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r AS q_row, q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.w::DOUBLE[], c.w::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q_row ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
""",
    "op13_filter_audit": r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), m AS (
  SELECT part, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic,
    CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM w
), c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask
), f(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)
), s AS (
  SELECT filter_order, step::INTEGER AS step, f.bit, (SELECT coalesce(sum(g.bit), 0)::INTEGER FROM f g WHERE position(g.f IN filter_order) < step) AS before
  FROM o JOIN range(1, 6) r(step) ON true JOIN f ON f.f = substr(filter_order, step::INTEGER, 1)
)
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & bit > 0), 0)::BIGINT AS shapley
FROM s JOIN c ON true GROUP BY part, filter_order, step
""",
}
