"""One query per operator, over its whole table with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality, toxicity
from .linededup import dedup_lines
from .mainpage import extract_main
from .mixing import mix
from .neardup import near_duplicates
from .packing import pack
from .repetition import repetition_rules
from .secrets import scan_secrets
from .shared import read
from .topk import exact_top_k


def op1_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its remaining text."""
    return dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op6_differencing_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op7_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept covered_words".split()
    return repetition_rules(read(spark, sf_dir, "documents")).select(cols)


def op8_line_block_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(read(spark, sf_dir, "pages"))


def op9_subsequence_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=4, least=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_fuzzy_line_dedup,
        op2_entropy_mix,
        op3_secret_scan,
        op4_exact_top_k,
        op5_cotrained_quality,
        op6_differencing_pack,
        op7_suffix_repetition,
        op8_line_block_extract,
        op9_subsequence_toxicity,
        op10_tensored_minhash,
    )
}
_WORDS = r"""words AS (SELECT doc_id, i, word FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS ws FROM documents)))"""

ORACLES: dict[str, str] = {
    "op4_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op7_suffix_repetition": "WITH " + _WORDS.format(text="coalesce(text, '')") + r"""
, g AS (SELECT doc_id, i, word,
  CASE WHEN count(*) OVER w5 = 5 THEN string_agg(word, ' ') OVER w5 END AS g5, CASE WHEN count(*) OVER w8 = 8 THEN string_agg(word, ' ') OVER w8 END AS g8, CASE WHEN count(*) OVER w61 = 61 THEN string_agg(word, ' ') OVER w61 END AS g61 FROM words
  WINDOW w5 AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), w8 AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), w61 AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 60 FOLLOWING)),
r AS (SELECT doc_id, i, word, CAST(g5 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g5) > 1 AS INTEGER) AS r5, CAST(g8 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g8) > 1 AS INTEGER) AS r8, CAST(g61 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g61) > 1 AS INTEGER) AS r61 FROM g),
c AS (SELECT doc_id, word, r61, max(r5) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS k5, max(r8) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS k8 FROM r),
a AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, sum(k5) AS n_repeat_words, sum(k8) AS covered_words, max(r61) AS too_long FROM c GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM documents),
j AS (SELECT l.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(covered_words, 0) AS covered_words, coalesce(too_long, 0) AS too_long FROM l LEFT JOIN a USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * covered_words <= 15 * n_words AND too_long = 0 AS kept, CAST(covered_words AS BIGINT) AS covered_words FROM b""",
    "op10_tensored_minhash": "WITH RECURSIVE " + _WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + """
, g AS (SELECT doc_id, i, string_agg(word, ' ') OVER w AS g, count(*) OVER w AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
s AS (SELECT DISTINCT doc_id, g FROM g WHERE n = 4 OR total < 4 AND i = 1), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, u.b FROM reach JOIN u ON u.a = reach.seen), c AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id""",
}
