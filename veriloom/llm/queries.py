"""The queries opN_<name> over whole tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from .common import read


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies; VERILOOM_TOKENIZERS names another folder."""
    if folder := os.environ.get("VERILOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(read(spark, sf_dir, "documents"))


def op2_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents mixed to shares that grow as the square root of a source's size, shuffled globally."""
    from .mixing import mix

    return mix(read(spark, sf_dir, "documents"), copy_col="copy")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k

    return exact_top_k(read(spark, sf_dir, "embeddings"), 20, 20, 64)


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 2048)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), 0.5)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), 4096)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations written as raw transcripts with markers of several styles, parsed again without their roles; weights come from a bounded sample of labelled turns."""
    from .chat import as_transcripts, format_transcripts, learn

    turns = read(spark, sf_dir, "conversations")
    return format_transcripts(as_transcripts(turns), weights=learn(turns))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), 0.3)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import embedding_components

    return embedding_components(read(spark, sf_dir, "embeddings"), 0.9)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: Every pair of a query and a candidate; only for the small tables of the correctness run.
TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: The table's own roles and texts, which the parser has to recover, in the canonical form.
CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS turn_no, role, text,
  '<|im_start|>' || role || chr(10) || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS chat FROM t
"""

#: Every pair of vectors and the closure of their links; only for the small tables of the correctness run.
LINKS_SQL = """
WITH RECURSIVE rows_in AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings),
v AS (SELECT r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS size FROM rows_in
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach(r, other) AS (SELECT r, r FROM rows_in UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.other),
least AS (SELECT reach.r, min(o.vec_id) AS component_id FROM reach JOIN rows_in o ON o.r = reach.other GROUP BY reach.r)
SELECT i.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, i.vec_id = component_id AS kept
FROM rows_in i JOIN least ON least.r = i.r LEFT JOIN counts ON counts.a = i.r
"""

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_poisson_mixing, op3_exact_topk, op4_pattern_packing, op5_toxicity, op6_simhash, op7_token_counts, op8_chat_format, op9_quality, op10_embedding_dedup, pipeline)}


def oracles() -> dict[str, str]:
    from .mixing import MIX_SQL

    return {
        "op3_exact_topk": TOPK_SQL,
        "op8_chat_format": CHAT_SQL,
        "op10_embedding_dedup": LINKS_SQL,
        "op2_poisson_mixing": MIX_SQL.format(docs="documents", columns="doc_id, text, lang, source, n_chars, copy"),
    }
