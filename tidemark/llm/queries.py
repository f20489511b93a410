"""The opN_ queries: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read
from .bpe_rank_queue import round_trip
from .chat_format import ORACLE as CHAT_SQL
from .chat_format import op11_chat_template as formatted_conversations
from .compact_windows import near_duplicate_passages
from .hard_negatives import hard_negatives
from .html_content import op5_html_content
from .ngram_trie import score as lm_score
from .packing import pack
from .prefix_trie import ORACLE as TRIE_SQL
from .prefix_trie import prefix_trie
from .quality_rules import ORACLE as QUALITY_SQL
from .quality_rules import op2_line_quality
from .simhash_covering import near_duplicates
from .suffix_dedup import removed_spans
from .topk_pivot import top_k
from .toxicity_kn import op10_toxicity


def op1_pivot_top_k(spark, sf_dir):
    return top_k(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op3_compact_windows(spark, sf_dir):
    return near_duplicate_passages(read(spark, sf_dir, "documents"))


def op4_bpe_rank_queue(spark, sf_dir):
    return round_trip(read(spark, sf_dir, "documents"))


def op6_ngram_trie(spark, sf_dir):
    return lm_score(read(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark, sf_dir):
    return removed_spans(read(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))


def op11_chat_template(spark, sf_dir):
    return formatted_conversations(read(spark, sf_dir, "conversations"))


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie(read(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, label=label)


QUERIES = {
    "op1_pivot_top_k": op1_pivot_top_k,
    "op2_line_quality": op2_line_quality,
    "op3_compact_windows": op3_compact_windows,
    "op4_bpe_rank_queue": op4_bpe_rank_queue,
    "op5_html_content": op5_html_content,
    "op6_ngram_trie": op6_ngram_trie,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_toxicity": op10_toxicity,
    "op11_chat_template": op11_chat_template,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op1_pivot_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x : CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
""",
    "op2_line_quality": QUALITY_SQL,
    "op11_chat_template": CHAT_SQL,
    "op12_prefix_trie": TRIE_SQL,
    "op13_hard_negatives": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x : floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, c.r, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 100 = 0),
p AS (SELECT a, anchor_id, r AS p, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, r) <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.a, p ORDER BY score DESC, vec_id, r) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score) WHERE rank <= 10
""",
}
