"""Registered queries of the corpus operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.alignment import align_documents
from tidemark.llm.ann import nearest
from tidemark.llm.embedding_dedup import embedding_components
from tidemark.llm.lexical import rank_documents
from tidemark.llm.mixing import mix_documents
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import fit_quality, quality_scores
from tidemark.llm.sharding import shard_rows
from tidemark.llm.shared import shared_path
from tidemark.llm.simhash import simhash_components
from tidemark.llm.toxicity import fit_toxicity, toxicity_scores
from tidemark.llm.training_order import write_training_order
from tidemark.llm.url_filter import judge_urls, rule_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# The rule list of the url query.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]


def _query(name: str):
    def register(f):
        QUERIES[name] = f
        return f
    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_url_filter")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page's url."""
    return judge_urls(_table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


ORACLE["op1_url_filter"] = r"""
WITH parsed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rule_host, rule_path, rule_verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
judged AS (
  SELECT page_id, host, path,
         (SELECT max_by(rule_host || rule_path, length(rule_host || rule_path)) FROM rules
          WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule
  FROM parsed)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(r.rule_verdict, 'allow') AS verdict
FROM judged j LEFT JOIN rules r ON j.rule = r.rule_host || r.rule_path
"""


@_query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document (3-word shingles, 3 bits)."""
    return simhash_components(_table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


@_query("op3_embedding_dedup")
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors within their label at a cosine of 0.98 or more."""
    return embedding_components(_table(spark, sf_dir, "embeddings"), threshold=0.98)


ORACLE["op3_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT r.x AS vec_id, (SELECT COUNT(*) FROM links l WHERE l.x = r.x) AS n_links, MIN(r.y) AS component_id,
       MIN(r.y) = r.x AS kept
FROM reach r GROUP BY r.x
"""


@_query("op5_ann")
def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    table = _table(spark, sf_dir, "embeddings")
    return nearest(table, table.vec_id % 20 == 0, k=20)


@_query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document among 16 shards."""
    return shard_rows(_table(spark, sf_dir, "documents"), shards=16)


@_query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces, packed into sequences of at most 2048 tokens."""
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


@_query("op8_training_order")
def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sequences of all documents written in training order; the place of each in the shard files."""
    return write_training_order(_table(spark, sf_dir, "documents"), shared_path(spark, "training-order"),
                                public_tokenizers.path("word_bpe_49k.json"))


@_query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the text they decode to, as digests."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(ids, ranks).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@_query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a rule ensemble learned from the labels."""
    docs = _table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))


@_query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and toxic spans of every document by a field learned from the labels."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))


@_query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's byte-level tokens aligned with its pieces; links with their corpus-wide counts."""
    return align_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"), digest=True)


@_query("op12_mixing")
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies of every document in a mix of all sources that weigh 3, 1, 2 in turn."""
    return mix_documents(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2)


@_query("op13_lexical_search")
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 highest-scoring documents of every benchmark item."""
    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


ORACLE["op13_lexical_search"] = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
counted AS (SELECT doc_id, term, COUNT(*) AS tf FROM words GROUP BY doc_id, term),
long AS (SELECT doc_id, CAST(SUM(tf) AS BIGINT) AS n FROM counted GROUP BY doc_id),
total AS (SELECT COUNT(*) AS docs, CAST(SUM(n) AS BIGINT) AS words FROM long),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
weighed AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * COUNT(*) + 1))) AS BIGINT) AS w
  FROM counted, total GROUP BY term, docs),
parts AS (
  SELECT c.term, c.doc_id, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words))) AS part
  FROM counted c JOIN weighed USING (term) JOIN long USING (doc_id), total
  WHERE c.term IN (SELECT term FROM wanted)),
scored AS (
  SELECT item_id, doc_id, CAST(SUM(part) AS BIGINT) AS score FROM wanted JOIN parts USING (term)
  GROUP BY item_id, doc_id HAVING SUM(part) > 0),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
           FROM scored)
SELECT * FROM ranked WHERE rank <= 50
"""
