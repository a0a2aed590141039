"""The operators over their whole tables, one query each, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm import (
    bpe,
    conversation_trie,
    langid,
    mixing,
    packing,
    quality,
    ranked_search,
    secret_scan,
    simhash,
    token_counts,
    toxicity,
    url_rules,
    vectors,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _query(run):
    QUERIES[run.__name__] = run
    return run


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(column: str, folds: int) -> Column:
    """Remainder of the CRC-32 of an id as text; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % folds


def learned_languages(docs: DataFrame) -> langid.Model:
    return langid.train(docs.where(fold("doc_id", 4) != 2))


@_query
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), BYTE_BPE)


@_query
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return quality.judge(docs, quality.train(docs, _table(spark, folder, "labels")))


@_query
def op3_bpe_automaton(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode(_table(spark, folder, "documents"), BYTE_BPE, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


@_query
def op5_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge_urls(_table(spark, folder, "pages"))


@_query
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held = docs.withColumn("held_out", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))
    return langid.identify(held, learned_languages(docs), ["doc_id", "held_out"])


@_query
def op7_embedding_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, folder, "embeddings"))


@_query
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    kinds = tuple(secret_scan.KINDS)
    counts = [F.size(secret_scan.of_kind(F.col("spans"), k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secret_scan.describe(F.col("spans"), kinds), 256).alias("base_sha256"),
        secret_scan.describe(F.col("spans")).alias("spans"),
    )


@_query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = toxicity.train(docs, _table(spark, folder, "labels").where(fold("doc_id", 5) != 0))
    scored = toxicity.score_texts(docs, model)
    return scored.withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)))


@_query
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, folder, "documents"), WORD_BPE)


@_query
def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = conversation_trie.numbered_turns(_table(spark, folder, "conversations"))
    return conversation_trie.prefix_trie(*conversation_trie.share_openings(turns))


# CRC-32 of the decimal id, bit by bit.
_CRC_STEP = "CASE WHEN i % 8 = 0 THEN xor(a, ascii((conv_id::VARCHAR)[i // 8 + 1])) ELSE a END"
ORACLE_SQL["op11_conversation_trie"] = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
    dense_rank() OVER (ORDER BY coalesce(role, ''), coalesce(text, '')) AS tid,
    strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, max(pos) AS n,
    xor(list_reduce(list_concat([4294967295::BIGINT], range(0, 8 * length(conv_id::VARCHAR))), lambda a, i:
      CASE WHEN ({_CRC_STEP}) % 2 = 1 THEN xor(({_CRC_STEP}) >> 1, 3988292384) ELSE ({_CRC_STEP}) >> 1 END),
      4294967295) % 9 AS h
  FROM turns GROUP BY conv_id),
openings AS (
  SELECT c.conv_id, c.h, coalesce(least(c.h, b.n), 0) AS k, c.conv_id - c.conv_id % 5 AS base
  FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 5),
rebuilt AS (
  SELECT o.conv_id, t.pos, t.tid, t.bytes FROM openings o JOIN turns t ON t.conv_id = o.base AND t.pos <= o.h
  UNION ALL
  SELECT o.conv_id, o.k + t.pos - o.h, t.tid, t.bytes FROM openings o JOIN turns t USING (conv_id) WHERE t.pos > o.h),
paths AS (
  SELECT conv_id, list(tid ORDER BY pos) AS path, list(bytes ORDER BY pos) AS sizes FROM rebuilt GROUP BY conv_id
  UNION ALL
  SELECT conv_id, [], [] FROM convs WHERE conv_id NOT IN (SELECT conv_id FROM rebuilt)),
prefixes AS (
  SELECT conv_id, len(path) AS own, d, path[1:d] AS p, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS bytes
  FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM paths)),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE own = d), '') AS ends
  FROM prefixes GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (p)),
sums AS (
  SELECT a.p, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.bytes)::BIGINT AS saved_tokens
  FROM counted a JOIN counted b ON b.d >= a.d AND b.p[1:a.d] = a.p GROUP BY a.p)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens,
  sha256(n.ends) AS ends_sha256
FROM counted n JOIN sums s USING (p) LEFT JOIN nodes u ON n.d > 0 AND u.p = n.p[1:n.d - 1] AND u.d = n.d - 1
"""


@_query
def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.rank_documents(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


ORACLE_SQL["op12_ranked_search"] = """
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
  FROM documents WHERE text IS NOT NULL),
items AS (
  SELECT row_number() OVER () AS item, item_id, unnest(list_distinct(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\\x{80}-\\x{10FFFF}]+'))) AS term
  FROM benchmark WHERE text IS NOT NULL),
counts AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM words) GROUP BY row, term),
dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
totals AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM words WHERE len(w) > 0),
lengths AS (
  SELECT row, doc_id, 10 + (90 * len(w) * n_docs) // n_terms AS m FROM words, totals WHERE len(w) > 0),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS weight FROM dfs, totals),
scored AS (
  SELECT i.item, i.item_id, l.row, l.doc_id,
    sum(w.weight * ((1000000000 * c.tf) // (1000 * c.tf + 8 * l.m)))::BIGINT AS score
  FROM items i JOIN weights w USING (term) JOIN counts c USING (term) JOIN lengths l USING (row)
  GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank,
    doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@_query
def op13_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.plan_copies(_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
