"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import align
from .common import documents, table
from .jaccard import jaccard_components
from .licenses import license_scan
from .lm import scores
from .media import media_columns
from .packing import pack
from .pii import personal_data
from .pieces import round_trip
from .prefixes import conversation_prefixes
from .quality import quality
from .rules import quality_rules
from .sharding import shard
from .toxicity import toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir))


def op6_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_prefixes(table(spark, sf_dir, "conversations"))


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir), digest=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_media_columns": op3_media_columns,
    "op4_pii": op4_pii,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_extendible_sharding": op6_extendible_sharding,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_packing": op10_packing,
    "op11_conversation_prefix_trie": op11_conversation_prefix_trie,
    "op12_license_scans": op12_license_scans,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}

#: The other operators fit models, hash, or encode, which SQL can't express; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) END AS ss FROM w),
e AS (SELECT doc_id, unnest(ss) AS shingle FROM s),
n AS (SELECT doc_id, len(ss) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reached FROM n UNION SELECT r.node, u.b FROM r JOIN u ON r.reached = u.a)
SELECT n.doc_id AS doc_id, n.n AS n_shingles, min(r.reached) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY 1, 2
""",
    "op11_conversation_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS family,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
f AS (SELECT conv_id AS family, count(*) AS n FROM t GROUP BY 1),
r AS (
  SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.family AND t.pos < c.h
  UNION ALL SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(f.n, 0)), t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h LEFT JOIN f USING (family)),
l AS (SELECT c.conv_id, coalesce(x.ts, []) AS ts FROM c LEFT JOIN (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS ts FROM r GROUP BY 1) x USING (conv_id)),
p AS (
  SELECT conv_id, d, len(ts) AS length, list_slice(ts, 1, d) AS prefix, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(ts[d].text, '[^\x20\x09-\x0D]+')) END AS words
  FROM (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS d FROM l)),
m AS (SELECT conv_id, d, length, words, min(conv_id) OVER (PARTITION BY d, prefix) AS node FROM p),
n AS (
  SELECT node, d, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE length = d), '')) AS ends_sha256
  FROM m GROUP BY node, d),
u AS (SELECT n.*, m.node AS parent FROM n LEFT JOIN m ON m.conv_id = n.node AND m.d = n.d - 1),
k AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM u WHERE d > 0 GROUP BY 1, 2),
s AS (
  SELECT m.node, m.d, sum(u.saved) AS saved_tokens, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves
  FROM u JOIN m ON m.conv_id = u.node AND m.d <= u.d LEFT JOIN k ON k.node = u.node AND k.d = u.d GROUP BY 1, 2)
SELECT u.node AS conv_id, u.d AS depth, u.parent AS parent_conv_id, u.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, u.ends_sha256
FROM u LEFT JOIN k ON k.node = u.node AND k.d = u.d JOIN s ON s.node = u.node AND s.d = u.d
""",
}
