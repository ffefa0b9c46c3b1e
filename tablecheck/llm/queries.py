"""The operators' queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .exact_dedup import exact_copies
from .fingerprints import fingerprint_documents
from .jaccard import jaccard_components
from .language import fit_languages, predict_languages
from .language import held_out as held_out_language
from .packing import pack_documents
from .pieces import piece_digests
from .prefix_trie import borrow_openings, conversation_turns, prefix_trie
from .quality import fit_quality, held_out, score_quality
from .resampling import resample
from .secrets import scan_secrets
from .sharding import shard_documents
from .suffix_dedup import remove_repeats
from .token_files import token_files

QUALITY_THRESHOLD = 0.3

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return wrap


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@register("op1_token_files")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), end_id=0)


@register("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), 1024, end_id=2)


EXACT_SQL = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM {documents})
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM rows WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id)
"""


@register("op3_exact_dedup", EXACT_SQL.format(documents="documents"))
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_quality(docs, documents(spark, sf_dir, "labels"))
    return score_quality(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


@register("op5_sentencepiece")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


@register("op6_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir)).select(
        "doc_id", "word_no", "kind", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"),
        "score", "is_secret")


@register("op8_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


@register("op9_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), 16).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@register("op10_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


TRIE_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS base,
         xor(4294967295::BIGINT, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
  FROM turns GROUP BY conv_id),
convs AS (
  SELECT s.*, least(s.h, coalesce(b.n, 0)) AS m FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.base),
rebuilt AS (
  SELECT c.conv_id, t.pos + 1 AS depth, t.key, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos < c.h
  UNION ALL
  SELECT c.conv_id, c.m + t.pos - c.h + 1, t.key, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h),
paths AS (
  SELECT conv_id, depth, length(text) AS n_chars, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path,
         row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1 AS last
  FROM rebuilt),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_chars) AS n_chars FROM paths GROUP BY path, depth
  UNION ALL
  SELECT '', 0, min(conv_id), count(*), 0 FROM convs HAVING count(*) > 0),
ends AS (
  SELECT coalesce(p.path, '') AS path, sha256(string_agg(c.conv_id::VARCHAR, ',' ORDER BY c.conv_id)) AS ends_sha256
  FROM convs c LEFT JOIN paths p ON p.conv_id = c.conv_id AND p.last GROUP BY 1),
children AS (SELECT substr(path, 1, 64 * (depth - 1)) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
subtree AS (
  SELECT substr(u.path, 1, 64 * a.k) AS path, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves,
         sum((u.n_convs - 1) * u.n_chars) AS saved
  FROM nodes u LEFT JOIN children c ON c.path = u.path, unnest(range(u.depth + 1)) AS a(k) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves,
       s.saved::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN subtree s ON s.path = n.path LEFT JOIN children c ON c.path = n.path LEFT JOIN ends e ON e.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = substr(n.path, 1, 64 * (n.depth - 1))
"""


@register("op11_prefix_trie", TRIE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*borrow_openings(conversation_turns(documents(spark, sf_dir, "conversations"))))


@register("op12_resampling")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


@register("op13_language")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict_languages(docs, fit_languages(docs)).select(
        "doc_id", held_out_language(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
