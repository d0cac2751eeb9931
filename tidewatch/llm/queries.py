"""Queries of this subpackage and, where SQL can express one, the SQL of its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chaining, decontam, filteraudit, langid, linededup, minhash, mining, packing, quality, secretscan
from .chat import CHAT_SQL, chat_report
from .sharding import shard_report
from .store import table
from .topk import top_k

Query = Callable[[SparkSession, str], DataFrame]


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_report(table(spark, sf_dir, "conversations"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(table(spark, sf_dir, "documents"))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


#: What importance resampling draws of the documents that are not rejected.
DRAWN_SHARE = 0.5


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.sampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), DRAWN_SHARE)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every seventh label is wrong: that is the noise which mining must stand
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mining.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.secrets(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES: dict[str, Query] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_packing": op4_packing,
    "op5_decontamination": op5_decontamination,
    "op6_language_id": op6_language_id,
    "op7_line_dedup": op7_line_dedup,
    "op8_sharding": op8_sharding,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_secret_scan": op12_secret_scan,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES: dict[str, str] = {"op2_chat_formatting": CHAT_SQL, "op5_decontamination": decontam.LEAKS_SQL, "op7_line_dedup": linededup.LINES_SQL, "op10_exact_top_k": TOP_K_SQL, "op11_hard_negatives": mining.NEGATIVES_SQL, "op13_filter_audit": filteraudit.AUDIT_SQL}
