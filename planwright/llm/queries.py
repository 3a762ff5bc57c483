"""The queries ``opN_<name>``, N from 1 to 13: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, html_extract, jaccard_join, lexical_search, line_dedup, lm_scoring, mixing, quality, source_divergence, substring_dedup, token_counts, vector_search
from .shared import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduped(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_scores(lm_scoring.scored(table(spark, sf_dir, "documents")))


def op6_lm_scoring_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram scores under all counts, a text's own included."""
    return _rounded_scores(lm_scoring.scored(table(spark, sf_dir, "documents"), order=2, held_out=False))


def _rounded_scores(out: DataFrame) -> DataFrame:
    rounded = [(F.floor(F.col(c) * f + 0.5) / f).alias(c) for c, f in (("log_score", 1e4), ("mean_log_score", 1e6))]
    return out.select("doc_id", "n_words", *rounded)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduped(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_format.rotated(table(spark, sf_dir, "conversations"))
    spans = F.transform("trained", lambda s: F.concat_ws("-", s["start"], s["stop"]))
    return out.withColumn("trained", F.array_join(spans, ","))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op11_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.searched(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.searched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_substring_dedup, op2_html_extraction, op3_token_counts, op4_quality_rules, op5_jaccard_join, op6_lm_scoring, op6_lm_scoring_whole, op7_line_dedup, op8_chat_format, op9_benchmark_decontamination, op10_source_mixing, op11_maxscore_search, op12_source_divergence, op13_lexical_search]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_lm_scoring": lm_scoring.HELD_OUT_SQL.format(docs="documents"),
        "op6_lm_scoring_whole": lm_scoring.WHOLE_SQL.format(docs="documents"),
        "op8_chat_format": chat_format.ROTATED_SQL.format(turns="conversations"),
        "op7_line_dedup": line_dedup.RESULT_SQL.format(docs="documents"),
        "op10_source_mixing": mixing.PLAN_SQL.format(docs="documents"),
        "op11_maxscore_search": vector_search.SEARCH_SQL.format(vectors="embeddings"),
        "op12_source_divergence": source_divergence.AUDIT_SQL.format(docs="documents"),
        "op13_lexical_search": lexical_search.SEARCH_SQL.format(docs="documents", items="benchmark"),
    }
