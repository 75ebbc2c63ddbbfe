"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, divergence, ffd, langid, lines, minhash, mixing, packing, pii, quality, sql, substrings, tokens, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark, sf_dir):
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op2_token_counts(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op3_pii(spark, sf_dir):
    return pii.span_digests(pii.disclosures(table(spark, sf_dir, "documents")))


def op4_line_dedup(spark, sf_dir):
    return lines.line_report(table(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark, sf_dir):
    return substrings.kept_digests(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).drop("tkey")


def op8_exact_top_k(spark, sf_dir):
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark, sf_dir):
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), max_repeat=1.1)
    return mixed.select("doc_id", "source", "n_tokens", F.round("weight", 6).alias("weight"), "copies")


def op10_quality_rules(spark, sf_dir):
    return quality.line_frequency_rules(table(spark, sf_dir, "documents")).drop("host", "tkey")


def op11_cross_tokenizer_alignment(spark, sf_dir):
    return align.align_tokenizers(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark, sf_dir):
    return divergence.divergence_audit(table(spark, sf_dir, "documents"))


def op13_first_fit_packing(spark, sf_dir):
    return ffd.first_fit_packing(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_token_counts, op3_pii, op4_line_dedup, op5_language_id, op6_substring_dedup, op7_minhash_near_dedup, op8_exact_top_k, op9_mixing, op10_quality_rules, op11_cross_tokenizer_alignment, op12_source_divergence, op13_first_fit_packing)}
SQL = sql.SQL
