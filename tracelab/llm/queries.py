"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tracelab.llm import decontaminate, fill_middle, lm, mixing, pieces, resampling, rules, secrets, simhash, suffix_dedup, topk, url_filter, whitening
from tracelab.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    lengths = [len(path) for _, path, _ in url_filter.RULES]
    return url_filter.judge(pages, url_filter.rule_rows(spark), lengths, url_filter.spam_hosts(pages))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integers(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), with_text=False)


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), pieces.Vocabulary.load(corpus_pipeline.MODEL_PATH))


def op9_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_url_filter": op2_url_filter,
    "op3_secrets": op3_secrets,
    "op4_topk": op4_topk,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_rules": op6_rules,
    "op7_lm": op7_lm,
    "op8_pieces": op8_pieces,
    "op9_resampling": op9_resampling,
    "op10_simhash": op10_simhash,
    "op11_decontaminate": op11_decontaminate,
    "op12_whitening": op12_whitening,
    "op13_fill_middle": op13_fill_middle,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.MIXTURE_SQL,
    "op2_url_filter": url_filter.JUDGE_SQL,
    "op4_topk": topk.SEARCH_SQL,
    "op11_decontaminate": decontaminate.CONTAMINATION_SQL,
    "op13_fill_middle": fill_middle.TRANSFORM_SQL,
}
