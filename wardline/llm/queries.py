"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import (licenses, lines, mixing, ngram_join, packing, phrases, quality, repeats, sharding,
                          spelling, topk, toxicity, urls)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@register("op2_mix_sources")
def q_mix_sources(spark, sf_dir):
    return mixing.op2_query(table(spark, sf_dir, "documents"))


@register("op4_shuffle_shards")
def q_shuffle_shards(spark, sf_dir):
    return sharding.op4_query(table(spark, sf_dir, "documents"))


@register("op3_pack_sequences")
def q_pack_sequences(spark, sf_dir):
    return packing.op3_query(table(spark, sf_dir, "documents"))


@register("op5_quality_rules")
def q_quality_rules(spark, sf_dir):
    return quality.op5_query(table(spark, sf_dir, "documents"))


@register("op8_url_filters")
def q_url_filters(spark, sf_dir):
    return urls.op8_query(table(spark, sf_dir, "pages"))


@register("op10_license_scans")
def q_license_scans(spark, sf_dir):
    return licenses.op10_query(table(spark, sf_dir, "documents"))


@register("op7_top_k_search")
def q_top_k_search(spark, sf_dir):
    return topk.op7_query(table(spark, sf_dir, "embeddings"))


@register("op1_ngram_join")
def q_ngram_join(spark, sf_dir):
    return ngram_join.op1_query(table(spark, sf_dir, "documents"))


@register("op9_line_dedup")
def q_line_dedup(spark, sf_dir):
    return lines.op9_query(table(spark, sf_dir, "documents"))


@register("op6_suffix_dedup")
def q_suffix_dedup(spark, sf_dir):
    return repeats.op6_query(table(spark, sf_dir, "documents"))


@register("op11_phrases")
def q_phrases(spark, sf_dir):
    return phrases.op11_query(table(spark, sf_dir, "documents"))


@register("op12_spelling")
def q_spelling(spark, sf_dir):
    return spelling.op12_query(table(spark, sf_dir, "documents"))


@register("op13_toxicity")
def q_toxicity(spark, sf_dir):
    return toxicity.op13_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# The mix, the shards, the packing, the quality verdicts, the fuzzy notices and the toxicity scores depend on random
# digests, a tokenizer, matching rules or a fitted model that SQL does not have; tests compare them with plain Python.
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": ngram_join.ORACLE_SQL,
    "op11_phrases": phrases.ORACLE_SQL,
    "op12_spelling": spelling.ORACLE_SQL,
    "op6_suffix_dedup": repeats.ORACLE_SQL,
    "op7_top_k_search": topk.ORACLE_SQL,
    "op8_url_filters": urls.ORACLE_SQL,
    "op9_line_dedup": lines.ORACLE_SQL,
}
