"""The registered corpus queries, with the SQL each must equal where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import (
    alignment, decontaminate, html_extract, language_id, line_dedup, packing, pieces, pii, quality_mil, quality_rules,
    simhash, span_dedup, spelling,
)
from attesta.llm.common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def register(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


@register("op1_quality_rules")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.report(documents(spark, folder))


@register("op2_pii")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(documents(spark, folder))


@register("op3_simhash_near_duplicates")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.report(documents(spark, folder))


@register("op4_html_extraction")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, folder, "pages"))


@register("op5_benchmark_decontamination", decontaminate.SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(documents(spark, folder), table(spark, folder, "benchmark"))


@register("op6_best_fit_packing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(documents(spark, folder), tokenizer_path())


@register("op7_line_dedup", line_dedup.SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.report(documents(spark, folder))


@register("op8_language_id")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.report(documents(spark, folder))


@register("op9_span_dedup", span_dedup.SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return span_dedup.report(documents(spark, folder))


@register("op10_quality_classifier")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return quality_mil.report(documents(spark, folder), table(spark, folder, "labels"))


@register("op11_sentencepiece")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.report(documents(spark, folder), tokenizer_path("piece_bpe_32k.model"))


@register("op12_spelling_variants", spelling.SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.report(documents(spark, folder))


@register("op13_tokenizer_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.report(documents(spark, folder), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
