"""Queries p1, p3, p6, p7, p8 and p9 over the test tables; plans, schemas and parameters as in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.functions.tables import table
from docfacts.llm import canon_map, eval_leak, forced_bpe, format_copies, natural_cuts, one_form


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    _, members = format_copies.collapse(table(spark, d, "benefit_rows"))
    return members.select("keep_id", "copy_id")


def p1_lines(spark: SparkSession, d: str) -> DataFrame:
    lines, _ = format_copies.collapse(table(spark, d, "benefit_rows"))
    return lines.select("guide_id", "keep_id", "n_copies")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "benefit_rows").where("benefit_group NOT IN ('', '-')").select(F.lit("group").alias("src"), F.col("row_id").alias("record_id"), F.col("benefit_group").alias("entered"))
    labels = table(spark, d, "extraction_report").select(F.lit("column").alias("src"), F.col("report_id").alias("record_id"), F.explode("columns_unmapped").alias("entered"))
    return canon_map.map_records(groups.union(labels), table(spark, d, "canon_terms"))


def _odd_texts(spark: SparkSession, d: str) -> DataFrame:
    descriptions = table(spark, d, "benefit_rows").select(F.lit("description").alias("src"), F.col("guide_id").cast("string").alias("grp"), F.col("row_id").alias("id"), F.col("description").alias("text"))
    quotes = table(spark, d, "premium_fields").select(F.lit("quote").alias("src"), F.col("plan_key").alias("grp"), F.col("premium_id").alias("id"), F.col("evidence_quote").alias("text"))
    return descriptions.union(quotes)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return one_form.lookalikes(_odd_texts(spark, d))


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    return one_form.forms(_odd_texts(spark, d)).select("src", "id", "form")


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    return one_form.classes(_odd_texts(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return forced_bpe.encode_column(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return eval_leak.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return eval_leak.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return natural_cuts.cut(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_lines, p3_found, p6_found, p6_forms, p6_classes, p7_ids, p8_found, p8_leaks, p9_pieces)}
