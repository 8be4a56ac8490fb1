"""Queries p2, p4 and p5 over the test tables; plans, schemas and parameters as in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.functions.tables import table
from docfacts.operators import drift, nested, units


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.linked_rows(table(spark, d, "service_output"))


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested.nodes(table(spark, d, "service_output"), ["delivery_id"], "payload")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    limits = units.service_limits_per_year(table(spark, d, "benefit_rows"))
    premiums = units.premiums_per_year(table(spark, d, "premium_fields"))
    both = limits.select(F.lit("frequency").alias("src"), F.col("row_id").alias("record_id"), "per_year").union(premiums.select(F.lit("premium").alias("src"), F.col("premium_id").alias("record_id"), "per_year"))
    return both.distinct()


def p4_days(spark: SparkSession, d: str) -> DataFrame:
    """Moments that are told as seconds, as days since 1970 and as days of a spreadsheet (one in each of three rows), as whole Julian days."""
    rows = table(spark, d, "benefit_rows").select("row_id", F.unix_seconds("extracted_at").alias("s"), F.floor(F.unix_seconds("extracted_at") / 86_400).alias("day"))
    kind = F.element_at(F.array(*map(F.lit, ("unix_second", "unix_day", "sheet_day"))), (F.pmod("row_id", F.lit(3)) + 1).cast("int"))
    told = F.when(F.col("unit") == "unix_second", F.col("s")).when(F.col("unit") == "unix_day", F.col("day")).otherwise(F.col("day") + 25_569)
    rows = rows.withColumn("unit", kind).withColumn("told", told)
    return units.convert(rows, units.conversion_table(spark, units.MOMENT_EDGES, "julian_day"), "unit", F.col("told"), F.lit(1), "julian_day").select("row_id", "unit", "told", "julian_day")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "extraction_report"), table(spark, d, "guide_cells"))


def p5_cells(spark: SparkSession, d: str) -> DataFrame:
    return drift.united(table(spark, d, "extraction_report"), table(spark, d, "guide_cells"), every=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_nodes, p4_found, p4_days, p5_found, p5_cells)}
