"""Records that differ only in letter case, white space, punctuation or the order of their fields (problem 1).

Dictionary encoding: every distinct value is brought to its canonical form once and gets an integer identifier; a
record becomes the sorted tuple of its values' identifiers; equal tuples are copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfacts.functions.tables import durable
from docfacts.operators import skew


def canonical(value: Column) -> Column:
    """Lower case, letters, digits and combining marks only: accents and look-alike letters keep values apart."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}\p{M}]+", "")


def dictionary(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(value, ident STRUCT<h BIGINT, r INT>, n): one row for each distinct value of any of the fields.

    The identifier is the 64-bit hash of the canonical form and a rank that tells apart canonical forms of one hash,
    so that equal identifiers mean equal forms with certainty and a lost partition is made again alike. n counts the
    records' fields that hold the value; counts are pre-aggregated before the shuffle.
    """
    values = rows.select(F.explode(F.array(*[F.col(f) for f in fields])).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    values = values.withColumn("form", canonical(F.col("value"))).withColumn("h", F.xxhash64("form"))
    rank = F.dense_rank().over(Window.partitionBy("h").orderBy("form"))
    return values.withColumn("ident", F.struct("h", rank.alias("r"))).select("value", "ident", "n")


def encode(rows: DataFrame, id_col: str, group_col: str, fields: list[str], total: int) -> DataFrame:
    """(id, group, tuple): each record as the sorted identifiers of its fields. Records with a null field are left out."""
    rows = rows.select(id_col, group_col, *fields).dropna(subset=fields)
    entries = durable(dictionary(rows, fields))
    names = []
    for i, f in enumerate(fields):
        rows = skew.lookup(rows, {"value": F.col(f)}, entries, "ident", "n", total * len(fields), F.col(id_col)).withColumnRenamed("ident", f"__i{i}").drop(f)
        names.append(f"__i{i}")
    return rows.select(id_col, group_col, F.array_sort(F.array(*names)).alias("tuple"))


def collapse(rows: DataFrame, id_col: str = "row_id", group_col: str = "guide_id", fields: tuple[str, ...] = ("dental_code", "description")) -> tuple[DataFrame, DataFrame]:
    """(lines, members) of records that hold the same content whichever of the fields holds which.

    lines: (group, keep_id, n_copies), one row for each set of copies, keep_id the smallest id of the set.
    members: (group, keep_id, copy_id), one row for each other id of a set.

    Values are compared without letter case, white space, punctuation and signs. Records with a null in one of the
    fields are in neither result; empty values and values of punctuation alone are equal to each other; a null group
    is a group like any other; a repeated id counts as a copy once for each row and as a member once. Columns besides
    the named ones are ignored, so clashing names do no harm. An empty table gives two empty results.
    """
    fields = list(fields)
    rows = rows.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
    total = rows.count()
    tuples = durable(encode(rows, "id", "grp", [f"f{i}" for i in range(len(fields))], total))
    keyed = tuples.withColumn("grp_", F.coalesce(F.col("grp").cast("string"), F.lit("\0")))
    sets = keyed.groupBy("grp_", "tuple").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"), F.first("grp").alias("grp"))
    lines = sets.select(F.col("grp").alias(group_col), "keep_id", F.col("n").alias("n_copies"))
    several = sets.where("n > 1").select("grp_", F.to_json("tuple").alias("key"), "keep_id", "n")
    found = skew.lookup(keyed.withColumn("key_", F.to_json("tuple")), {"grp_": F.col("grp_"), "key": F.col("key_")}, several, "keep_id", "n", total, F.col("id"), how="inner")
    members = found.where("id <> keep_id").select(F.col("grp").alias(group_col), "keep_id", F.col("id").alias("copy_id")).distinct()
    return lines, members
