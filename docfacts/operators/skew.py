"""Joins that stay balanced when one key holds a large share of all rows.

A key is hot if it holds more than ``1 / HOT_PARTS`` of the rows counted. The counts add up to the number of
rows, so there are fewer than ``HOT_PARTS`` hot keys whatever the data: that is the size bound of every
broadcast made here. Rows of hot keys never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_PARTS = 1000


def hot_part(counted: DataFrame, count_col: str, total: int, parts: int = HOT_PARTS) -> DataFrame:
    """The rows of a counted table (one row for each key) whose count exceeds total / parts."""
    return counted.where(F.col(count_col) > F.lit(max(total // parts, 1)))


def lookup(big: DataFrame, keys: dict[str, Column], entries: DataFrame, value: str, count_col: str, total: int, spread: Column, how: str = "left") -> DataFrame:
    """big with the column ``value`` of the entry whose key columns equal the given expressions.

    big: rows, any key may be hot. keys: entry column -> expression over big. entries: one row for each key, with
    ``value`` and ``count_col`` (rows of big that have the key). spread: a column of big that differs from row to
    row. Hot entries (fewer than HOT_PARTS) are broadcast; the others are joined by shuffle, where rows already
    answered by the broadcast carry a key of their own, so that they are spread over all tasks. Null keys find
    nothing: value is null ("left") or the row is left out ("inner").
    """
    names = list(keys)
    tmp = [f"__k{i}" for i in range(len(names))]
    big = big.withColumns(dict(zip(tmp, keys.values())))
    hot = hot_part(entries, count_col, total).select(*[F.col(n).alias(f"__h{i}") for i, n in enumerate(names)], F.col(value).alias("__hot"), F.lit(True).alias("__is"))
    cond = [F.col(t) == F.col(f"__h{i}") for i, t in enumerate(tmp)]
    step = big.join(F.broadcast(hot), cond, "left").drop(*[f"__h{i}" for i in range(len(names))])
    answered = F.col("__is").isNotNull()
    lone = F.when(answered | F.greatest(*[F.col(t).isNull().cast("int") for t in tmp], F.lit(0)).cast("boolean"), F.xxhash64(spread)).otherwise(F.lit(0))
    cold = entries.where(F.col(count_col) <= F.lit(max(total // HOT_PARTS, 1))).select(*[F.col(n).alias(f"__c{i}") for i, n in enumerate(names)], F.col(value).alias("__cold"), F.lit(0).cast("bigint").alias("__lone_c"))
    step = step.withColumn("__lone", lone)
    cond = [F.col("__lone") == F.col("__lone_c")] + [F.coalesce(F.col(t), _zero(step, t)) == F.col(f"__c{i}") for i, t in enumerate(tmp)]
    out = step.join(cold, cond, "left").withColumn(value, F.coalesce("__hot", "__cold"))
    out = out.drop(*tmp, "__hot", "__is", "__lone", "__cold", "__lone_c", *[f"__c{i}" for i in range(len(names))])
    return out if how == "left" else out.where(F.col(value).isNotNull())


def _zero(df: DataFrame, name: str) -> Column:
    """A value of the column's own type in place of null, so that null keys are spread by their own key."""
    kind = df.schema[name].dataType
    return F.lit("").cast(kind) if kind.typeName() == "string" else F.lit(0).cast(kind)


def salted_pairs(a: DataFrame, b: DataFrame, keys: list[str], total: int, spread_b: str, salts: int = 32) -> DataFrame:
    """Inner equi-join of a and b on ``keys`` in which the rows of a hot key of b are split over ``salts`` tasks.

    Both sides name the keys alike; other columns must differ. Rows of a with a hot key are repeated once for
    each salt, those of b are not. The hot keys are found by counting b (pre-aggregated before the shuffle).
    """
    hot = hot_part(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), "__n", total).select(*keys, F.lit(True).alias("__hot"))
    b = b.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread_b), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("__hot")
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    a = a.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(every)).drop("__hot")
    return a.join(b, [*keys, "__salt"]).drop("__salt")
