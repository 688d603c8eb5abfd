"""Joins that stay balanced when one key holds a large share of the rows.

Adaptive execution splits the partitions of a hot key by itself in a join whose result is
shuffled again or written, so joins that only look up one row per key are plain joins. It cannot
do so where the rows of a key are multiplied by the join or aggregated by the same key right
after; `skew_join` is for those.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 10_000
SALTS = 64
#: Rows of a task where sorts and hash tables hold them, in the mean.
TASK_ROWS = 500_000


def hot_keys(
    df: DataFrame, keys: list[str], min_rows: int = HOT_ROWS, limit: int = MAX_HOT_KEYS
) -> DataFrame:
    """The most frequent keys with at least `min_rows` rows, `limit` of them at most.

    The bound makes the result safe to broadcast; with n rows in all, a key left out has at most
    max(min_rows, n / limit) rows.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.where(F.col("_rows") >= min_rows).orderBy(F.desc("_rows"), *keys).limit(limit).select(*keys)


def skew_join(
    big: DataFrame,
    other: DataFrame,
    on: list[str],
    hot: DataFrame,
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join where the rows of hot keys of `big` are spread over `salts` partitions.

    `hot` holds hot values of some of the columns `on` (see `hot_keys`). Only the matching rows
    of `other` are repeated. The salt is a hash of the row, so a retried task repeats itself.
    """
    keys = hot.columns
    marked = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    spread = F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")
    left = big.join(marked, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0))
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = other.join(marked, keys, "left").withColumn("_salt", F.explode(copies))
    return left.drop("_hot").join(right.drop("_hot"), [*on, "_salt"], how).drop("_salt")


def unsent(df: DataFrame) -> DataFrame:
    """Mark a table that grows with the input so that a join with it shuffles both sides.

    The planner takes a computed text for twenty bytes and a scan for its compressed files, and sends
    tables that are many times larger through the driver.
    """
    return df.hint("merge")


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df`, which has about `rows` rows, dealt by `keys` to tasks of TASK_ROWS rows at most, in the mean.

    Small rows take many times their compressed size in sorts and hash tables, so neither a fixed number of
    partitions nor one that adaptive execution derives from bytes bounds the memory of a task.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, math.ceil(rows / TASK_ROWS)), *keys)
