"""Running sums and maxima over groups of any size.

A window over a whole group runs in one task. Here a group is cut into buckets that follow its
order; a window runs inside each (group, bucket) and the totals of the earlier buckets are added.
Results are exact. The bucket only has to grow with the order: a day for times, leading digits
for hashes, a block of numbers for ids, quantiles for scores.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultsift.operators.skew import dealt

BLOCK = 1 << 20
MIN_SCORE_BUCKETS = 256
MAX_SCORE_BUCKETS = 10_000


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    bucket: Column,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    inclusive: bool = True,
    totals: Mapping[str, str] | None = None,
    size: int | None = None,
) -> DataFrame:
    """Add running aggregates to `df`, which has one row per `keys` and `order`.

    `sums` and `maxima` name new columns; without earlier rows they are 0 and null. With
    `inclusive=False` the current row does not count. `totals` maps the name of a sum to a new
    column with its total over the group. `size`, the number of rows, bounds the rows of a task. Every row stays: null keys are a group like any other,
    and rows without a bucket come after all that have one.
    """
    sums, maxima, totals = dict(sums or {}), dict(maxima or {}), dict(totals or {})
    # One struct, which is never null, names a bucket of a group; windows, totals and the join
    # below are all dealt by it.
    base = df.withColumn("_bucket", bucket).withColumn("_place", F.struct(*keys, "_bucket"))
    for name, value in {**sums, **maxima}.items():
        base = base.withColumn(f"_in_{name}", value)
    if size is not None:
        base = dealt(base, size, "_place")

    last = 0 if inclusive else -1
    inside = (
        Window.partitionBy("_place").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    )
    rows = base
    for name in sums:
        rows = rows.withColumn(name, F.coalesce(F.sum(f"_in_{name}").over(inside), F.lit(0)))
    for name in maxima:
        rows = rows.withColumn(name, F.max(f"_in_{name}").over(inside))

    per_bucket = base.groupBy("_place").agg(
        *[F.sum(f"_in_{name}").alias(f"_b_{name}") for name in sums],
        *[F.max(f"_in_{name}").alias(f"_b_{name}") for name in maxima],
    )
    group = Window.partitionBy(*[F.col("_place")[k] for k in keys] or [F.lit(0)])
    before = group.orderBy(F.asc_nulls_last(F.col("_place._bucket"))).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        "_place",
        (F.count(F.lit(1)).over(before) > 0).alias("_later"),
        *[F.coalesce(F.sum(f"_b_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in sums],
        *[F.max(f"_b_{name}").over(before).alias(f"_o_{name}") for name in maxima],
        *[F.sum(f"_b_{name}").over(group).alias(total) for name, total in totals.items()],
    )
    if totals:
        out = rows.join(offsets, "_place")
    else:
        # A first bucket has nothing before it; most groups have no other.
        out = rows.join(offsets.where(F.col("_later")), "_place", "left")
    for name in sums:
        out = out.withColumn(name, F.col(name) + F.coalesce(F.col(f"_o_{name}"), F.lit(0)))
    for name in maxima:
        out = out.withColumn(name, F.greatest(name, f"_o_{name}"))
    return out.select(*df.columns, *sums, *maxima, *totals.values())


def numbered(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str, total: str | None = None
) -> DataFrame:
    """A 1-based row number per group, `total` naming a column for the size of the group.

    `order` must tell all rows of a group apart.
    """
    totals = {name: total} if total else None
    return running(df, keys, order, bucket, sums={name: F.lit(1)}, totals=totals)


def id_block(number: Column, block: int = BLOCK) -> Column:
    """Bucket of an integer order column: blocks of consecutive numbers."""
    return F.floor(number / block)


def hash_block(digest: Column, digits: int = 3) -> Column:
    """Bucket of a hexadecimal digest order column."""
    return F.substring(digest, 1, digits)


def with_score_block(df: DataFrame, score: str, name: str = "_block", buckets: int | None = None) -> DataFrame:
    """Add a bucket for a double order column: quantiles of the whole column.

    Every bucket has about rows / buckets rows however the rows spread over groups; there are as
    many buckets as shuffle partitions, within bounds. Finding the boundaries is one pass over
    `df`, and they are all that reaches the driver.
    """
    if buckets is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(MIN_SCORE_BUCKETS, min(MAX_SCORE_BUCKETS, partitions))
    discretizer = QuantileDiscretizer(
        numBuckets=buckets, inputCol=score, outputCol=name, relativeError=0.25 / buckets, handleInvalid="keep"
    )
    return discretizer.fit(df).transform(df)
