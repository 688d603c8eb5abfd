"""Scalar formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The smoothed inverse document frequency of a term in a collection of two texts,
# ln((1 + 2) / (1 + df)) + 1, for a term of one text only; a shared term has 1.
UNSHARED_IDF = math.log(3 / 2) + 1

# Weights of the direct and the indirect score.
DIRECT_WEIGHT = 0.8
INDIRECT_WEIGHT = 0.2


def months_between(a: Column, b: Column) -> Column:
    """Calendar months apart; days do not count."""
    return F.abs((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b))


def recency(report_time: Column, last_time: Column) -> Column:
    """1 / (months since the latest earlier report + 1), 0 without one."""
    return F.coalesce(1.0 / (months_between(report_time, last_time) + 1), F.lit(0.0))


def damped_tf(tf: Column) -> Column:
    return F.log1p(tf.cast("double"))


def idf(documents: Column, df: Column, base: float | None = None) -> Column:
    """ln(D / df), or the logarithm to another base."""
    ratio = documents.cast("double") / df
    return F.log(ratio) if base is None else (F.log2(ratio) if base == 2 else F.log(float(base), ratio))


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def scaled_length(size: Column, mean: Column, sd: Column) -> Column:
    """6 (x - min) / (high - min) with high = mean + 3 sd and min = trunc(mean - 3 sd), not below 0."""
    low, high = mean - 3 * sd, mean + 3 * sd
    least = F.when(low > 0, F.floor(low).cast("double")).otherwise(F.lit(0.0))
    return 6 * (size - least) / (high - least)


def length_score(size: Column, mean: Column, sd: Column) -> Column:
    """0 for an empty file, 0.5 below mean - 3 sd, 1 above mean + 3 sd, logistic between."""
    return (
        F.when(size == 0, F.lit(0.0))
        .when(size < mean - 3 * sd, F.lit(0.5))
        .when(size > mean + 3 * sd, F.lit(1.0))
        .otherwise(logistic(scaled_length(size, mean, sd)))
    )


def min_max(x: Column, low: Column, high: Column, constant: Column | None = None) -> Column:
    """Scale to [0, 1]. A constant group keeps x, or becomes `constant` where that is given."""
    return F.when(high != low, (x - low) / (high - low)).otherwise(x if constant is None else constant)


def blended(direct: Column, indirect: Column) -> Column:
    """0.8 direct + 0.2 indirect; the direct score alone, in full, where there is no indirect one."""
    return F.when(
        indirect.isNotNull(), DIRECT_WEIGHT * direct + INDIRECT_WEIGHT * indirect
    ).otherwise(direct)


def pair_cosine(dot: Column, shared1: Column, all1: Column, shared2: Column, all2: Column) -> Column:
    """Cosine of two texts under smoothed TF-IDF fitted on just these two texts.

    `dot` is the sum of tf1 * tf2 over shared terms, `shared` and `all` are sums of tf * tf over
    shared terms and over all terms. Null where neither text has a term.
    """
    c2 = UNSHARED_IDF**2
    norm = F.sqrt(shared1 + c2 * (all1 - shared1)) * F.sqrt(shared2 + c2 * (all2 - shared2))
    return (
        F.when((all1 == 0) & (all2 == 0), F.lit(None).cast("double"))
        .when(dot == 0, F.lit(0.0))
        .otherwise(dot / norm)
    )


def no_nan(x: Column) -> Column:
    return F.nanvl(x, F.lit(0.0))


def margin(positive: Column, negative: Column, size: float) -> Column:
    """Pairwise margin loss, not below 1e-6."""
    return F.greatest(size - positive + negative, F.lit(1e-6))
