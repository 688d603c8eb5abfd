"""Term vectors, weights and sparse cosine.

A sparse vector is a set of rows (document key, term, weight). Pairs to compare come as a table,
the candidate pool. A pair meets the vectors of its two documents in a cell (`operators.cells`), so
what is shuffled grows with the vectors and the pool, not with the terms of all pairs.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultsift.functions import measures
from faultsift.functions.arrays import FIRST_CORE_ID
from faultsift.operators.cells import shared_sums
from faultsift.operators.running import numbered
from faultsift.operators.skew import hot_keys


def term_frequencies(docs: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """Rows (keys, term, tf). A document is one row, so counting is done before the shuffle."""
    return (
        docs.select(*keys, F.explode(tokens).alias("term"))
        .groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    )


def document_frequencies(tf: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows (by, term, df) from one row per document and term."""
    return tf.groupBy(*(by or []), "term").agg(F.count(F.lit(1)).alias("df"))


def _scalar(df: DataFrame, value: Column) -> Column:
    """A single value as a scalar subquery."""
    return df.agg(value).scalar()


def idf_table(tf: DataFrame, documents: DataFrame, base: float | None = None) -> DataFrame:
    """Rows (term, df, idf) with idf = log(D / df) over all rows of `documents`."""
    size = _scalar(documents, F.count(F.lit(1)))
    return document_frequencies(tf).withColumn("idf", measures.idf(size, F.col("df"), base))


def tfidf(tf: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Weights ln(tf + 1) * idf; terms outside the vocabulary are dropped, nothing is normalised."""
    weighted = tf.join(vocabulary, "term")
    return weighted.withColumn("weight", measures.damped_tf(F.col("tf")) * F.col("idf")).drop("df", "idf")


def unit_tfidf(tf: DataFrame, vocabulary: DataFrame, keys: list[str]) -> DataFrame:
    """Weights tf * idf scaled to length one per document; zero vectors are dropped."""
    weight = F.col("weight").cast("double")
    length = F.sqrt(F.sum(weight * weight).over(Window.partitionBy(*keys)))
    weighted = tf.na.drop(subset=keys).join(vocabulary, "term").withColumn("weight", F.col("tf") * F.col("idf"))
    return weighted.withColumn("length", length).where(F.col("length") > 0).select(
        *keys, "term", "tf", (F.col("weight") / F.col("length")).alias("weight")
    )


def lengths(weights: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """Euclidean length per document."""
    square = F.col(weight).cast("double") * F.col(weight).cast("double")
    return weights.groupBy(*keys).agg(F.sqrt(F.sum(square)).alias("length"))


def sparse_cosine(
    pairs: DataFrame,
    left: DataFrame,
    right: DataFrame,
    left_keys: list[str],
    right_keys: list[str],
    name: str = "cosine",
) -> DataFrame:
    """Cosine of weighted vectors for every pair, 0 where nothing is shared. One row per pair."""
    met = shared_sums(pairs, left, [right], left_keys, right_keys, "weight", hot_keys(pairs, right_keys))
    cosine = F.coalesce(F.try_divide("_dot0", F.sqrt("_la") * F.sqrt("_ra0")), F.lit(0.0))
    return met.select(*pairs.columns, cosine.alias(name))


def pair_cosine(
    pairs: DataFrame,
    left: DataFrame,
    right: DataFrame,
    left_keys: list[str],
    right_keys: list[str],
    name: str = "similarity",
) -> DataFrame:
    """Cosine of two texts under TF-IDF fitted on these two texts alone. One row per pair.

    Takes term frequencies; 0 when one text has no term, null when neither has one.
    """
    return pair_cosines(pairs, left, {name: right}, left_keys, right_keys)


def pair_cosines(
    pairs: DataFrame, left: DataFrame, rights: Mapping[str, DataFrame], left_keys: list[str], right_keys: list[str]
) -> DataFrame:
    """`pair_cosine` of the left text with several texts of the right side in one pass.

    `rights` maps the name of a similarity to term frequencies. The inverse document frequency
    has two possible values, so sums over shared terms are all it takes.
    """
    met = shared_sums(pairs, left, list(rights.values()), left_keys, right_keys, "tf", hot_keys(pairs, right_keys))
    zero = F.lit(0.0)
    return met.select(
        *pairs.columns,
        *[
            measures.pair_cosine(*[F.coalesce(c, zero) for c in (f"_dot{i}", f"_ls{i}", "_la", f"_rs{i}", f"_ra{i}")]).alias(name)
            for i, name in enumerate(rights)
        ],
    )


def squares(tf: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of squared term frequencies per document."""
    square = F.col("tf").cast("double") * F.col("tf").cast("double")
    return tf.groupBy(*keys).agg(F.sum(square).alias("squares"))


def vocabulary_ids(tf: DataFrame, first_id: int = FIRST_CORE_ID) -> DataFrame:
    """Rows (term, id), ids following the sorted order of the terms."""
    terms = tf.select("term").distinct()
    ranked = numbered(terms, [], [F.col("term")], F.substring("term", 1, 3), "_rn")
    return ranked.select("term", (F.col("_rn") + (first_id - 1)).alias("id"))
