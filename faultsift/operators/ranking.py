"""Ranking and ranking metrics.

A scored table has one row per (query, candidate) with `score` and `match` (0 or 1). Three tie
rules occur and are kept apart: hit@k and reciprocal rank break ties by candidate id, average
precision treats equal scores as one step, the pessimistic rank counts ties against the match.
A candidate without a score, or with NaN, stays and ranks as the lowest score there is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultsift.functions import measures
from faultsift.operators.running import id_block, numbered, running, with_score_block
from faultsift.operators.skew import hot_keys, skew_join

MAX_K = 20


def usable(score: Column) -> Column:
    """The score, minus infinity for null and NaN."""
    value = score.cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(float("-inf"))).otherwise(value)


def top_k(scored: DataFrame, query: list[str], candidate: str, k: int, score: str = "score") -> DataFrame:
    """The k best candidates per query with their rank, ties by candidate.

    Spark limits each group on the map side before the shuffle, so a large group costs k rows per
    task (while k is below spark.sql.optimizer.windowGroupLimitThreshold).
    """
    order = Window.partitionBy(*query).orderBy(usable(F.col(score)).desc(), F.asc(candidate))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def full_ranking(scored: DataFrame, query: list[str], candidate: str) -> DataFrame:
    """All candidates with their rank per query, best first, ties by candidate."""
    falling = scored.withColumn("_falling", -usable(F.col("score")))
    order = [F.col("_falling"), F.col(candidate)]
    ranked = numbered(with_score_block(falling, "_falling"), query, order, F.col("_block"), "rank")
    return ranked.drop("_falling", "_block")


def average_precision(scored: DataFrame, query: list[str], buckets: int | None = None) -> DataFrame:
    """Rows (query, n, positives, average_precision); 0 for a query without a match."""
    steps = scored.withColumn("score", usable(F.col("score"))).groupBy(*query, "score").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("match").cast("bigint").alias("_p")
    )
    blocked = with_score_block(steps, "score", buckets=buckets)
    ranked = running(
        blocked,
        query,
        [F.desc("score")],
        -F.col("_block"),
        sums={"_cn": F.col("_n"), "_cp": F.col("_p")},
    )
    gain = F.sum(F.col("_p") * F.col("_cp") / F.col("_cn"))
    summed = ranked.groupBy(*query).agg(
        F.sum("_n").alias("n"), F.sum("_p").alias("positives"), gain.alias("_gain")
    )
    precision = F.coalesce(F.try_divide("_gain", F.col("positives").cast("double")), F.lit(0.0))
    return summed.withColumn("average_precision", precision).drop("_gain")


def first_rank(scored: DataFrame, query: list[str], candidate: str) -> DataFrame:
    """Rows (query, n, positives, first_rank): rank of the best match, null without one.

    The rank is one plus the number of candidates ahead of the best match, counted with partial
    aggregates; nothing is sorted.
    """
    place = F.struct((-usable(F.col("score"))).alias("s"), F.col(candidate).alias("c"))
    best = scored.groupBy(*query).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("match").cast("bigint").alias("positives"),
        F.min(F.when(F.col("match") == 1, place)).alias("_best"),
    )
    slim = scored.select(*query, place.alias("_place"))
    joined = skew_join(slim, best, query, hot_keys(scored, query))
    ahead = F.sum((F.col("_place") < F.col("_best")).cast("bigint")) + 1
    return joined.groupBy(*query).agg(
        F.first("n").alias("n"), F.first("positives").alias("positives"), ahead.alias("first_rank")
    )


def pessimistic_rank(scored: DataFrame, query: list[str]) -> DataFrame:
    """Rows (query, rank): number of candidates scored at least as high as the one true candidate."""
    scored = scored.withColumn("score", usable(F.col("score")))
    truth = scored.where(F.col("match") == 1).groupBy(*query).agg(F.max("score").alias("_true"))
    joined = skew_join(scored.select(*query, "score"), truth, query, hot_keys(scored, query))
    return joined.groupBy(*query).agg(F.sum((F.col("score") >= F.col("_true")).cast("bigint")).alias("rank"))


def positive_ranks(scored: DataFrame, query: list[str], candidate: str) -> DataFrame:
    """Rank of every match against the non-matches of its query: 1 + number scored as high or higher."""
    scored = scored.withColumn("score", usable(F.col("score")))
    steps = scored.groupBy(*query, "score").agg(F.sum((F.col("match") == 0).cast("bigint")).alias("_neg"))
    ahead = running(
        with_score_block(steps, "score"), query, [F.desc("score")], -F.col("_block"), sums={"_ahead": F.col("_neg")}
    ).select(*query, "score", "_ahead")
    positives = scored.where(F.col("match") == 1).select(*query, candidate, "score")
    keys = [*query, "score"]
    joined = positives.join(ahead, keys)
    return joined.select(*query, candidate, (F.col("_ahead") + 1).alias("rank"))


def reciprocal(rank: Column) -> Column:
    """1 / rank, 0 without a rank."""
    return F.coalesce(F.try_divide(F.lit(1.0), rank.cast("double")), F.lit(0.0))


def mean_reciprocal_rank(ranks: DataFrame, group: list[str] | None = None, rank: str = "first_rank") -> DataFrame:
    return ranks.groupBy(*(group or [])).agg(F.avg(reciprocal(F.col(rank))).alias("mrr"))


def hit_at_k(ranks: DataFrame, group: list[str] | None = None, rank: str = "first_rank", max_k: int = MAX_K) -> DataFrame:
    """Rows (group, k, hits, queries, hit_rate) for k = 1 ... max_k, the rate to three places.

    One aggregate counts all k at once.
    """
    group = group or []
    counts = ranks.groupBy(*group).agg(
        F.count(F.lit(1)).alias("queries"),
        *[F.sum(F.when(F.col(rank) <= k, 1).otherwise(0)).alias(f"_h{k}") for k in range(1, max_k + 1)],
    )
    per_k = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_h{k}").alias("hits")) for k in range(1, max_k + 1)])
    return counts.select(*group, "queries", F.inline(per_k)).withColumn(
        "hit_rate", F.round(F.col("hits") / F.col("queries"), 3)
    )


def path_precision(ranked: DataFrame, fixes: DataFrame, query: list[str], file: str = "file", rank: str = "rank") -> DataFrame:
    """Average precision and first position where a fixed path occurs inside a predicted path.

    `ranked` has one row per query and rank, `fixes` one row per query with an array `fixes`, the
    list a report comes with. A prediction counts once per fix it contains. Without a hit: 0 and -1.
    """
    joined = skew_join(ranked, fixes, query, hot_keys(ranked, query), "left")
    hits = F.size(F.filter(F.coalesce("fixes", F.array().cast("array<string>")), lambda f: F.contains(F.col(file), f)))
    counted = joined.select(*query, F.col(rank).cast("bigint").alias("_rank"), hits.cast("bigint").alias("_hits"))
    before = running(
        counted, query, [F.col("_rank")], id_block(F.col("_rank")), sums={"_before": F.col("_hits")}, inclusive=False
    )
    hits, before_hits = F.col("_hits"), F.col("_before")
    gain = (hits * before_hits + hits * (hits + 1) / 2) / F.col("_rank")
    summed = before.groupBy(*query).agg(
        F.sum("_hits").alias("_found"),
        F.sum(gain).alias("_gain"),
        F.min(F.when(hits > 0, F.col("_rank"))).alias("_first"),
    )
    return summed.select(
        *query,
        F.coalesce(F.try_divide("_gain", F.col("_found").cast("double")), F.lit(0.0)).alias("average_precision"),
        F.coalesce("_first", F.lit(-1)).cast("bigint").alias("first_pos"),
    )


def margin_loss(scored: DataFrame, query: list[str], margin: float) -> DataFrame:
    """Mean pairwise margin loss over (match, non-match) pairs of a query that has one match."""
    positive = scored.where(F.col("match") == 1).groupBy(*query).agg(F.max("score").alias("_pos"))
    negatives = scored.where(F.col("match") == 0).select(*query, F.col("score").alias("_neg"))
    pairs = skew_join(negatives, positive, query, hot_keys(negatives, query))
    loss = measures.margin(F.col("_pos"), F.col("_neg"), margin)
    return pairs.groupBy(*query).agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("pairs"))


def metrics(scored: DataFrame, query: list[str], candidate: str, group: list[str] | None = None) -> DataFrame:
    """Long metrics table (group, metric, k, value): hit@1..20, MAP, MRR, evaluated queries.

    `group` names columns of the query key, such as the project. Queries without candidates have
    no rows and take no part; `evaluated` says how many did.
    """
    return metrics_of(first_rank(scored, query, candidate), average_precision(scored, query), group)


def metrics_of(ranks: DataFrame, precision: DataFrame, group: list[str] | None = None) -> DataFrame:
    """`metrics` from the first ranks and average precisions of the queries."""
    group = group or []
    hits = hit_at_k(ranks, group).select(
        *group, F.lit("hit").alias("metric"), "k", F.col("hit_rate").alias("value")
    )
    no_k = F.lit(None).cast("int").alias("k")
    summary = ranks.groupBy(*group).agg(
        F.avg(reciprocal(F.col("first_rank"))).alias("mrr"), F.count(F.lit(1)).cast("double").alias("evaluated")
    )
    mean = precision.groupBy(*group).agg(F.avg("average_precision").alias("map"))
    parts = [
        summary.select(*group, F.lit("mrr").alias("metric"), no_k, F.col("mrr").alias("value")),
        summary.select(*group, F.lit("evaluated").alias("metric"), no_k, F.col("evaluated").alias("value")),
        mean.select(*group, F.lit("map").alias("metric"), no_k, F.col("map").alias("value")),
    ]
    out = hits
    for part in parts:
        out = out.unionByName(part)
    return out
