"""Evaluation jobs: result tables and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultsift.operators import models, ranking
from faultsift.session import stage
from faultsift.sources import writers


def evaluated(scored: DataFrame, query: list[str], candidate: str, group: list[str] | None = None) -> DataFrame:
    """Metrics of a scored table. The table is written once, as several measures read it."""
    return ranking.metrics(stage(scored), query, candidate, group)


def project_results(scored: DataFrame, query: list[str], candidate: str, group: list[str]) -> DataFrame:
    """One row per project: map, mrr and the number of evaluated reports."""
    slim = stage(scored.select(*query, candidate, "score", "match"))
    ranks = ranking.first_rank(slim, query, candidate)
    precision = ranking.average_precision(slim, query).drop("n", "positives")
    both = ranks.join(precision, query)
    return both.groupBy(*group).agg(
        F.avg("average_precision").alias("map"),
        F.avg(ranking.reciprocal(F.col("first_rank"))).alias("mrr"),
        F.count(F.lit(1)).alias("reports"),
    )


def fold_metrics(sides: DataFrame, query: list[str], candidate: str) -> DataFrame:
    """Metrics (side, fold, metric, k, value) of every fold and side, and their mean over folds.

    `sides` has `fold` and `side` beside the scores, as `models.cross_validated_sides` gives them.
    The mean has a null fold and three decimal places.
    """
    group = ["side", "fold"]
    slim = stage(sides.select(*group, *query, candidate, "score", "match"))
    return _with_mean(ranking.metrics(slim, [*group, *query], candidate, group))


def untrained_fold_metrics(scored: DataFrame, query: list[str], candidate: str, k: int) -> DataFrame:
    """`fold_metrics` of `models.fold_sides` for a score that needs no training; needs `fold`.

    A report has the same ranks in every fold, so candidates are ranked once and only reports are repeated.
    """
    own = ["fold", *query]
    slim = stage(scored.select(*own, candidate, "score", "match"))
    ranks = models.fold_sides(stage(ranking.first_rank(slim, own, candidate)), k)
    precision = models.fold_sides(ranking.average_precision(slim, own), k)
    return _with_mean(ranking.metrics_of(ranks, precision, ["side", "fold"]))


def _with_mean(metrics: DataFrame) -> DataFrame:
    per_fold = stage(metrics)
    mean = per_fold.groupBy("side", "metric", "k").agg(F.round(F.avg("value"), 3).alias("value"))
    return per_fold.unionByName(mean.withColumn("fold", F.lit(None).cast("int")))


def write_results(scored: DataFrame, query: list[str], candidate: str, group: list[str], path: str) -> None:
    """Metrics as JSON and as a long table, rankings as text, below one folder."""
    table = stage(evaluated(scored, query, candidate, group))
    writers.metrics(table, f"{path}/metrics")
    writers.metrics_json(table, group).write.mode("overwrite").json(f"{path}/results")
    writers.scores(scored, f"{path}/scores", query=query[-1], candidate=candidate)
