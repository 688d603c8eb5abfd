"""Work that is done once, not once a fold or use."""

import pytest
from pyspark.sql import functions as F

from faultsift.operators import models, ranking, terms
from faultsift.plans import evaluation


def test_candidates_are_ranked_once_for_all_folds(spark, monkeypatch):
    query = F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 7)
    scored = spark.range(300).select(
        query.alias("q"), F.col("id").alias("c"), (F.col("id") * 7 % 13 / 10).alias("score"), (F.col("id") % 5 == 0).cast("int").alias("match")
    ).withColumn("fold", (F.col("q") % 3).cast("int"))
    want = evaluation.fold_metrics(models.fold_sides(scored, 3), ["q"], "c").collect()
    ranked, plain = [], ranking.first_rank
    monkeypatch.setattr(ranking, "first_rank", lambda df, *a: ranked.append(df.count()) or plain(df, *a))
    got = evaluation.untrained_fold_metrics(scored, ["q"], "c", 3).collect()
    rows = lambda found: sorted((r.side, str(r.fold), r.metric, str(r.k), round(r.value, 9)) for r in found)
    assert rows(got) == rows(want) and ranked == [300]


def test_weights_are_read_once(spark):
    tf = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "x", 3), (None, "x", 1), ("c", "z", 1)], "d string, term string, tf long")
    vocabulary = spark.createDataFrame([("x", 2, 1.5), ("y", 1, 0.5), ("z", 1, 0.0)], "term string, df long, idf double")
    unit = terms.unit_tfidf(tf, vocabulary, ["d"])
    assert unit._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    got = {(r.d, r.term): r.weight for r in unit.collect()}
    assert got == pytest.approx({("a", "x"): 3 / 9.25**0.5, ("a", "y"): 0.5 / 9.25**0.5, ("b", "x"): 1.0})
