"""One group holds a third of the rows: results stay whole and work is spread."""

import re

import pytest
from pyspark.sql import functions as F

from faultsift.operators import history, ranking, running, scoring, skew, terms


@pytest.fixture()
def eager_salting(monkeypatch):
    """Treat every key with ten rows as hot."""

    def hot(df, keys):
        return skew.hot_keys(df, keys, min_rows=10)

    for module in (ranking, scoring, terms):
        monkeypatch.setattr(module, "hot_keys", hot)


def scored(spark):
    query = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40)
    score = F.pmod(F.xxhash64("id"), F.lit(500)) / 500
    match = (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9)) == 0).cast("int")
    return spark.range(6000).select(query.alias("q"), F.col("id").alias("c"), score.alias("score"), match.alias("match"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ranks_with_a_hot_query(spark, eager_salting):
    df = scored(spark)
    order = "row_number() OVER (PARTITION BY q ORDER BY score DESC, c)"
    plain = df.selectExpr("q", "match", f"{order} AS rn").groupBy("q").agg(
        F.count(F.lit(1)).alias("n"), F.sum("match").alias("p"), F.min(F.when(F.col("match") == 1, F.col("rn"))).alias("f")
    )
    assert rows(ranking.first_rank(df, ["q"], "c")) == rows(plain)


def test_no_window_sees_the_whole_hot_query(spark):
    df = running.with_score_block(scored(spark), "score", buckets=32)
    sizes = df.groupBy("q", "_block").count().where("q = 0").collect()
    assert len(sizes) >= 30 and max(r["count"] for r in sizes) < 300


def test_links_and_indirect_scores_with_a_hot_key(spark, eager_salting):
    pools = spark.range(60).select(F.col("id").alias("report_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"))
    links = scoring.links(pools, pools)
    expected = {(a, b) for a in range(60) for b in range(60) if a != b and (a % 3 == b % 3 == 0)}
    assert {tuple(r) for r in links.collect()} == expected
    similar = links.withColumn("similarity", (F.col("report_id") * 7 + F.col("other_id") * 3) % 11 / 10)
    best = {(r.report_id, r.key): r.score for r in scoring.indirect_scores(similar, pools).collect()}
    assert best == {
        (a, 0): max((a * 7 + b * 3) % 11 / 10 for b in range(0, 60, 3) if b != a) for a in range(0, 60, 3)
    }


def test_similarity_with_a_hot_file(spark, eager_salting):
    docs = spark.range(40).select(F.col("id"), F.array(F.concat(F.lit("t"), (F.col("id") % 4).cast("string")), F.lit("all")).alias("ts"))
    tf = terms.term_frequencies(docs, ["id"], F.col("ts"))
    left, right = tf.withColumnRenamed("id", "r"), tf.withColumnRenamed("id", "f")
    pairs = spark.range(40).select(F.col("id").alias("r"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("f"))
    got = {(x.r, x.f): round(x.similarity, 9) for x in terms.pair_cosine(pairs, left, right, ["r"], ["f"]).collect()}
    assert len(got) == 40
    for (r, f), value in got.items():
        assert (value == 1.0) == (r % 4 == f % 4)


def test_rows_of_a_task_are_bounded(spark, monkeypatch, tmp_path):
    """More touches mean more tasks, whatever the number of shuffle partitions."""
    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    at = F.timestamp_seconds(F.lit(10_000_000) * (F.col("id") % 7))
    touched = spark.range(3_000).select(F.col("id").alias("report_id"), (F.col("id") % 50).alias("file"), at.alias("report_time"))
    found = history.recency_and_frequency(touched, touched.withColumn("file", F.col("file") + 1))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(file") >= 3 and ", 60)" in plan and not re.search(r"hashpartitioning\((file|_place)[^)]*, 4\)", plan)
    got = {(r.report_id, r.file): r.bug_frequency for r in found.collect()}
    rows = [(r.report_id, r.file, r.report_time) for r in touched.collect()]
    before = lambda file, time: sum(f == file and t < time for _, f, t in rows)
    assert len(got) == 3_000 and all(got[i, f + 1] == before(f + 1, t) for i, f, t in rows[::37])
