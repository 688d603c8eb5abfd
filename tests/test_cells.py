"""Pairs meet the vectors of their documents in cells."""

import random
import re

import pytest
from pyspark.sql import functions as F

from faultsift.operators import cells, scoring, skew, terms

TF = "k long, term string, tf long"


def tables(spark, seed):
    """Terms that come twice or are null, pairs that come twice, have a null key or a document without terms."""
    rng = random.Random(seed)
    left, right = ([(rng.choice([k, None]) if k > 25 else k, rng.choice([f"t{t}", "t0", None]), rng.choice([1, 2, None]))
                    for k in range(30) for t in range(rng.randrange(0, n))] for n in (9, 25))
    pairs = [(rng.choice([None, *range(32)]), rng.choice([None, 0, 0, 0, *range(40)]), rng.randrange(3)) for _ in range(400)]
    return left, right, pairs


@pytest.mark.parametrize("block, products, hot_rows", [(1 << 20, 1 << 20, 1_000_000), (7, 5, 3)])
def test_sums_equal_joined_rows(spark, monkeypatch, block, products, hot_rows):
    monkeypatch.setattr(cells, "BLOCK_TERMS", block)
    monkeypatch.setattr(cells, "MOST_PRODUCTS", products)
    monkeypatch.setattr(terms, "hot_keys", lambda df, keys: skew.hot_keys(df, keys, min_rows=hot_rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", block)
    left, right, pairs = tables(spark, block)
    lt, rt = spark.createDataFrame(left, TF).withColumnRenamed("k", "l"), spark.createDataFrame(right, TF).withColumnRenamed("k", "r")
    pt = spark.createDataFrame(pairs, "l long, r long, x int")
    try:
        got = terms.sparse_cosine(pt, lt.withColumnRenamed("tf", "weight"), rt.withColumnRenamed("tf", "weight"), ["l"], ["r"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    square = lambda rows, k: sum((v or 0) ** 2 for a, _, v in rows if a == k) ** 0.5
    want = []
    for l, r, x in pairs:
        dot = sum((v or 0) * (w or 0) for a, s, v in left if a == l for b, t, w in right if b == r and s == t and s is not None)
        length = square(left, l) * square(right, r)
        known = l is not None and r is not None and length > 0
        n = sum(1 for p in pairs if p[:2] == (l, r))
        want.append((str(l), str(r), x, round(n * dot / length, 9) if known else 0.0))
    assert sorted((str(a), str(b), x, round(c, 9)) for a, b, x, c in got) == sorted(want)


@pytest.mark.parametrize("batch", [10_000, 7])
def test_listed_sums_equal_cells(spark, monkeypatch, batch):
    left, right, pairs = tables(spark, batch)
    lt, rt = spark.createDataFrame(left, TF).withColumnRenamed("k", "l"), spark.createDataFrame(right, TF).withColumnRenamed("k", "r")
    other = rt.where("r % 3 = 0").withColumn("tf", F.col("tf") + 1)
    pt = spark.createDataFrame(pairs, "l long, r int, x int")
    columns = ["l", "r", "x", "one", "two"]
    found = lambda: sorted(map(str, terms.pair_cosines(pt, lt, {"one": rt, "two": other}, ["l"], ["r"]).select(*columns).collect()))
    want, taken, plain = found(), [], cells._listed_sums
    monkeypatch.setattr(cells, "_listed_sums", lambda *a: taken.append(a) or plain(*a))
    monkeypatch.setattr(cells, "FEW_COPIES", 0)
    monkeypatch.setattr(cells, "DEALS", 10_000)  # many copies of left terms
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert found() == want and len(taken) == 1
        monkeypatch.setattr(cells, "SHORT", 3)
        monkeypatch.setattr(cells, "DEALS", 4)
        assert found() == want and len(taken) == 1  # long documents go to cells
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_left_terms_are_not_copied_for_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(cells, "FEW_COPIES", 1_000)
    words = F.array(*[F.concat(F.lit("w"), F.pmod(F.col("id") * n, F.lit(9)).cast("string")) for n in (1, 2, 3)])
    tf = spark.range(500).select(F.col("id").alias("l"), F.explode(F.array_distinct(words)).alias("term"), F.lit(1).alias("tf"))
    pairs = spark.range(500).select(F.col("id").alias("l"), F.col("id").alias("r"))
    met = terms.pair_cosine(pairs, tf, tf.withColumnRenamed("l", "r"), ["l"], ["r"])
    assert "sequence" not in met._jdf.queryExecution().optimizedPlan().toString()
    assert met.where("round(similarity, 9) = 1").count() == 500


def test_no_row_per_pair_and_term(spark):
    tf = spark.range(9).select(F.col("id").alias("l"), F.lit("t").alias("term"), F.lit(1).alias("tf"))
    pairs = spark.range(9).select(F.col("id").alias("l"), F.col("id").alias("r"))
    met = terms.pair_cosine(pairs, tf, tf.withColumnRenamed("l", "r"), ["l"], ["r"])
    joins = re.findall(r"(?:SortMergeJoin|HashJoin) \[[^\]]*", met._jdf.queryExecution().executedPlan().toString())
    assert met.count() == 9 and not any("term" in join for join in joins)


@pytest.mark.parametrize("sent", [False, True])
def test_indirect_scores_of_wanted_keys(spark, sent):
    rng = random.Random(4)
    fixes = spark.createDataFrame([(rng.randrange(9), f"k{rng.randrange(60)}") for _ in range(120)], "report_id long, key string")
    similar = spark.createDataFrame([(a, b, rng.random()) for a in range(9) for b in range(9) if rng.random() < 0.8], "report_id long, other_id long, similarity double")
    pool = spark.createDataFrame([(rng.randrange(9), f"k{rng.randrange(70)}") for _ in range(90)], "report_id long, key string").distinct()
    direct = pool.withColumn("score", F.pmod(F.xxhash64("report_id", "key"), F.lit(100)) / 100).localCheckpoint()
    every = scoring.indirect_scores(similar, fixes)
    few = scoring.distinct_fixes(fixes)
    wanted = scoring.indirect_scores(similar, fixes, sent=sent, wanted=pool)
    whole = scoring.indirect_scores(similar, few, sent=sent)
    assert few.count() < fixes.distinct().count()
    assert sorted(wanted.collect()) == sorted(every.join(pool, ["report_id", "key"], "left_semi").collect())
    assert sorted(scoring.synthesized(direct, wanted, whole).collect()) == sorted(scoring.synthesized(direct, every).collect())
