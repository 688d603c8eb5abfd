"""Negative sampling, splits, folds and balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.catalog import data
from faultsift.catalog.registry import query
from faultsift.catalog.vectors import DENSE, dense_cosine
from faultsift.operators import neighbours, sampling, terms
from faultsift.operators.running import hash_block, id_block, numbered
from faultsift.session import stage


def circle_sql(n: int) -> str:
    """`drawn`: n wrong files per touch, as the sampler defines them."""
    return f"""
circle AS (SELECT p_partkey AS candidate, row_number() OVER (ORDER BY md5('0|' || p_partkey), p_partkey) - 1 AS place FROM part),
total AS (SELECT count(*) AS n FROM part),
fixed AS (SELECT report_id, count(*) AS f FROM touches GROUP BY 1),
walk AS (
  SELECT t.report_id, t.file, unnest(range(least(f + {n}, total.n))) AS step,
         ('0x' || substr(md5('0|' || t.report_id || '|' || t.file), 1, 13))::BIGINT % total.n AS start, total.n AS size
  FROM touches t JOIN fixed USING (report_id), total),
kept AS (
  SELECT w.report_id, w.file, c.candidate, row_number() OVER (PARTITION BY w.report_id, w.file ORDER BY step) AS draw
  FROM walk w JOIN circle c ON c.place = (w.start + w.step) % w.size
  WHERE NOT EXISTS (SELECT 1 FROM touches x WHERE x.report_id = w.report_id AND x.file = c.candidate)),
drawn AS (SELECT * FROM kept WHERE draw <= {n})"""


@query(f"WITH {data.TOUCHES}, {circle_sql(100)} SELECT report_id, file, candidate, draw FROM drawn")
def sampled_wrong_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred random files a report did not fix, for every file it fixed; all where there are fewer."""
    files = data.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"))
    touched = data.touches(spark, sf_dir).select("report_id", "file")
    return sampling.sampled_wrong_files(touched, files, 100).select("report_id", "file", "candidate", "draw")


@query(
    """
SELECT user_id, event_id, match FROM (
  SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS match,
         row_number() OVER (PARTITION BY user_id, event_type = 'purchase' ORDER BY ts, event_id) AS rn FROM events)
WHERE match = 1 OR rn <= 10"""
)
def first_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches and the first ten non-matches of every bug."""
    events = _events(spark, sf_dir).withColumn("ts", F.col("ts"))
    picked = sampling.positives_and_negatives(events, "user_id", [F.col("ts"), F.col("event_id")], 10)
    return picked.select("user_id", "event_id", "match")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.table(spark, sf_dir, "events").select(
        "user_id", "event_id", "ts", F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("match")
    )


SAMPLES = """
cands AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS match FROM events),
counts AS (SELECT user_id, sum(match) AS pos, sum(1 - match) AS neg FROM cands GROUP BY 1),
whole AS (SELECT user_id FROM counts WHERE pos > 0 AND neg >= 50)"""


@query(
    f"""
WITH {SAMPLES},
negs AS (SELECT user_id, event_id, match, row_number() OVER (PARTITION BY user_id ORDER BY md5('0|' || user_id || '|' || event_id), event_id) AS rn
         FROM cands WHERE match = 0)
SELECT user_id, event_id, match FROM negs WHERE rn <= 50 AND user_id IN (SELECT user_id FROM whole)
UNION ALL SELECT user_id, min(event_id), 1 FROM cands WHERE match = 1 AND user_id IN (SELECT user_id FROM whole) GROUP BY 1"""
)
def ranking_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One match and 50 random non-matches per bug."""
    return sampling.ranking_samples(_events(spark, sf_dir).drop("ts"), "user_id", "event_id", 50)


@query(
    f"""
WITH {SAMPLES},
r AS (SELECT CASE WHEN pos = 0 THEN 'no positive' WHEN neg < 50 THEN 'too few negatives' END AS reason FROM counts)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1"""
)
def skipped_bugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bugs without samples, counted by reason."""
    return sampling.skipped_bugs(_events(spark, sf_dir), "user_id", 50)


@query(
    f"""
WITH {DENSE},
near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, other_id) AS rank FROM dense WHERE vec_id <> other_id)
SELECT vec_id, other_id, draw FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY md5('0|' || vec_id || '|' || other_id), other_id) AS draw FROM near WHERE rank <= 20)
WHERE draw <= 5"""
)
def neighbour_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five random ones of the 20 most similar other queries."""
    similar = dense_cosine(spark, sf_dir).withColumnRenamed("cosine", "similarity")
    out = sampling.neighbour_negatives(similar, "vec_id", "other_id", 20, 5)
    return out.select("vec_id", "other_id", "draw")


@query(
    f"""
WITH {data.DIALOGUE},
docs AS (SELECT conv_id * 100000 + turn AS report_id, query, code FROM dialogue),
tf AS (SELECT report_id, term, count(*) AS tf FROM (SELECT report_id, unnest(query) AS term FROM docs) GROUP BY ALL),
idf AS (SELECT term, ln((SELECT count(*) FROM docs) / count(*)::DOUBLE) AS idf FROM tf GROUP BY 1),
raw AS (SELECT report_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
unit AS (SELECT report_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY report_id)) AS w FROM raw QUALIFY sum(w * w) OVER (PARTITION BY report_id) > 0),
sims AS (
  SELECT a.report_id, b.report_id AS other, round(sum(a.w * b.w), 9) AS similarity
  FROM unit a JOIN unit b ON a.term = b.term AND a.report_id <> b.report_id WHERE a.w > 0 AND b.w > 0 GROUP BY ALL),
near AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY similarity DESC, other) AS rank FROM sims),
drawn AS (
  SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY md5('0|' || report_id || '|' || other), other) AS draw FROM near WHERE rank <= 20)
SELECT d.report_id, d.other, d.rank, d.draw, round(d.similarity, 6) AS similarity, md5(array_to_string(c.code, ' ')) AS code_md5
FROM drawn d JOIN docs c ON c.report_id = d.other WHERE draw <= 5"""
)
def tfidf_neighbour_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of five random ones of the 20 reports most similar by TF-IDF, as wrong codes of a report."""
    dialogue = data.dialogue(spark, sf_dir)
    docs = stage(dialogue.select((F.col("conv_id") * 100000 + F.col("turn")).alias("report_id"), "query", "code"))
    tf = terms.term_frequencies(docs, ["report_id"], F.col("query"))
    weights = terms.unit_tfidf(tf, terms.idf_table(tf, docs), ["report_id"]).where("weight > 0")
    near = neighbours.nearest(weights, "report_id", 20)
    drawn = sampling.drawn_neighbours(near, "report_id", "other", 5)
    codes = docs.select(F.col("report_id").alias("other"), F.md5(F.array_join("code", " ")).alias("code_md5"))
    return drawn.join(codes, "other").select(
        "report_id", "other", "rank", "draw", F.round("similarity", 6).alias("similarity"), "code_md5"
    )


@query(
    """
WITH pos AS (SELECT *, row_number() OVER (ORDER BY event_id) AS rn, count(*) OVER () AS n FROM events WHERE event_type = 'purchase'),
side AS (SELECT user_id, CASE WHEN rn <= n - ceil(0.4 * n) THEN 'train' ELSE 'test' END AS split FROM pos)
SELECT e.event_id, s.split FROM events e JOIN (SELECT DISTINCT user_id, split FROM side) s USING (user_id)"""
)
def ordered_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered split of the matches, then of all rows by bug."""
    events = _events(spark, sf_dir)
    order = F.col("event_id")
    sides = sampling.ordered_split(events.where(F.col("match") == 1), [order], id_block(order), 0.4)
    return sampling.split_members(events, sides, "user_id").select("event_id", "split")


@query(
    """
SELECT doc_id, floor(rn / ceil(n / 10.0))::INTEGER AS fold FROM (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM labels)"""
)
def contiguous_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten contiguous folds over rows."""
    rows = data.table(spark, sf_dir, "labels").select("doc_id")
    return sampling.folds(rows, [F.col("doc_id")], id_block(F.col("doc_id")), 10)


@query(
    """
WITH u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events))
SELECT event_id, floor(rn / ceil(n / 10.0))::INTEGER AS fold FROM events JOIN u USING (user_id)"""
)
def report_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten folds with every report in one of them."""
    samples = data.table(spark, sf_dir, "events").select("event_id", "user_id")
    user = F.col("user_id")
    return sampling.report_folds(samples, "user_id", user, id_block(user), 10).select("event_id", "fold")


@query(
    """
SELECT event_id, rn % 51 = 0 AS flag FROM (SELECT event_id, row_number() OVER (ORDER BY user_id, event_id) - 1 AS rn FROM events)"""
)
def every_51st(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag on every 51st row."""
    rows = data.table(spark, sf_dir, "events").select("event_id", "user_id")
    user, event = F.col("user_id"), F.col("event_id")
    block = F.struct(user, id_block(event))
    return sampling.every_nth(rows, [user, event], block).select("event_id", "flag")


@query(
    """
SELECT doc_id, copy::INTEGER AS copy FROM labels, range(1, 11) c(copy) WHERE quality = 1 OR copy = 1"""
)
def oversampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches ten times, other rows once."""
    samples = data.table(spark, sf_dir, "labels").withColumnRenamed("quality", "match")
    return sampling.oversampled(samples).select("doc_id", "copy")


@query(
    """
SELECT * FROM (SELECT 'customer' AS origin, c_custkey AS key FROM customer ORDER BY md5('0|customer|' || c_custkey), c_custkey LIMIT 300)
UNION ALL SELECT * FROM (SELECT 'part', p_partkey FROM part ORDER BY md5('0|part|' || p_partkey), p_partkey LIMIT 300)
UNION ALL SELECT * FROM (SELECT 'order', o_orderkey FROM orders ORDER BY md5('0|order|' || o_orderkey), o_orderkey LIMIT 300)"""
)
def equal_share_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same number of random rows of three tables."""
    tables = [
        data.table(spark, sf_dir, name).select(F.lit(origin).alias("origin"), F.col(key).alias("key"))
        for name, origin, key in (
            ("customer", "customer", "c_custkey"), ("part", "part", "p_partkey"), ("orders", "order", "o_orderkey")
        )
    ]
    return sampling.equal_share_sample(tables, ["origin", "key"], 900)


@query("SELECT o_orderkey AS key, row_number() OVER (ORDER BY md5('7|' || o_orderkey), o_orderkey) AS position FROM orders")
def shuffled_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every row after a shuffle."""
    rows = data.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    hashed = rows.withColumn("_h", sampling.shuffle_key("7", F.col("key")))
    return numbered(hashed, [], [F.col("_h"), F.col("key")], hash_block(F.col("_h")), "position").drop("_h")
