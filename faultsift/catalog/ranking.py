"""Ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.catalog import data
from faultsift.catalog.registry import query
from faultsift.operators import ranking
from faultsift.plans import evaluation
from faultsift.session import scratch_path, stage
from faultsift.sources import readers, writers

QUERY, CANDIDATE = ["query_id"], "candidate_id"

FIRST = f"""
{data.SCORED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rn FROM scored),
first AS (SELECT query_id, any_value(project) AS project, count(*) AS n, sum(match)::BIGINT AS positives,
                 min(CASE WHEN match = 1 THEN rn END) AS first_rank FROM ranked GROUP BY 1)"""

PRECISION = f"""
{FIRST},
steps AS (SELECT query_id, score, count(*) AS n, sum(match) AS p FROM scored GROUP BY 1, 2),
cum AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp FROM steps WINDOW w AS (PARTITION BY query_id ORDER BY score DESC)),
ap AS (SELECT query_id, sum(n)::BIGINT AS n, sum(p)::BIGINT AS positives,
              CASE WHEN sum(p) > 0 THEN sum(p * cp / cn::DOUBLE) / sum(p) ELSE 0 END AS average_precision FROM cum GROUP BY 1)"""


@query(f"WITH {FIRST} SELECT query_id, n, positives, first_rank FROM first")
def first_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the best match of every query."""
    return ranking.first_rank(data.scored(spark, sf_dir), QUERY, CANDIDATE)


@query(
    f"""
WITH {FIRST}
SELECT k::INTEGER AS k, count(*) AS queries, count(*) FILTER (first_rank <= k) AS hits,
       round(count(*) FILTER (first_rank <= k) / count(*)::DOUBLE, 3) AS hit_rate
FROM first, range(1, 21) ks(k) GROUP BY k"""
)
def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of queries with a match among the first k, k = 1 ... 20."""
    return ranking.hit_at_k(first_rank(spark, sf_dir))


@query(f"WITH {PRECISION} SELECT query_id, n, positives, round(average_precision, 6) AS average_precision FROM ap")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-wise average precision, equal scores in one step."""
    out = ranking.average_precision(data.scored(spark, sf_dir), QUERY)
    return out.withColumn("average_precision", F.round("average_precision", 6))


@query(f"WITH {FIRST} SELECT project, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr FROM first GROUP BY 1")
def mean_reciprocal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reciprocal rank per project."""
    ranks = ranking.first_rank(data.scored(spark, sf_dir), ["project", *QUERY], CANDIDATE)
    return ranking.mean_reciprocal_rank(ranks, ["project"]).withColumn("mrr", F.round("mrr", 6))


TRUTH = """
binned AS (SELECT user_id AS query_id, event_id AS candidate_id, floor(value) AS score FROM events),
truth AS (SELECT query_id, min(candidate_id) AS candidate_id FROM binned GROUP BY 1),
one AS (SELECT b.*, CASE WHEN t.candidate_id IS NULL THEN 0 ELSE 1 END AS match
        FROM binned b LEFT JOIN truth t ON b.query_id = t.query_id AND b.candidate_id = t.candidate_id)"""


def _one_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events binned to force ties; the first event of a user is the true candidate."""
    binned = data.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("candidate_id"),
        F.floor("value").cast("double").alias("score"),
    )
    truth = binned.groupBy("query_id").agg(F.min("candidate_id").alias("candidate_id")).withColumn("match", F.lit(1))
    return binned.join(truth, ["query_id", "candidate_id"], "left").withColumn("match", F.coalesce("match", F.lit(0)))


@query(
    f"""
WITH {TRUTH}
SELECT o.query_id, count(*) AS rank FROM one o JOIN one t ON t.query_id = o.query_id AND t.match = 1
WHERE o.score >= t.score GROUP BY 1"""
)
def pessimistic_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of candidates scored at least as high as the true one."""
    return ranking.pessimistic_rank(_one_match(spark, sf_dir), QUERY)


@query(
    f"""
WITH {TRUTH},
r AS (SELECT o.query_id, count(*) AS rank FROM one o JOIN one t ON t.query_id = o.query_id AND t.match = 1
      WHERE o.score >= t.score GROUP BY 1)
SELECT k::INTEGER AS k, round(count(*) FILTER (rank <= k) / count(*)::DOUBLE, 3) AS hit_rate, round(avg(1.0 / rank), 6) AS mrr
FROM r, range(1, 11) ks(k) GROUP BY k"""
)
def whole_pool_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit@1 ... 10 and reciprocal rank with ties against the match."""
    ranks = ranking.pessimistic_rank(_one_match(spark, sf_dir), QUERY)
    mrr = ranking.mean_reciprocal_rank(ranks, rank="rank").select(F.round("mrr", 6).alias("mrr")).scalar()
    return ranking.hit_at_k(ranks, rank="rank", max_k=10).select("k", "hit_rate", mrr.alias("mrr"))


@query(
    f"""
WITH {data.SCORED}
SELECT p.query_id, p.candidate_id, 1 + count(n.candidate_id) AS rank
FROM scored p LEFT JOIN scored n ON n.query_id = p.query_id AND n.match = 0 AND n.score >= p.score
WHERE p.match = 1 GROUP BY ALL"""
)
def positive_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of every match against the non-matches of its query."""
    return ranking.positive_ranks(data.scored(spark, sf_dir), QUERY, CANDIDATE)


@query(
    f"""
WITH {TRUTH}
SELECT n.query_id, round(avg(greatest(25.0::DOUBLE - p.score + n.score, 1e-6)), 6) AS loss, count(*) AS pairs
FROM one p JOIN one n ON n.query_id = p.query_id AND n.match = 0 WHERE p.match = 1 GROUP BY 1"""
)
def margin_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean pairwise margin loss of the true candidate against the others."""
    out = ranking.margin_loss(_one_match(spark, sf_dir), QUERY, 25.0)
    return out.withColumn("loss", F.round("loss", 6))


@query(
    """
WITH lines AS (SELECT DISTINCT l_orderkey AS report_id, l_suppkey, l_partkey, l_extendedprice FROM lineitem),
ranked AS (
  SELECT report_id, 'lib/S' || (l_suppkey % 10) || '/P' || l_partkey || '.java' AS file,
         row_number() OVER (PARTITION BY report_id ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS rank FROM lines),
fixes AS (SELECT o_orderkey AS report_id, unnest(['/S' || (o_custkey % 10) || '/', (o_custkey % 100) || '.']) AS fix FROM orders),
hits AS (SELECT r.report_id, rank, count(f.fix) AS h FROM ranked r LEFT JOIN fixes f ON f.report_id = r.report_id AND contains(r.file, f.fix) GROUP BY 1, 2),
found AS (SELECT *, coalesce(sum(h) OVER (PARTITION BY report_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM hits)
SELECT report_id, round(CASE WHEN sum(h) > 0 THEN sum((h * b + h * (h + 1) / 2) / rank) / sum(h) ELSE 0 END, 6) AS average_precision,
       coalesce(min(CASE WHEN h > 0 THEN rank END), -1) AS first_pos
FROM found GROUP BY 1"""
)
def path_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision and first position by path substring."""
    from faultsift.operators.running import numbered, with_score_block

    lines = data.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("report_id"), "l_suppkey", "l_partkey", (-F.col("l_extendedprice")).alias("_price")
    )
    blocked = with_score_block(lines.distinct(), "_price")
    order = [F.col("_price"), F.col("l_partkey"), F.col("l_suppkey")]
    ranked = numbered(blocked, ["report_id"], order, F.col("_block"), "rank")
    shelf = F.pmod("l_suppkey", F.lit(10)).cast("string")
    file = F.concat(F.lit("lib/S"), shelf, F.lit("/P"), F.col("l_partkey").cast("string"), F.lit(".java"))
    customer = F.col("o_custkey")
    folder = F.concat(F.lit("/S"), F.pmod(customer, F.lit(10)).cast("string"), F.lit("/"))
    name = F.concat(F.pmod(customer, F.lit(100)).cast("string"), F.lit("."))
    fixes = data.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("report_id"), F.array(folder, name).alias("fixes")
    )
    out = ranking.path_precision(ranked.select("report_id", "rank", file.alias("file")), fixes, ["report_id"])
    return out.withColumn("average_precision", F.round("average_precision", 6))


@query(
    f"""
WITH {data.SCORED}
SELECT query_id, candidate_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM scored) WHERE rank <= 20"""
)
def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates of every query."""
    best = ranking.top_k(data.scored(spark, sf_dir), QUERY, CANDIDATE, 20)
    return best.select("query_id", "candidate_id", "score", "rank")


@query(
    f"""
WITH {data.SCORED}
SELECT project, query_id, candidate_id, row_number() OVER (PARTITION BY project, query_id ORDER BY score DESC, candidate_id) AS rank
FROM scored"""
)
def full_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of every candidate of every query."""
    ranked = ranking.full_ranking(data.scored(spark, sf_dir), ["project", *QUERY], CANDIDATE)
    return ranked.select("project", "query_id", "candidate_id", "rank")


@query(
    f"""
WITH {data.SCORED},
gaps AS (
  SELECT project, query_id, candidate_id, match,
         CASE WHEN candidate_id % 7 = 0 OR candidate_id % 11 = 0 THEN '-Infinity'::DOUBLE ELSE score END AS score
  FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM gaps),
steps AS (SELECT query_id, score, count(*) AS n, sum(match) AS p FROM gaps GROUP BY 1, 2),
cum AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp FROM steps WINDOW w AS (PARTITION BY query_id ORDER BY score DESC)),
per_query AS (
  SELECT query_id, sum(n)::BIGINT AS n,
         round(CASE WHEN sum(p) > 0 THEN sum(p * cp / cn::DOUBLE) / sum(p) ELSE 0 END, 6) AS average_precision
  FROM cum GROUP BY 1)
SELECT r.query_id, r.candidate_id, r.rank, r.rank <= 5 AS in_top, u.n, u.average_precision,
       min(CASE WHEN r.match = 1 THEN r.rank END) OVER (PARTITION BY r.query_id) AS first_rank
FROM ranked r JOIN per_query u USING (query_id)"""
)
def ranking_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule for candidates without a score or with NaN: they stay and come last."""
    scored = data.scored(spark, sf_dir)
    score = F.when(F.col("candidate_id") % 7 == 0, F.lit(None)).when(F.col("candidate_id") % 11 == 0, F.lit(float("nan")))
    gaps = scored.withColumn("score", score.otherwise(F.col("score")))
    ranked = ranking.full_ranking(gaps, QUERY, CANDIDATE).select(*QUERY, CANDIDATE, "rank")
    best = ranking.top_k(gaps, QUERY, CANDIDATE, 5).select(*QUERY, CANDIDATE, F.lit(True).alias("in_top"))
    first = ranking.first_rank(gaps, QUERY, CANDIDATE).select(*QUERY, "first_rank")
    precise = ranking.average_precision(gaps, QUERY).select(*QUERY, "n", F.round("average_precision", 6).alias("average_precision"))
    joined = ranked.join(best, [*QUERY, CANDIDATE], "left").join(first, QUERY).join(precise, QUERY)
    return joined.withColumn("in_top", F.coalesce("in_top", F.lit(False)))


METRICS = f"""
{PRECISION},
long AS (
  SELECT project, 'hit' AS metric, k::INTEGER AS k, round(count(*) FILTER (first_rank <= k) / count(*)::DOUBLE, 3) AS value
  FROM first, range(1, 21) ks(k) GROUP BY ALL
  UNION ALL SELECT project, 'mrr', NULL, avg(coalesce(1.0 / first_rank, 0)) FROM first GROUP BY ALL
  UNION ALL SELECT project, 'evaluated', NULL, count(*)::DOUBLE FROM first GROUP BY ALL
  UNION ALL SELECT project, 'map', NULL, avg(average_precision) FROM ap JOIN first USING (query_id) GROUP BY ALL)"""


@query(f"WITH {METRICS} SELECT project, metric, k, round(value, 6) AS value FROM long")
def metrics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics per project in one long table."""
    out = evaluation.evaluated(data.scored(spark, sf_dir), ["project", *QUERY], CANDIDATE, ["project"])
    return out.withColumn("value", F.round("value", 6))


@query(
    f"""
WITH {PRECISION}
SELECT project, round(avg(average_precision), 6) AS map, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr, count(*) AS reports
FROM ap JOIN first USING (query_id) GROUP BY 1"""
)
def project_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result row per project."""
    out = evaluation.project_results(data.scored(spark, sf_dir), ["project", *QUERY], CANDIDATE, ["project"])
    return out.withColumns({"map": F.round("map", 6), "mrr": F.round("mrr", 6)})


@query(
    f"""
WITH {PRECISION},
results AS (
  SELECT project, avg(average_precision) AS map, avg(coalesce(1.0 / first_rank, 0)) AS mrr, count(*) AS reports
  FROM ap JOIN first USING (query_id) GROUP BY 1)
SELECT 'within_project' AS data_setting, project::VARCHAR AS project_name, 'test' AS split,
       CASE WHEN project <> 5 THEN round(map, 6) END AS map, CASE WHEN project <> 5 THEN round(mrr, 6) END AS mrr,
       CASE WHEN project NOT IN (0, 5) THEN reports END AS reports,
       CASE project WHEN 0 THEN 'not a number' WHEN 5 THEN 'no column map' END AS reason FROM results"""
)
def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of the result files of all projects, which do not all look alike; two of them are broken."""
    out = evaluation.project_results(data.scored(spark, sf_dir), ["project", *QUERY], CANDIDATE, ["project"])
    keys = [F.lit("within_project").alias("data_setting"), F.col("project").alias("project_name"), F.lit("test").alias("split")]
    out = stage(out.select(*keys, "map", "mrr", "reports"))
    root = scratch_path(spark, "results")
    others = out.select("data_setting", "project_name", "split", "reports", F.lit("x").alias("note"), "mrr", "map")
    writers.result_files(out.where("project_name IN (1, 2)"), root)
    writers.result_files(others.where("project_name IN (3, 4)"), root)
    writers.result_files(others.where("project_name = 0").withColumn("reports", F.lit("many")), root)
    writers.result_files(out.where("project_name = 5").withColumnRenamed("map", "mean"), root)
    merged = readers.result_files(spark, root).drop("file")
    return merged.withColumns({"map": F.round("map", 6), "mrr": F.round("mrr", 6)})


@query(
    f"""
WITH {FIRST}
SELECT project, count(*) AS evaluated, round(count(*) FILTER (first_rank <= 1) / count(*)::DOUBLE, 3) AS hit1,
       round(count(*) FILTER (first_rank <= 20) / count(*)::DOUBLE, 3) AS hit20 FROM first GROUP BY 1"""
)
def metrics_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as one JSON document per project, read back."""
    long = evaluation.evaluated(data.scored(spark, sf_dir), ["project", *QUERY], CANDIDATE, ["project"])
    doc = F.from_json("metrics", "map double, mrr double, evaluated bigint, hit map<string, double>")
    return writers.metrics_json(long, ["project"]).select(
        "project",
        doc["evaluated"].alias("evaluated"),
        F.element_at(doc["hit"], "1").alias("hit1"),
        F.element_at(doc["hit"], "20").alias("hit20"),
    )


@query("SELECT user_id || ' ' || event_id || ' ' || value AS line FROM events")
def score_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise scores as lines of text."""
    lines = writers.score_lines(data.scored(spark, sf_dir), "query_id", "candidate_id", "score")
    return lines.select(F.col("value").alias("line"))
