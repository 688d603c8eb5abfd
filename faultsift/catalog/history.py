"""Features from earlier reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.catalog import data
from faultsift.catalog.registry import query
from faultsift.functions.text import identifier_tokens
from faultsift.operators import history
from faultsift.operators.terms import term_frequencies


@query(
    f"""
WITH {data.TOUCHES}
SELECT t.report_id, t.file, count(p.report_id) AS prior_count, strftime(max(p.report_time), '%Y-%m-%d') AS last_day,
       arg_max(p.report_id, (p.report_time, -p.report_id)) AS last_report
FROM touches t LEFT JOIN touches p ON p.file = t.file AND p.report_time < t.report_time
GROUP BY t.report_id, t.file"""
)
def prior_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of strictly earlier reports of the same file, and the latest of them."""
    touched = data.touches(spark, sf_dir)
    return history.with_last_report(history.prior_activity(touched), touched).select(
        "report_id", "file", "prior_count", F.date_format("last_time", "yyyy-MM-dd").alias("last_day"), "last_report"
    )


@query(
    f"""
WITH {data.TOUCHES},
gaps AS (SELECT report_id, file, CASE WHEN report_id % 9 = 0 THEN NULL ELSE report_time END AS report_time FROM touches)
SELECT t.report_id, t.file, count(p.report_id) AS prior_count, strftime(max(p.report_time), '%Y-%m-%d') AS last_day
FROM gaps t LEFT JOIN gaps p ON p.file = t.file AND p.report_time < t.report_time
GROUP BY t.report_id, t.file"""
)
def history_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touches without a time stay, see none before them and are before none."""
    touched = data.touches(spark, sf_dir)
    gaps = touched.withColumn("report_time", F.when(F.col("report_id") % 9 != 0, F.col("report_time")))
    return history.prior_activity(gaps).select(
        "report_id", "file", "prior_count", F.date_format("last_time", "yyyy-MM-dd").alias("last_day")
    )


@query(
    f"""
WITH {data.TOUCHES},
prior AS (
  SELECT t.report_id, t.file, any_value(t.report_time) AS now, max(p.report_time) AS last, count(p.report_id) AS bug_frequency
  FROM touches t LEFT JOIN touches p ON p.file = t.file AND p.report_time < t.report_time GROUP BY t.report_id, t.file)
SELECT report_id, file, bug_frequency,
       round(coalesce(1.0 / (abs((year(now) - year(last)) * 12 + month(now) - month(last)) + 1), 0.0), 6) AS bug_recency
FROM prior"""
)
def recency_and_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bug fixing recency and frequency."""
    out = history.recency_and_frequency(data.touches(spark, sf_dir))
    return out.withColumn("bug_recency", F.round("bug_recency", 6))


COLLAB = f"""
{data.REPORTS}, {data.TOUCHES},
{data.tf_sql("report_tf", "reports", "report_id", "raw_text")},
prior_tf AS (
  SELECT t.report_id, t.file, f.term, sum(f.tf) AS tf
  FROM touches t JOIN touches p ON p.file = t.file AND p.report_time < t.report_time
  JOIN report_tf f ON f.report_id = p.report_id GROUP BY ALL),
prior_sq AS (SELECT report_id, file, sum(tf * tf)::DOUBLE AS ra FROM prior_tf GROUP BY ALL),
report_sq AS (SELECT report_id, sum(tf * tf)::DOUBLE AS la FROM report_tf GROUP BY ALL),
both_tf AS (
  SELECT p.report_id, p.file, sum(f.tf * p.tf)::DOUBLE AS dot, sum(f.tf * f.tf)::DOUBLE AS ls, sum(p.tf * p.tf)::DOUBLE AS rs
  FROM prior_tf p JOIN report_tf f ON f.report_id = p.report_id AND f.term = p.term GROUP BY ALL),
collab AS (
  SELECT t.report_id, t.file, coalesce(dot / (sqrt(ls + pow(ln(1.5) + 1, 2) * (la - ls)) *
         sqrt(rs + pow(ln(1.5) + 1, 2) * (ra - rs))), 0.0) AS collab_filter
  FROM touches t LEFT JOIN both_tf b ON t.report_id = b.report_id AND t.file = b.file
  LEFT JOIN prior_sq s ON t.report_id = s.report_id AND t.file = s.file
  LEFT JOIN report_sq r ON t.report_id = r.report_id)"""


@query(f"WITH {COLLAB} SELECT report_id, file, round(collab_filter, 6) AS collab_filter FROM collab")
def collaborative_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of a report to all earlier reports of a file taken together."""
    reports = data.reports(spark, sf_dir)
    tf = term_frequencies(reports, ["report_id"], identifier_tokens(F.col("raw_text")))
    out = history.collaborative_similarity(data.touches(spark, sf_dir), tf)
    return out.select("report_id", "file", F.round("collab_filter", 6).alias("collab_filter"))


@query(
    """
WITH hub AS (SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT DISTINCT o_orderkey AS report_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_partkey = (SELECT l_partkey FROM hub) AND o_orderdate < TIMESTAMP '1999-01-01'"""
)
def previous_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that fixed the most often fixed file before a day."""
    items = data.table(spark, sf_dir, "lineitem").select("l_partkey")
    most = items.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_partkey").limit(1)
    until = F.lit("1999-01-01").cast("timestamp_ntz")
    hub = most.select("l_partkey").scalar()
    return history.previous_reports(data.touches(spark, sf_dir), hub, until).select("report_id")
