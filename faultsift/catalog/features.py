"""The feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.catalog import data
from faultsift.catalog.history import COLLAB
from faultsift.catalog.registry import query
from faultsift.catalog.sampling import circle_sql
from faultsift.functions.text import identifier_tokens
from faultsift.plans import features

NEGATIVES = 50

PAIRS = f"""
{COLLAB}, {data.SOURCES},
names AS (SELECT p_partkey AS file, replace(p_brand, '#', '') AS class_names FROM part),
{data.tf_sql("source_tf", "sources", "file", "file_content")},
{data.tf_sql("class_tf", "names", "file", "class_names")},
{circle_sql(2 * NEGATIVES)},
asked AS (SELECT report_id, file FROM touches UNION SELECT report_id, candidate FROM drawn),
{data.pair_cosine_sql("by_text", "asked", "report_tf", "source_tf", "report_id", "file")},
{data.pair_cosine_sql("by_class", "asked", "report_tf", "class_tf", "report_id", "file")},
lexical AS (SELECT t.report_id, t.file, t.similarity AS rvsm, c.similarity AS cns FROM by_text t JOIN by_class c USING (report_id, file)),
past AS (
  SELECT t.report_id, t.file, count(p.report_id) AS bug_frequency, any_value(t.report_time) AS now, max(p.report_time) AS last
  FROM touches t LEFT JOIN touches p ON p.file = t.file AND p.report_time < t.report_time GROUP BY t.report_id, t.file),
known AS (
  SELECT report_id, file, collab_filter, bug_frequency,
         coalesce(1.0 / (abs((year(now) - year(last)) * 12 + month(now) - month(last)) + 1), 0.0) AS bug_recency
  FROM past JOIN collab USING (report_id, file)),
hard AS (
  SELECT d.report_id, d.file, d.candidate, rvsm, cns,
         row_number() OVER (PARTITION BY d.report_id, d.file ORDER BY rvsm DESC, d.candidate) AS rn
  FROM drawn d JOIN lexical l ON l.report_id = d.report_id AND l.file = d.candidate)"""


@query(
    f"""
WITH {PAIRS}
SELECT report_id, file, round(rvsm, 5) AS rVSM_similarity, round(collab_filter, 5) AS collab_filter, round(cns, 5) AS classname_similarity,
       round(bug_recency, 5) AS bug_recency, bug_frequency, 1 AS match
FROM lexical JOIN known USING (report_id, file)
UNION ALL
SELECT h.report_id, candidate, round(rvsm, 5), round(collab_filter, 5), round(cns, 5), round(bug_recency, 5), bug_frequency, 0
FROM hard h JOIN known k ON h.report_id = k.report_id AND h.file = k.file WHERE rn <= {NEGATIVES}"""
)
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five features of every fixed file and of its hard negatives."""
    out = features.feature_table(
        data.reports(spark, sf_dir),
        data.touches(spark, sf_dir),
        data.sources(spark, sf_dir),
        tokens=identifier_tokens,
        negatives=NEGATIVES,
    )
    rounded = ("rVSM_similarity", "collab_filter", "classname_similarity", "bug_recency")
    return out.withColumns({c: F.round(c, 5) for c in rounded})


@query(
    f"""
WITH {data.TOUCHES}
SELECT 'unknown file' AS reason, count(*) AS n FROM touches WHERE file NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)"""
)
def unknown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touches of files that are not in the source table."""
    known = data.table(spark, sf_dir, "part").where(F.col("p_size") < 40)
    return features.unknown_files(data.touches(spark, sf_dir), known.select(F.col("p_partkey").alias("file")))


@query(
    f"""
WITH {data.TOUCHES},
other AS (SELECT report_id, (file * 7 + 3) % (SELECT count(*) FROM part) AS file, report_time FROM touches),
pairs AS (SELECT DISTINCT report_id, file, report_time FROM other),
past AS (
  SELECT t.report_id, t.file, count(p.report_id) AS bug_frequency, any_value(t.report_time) AS now, max(p.report_time) AS last
  FROM pairs t LEFT JOIN touches p ON p.file = t.file AND p.report_time < t.report_time GROUP BY t.report_id, t.file)
SELECT report_id, file, bug_frequency,
       round(coalesce(1.0 / (abs((year(now) - year(last)) * 12 + month(now) - month(last)) + 1), 0.0), 6) AS bug_recency FROM past"""
)
def own_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History features of files a report did not fix, from the past of those files."""
    from faultsift.operators import history

    touched = data.touches(spark, sf_dir)
    n = data.size_of(data.table(spark, sf_dir, "part"))
    asked = touched.withColumn("file", F.pmod(F.col("file") * 7 + 3, n)).distinct()
    out = history.recency_and_frequency(touched, asked)
    return out.withColumn("bug_recency", F.round("bug_recency", 6))
