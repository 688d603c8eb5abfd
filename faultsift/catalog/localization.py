"""Length boost, score fusion, direct and indirect localisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.catalog import data
from faultsift.catalog.registry import query
from faultsift.catalog.vectors import DENSE, IDF, SPARSE, dense_cosine
from faultsift.functions.text import prose_words, token_count
from faultsift.operators import scoring
from faultsift.plans import localization
from faultsift.session import scratch_path
from faultsift.sources import writers

SIZES = """
sizes AS (SELECT doc_id, source, len(regexp_extract_all(text, '[\\p{L}\\p{N}'']+')) AS size FROM documents)"""


def _length_sql(mean: str, sd: str) -> str:
    return (
        f"CASE WHEN size = 0 THEN 0.0 WHEN size < {mean} - 3 * {sd} THEN 0.5 WHEN size > {mean} + 3 * {sd} THEN 1.0 ELSE "
        f"1.0 / (1.0 + exp(-(6 * (size - CASE WHEN {mean} - 3 * {sd} > 0 THEN floor({mean} - 3 * {sd}) ELSE 0.0 END) / "
        f"({mean} + 3 * {sd} - CASE WHEN {mean} - 3 * {sd} > 0 THEN floor({mean} - 3 * {sd}) ELSE 0.0 END)))) END"
    )


LENGTHS = f"""
{SIZES},
stats AS (SELECT avg(size) AS m, stddev_samp(size) AS s FROM sizes),
lengths AS (SELECT doc_id, size, {_length_sql('m', 's')} AS length_score FROM sizes, stats)"""


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = data.texts(spark, sf_dir, "documents", "doc_id", "source", "text")
    return docs.select("doc_id", "source", token_count(prose_words(F.col("text"))).cast("bigint").alias("size"))


@query(f"WITH {LENGTHS} SELECT doc_id, size, round(length_score, 6) AS length_score FROM lengths")
def length_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length boost over the whole corpus."""
    out = scoring.length_scores(_sizes(spark, sf_dir))
    return out.select("doc_id", "size", F.round("length_score", 6).alias("length_score"))


@query(
    f"""
WITH {SIZES}, stats AS (SELECT source, avg(size) AS m, stddev_samp(size) AS s FROM sizes GROUP BY 1)
SELECT doc_id, round({_length_sql('m', 's')}, 6) AS length_score FROM sizes JOIN stats USING (source)"""
)
def length_scores_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length boost within every source."""
    out = scoring.length_scores(_sizes(spark, sf_dir), ["source"])
    return out.select("doc_id", F.round("length_score", 6).alias("length_score"))


@query(
    """
WITH r AS (SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)
SELECT event_id, round(CASE WHEN hi <> lo THEN (value - lo) / (hi - lo) ELSE value END, 6) AS scaled, 3.0::DOUBLE AS kept, 1.0::DOUBLE AS ones
FROM events JOIN r USING (user_id)"""
)
def min_max_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Min-max scaling per query; both rules for a constant column."""
    events = data.table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("value").alias("scaled"), F.lit(3.0).alias("kept"), F.lit(3.0).alias("ones")
    )
    scaled = scoring.min_max(events, ["user_id"], ["scaled", "kept"])
    out = scoring.min_max(scaled, ["user_id"], ["ones"], 1.0)
    return out.select("event_id", F.round("scaled", 6).alias("scaled"), "kept", "ones")


# Vectors of the items are the first embeddings, those of the documents repeat them.
VECTOR_OF = """
n_vec AS (SELECT count(*) AS n FROM embeddings),
item_v AS (SELECT item_id, embedding::DOUBLE[] AS v FROM benchmark, n_vec, embeddings WHERE vec_id = item_id % n),
doc_v AS (SELECT doc_id, embedding::DOUBLE[] AS v FROM documents, n_vec, embeddings WHERE vec_id = doc_id % n)"""


def _vectors_of(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    n = data.size_of(data.table(spark, sf_dir, "embeddings"))
    keys = data.table(spark, sf_dir, name).select(key, F.pmod(key, n).alias("vec_id"))
    return keys.join(data.vectors(spark, sf_dir), "vec_id").select(key, "vector")


def _cos(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


def _mm(x: str, by: str, constant: str | None = None) -> str:
    lo, hi = f"min({x}) OVER (PARTITION BY {by})", f"max({x}) OVER (PARTITION BY {by})"
    return f"CASE WHEN {hi} <> {lo} THEN ({x} - {lo}) / ({hi} - {lo}) ELSE {constant or x} END"


DIRECT = f"""
{data.POOL}, {data.ITEM_TF}, {data.DOC_TF}, {IDF}, {SPARSE}, {VECTOR_OF}, {LENGTHS},
fused AS (
  SELECT item_id, doc_id, {_mm('cosine', 'item_id')} + {_mm('dense', 'item_id')} AS similarity FROM (
    SELECT s.item_id, s.doc_id, s.cosine, {_cos('i.v', 'd.v')} AS dense
    FROM sparse s JOIN item_v i ON s.item_id = i.item_id JOIN doc_v d ON s.doc_id = d.doc_id)),
direct AS (SELECT f.item_id, f.doc_id, similarity, similarity * length_score AS score FROM fused f JOIN lengths l ON f.doc_id = l.doc_id)"""


@query(
    f"WITH {DIRECT} SELECT item_id, doc_id, round(similarity, 6) AS similarity, round(score, 6) AS score FROM direct"
)
def direct_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused TF-IDF and dense similarity times the length score."""
    item_weights, doc_weights = localization.weighted(
        data.item_tf(spark, sf_dir), data.doc_tf(spark, sf_dir), data.table(spark, sf_dir, "documents")
    )
    fused = localization.similarities(
        data.pool(spark, sf_dir).select("item_id", "doc_id"),
        item_weights,
        doc_weights,
        _vectors_of(spark, sf_dir, "benchmark", "item_id"),
        _vectors_of(spark, sf_dir, "documents", "doc_id"),
        ["item_id"],
        ["doc_id"],
        ["item_id"],
    )
    lengths = scoring.length_scores(_sizes(spark, sf_dir))
    out = scoring.direct_scores(fused, lengths, ["doc_id"])
    return out.select(
        "item_id", "doc_id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score")
    )


@query(
    f"""
WITH {DENSE},
fixes AS (SELECT DISTINCT c_custkey % (SELECT count(*) FROM embeddings) AS report_id, c_nationkey AS key FROM customer)
SELECT vec_id AS report_id, key, max(cosine) AS score FROM dense JOIN fixes ON other_id = fixes.report_id
WHERE vec_id <> other_id GROUP BY ALL"""
)
def indirect_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per report and file the best similarity of another report that fixed the file."""
    n = data.size_of(data.table(spark, sf_dir, "embeddings"))
    fixes = data.table(spark, sf_dir, "customer").select(
        F.pmod("c_custkey", n).alias("report_id"), F.col("c_nationkey").alias("key")
    )
    similar = dense_cosine(spark, sf_dir).withColumnRenamed("vec_id", "report_id")
    return scoring.indirect_scores(similar, fixes, "cosine").select("report_id", "key", "score")


@query(
    f"""
WITH d AS (SELECT user_id AS report_id, event_id // 3 AS key, max(value) AS score FROM events WHERE event_type <> 'view' GROUP BY ALL),
i AS (SELECT user_id AS report_id, event_id // 3 AS key, max(value) AS score FROM events WHERE event_type <> 'click' GROUP BY ALL),
dn AS (SELECT report_id, key, {_mm('score', 'report_id', '1.0')} AS score FROM d),
n AS (SELECT report_id, key, {_mm('score', 'report_id', '1.0')} AS score FROM i)
SELECT dn.report_id, dn.key, round(CASE WHEN n.score IS NOT NULL THEN 0.8 * dn.score + 0.2 * n.score ELSE dn.score END, 6) AS score
FROM dn LEFT JOIN n USING (report_id, key)"""
)
def synthesized_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blend of two score tables."""
    events = data.table(spark, sf_dir, "events")

    def side(other: str) -> DataFrame:
        kept = events.where(F.col("event_type") != other)
        return kept.groupBy(F.col("user_id").alias("report_id"), F.expr("event_id div 3").alias("key")).agg(
            F.max("value").alias("score")
        )

    out = scoring.synthesized(side("view"), side("click"))
    return out.withColumn("score", F.round("score", 6))


LOCALIZED = f"""
{DIRECT},
fixes AS (SELECT item_id, doc_id FROM pool WHERE match = 1),
links AS (SELECT DISTINCT p.item_id, f.item_id AS other FROM pool p JOIN fixes f ON p.doc_id = f.doc_id WHERE p.item_id <> f.item_id),
link_dot AS (SELECT l.item_id, l.other, sum(a.w * b.w) AS dot FROM links l JOIN item_w a ON l.item_id = a.item_id
             JOIN item_w b ON l.other = b.item_id AND a.term = b.term GROUP BY ALL),
link_cos AS (
  SELECT l.item_id, l.other, coalesce(dot / (x.l * y.l), 0) AS lexical, {_cos('p.v', 'q.v')} AS dense
  FROM links l LEFT JOIN link_dot d ON l.item_id = d.item_id AND l.other = d.other
  LEFT JOIN item_len x ON l.item_id = x.item_id LEFT JOIN item_len y ON l.other = y.item_id
  JOIN item_v p ON l.item_id = p.item_id JOIN item_v q ON l.other = q.item_id),
link_sim AS (SELECT item_id, other, {_mm('lexical', 'item_id')} + {_mm('dense', 'item_id')} AS similarity FROM link_cos),
indirect AS (SELECT s.item_id, f.doc_id, max(similarity) AS score FROM link_sim s JOIN fixes f ON s.other = f.item_id GROUP BY ALL),
dn AS (SELECT item_id, doc_id, {_mm('score', 'item_id', '1.0')} AS score FROM direct),
n AS (SELECT item_id, doc_id, {_mm('score', 'item_id', '1.0')} AS score FROM indirect),
localized AS (
  SELECT dn.item_id AS report_id, 'Doc' || dn.doc_id AS key,
         round(CASE WHEN n.score IS NOT NULL THEN 0.8 * dn.score + 0.2 * n.score ELSE dn.score END, 5) AS score
  FROM dn LEFT JOIN n USING (item_id, doc_id))"""


@query(f"WITH {LOCALIZED} SELECT report_id, key, score FROM localized")
def localized_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole localisation: direct and indirect scores of every report over its pool."""
    name = F.concat(F.lit("corpus.Doc"), F.col("doc_id").cast("string"), F.lit(".java"))
    pool = data.pool(spark, sf_dir).select(F.col("item_id").alias("report_id"), name.alias("file"), "match")
    sizes = _sizes(spark, sf_dir).select(name.alias("file"), "size")
    out = localization.localized(
        pool.select("report_id", "file"),
        pool.where(F.col("match") == 1).select("report_id", "file"),
        data.item_tf(spark, sf_dir).withColumnRenamed("item_id", "report_id"),
        data.doc_tf(spark, sf_dir).select(name.alias("file"), "term", "tf"),
        sizes,
        _vectors_of(spark, sf_dir, "benchmark", "item_id").withColumnRenamed("item_id", "report_id"),
        _vectors_of(spark, sf_dir, "documents", "doc_id").select(name.alias("file"), "vector"),
    )
    return out.withColumn("score", F.round("score", 5))


@query(
    f"""
WITH {LOCALIZED}
SELECT 'p' || report_id % 3 AS project_name, report_id, key, score,
       row_number() OVER (PARTITION BY report_id ORDER BY score DESC NULLS LAST, key) AS rank FROM localized"""
)
def ranked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The localised files of every report with their ranks, written a folder a project and read back."""
    project = F.concat(F.lit("p"), (F.col("item_id") % 3).cast("string")).alias("project_name")
    reports = data.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("report_id"), project)
    path = scratch_path(spark, "ranked")
    writers.localized(localization.ranked(localized_files(spark, sf_dir), reports), path)
    return spark.read.parquet(path).select("project_name", "report_id", "key", "score", "rank")


@query(
    f"""
WITH {data.POOL},
files AS (
  SELECT match, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'Doc' || doc_id ELSE 'Doc' || doc_id || '.java' END AS file
  FROM pool),
sides AS (SELECT 'candidate' AS side, file FROM files UNION ALL SELECT 'fix', file FROM files WHERE match = 1)
SELECT side, CASE WHEN file IS NULL THEN 'no file' ELSE 'no stem' END AS reason, count(*) AS n
FROM sides WHERE file IS NULL OR file NOT LIKE '%.%' GROUP BY ALL"""
)
def files_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and fixes that localisation leaves out, counted by reason."""
    number = F.concat(F.lit("Doc"), F.col("doc_id").cast("string"))
    file = F.when(F.col("doc_id") % 7 != 0, F.when(F.col("doc_id") % 5 == 0, number).otherwise(F.concat(number, F.lit(".java"))))
    pool = data.pool(spark, sf_dir).select(F.col("item_id").alias("report_id"), file.alias("file"), "match")
    return localization.left_out(pool, pool.where(F.col("match") == 1))
