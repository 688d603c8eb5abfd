"""Tables written and read back, below the shared folder of the session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.catalog import data
from faultsift.catalog.registry import query
from faultsift.functions.text import prose_words
from faultsift.plans import datasets
from faultsift.session import scratch_path, unstage
from faultsift.sources import readers, schemas, writers


@query(
    """
SELECT o_orderkey::VARCHAR AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS seen, 2 AS n_files,
       'src/' || o_orderstatus || '.java' AS first_file, md5(o_orderpriority || chr(10) || '"quoted"' || chr(9) || 'text') AS digest
FROM orders"""
)
def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports through tab separated text with quotes, tabs and line breaks in it."""
    orders = data.table(spark, sf_dir, "orders")
    rows = orders.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").alias("bug_id"),
        F.lit("c0").alias("commit"),
        F.col("o_orderpriority").alias("summary"),
        F.lit('\n"quoted"\ttext').alias("description"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("report_time"),
        F.concat(F.lit("./src//"), "o_orderstatus", F.lit(".java lib/x/../y.java")).alias("files"),
    )
    path = scratch_path(spark, "reports")
    writers.delimited(rows, path, "\t")
    return readers.reports(spark, path, "shop").select(
        "id",
        F.date_format("report_time", "yyyy-MM-dd HH:mm:ss").alias("seen"),
        F.size("files").alias("n_files"),
        F.element_at("files", 1).alias("first_file"),
        F.md5("raw_text").alias("digest"),
    )


@query(
    """
SELECT l_orderkey::VARCHAR AS report_id, l_partkey::VARCHAR AS file, l_discount AS rVSM_similarity, l_tax AS collab_filter,
       l_quantity AS classname_similarity, l_extendedprice AS bug_recency, l_linenumber AS bug_frequency,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS match FROM lineitem"""
)
def feature_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature table through comma separated text."""
    rows = data.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("report_id"),
        F.col("l_partkey").cast("string").alias("file"),
        F.col("l_discount").alias("rVSM_similarity"),
        F.col("l_tax").alias("collab_filter"),
        F.col("l_quantity").alias("classname_similarity"),
        F.col("l_extendedprice").alias("bug_recency"),
        F.col("l_linenumber").alias("bug_frequency"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("match"),
    )
    path = scratch_path(spark, "features")
    writers.features(rows, path)
    return readers.features(spark, path)


# A split by row, by project and by both.
SETTINGS = """
  SELECT *, 'within_project' AS data_setting, CASE WHEN early THEN 'train' ELSE 'test' END AS split FROM base
  UNION ALL SELECT *, 'cross_project', CASE WHEN other THEN 'train' ELSE 'test' END FROM base
  UNION ALL SELECT *, 'cross_project_and_within_project', CASE WHEN other OR early THEN 'train' ELSE 'test' END FROM base"""


def in_all_settings(rows: DataFrame, early: Column, other: Column) -> DataFrame:
    """`rows` in each of the three settings: `early` rows train within a project, rows of `other` projects across."""
    side = lambda train: F.when(train, "train").otherwise("test").alias("split")
    tests = zip(schemas.DATA_SETTINGS, (other, early, other | early), strict=True)
    return rows.select("*", F.inline(F.array(*[F.struct(F.lit(name).alias("data_setting"), side(train)) for name, train in tests])))


@query(
    f"""
WITH base AS (SELECT *, year(o_orderdate) < 2000 AS early, o_orderpriority <> '1-URGENT' AS other FROM orders), settings AS ({SETTINGS})
SELECT data_setting, o_orderpriority AS project_name, split, count(*) AS n, sum(o_custkey)::BIGINT AS customers FROM settings GROUP BY ALL"""
)
def data_set_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data set of three settings in folders data_setting / project_name / split."""
    orders = data.table(spark, sf_dir, "orders")
    rows = in_all_settings(orders, F.year("o_orderdate") < 2000, F.col("o_orderpriority") != "1-URGENT")
    path = scratch_path(spark, "data-set")
    writers.data_set(rows.select("data_setting", F.col("o_orderpriority").alias("project_name"), "split", "o_custkey"), path)
    return (
        readers.table(spark, path).groupBy("data_setting", "project_name", "split")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("customers"))
    )


QUERY_MAX, CODE_MAX, NEGATIVES = 50, 500, 10
_WORDS = "len(regexp_extract_all({}.text, '[\\p{{L}}\\p{{N}}'']+'))"
CANDIDATES = f"""
base AS (
  SELECT user_id AS bug_id, event_id AS cid, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS match, 'p' || user_id % 3 AS project_name,
         user_id % 5 <> 0 AS early, user_id % 3 <> 2 AS other, {_WORDS.format('b')} AS report_words, {_WORDS.format('d')} AS code_words
  FROM events JOIN benchmark b ON item_id = user_id % (SELECT count(*) FROM benchmark)
  JOIN documents d ON doc_id = event_id % (SELECT count(*) FROM documents)),
settings AS ({SETTINGS}),
fitting AS (SELECT * FROM settings WHERE report_words <= {QUERY_MAX} AND code_words <= {CODE_MAX}),
counts AS (SELECT data_setting, project_name, split, bug_id, sum(match) AS pos, sum(1 - match) AS neg FROM fitting GROUP BY ALL)"""


def _two_runs(spark: SparkSession, sf_dir: str) -> str:
    """Sample folders of two projects, then of all three with another seed, which leaves the first as they are."""
    tokens = lambda name, key: data.texts(spark, sf_dir, name, key, "text").select(key, prose_words(F.col("text")).alias("tokens"))
    reports, files = tokens("benchmark", "item_id"), tokens("documents", "doc_id")
    events = data.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("bug_id"),
        F.col("event_id").alias("cid"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("match"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("project_name"),
        F.pmod("user_id", data.size_of(data.table(spark, sf_dir, "benchmark"))).alias("item_id"),
        F.pmod("event_id", data.size_of(data.table(spark, sf_dir, "documents"))).alias("doc_id"),
    )
    texts = {
        "report_processed": reports.withColumnRenamed("tokens", "report_processed"),
        "file_content_processed": files.withColumnRenamed("tokens", "file_content_processed"),
    }
    sized = datasets.sized_candidates(events, texts)
    candidates = in_all_settings(sized, F.col("bug_id") % 5 != 0, F.col("bug_id") % 3 != 2)
    path = scratch_path(spark, "samples")
    for seed, rows in (("0", candidates.where(F.col("project_name") != "p2")), ("1", candidates)):
        datasets.add_sample_folders(rows, path, QUERY_MAX, CODE_MAX, NEGATIVES, seed, texts=texts)
    unstage(sized)
    return path


@query(
    f"""
WITH {CANDIDATES},
drawn AS (
  SELECT *, row_number() OVER (
      PARTITION BY data_setting, split, bug_id, match
      ORDER BY CASE WHEN match = 1 THEN '' ELSE md5(concat_ws('|', CASE WHEN project_name = 'p2' THEN '1' ELSE '0' END,
                                                              data_setting, project_name, split, bug_id, cid)) END, cid) AS rn
  FROM fitting SEMI JOIN (SELECT * FROM counts WHERE pos > 0 AND neg >= {NEGATIVES}) c USING (data_setting, project_name, split, bug_id))
SELECT data_setting, project_name, split, bug_id, cid, match, report_words, code_words
FROM drawn WHERE rn <= CASE WHEN match = 1 THEN 1 ELSE {NEGATIVES} END"""
)
def sample_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking samples of three settings, written in two runs."""
    samples = readers.table(spark, f"{_two_runs(spark, sf_dir)}/samples")
    words = [F.size(c).alias(n) for c, n in (("report_processed", "report_words"), ("file_content_processed", "code_words"))]
    return samples.select("data_setting", "project_name", "split", "bug_id", "cid", "match", *words)


@query(
    f"""
WITH {CANDIDATES}
SELECT data_setting, project_name, split, 'candidate' AS unit, 'too many words' AS reason, count(*) AS n
FROM settings WHERE report_words > {QUERY_MAX} OR code_words > {CODE_MAX} GROUP BY ALL
UNION ALL
SELECT data_setting, project_name, split, 'bug', CASE WHEN pos = 0 THEN 'no positive' ELSE 'too few negatives' END AS reason, count(*)
FROM counts WHERE pos = 0 OR neg < {NEGATIVES} GROUP BY ALL"""
)
def sample_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two runs of the sample folders left out, by reason."""
    rejects = readers.table(spark, f"{_two_runs(spark, sf_dir)}/rejects")
    return rejects.select("data_setting", "project_name", "split", "unit", "reason", "n")


@query("SELECT doc_id::VARCHAR AS id, md5(array_to_string(regexp_extract_all(text, '[\\p{L}\\p{N}'']+'), ' ')) AS digest FROM documents")
def keyed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines `id TAB text` written and read back."""
    docs = data.texts(spark, sf_dir, "documents", "doc_id", "text")
    line = F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.array_join(prose_words(F.col("text")), " "))
    path = scratch_path(spark, "lines")
    docs.select(line.alias("value")).write.text(path)
    return readers.keyed_text(spark, path).select("id", F.md5("text").alias("digest"))


@query(
    """
SELECT event_id::INTEGER AS cid, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS match, value AS predicted, user_id::VARCHAR AS bug_id FROM events"""
)
def ranking_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking through comma separated text."""
    from faultsift.sources import schemas

    rows = data.scored(spark, sf_dir).select(
        F.col("candidate_id").alias("cid"), "match", F.col("score").alias("predicted"), F.col("query_id").alias("bug_id")
    )
    path = scratch_path(spark, "ranking")
    writers.ranking(rows, path)
    return readers.delimited(spark, path, schemas.RANKING)


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def still_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows the existing output does not have yet."""
    rows = data.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    done = data.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))
    return writers.missing_from(rows, done, ["key"])
