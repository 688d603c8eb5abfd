"""Table operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.catalog import data
from faultsift.catalog.registry import query
from faultsift.functions import paths, text
from faultsift.operators import tables
from faultsift.operators.running import id_block
from faultsift.operators.skew import unsent
from faultsift.plans import datasets


@query(
    """
SELECT bool_or(c.c_name IS NULL) AS c_name, bool_or(o.o_orderkey IS NULL) AS o_orderkey, bool_or(o.o_orderstatus IS NULL) AS o_orderstatus
FROM customer c LEFT JOIN orders o ON c_custkey = o_custkey"""
)
def null_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns have a null."""
    customers = data.table(spark, sf_dir, "customer")
    joined = customers.join(data.table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return tables.null_audit(joined, ["c_name", "o_orderkey", "o_orderstatus"])


@query(
    """
SELECT o_orderkey, o_orderpriority FROM orders WHERE (o_custkey, o_orderstatus) IN (
  SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 300000)"""
)
def split_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose composite key occurs in another table."""
    orders = data.table(spark, sf_dir, "orders")
    members = orders.where(F.col("o_totalprice") > 300000)
    return tables.keep(orders, members, ["o_custkey", "o_orderstatus"]).select("o_orderkey", "o_orderpriority")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def never_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files no report of a kind touched."""
    touched = data.table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    files = data.table(spark, sf_dir, "part").select("p_partkey")
    return tables.without(files, touched.select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


@query(
    """
SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1"""
)
def first_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row per key."""
    items = data.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]
    return tables.first_by(items, ["l_orderkey"], order).drop("l_linenumber")


@query(
    """
WITH f AS (SELECT l_orderkey AS id, l_linenumber AS line, min(l_partkey) AS part FROM lineitem WHERE l_quantity < 40 GROUP BY 1, 2),
r AS (SELECT l_orderkey AS id, l_linenumber AS line, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2)
SELECT coalesce(f.id, r.id) AS id, coalesce(f.line, r.line) AS line, part, n FROM f FULL JOIN r ON f.id = r.id AND f.line = r.line"""
)
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables aligned on a key after dropping repeated keys."""
    items = data.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), "l_quantity"
    )
    left = items.where(F.col("l_quantity") < 40).select("id", "line", "part")
    right = items.where(F.col("l_quantity") > 10).groupBy("id", "line").agg(F.count(F.lit(1)).alias("n"))
    return tables.align(left, right, ["id", "line"], [F.col("part")])


@query(
    """
SELECT l_orderkey, l_returnflag, n FROM (
  SELECT l_orderkey, l_returnflag, count(*) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, l_returnflag) AS rn
  FROM lineitem GROUP BY 1, 2) WHERE rn = 1"""
)
def most_common_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent value per key."""
    return tables.most_common(data.table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag")


JOINED = f"""
{data.REPORTS}, {data.SOURCES},
cands AS (SELECT l_orderkey AS report_id, l_partkey AS cid, o_orderpriority AS project_name, l_linenumber, l_suppkey,
                 CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS match
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = data.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("report_id"), F.col("o_orderpriority").alias("project_name")
    )
    items = data.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("report_id"), F.col("l_partkey").alias("cid"), "l_linenumber", "l_suppkey",
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("match"),
    )
    return items.join(unsent(orders), "report_id")


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every project has every file."""
    projects = data.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("project_name")).distinct()
    files = data.sources(spark, sf_dir).withColumnRenamed("file", "cid")
    listed = projects.agg(F.array_sort(F.collect_set("project_name"))).scalar()  # five priorities
    return files.withColumn("project_name", F.explode(listed))


@query(
    f"""
WITH {JOINED}
SELECT c.report_id, c.cid, c.l_linenumber, c.l_suppkey, md5(file_content) AS content, md5(raw_text) AS report
FROM cands c JOIN sources s ON s.file = c.cid JOIN reports r ON r.report_id = c.report_id"""
)
def candidate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates joined with file contents and reports."""
    reports = data.reports(spark, sf_dir).select(F.col("report_id").alias("id"), "project_name", "raw_text")
    with_content = tables.with_content(_candidates(spark, sf_dir), _contents(spark, sf_dir))
    joined = tables.with_reports(with_content, reports)
    return joined.select(
        "report_id", "cid", "l_linenumber", "l_suppkey",
        F.md5("file_content").alias("content"), F.md5("raw_text").alias("report"),
    )


@query(
    f"""
WITH {JOINED}
SELECT c.project_name, c.cid, length(file_content) AS size, c.report_id AS bug_id, c.l_suppkey AS commit, c.match
FROM cands c JOIN sources s ON s.file = c.cid"""
)
def qualified_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of files with the bugs they belong to."""
    sized = _contents(spark, sf_dir).select("project_name", "cid", F.length("file_content").cast("bigint").alias("size"))
    mapping = _candidates(spark, sf_dir).withColumnsRenamed({"report_id": "bug_id", "l_suppkey": "commit"})
    return tables.qualified(sized, mapping)


@query(
    """
WITH s AS (SELECT l_orderkey, sum(l_discount) AS d FROM lineitem WHERE l_discount > 0.05 GROUP BY 1)
SELECT o_orderkey AS key, round(coalesce(d, 0), 6) AS score FROM orders LEFT JOIN s ON o_orderkey = l_orderkey"""
)
def default_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores written back to their rows, 0 elsewhere."""
    rows = data.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    found = data.table(spark, sf_dir, "lineitem").where(F.col("l_discount") > 0.05)
    scores = found.groupBy(F.col("l_orderkey").alias("key")).agg(F.sum("l_discount").alias("score"))
    return tables.with_default(rows, scores, ["key"], "score").withColumn("score", F.round("score", 6))


@query(
    """
SELECT project_name, count(*) AS n, sum(length(report))::BIGINT AS chars FROM (
  SELECT 'talk' AS project_name, coalesce(role, '') || coalesce(text, '') AS report FROM conversations
  UNION ALL SELECT 'item', text FROM benchmark UNION ALL SELECT 'site', url || html FROM pages)
GROUP BY 1"""
)
def combined_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report table from three projects."""
    parts = {
        "talk": data.table(spark, sf_dir, "conversations").select(F.col("role").alias("summary"), F.col("text").alias("description")),
        "item": data.table(spark, sf_dir, "benchmark").select(F.lit(None).cast("string").alias("summary"), F.col("text").alias("description")),
        "site": data.table(spark, sf_dir, "pages").select(F.col("url").alias("summary"), F.col("html").alias("description")),
    }
    merged = datasets.combined_reports(parts)
    return merged.groupBy("project_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("report")).alias("chars")
    )


@query("SELECT md5(text) AS doc_hash, count(*) AS copies FROM documents GROUP BY 1")
def distinct_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per content, with the number of copies."""
    docs = data.table(spark, sf_dir, "documents").select("doc_id", "text")
    hashed = docs.select(F.md5("text").alias("doc_hash"))
    copies = hashed.groupBy("doc_hash").agg(F.count(F.lit(1)).alias("copies"))
    return tables.distinct_contents(docs, "text").select("doc_hash").join(copies, "doc_hash")


@query(
    """
SELECT reason, count(*) AS n FROM (
  SELECT CASE WHEN quality IS NULL THEN 'no label' WHEN toxic = 1 THEN 'toxic' WHEN n_chars < 200 THEN 'short' END AS reason
  FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE reason IS NOT NULL GROUP BY 1"""
)
def reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left out, counted by the first reason that applies."""
    docs = data.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    joined = docs.join(data.table(spark, sf_dir, "labels"), "doc_id", "left")
    return tables.rejects(
        joined, {"no label": F.col("quality").isNull(), "toxic": F.col("toxic") == 1, "short": F.col("n_chars") < 200}
    )


@query(
    """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen, json_extract_string(props, '$.k')::DOUBLE AS number,
       event_type || coalesce(CASE WHEN value > 50 THEN event_type END, '') AS loose,
       event_type || CASE WHEN value > 50 THEN event_type END AS strict
FROM events"""
)
def typed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed times, numbers from text, joined texts with both null rules."""
    events = data.table(spark, sf_dir, "events")
    half = F.when(F.col("value") > 50, F.col("event_type"))
    seen = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return events.select(
        "event_id",
        F.date_format(paths.report_time(seen), "yyyy-MM-dd HH:mm:ss").alias("seen"),
        paths.to_number(F.get_json_object("props", "$.k")).alias("number"),
        text.report_text(F.col("event_type"), half).alias("loose"),
        text.report_text(F.col("event_type"), half, null_safe=False).alias("strict"),
    )


@query(
    """
SELECT count(*) AS complete, (SELECT count(DISTINCT coalesce(o_orderstatus, '')) FROM customer LEFT JOIN orders ON c_custkey = o_custkey) AS filled
FROM customer JOIN orders ON c_custkey = o_custkey"""
)
def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without nulls; distinct values after filling nulls."""
    joined = data.table(spark, sf_dir, "customer").join(
        data.table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left"
    )
    filled = joined.na.fill("", ["o_orderstatus"]).agg(F.count_distinct("o_orderstatus")).scalar()
    return joined.na.drop("any").agg(F.count(F.lit(1)).alias("complete")).select("complete", filled.alias("filled"))


@query(
    f"""
WITH {data.REPORTS}, m AS (
  SELECT report_id, 'within_project' AS data_setting, CASE WHEN year(report_time) < 2000 THEN 'train' ELSE 'test' END AS split, project_name, raw_text FROM reports
  UNION ALL SELECT report_id, 'cross_project', CASE WHEN project_name = '1-URGENT' THEN 'test' ELSE 'train' END, project_name, raw_text FROM reports
  UNION ALL SELECT report_id, 'cross_project_and_within_project',
         CASE WHEN project_name = '1-URGENT' AND year(report_time) >= 2000 THEN 'test' ELSE 'train' END, project_name, raw_text FROM reports)
SELECT data_setting, split, project_name, count(*) AS n, sum(length(raw_text))::BIGINT AS chars FROM m GROUP BY ALL"""
)
def split_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of the three data settings by split, from a membership table."""
    reports = data.reports(spark, sf_dir).select(
        F.col("report_id").alias("bug_id"), F.year("report_time").alias("commit"), "project_name", "raw_text"
    )
    within = F.when(F.col("commit") < 2000, "train").otherwise("test")
    cross = F.when(F.col("project_name") == "1-URGENT", "test").otherwise("train")
    both = F.when((cross == "test") & (within == "test"), "test").otherwise("train")
    settings = F.array(
        F.struct(F.lit("within_project").alias("data_setting"), within.alias("split")),
        F.struct(F.lit("cross_project").alias("data_setting"), cross.alias("split")),
        F.struct(F.lit("cross_project_and_within_project").alias("data_setting"), both.alias("split")),
    )
    membership = reports.select("bug_id", "commit", "project_name", F.inline(settings))
    split = datasets.split_reports(reports, membership)
    return split.groupBy("data_setting", "split", "project_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("raw_text")).alias("chars")
    )


@query(
    f"""
WITH {JOINED},
full_set AS (SELECT c.*, file_content, raw_text FROM cands c JOIN sources s ON s.file = c.cid JOIN reports r ON r.report_id = c.report_id),
pos AS (SELECT report_id, row_number() OVER (ORDER BY report_id, l_linenumber, cid, l_suppkey) AS rn, count(*) OVER () AS n FROM full_set WHERE match = 1),
train AS (SELECT DISTINCT report_id FROM pos WHERE rn <= n - ceil(0.4 * n)),
rows AS (SELECT *, row_number() OVER (PARTITION BY report_id, match ORDER BY report_id, l_linenumber, cid, l_suppkey) AS rn
         FROM full_set WHERE report_id IN (SELECT report_id FROM train))
SELECT report_id AS id, cid, md5(raw_text) AS report, md5(file_content) AS file_content, match FROM rows WHERE match = 1 OR rn <= 10"""
)
def small_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows of an ordered split with ten non-matches per bug."""
    reports = data.reports(spark, sf_dir).select(
        F.col("report_id").alias("id"), F.col("report_id").alias("bug_id"), "project_name",
        F.col("raw_text").alias("summary"), F.lit("").alias("description"),
    )
    order = [F.col(c) for c in ("report_id", "l_linenumber", "cid", "l_suppkey")]
    out = datasets.small_training_set(
        reports, _candidates(spark, sf_dir), _contents(spark, sf_dir), order, id_block(F.col("report_id")), negatives=10
    )
    return out.withColumns({"report": F.md5("report"), "file_content": F.md5("file_content")})
