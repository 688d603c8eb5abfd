"""How the test tables stand in for reports, source files and candidates.

Every view exists twice: as a DataFrame and as a SQL text (a common table expression).

reports     orders; text from the first part name, priority, segment and nation
touches     distinct (order, part) of lineitem with the order date
sources     parts; a few lines of code built from the columns of the part
items       benchmark texts, documents texts
pool        (item, document) from events, match = a purchase among the events
scored      events: query user, candidate event, score value, match = purchase
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.sources.readers import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table with long texts."""
    return spread(table(spark, sf_dir, name).select(*columns))


def size_of(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


# Reports, touches, sources

REPORTS = """
first_part AS (
  SELECT l_orderkey, arg_min(p_name, (l_linenumber, l_partkey)) AS summary
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
reports AS (
  SELECT o_orderkey AS report_id, o_orderdate AS report_time, o_orderpriority AS project_name,
         coalesce(summary, '') || (' ' || o_orderpriority || ' ' || c_mktsegment || ' ' || n_name) AS raw_text
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN first_part ON l_orderkey = o_orderkey)"""

TOUCHES = """
touches AS (
  SELECT DISTINCT l_orderkey AS report_id, l_partkey AS file, o_orderdate AS report_time
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

SOURCES = """
sources AS (
  SELECT p_partkey AS file,
    'package shop.' || lower(p_type) || ';' || chr(10) || 'import java.util.List;' || chr(10) ||
    '/* ' || p_name || ' */' || chr(10) || 'public class ' || replace(p_brand, '#', '') || ' extends ' || p_type ||
    'Part {' || chr(10) || '  String itemName = "' || p_name || ' // in stock"; // ' || p_type || chr(10) ||
    '  int getPartSize() { return ' || p_size || '; }' || chr(10) || '}' || chr(10) AS file_content
  FROM part)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultsift.functions.text import report_text
    from faultsift.operators.skew import unsent

    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    first = (
        items.join(unsent(parts), "l_partkey")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.min_by("p_name", F.struct("l_linenumber", "l_partkey")).alias("summary"))
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").alias("n_nationkey")
    )
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    joined = orders.join(unsent(customers), "o_custkey").join(nations, "n_nationkey").join(first, "o_orderkey", "left")
    description = F.concat(F.lit(" "), F.concat_ws(" ", "o_orderpriority", "c_mktsegment", "n_name"))
    return joined.select(
        F.col("o_orderkey").alias("report_id"),
        F.col("o_orderdate").alias("report_time"),
        F.col("o_orderpriority").alias("project_name"),
        report_text(F.col("summary"), description).alias("raw_text"),
    )


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultsift.operators.skew import dealt

    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("report_id"), F.col("l_partkey").alias("file")
    )
    times = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("report_id"), F.col("o_orderdate").alias("report_time")
    )
    return dealt(items, items.count(), "report_id").distinct().join(times, "report_id")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(
        F.lit("package shop."), F.lower("p_type"), F.lit(";\nimport java.util.List;\n/* "), "p_name",
        F.lit(" */\npublic class "), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(" extends "), "p_type",
        F.lit('Part {\n  String itemName = "'), "p_name", F.lit(' // in stock"; // '), "p_type",
        F.lit("\n  int getPartSize() { return "), F.col("p_size").cast("string"), F.lit("; }\n}\n"),
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), content.alias("file_content"))


# Items, documents, pool

POOL = """
pool AS (
  SELECT user_id % (SELECT count(*) FROM benchmark) AS item_id, event_id // 10 AS doc_id,
         max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS match
  FROM events GROUP BY 1, 2)"""


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = size_of(table(spark, sf_dir, "benchmark"))
    bought = F.when(F.col("event_type") == "purchase", 1).otherwise(0)
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.pmod("user_id", items).alias("item_id"), F.expr("event_id div 10").alias("doc_id"))
        .agg(F.max(bought).alias("match"))
    )


def camel_sql(text: str) -> str:
    return (
        rf"regexp_replace(regexp_replace({text}, '([a-z])([A-Z])', '\1 \2', 'g'), "
        rf"'([A-Z])([A-Z][a-z])', '\1 \2', 'g')"
    )


def tf_sql(name: str, source: str, key: str, text: str, as_key: str | None = None) -> str:
    """Term frequencies of identifier tokens as a common table expression."""
    as_key = as_key or key
    return f"""
{name} AS (
  SELECT {as_key}, term, count(*) AS tf FROM (
    SELECT {key} AS {as_key}, lower(unnest(regexp_extract_all({camel_sql(text)}, '[A-Za-z]+'))) AS term
    FROM {source}) GROUP BY ALL)"""


ITEM_TF = tf_sql("item_tf", "benchmark", "item_id", "text")
DOC_TF = tf_sql("doc_tf", "documents", "doc_id", "text")


def item_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultsift.functions.text import identifier_tokens
    from faultsift.operators.terms import term_frequencies

    items = texts(spark, sf_dir, "benchmark", "item_id", "text")
    return term_frequencies(items, ["item_id"], identifier_tokens(F.col("text")))


def doc_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultsift.functions.text import identifier_tokens
    from faultsift.operators.terms import term_frequencies

    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    return term_frequencies(docs, ["doc_id"], identifier_tokens(F.col("text")))


def pair_cosine_sql(name: str, pairs: str, left: str, right: str, lk: str, rk: str) -> str:
    """Closed form of the two-text cosine; columns of `pairs` and `similarity`."""
    return f"""
{name}_sq AS (SELECT {lk}, sum(tf * tf)::DOUBLE AS la FROM {left} GROUP BY ALL),
{name}_sr AS (SELECT {rk}, sum(tf * tf)::DOUBLE AS ra FROM {right} GROUP BY ALL),
{name}_sh AS (
  SELECT p.{lk}, p.{rk}, sum(l.tf * r.tf)::DOUBLE AS dot, sum(l.tf * l.tf)::DOUBLE AS ls, sum(r.tf * r.tf)::DOUBLE AS rs
  FROM {pairs} p JOIN {left} l ON p.{lk} = l.{lk} JOIN {right} r ON p.{rk} = r.{rk} AND l.term = r.term GROUP BY ALL),
{name} AS (
  SELECT p.*, CASE WHEN la IS NULL AND ra IS NULL THEN NULL WHEN dot IS NULL THEN 0.0 ELSE
    dot / (sqrt(ls + pow(ln(1.5) + 1, 2) * (la - ls)) * sqrt(rs + pow(ln(1.5) + 1, 2) * (ra - rs))) END AS similarity
  FROM {pairs} p LEFT JOIN {name}_sh s ON p.{lk} = s.{lk} AND p.{rk} = s.{rk}
  LEFT JOIN {name}_sq l ON p.{lk} = l.{lk} LEFT JOIN {name}_sr r ON p.{rk} = r.{rk})"""


# Dense vectors

VECTORS = """
vectors AS (SELECT vec_id, embedding::DOUBLE[] AS vector FROM embeddings),
vector_pairs AS (
  SELECT DISTINCT l_orderkey % (SELECT count(*) FROM embeddings) AS vec_id,
         l_partkey % (SELECT count(*) FROM embeddings) AS other_id FROM lineitem)"""


def vectors(spark: SparkSession, sf_dir: str, key: str = "vec_id") -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(key), F.col("embedding").alias("vector"))


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = size_of(table(spark, sf_dir, "embeddings"))
    return (
        table(spark, sf_dir, "lineitem")
        .select(F.pmod("l_orderkey", n).alias("vec_id"), F.pmod("l_partkey", n).alias("other_id"))
        .distinct()
    )


# Scored candidates

SCORED = """
scored AS (
  SELECT user_id AS query_id, event_id AS candidate_id, value AS score, user_id % 6 AS project,
         CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS match FROM events)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("query_id"),
        F.col("event_id").alias("candidate_id"),
        F.col("value").alias("score"),
        F.pmod("user_id", F.lit(6)).alias("project"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("match"),
    )


# Dialogue turns: a user turn is a report, the assistant turn that follows it its code

DIALOGUE = f"""
turn_tokens AS (
  SELECT conv_id, turn, role, list_transform(regexp_extract_all({camel_sql('text')}, '[A-Za-z]+'), lambda x: lower(x)) AS tokens
  FROM conversations),
dialogue AS (
  SELECT q.conv_id, q.turn, q.tokens AS query, c.tokens AS code
  FROM turn_tokens q JOIN turn_tokens c ON c.conv_id = q.conv_id AND c.turn = q.turn + 1
  WHERE q.role = 'user' AND c.role = 'assistant')"""


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultsift.functions.text import identifier_tokens

    turns = texts(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    tokens = turns.withColumn("tokens", identifier_tokens(F.col("text")))
    asked = tokens.where(F.col("role") == "user").select("conv_id", "turn", F.col("tokens").alias("query"))
    given = tokens.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("tokens").alias("code")
    )
    return asked.join(given, ["conv_id", "turn"])
