"""Def-use graphs. Tokens of distinct documents; a token at an even position is a definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.catalog import data
from faultsift.catalog.registry import query
from faultsift.functions.text import identifier_tokens
from faultsift.operators import graphs, tables, terms
from faultsift.session import stage
from faultsift.sources import writers

LINKED = f"""
contents AS (SELECT md5(text) AS doc_hash, any_value(text) AS text FROM documents GROUP BY 1),
listed AS (SELECT doc_hash, list_transform(regexp_extract_all({data.camel_sql('text')}, '[A-Za-z]+'), lambda x: lower(x)) AS ts FROM contents),
toks AS (SELECT doc_hash, unnest(ts) AS token, unnest(range(len(ts))) AS idx FROM listed),
linked AS (
  SELECT doc_hash, idx, token, max(CASE WHEN idx % 2 = 0 THEN idx END) OVER (
    PARTITION BY doc_hash, token ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src FROM toks)"""

PRUNED = f"""
{LINKED},
used AS (SELECT doc_hash, idx FROM linked WHERE src IS NOT NULL UNION SELECT doc_hash, src FROM linked WHERE src IS NOT NULL),
pruned AS (SELECT l.* FROM linked l JOIN used u ON l.doc_hash = u.doc_hash AND l.idx = u.idx),
nodes AS (SELECT *, row_number() OVER (PARTITION BY doc_hash ORDER BY idx) - 1 AS node_idx FROM pruned),
edges AS (SELECT d.doc_hash, s.node_idx AS src, d.node_idx AS dst FROM nodes d JOIN nodes s ON s.doc_hash = d.doc_hash AND s.idx = d.src)"""


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = data.texts(spark, sf_dir, "documents", "text")
    distinct = tables.distinct_contents(docs, "text")
    token = lambda t, i: F.struct(
        i.cast("bigint").alias("idx"), t.alias("token"), (F.pmod(i, F.lit(2)) == 0).alias("is_def")
    )
    listed = distinct.select("doc_hash", F.transform(identifier_tokens(F.col("text")), token).alias("tokens"))
    return graphs.linked_uses(listed)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruned entries, one row per document."""
    return graphs.pruned(graphs.entries_from_links(_linked(spark, sf_dir)))


def _per_graph(df: DataFrame, *sums: str) -> DataFrame:
    return df.groupBy("doc_hash").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("bigint").alias(f"sum_{c}") for c in sums]
    )


@query(
    f"""
WITH {LINKED}
SELECT doc_hash, count(*) AS n, count(src) AS links, coalesce(sum(src), 0)::BIGINT AS sum_src FROM linked GROUP BY 1"""
)
def linked_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of occurrences to their latest definition, summed up per graph."""
    return graphs.opened(_linked(spark, sf_dir)).groupBy("doc_hash").agg(
        F.count(F.lit(1)).alias("n"), F.count("src").alias("links"), F.coalesce(F.sum("src"), F.lit(0)).alias("sum_src")
    )


@query(f"WITH {PRUNED} SELECT doc_hash, count(*) AS n, sum(idx)::BIGINT AS sum_idx FROM pruned GROUP BY 1")
def pruned_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with a source or a use."""
    return _per_graph(graphs.opened(_entries(spark, sf_dir)), "idx")


@query(
    f"""
WITH {PRUNED}
SELECT doc_hash, count(*) AS n, sum(node_idx * idx)::BIGINT AS sum_place FROM nodes GROUP BY 1"""
)
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes numbered in token order."""
    nodes = graphs.opened(graphs.nodes(_entries(spark, sf_dir)))
    return _per_graph(nodes.withColumn("place", F.col("node_idx") * F.col("idx")), "place")


@query(
    f"""
WITH {PRUNED}
SELECT doc_hash, count(*) AS n, sum(src)::BIGINT AS sum_src, sum(dst)::BIGINT AS sum_dst FROM edges GROUP BY 1"""
)
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between node numbers."""
    nodes = graphs.nodes(_entries(spark, sf_dir))
    return _per_graph(graphs.opened(graphs.edges(nodes, nodes)), "src", "dst")


@query(
    f"""
WITH {PRUNED}
SELECT doc_hash, (SELECT count(*) FROM nodes m WHERE m.doc_hash = n.doc_hash AND m.node_idx < 1024) AS nodes,
       (SELECT count(*) FROM edges e WHERE e.doc_hash = n.doc_hash AND e.src < 1024 AND e.dst < 1024) AS edges
FROM nodes n GROUP BY doc_hash"""
)
def capped_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs cut to the input size of a graph model."""
    nodes = stage(graphs.nodes(_entries(spark, sf_dir)))
    few, arrows = graphs.capped(nodes, graphs.edges(nodes, nodes))
    n = graphs.opened(few).groupBy("doc_hash").agg(F.count(F.lit(1)).alias("nodes"))
    e = graphs.opened(arrows).groupBy("doc_hash").agg(F.count(F.lit(1)).alias("edges"))
    return n.join(e, "doc_hash", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


@query(
    f"""
WITH {PRUNED},
rare AS (SELECT token, row_number() OVER (ORDER BY token) + 1 AS id FROM (SELECT token FROM toks GROUP BY 1 HAVING count(DISTINCT doc_hash) > 5))
SELECT doc_hash, count(*) AS n, sum(coalesce(id, 1))::BIGINT AS sum_token_id FROM nodes LEFT JOIN rare USING (token) GROUP BY 1"""
)
def node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node tokens as vocabulary ids."""
    distinct = tables.distinct_contents(data.texts(spark, sf_dir, "documents", "text"), "text")
    tf = terms.term_frequencies(distinct, ["doc_hash"], identifier_tokens(F.col("text")))
    known = terms.document_frequencies(tf).where(F.col("df") > 5)
    nodes = graphs.opened(graphs.nodes(_entries(spark, sf_dir)))
    return _per_graph(graphs.node_ids(nodes, stage(terms.vocabulary_ids(known)), 1), "token_id")


@query(
    """
WITH e AS (SELECT l_orderkey AS doc_hash, l_linenumber AS idx, l_returnflag AS token, l_linestatus AS relation, l_shipmode AS name, l_suppkey AS src
           FROM (SELECT *, 'n' || (l_suppkey % 5) AS l_shipmode FROM lineitem))
SELECT doc_hash, idx, token, relation, array_to_string(list_sort(list(DISTINCT name)), ',') AS names,
       array_to_string(list_sort(list(DISTINCT src)), ',') AS src_idx FROM e GROUP BY ALL"""
)
def merged_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated entries merged: union of names and sources."""
    items = data.table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("n"), F.pmod("l_suppkey", F.lit(5)).cast("string"))
    entries = items.select(
        F.col("l_orderkey").alias("doc_hash"), F.col("l_linenumber").alias("idx"), F.col("l_returnflag").alias("token"),
        F.col("l_linestatus").alias("relation"), F.array(name).alias("names"), F.array("l_suppkey").alias("src_idx"),
    )
    merged = graphs.merged_entries(entries)
    return merged.withColumns(
        {"names": F.array_join("names", ","), "src_idx": F.array_join(F.col("src_idx").cast("array<string>"), ",")}
    )


@query(
    f"""
WITH {PRUNED}
SELECT n.doc_hash, count(*) AS nodes, (SELECT count(*) FROM edges e WHERE e.doc_hash = n.doc_hash) AS edges,
       arg_min(token, node_idx) AS first_token FROM nodes n GROUP BY 1"""
)
def graph_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs as JSON documents, read back."""
    nodes = graphs.nodes(_entries(spark, sf_dir))
    whole = graphs.edges(nodes, nodes)
    docs = writers.graphs_json(whole, whole)
    parsed = docs.select("doc_hash", F.from_json("graph", "nodes array<string>, edges array<array<bigint>>").alias("g"))
    return parsed.select(
        "doc_hash",
        F.size("g.nodes").cast("bigint").alias("nodes"),
        F.size(F.element_at("g.edges", 1)).cast("bigint").alias("edges"),
        F.element_at("g.nodes", 1).alias("first_token"),
    )
