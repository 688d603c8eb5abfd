"""Steps that must not send or shuffle more than their input allows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultsift.catalog import data
from faultsift.catalog import graphs as graph_queries
from faultsift.llm import probminhash
from faultsift.operators import graphs, sampling, tables
from faultsift.sources import writers


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_sent_through_the_driver(spark, sf_dir):
    features = spark.createDataFrame([("p", 1, "r", 0, "c")], "project_name string, cid bigint, bug_id string, match int, commit string")
    contents = spark.range(9).select(F.lit("p").alias("project_name"), F.col("id").alias("cid"), F.repeat(F.lit("x"), F.lit(99)).alias("file_content"))
    reports = spark.createDataFrame([("r", "p", "text")], "id string, project_name string, raw_text string")
    with_reports = tables.with_reports(features.withColumnRenamed("bug_id", "report_id"), reports)
    for joined in (tables.with_content(features, contents), with_reports, tables.qualified(contents, features)):
        assert "BroadcastHashJoin" not in plan(joined) and joined.count() == 1
    assert plan(data.reports(spark, sf_dir)).count("BroadcastExchange") <= 1  # nations


ENTRIES = [
    ("d", 1, "x", "comesFrom", ["b"], [4, 2, 2]), ("d", 1, "x", "comesFrom", ["a"], [2]), ("d", 1, "x", "computedFrom", [], []),
    ("d", 2, "y", "comesFrom", [], []), ("d", 2, "é", "comesFrom", [], []), ("d", 3, "z", "comesFrom", [], []),
    ("e", 2, "y", "comesFrom", [], []), ("e", 9, None, "comesFrom", [], [2, 7, None]), ("f", 0, "x", "comesFrom", [], []),
]


def listed(df, name):
    columns = [c for c in df.columns if c != "doc_hash"]
    return df.groupBy("doc_hash").agg(F.collect_list(F.struct(*columns)).alias(name))


def test_listed_graphs_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(graphs, "BATCH_GRAPHS", 2)
    schema = "doc_hash string, idx bigint, token string, relation string, names array<string>, src_idx array<bigint>"
    long = spark.createDataFrame(ENTRIES, schema)
    pruned, whole = graphs.pruned(long), graphs.pruned(listed(long, "entries"))
    same = lambda a, b, *c: rows(a, "doc_hash", *c) == rows(graphs.opened(b), "doc_hash", *c)
    assert same(pruned, whole, "idx", F.coalesce("token", F.lit("")), "relation", F.to_json("src_idx"))
    nodes, placed = graphs.nodes(pruned), graphs.nodes(whole)
    assert same(nodes, placed, "node_idx", "idx", F.coalesce("token", F.lit("")), "relation")
    edges, arrows = graphs.edges(pruned, nodes), graphs.edges(whole, placed)
    assert same(edges, arrows, "src", "dst") and edges.count() > 0
    assert same(edges, graphs.edges(placed, placed), "src", "dst")
    for a, b in zip(graphs.capped(nodes, edges, 2), graphs.capped(placed, arrows, 2)):
        assert rows(a, "doc_hash", *a.columns[1:2]) == rows(graphs.opened(b), "doc_hash", *a.columns[1:2])
    docs = rows(writers.graphs_json(nodes, edges), "doc_hash", "graph")
    for pair in ((placed, arrows), (arrows, arrows)):
        assert docs == rows(writers.graphs_json(*pair), "doc_hash", "graph")


@pytest.mark.parametrize("distance", [2, 3])
def test_listed_links_equal_rows(spark, distance):
    token = F.concat(F.lit("t"), (F.col("id") % 7).cast("string"))
    long = spark.range(200).select((F.col("id") % 3).cast("string").alias("doc_hash"), F.col("id").alias("idx"), token.alias("token"), (F.col("id") % distance == 0).alias("is_def"))
    a, b = graphs.linked_uses(long), graphs.linked_uses(listed(long, "tokens"))
    shown = ("doc_hash", "idx", "token", F.coalesce("src", F.lit(-1)))
    assert rows(a, *shown) == rows(graphs.opened(b), *shown)
    keys = ("doc_hash", "idx", F.to_json("names"), F.to_json("src_idx"))
    assert rows(graphs.entries_from_links(a), *keys) == rows(graphs.opened(graphs.entries_from_links(b)), *keys)


def test_tokens_are_not_shuffled(spark, sf_dir):
    """Texts are dealt by content once; what follows are sums by graph."""
    found = plan(graph_queries.graph_nodes(spark, sf_dir))
    assert "Window" not in found and found.count("Exchange hashpartitioning") <= 2


def test_counts_of_shingles_travel_by_range(spark, monkeypatch):
    """Each of many tasks with the same shingles hands on a row a range, not a row a shingle."""
    monkeypatch.setattr(probminhash, "RANGES", 4)
    sets = spark.range(0, 24, 1, 6).select(F.array_append(F.sequence(F.lit(0).cast("long"), F.lit(999).cast("long")), -F.col("id") - 1).alias("elements"))
    seen = []
    plain = type(sets).groupBy
    monkeypatch.setattr(type(sets), "groupBy", lambda df, *c: seen.append(df.count()) or plain(df, *c))
    held = probminhash._holders(sets)
    assert seen == [12]  # two ranges a task
    assert held[:1000].tolist() == [24] * 1000 and held[-24:].tolist() == [1] * 24 and int(np.sum(held)) == 24 * 1001


@pytest.mark.parametrize("block", [3, 512])
def test_draws_are_not_shuffled(spark, monkeypatch, block):
    """Positives meet the blocks of their walk; no row per draw is joined."""
    monkeypatch.setattr(sampling, "DRAW_BLOCK", block)
    files = spark.range(40).select(F.col("id").alias("file"))
    positives = spark.range(90).select((F.col("id") % 11).alias("report_id"), (F.col("id") * 7 % 43).alias("file")).distinct()
    found = sampling.sampled_wrong_files(positives, files, 2)
    assert "Join [place" not in plan(found)
    placed = sampling.circle(files)
    named = sampling.drawn_places(positives, placed, 2).select("report_id", "file", F.posexplode("places").alias("_at", "place"))
    want = named.join(placed.withColumnRenamed("file", "candidate"), "place").withColumn("draw", F.col("_at") + 1)
    columns = ("report_id", "file", "candidate", "draw")
    assert rows(found, *columns) == rows(want, *columns) and found.count() > 0
