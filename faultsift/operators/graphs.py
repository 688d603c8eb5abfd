"""Def-use graphs as node and edge tables.

Input are entries (doc_hash, idx, token, relation, names, src_idx): token number `idx` takes its
value from the tokens at the positions `src_idx`.

A table has one row per token, entry, node or edge, or is listed: one row per graph with its doc_hash
and an array of them in the column `tokens`, `entries`, `nodes` or `edges`. Operators return what they
take. Listed graphs are worked on where they are, a batch at a time, and keep the lists they came from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from faultsift.operators.blocks import flat
from faultsift.operators.running import numbered, running

POSITION_BLOCK = 1 << 18
MAX_NODES = 1024
#: Graphs whose arrays are worked on at a time.
BATCH_GRAPHS = 1_000
LISTS = ("edges", "nodes", "entries", "tokens")
TOKENS = "array<struct<idx: bigint, token: string, is_def: boolean, src: bigint>>"
ENTRIES = "array<struct<idx: bigint, token: string, relation: string, names: array<string>, src_idx: array<bigint>>>"
NODES = "array<struct<node_idx: bigint, idx: bigint, token: string, relation: string>>"
EDGES = "array<struct<src: bigint, dst: bigint>>"


def opened(graphs: DataFrame) -> DataFrame:
    """Listed graphs as one row per edge, node, entry or token: of the first of these lists they have."""
    return graphs.select("doc_hash", F.inline(next(F.col(c) for c in LISTS if c in graphs.columns)))


def _each(
    graphs: DataFrame, columns: list[str], name: str, kind: str, work: Callable[..., tuple[pa.Array, np.ndarray]], kept: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_hash, name, kept lists): the list that `work` makes of the lists of each graph.

    `work` gets for every column its values and the graph of each, and returns values in the order of
    their graphs, with the graph of each.
    """
    schema = T.StructType([graphs.schema["doc_hash"], *T.StructType.fromDDL(f"{name} {kind}").fields, *[graphs.schema[c] for c in kept]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, BATCH_GRAPHS):
                batch = whole.slice(low, BATCH_GRAPHS)
                n, lists = batch.num_rows, []
                for i in range(len(columns)):
                    ends, values = flat(batch.column(1 + i))
                    lists += [values, np.repeat(np.arange(n), np.diff(ends))]
                values, graph = work(*lists)
                ends = np.concatenate([[0], np.cumsum(np.bincount(graph, minlength=n))])
                made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values).cast(arrow.field(1).type)
                along = [batch.column(1 + columns.index(c)).cast(arrow.field(c).type) for c in kept]
                yield pa.RecordBatch.from_arrays([batch.column(0), made, *along], schema=arrow)

    return graphs.select("doc_hash", *columns).mapInArrow(run, schema)


def _numbers(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()))


def _ranks(column: pa.Array) -> np.ndarray:
    """The place of every text among the distinct texts in their order, -1 for null."""
    coded = column.dictionary_encode()
    rank = np.empty(len(coded.dictionary), "int64")
    rank[np.asarray(pc.array_sort_indices(coded.dictionary))] = np.arange(len(rank))
    where = np.asarray(coded.indices.fill_null(-1))
    return np.where(where < 0, -1, rank[where] if len(rank) else -1)


def _starts(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether a place of a sorted order differs from the one before in a key."""
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return new


def _names(*keys: np.ndarray) -> np.ndarray:
    """One number for equal rows of the keys."""
    order = np.lexsort(keys)
    named = np.empty(len(order), "int64")
    named[order] = np.cumsum(_starts(order, *keys)) - 1
    return named


def _records(**columns: np.ndarray | pa.Array) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns.values()], list(columns))


def merged_entries(entries: DataFrame) -> DataFrame:
    """One entry per (doc_hash, idx, token, relation): union of names, sorted union of sources.

    Values are made distinct before they are collected, so an array holds distinct positions only.
    """
    keys = ["doc_hash", "idx", "token", "relation"]
    names = entries.select(*keys, F.explode_outer("names").alias("name")).distinct()
    sources = entries.select(*keys, F.explode_outer("src_idx").alias("src")).distinct()
    named = names.groupBy(*keys).agg(F.array_sort(F.collect_list("name")).alias("names"))
    sourced = sources.groupBy(*keys).agg(F.array_sort(F.collect_list("src")).alias("src_idx"))
    return named.join(sourced, keys)


def raw_edges(entries: DataFrame) -> DataFrame:
    """Rows (doc_hash, src, dst) over token positions."""
    return entries.select("doc_hash", F.explode("src_idx").alias("src"), F.col("idx").alias("dst"))


def pruned(entries: DataFrame) -> DataFrame:
    """Entries that have a source or are one."""
    if "entries" in entries.columns:
        return _each(entries, ["entries"], "entries", ENTRIES, _pruned)
    edges = raw_edges(entries)
    used = edges.select("doc_hash", F.col("src").alias("idx")).union(edges.select("doc_hash", "dst")).distinct()
    return entries.join(used, ["doc_hash", "idx"], "left_semi")


def _pruned(entries: pa.Array, graph: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    ends, sources = flat(entries.field("src_idx"))
    counts = np.diff(ends)
    known = np.asarray(sources.is_valid())
    of = np.repeat(graph, counts)[known]
    named = _names(np.concatenate([_numbers(entries.field("idx")), _numbers(sources.drop_null())]), np.concatenate([graph, of]))
    own = named[: len(graph)]
    kept = np.flatnonzero(np.isin(own, np.concatenate([own[counts > 0], named[len(graph) :]])))
    return entries.take(pa.array(kept)), graph[kept]


def nodes(entries: DataFrame) -> DataFrame:
    """Rows (doc_hash, node_idx, idx, token): entries numbered from 0 in token order."""
    if "entries" in entries.columns:
        return _each(entries, ["entries"], "nodes", NODES, _nodes, ("entries",))
    keys = ["idx", "token", "relation"]
    rows = entries.select("doc_hash", *keys).distinct()
    order = [F.col(k) for k in keys]
    block = F.floor(F.col("idx") / POSITION_BLOCK)
    placed = numbered(rows, ["doc_hash"], order, block, "_rn")
    return placed.select("doc_hash", (F.col("_rn") - 1).alias("node_idx"), "idx", "token", "relation")


def _nodes(entries: pa.Array, graph: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    idx, token, relation = _numbers(entries.field("idx")), entries.field("token"), entries.field("relation")
    keys = (_ranks(relation), _ranks(token), idx, graph)
    order = np.lexsort(keys)
    kept = order[_starts(order, *keys)]
    graph = graph[kept]
    number = np.arange(len(kept)) - np.searchsorted(graph, graph)
    at = pa.array(kept)
    return _records(node_idx=number, idx=idx[kept], token=token.take(at), relation=relation.take(at)), graph


def edges(entries: DataFrame, numbered_nodes: DataFrame) -> DataFrame:
    """Rows (doc_hash, src, dst) over node numbers.

    Where a token position has several entries, the last one stands for it as a source. Listed nodes
    hold their entries; given as both tables, they are not joined with themselves.
    """
    if "entries" in entries.columns:
        both = entries
        if entries is not numbered_nodes:
            both = entries.select("doc_hash", "entries").join(numbered_nodes.select("doc_hash", "nodes"), "doc_hash")
        return _each(both, ["entries", "nodes"], "edges", EDGES, _edges, ("nodes",))
    arrows = entries.select("doc_hash", "idx", "token", "relation", F.explode("src_idx").alias("src_pos")).distinct()
    targets = arrows.join(numbered_nodes, ["doc_hash", "idx", "token", "relation"]).select(
        "doc_hash", "src_pos", F.col("node_idx").alias("dst")
    )
    last = numbered_nodes.groupBy("doc_hash", "idx").agg(F.max("node_idx").alias("src"))
    return targets.join(last.withColumnRenamed("idx", "src_pos"), ["doc_hash", "src_pos"]).select(
        "doc_hash", "src", "dst"
    )


def _edges(entries: pa.Array, graph: np.ndarray, nodes: pa.Array, of: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    number, place = _numbers(nodes.field("node_idx")), _numbers(nodes.field("idx"))
    ends, sources = flat(entries.field("src_idx"))
    keyed = np.asarray(entries.field("token").is_valid()) & np.asarray(entries.field("relation").is_valid())
    known = np.asarray(sources.is_valid()) & np.repeat(keyed, np.diff(ends))
    entry = np.repeat(np.arange(len(graph)), np.diff(ends))[known]
    source = _numbers(sources.filter(pa.array(known)))
    texts = [_ranks(pa.concat_arrays([nodes.field(c), entries.field(c)])) for c in ("token", "relation")]
    named = _names(*texts, np.concatenate([place, _numbers(entries.field("idx"))]), np.concatenate([of, graph]))
    positions = _names(np.concatenate([place, source]), np.concatenate([of, graph[entry]]))
    target, last = np.full(named.max(initial=-1) + 1, -1), np.full(positions.max(initial=-1) + 1, -1)
    target[named[: len(of)]] = number
    np.maximum.at(last, positions[: len(of)], number)
    whose, src, dst = graph[entry], last[positions[len(of) :]], target[named[len(of) :][entry]]
    # Arrows repeat where an entry does; arrows of different sources may end in the same nodes.
    keys = (source, named[len(of) :][entry], whose)
    order = np.lexsort(keys)
    order = order[_starts(order, *keys)]
    order = order[(src[order] >= 0) & (dst[order] >= 0)]
    return _records(src=src[order], dst=dst[order]), whose[order]


def capped(numbered_nodes: DataFrame, arrows: DataFrame, limit: int = MAX_NODES) -> tuple[DataFrame, DataFrame]:
    """Graphs of at most `limit` nodes (the input size of a graph model); edges to cut nodes go."""
    if "nodes" in numbered_nodes.columns:
        return (
            numbered_nodes.withColumn("nodes", F.filter("nodes", lambda n: n.node_idx < limit)),
            arrows.withColumn("edges", F.filter("edges", lambda e: (e.src < limit) & (e.dst < limit))),
        )
    return (
        numbered_nodes.where(F.col("node_idx") < limit),
        arrows.where((F.col("src") < limit) & (F.col("dst") < limit)),
    )


def linked_uses(tokens: DataFrame) -> DataFrame:
    """Straight-line def-use links: an occurrence comes from the latest earlier definition.

    `tokens` has (doc_hash, idx, token, is_def). Adds `src`, null where nothing was defined yet.
    """
    if "tokens" in tokens.columns:
        return _each(tokens, ["tokens"], "tokens", TOKENS, _linked)
    return running(
        tokens,
        ["doc_hash", "token"],
        [F.col("idx")],
        F.floor(F.col("idx") / POSITION_BLOCK),
        maxima={"src": F.when(F.col("is_def"), F.col("idx"))},
        inclusive=False,
    )


def _linked(tokens: pa.Array, graph: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    idx, is_def = _numbers(tokens.field("idx")), np.asarray(tokens.field("is_def").fill_null(False))
    keys = (np.asarray(tokens.field("token").dictionary_encode().indices.fill_null(-1)), graph)
    order = np.lexsort((idx, *keys))
    place = np.arange(len(order))
    first = np.maximum.accumulate(np.where(_starts(order, *keys), place, 0))
    before = np.concatenate([[-1], np.maximum.accumulate(np.where(is_def[order], place, -1))])[:-1]
    src, none = np.zeros(len(order), "int64"), np.ones(len(order), bool)
    src[order], none[order] = idx[order][before], before < first
    columns = {c: tokens.field(c) for c in ("idx", "token", "is_def")}
    return _records(**columns, src=pa.array(src, mask=none)), graph


def entries_from_links(linked: DataFrame) -> DataFrame:
    """Entries as the other operators take them from linked tokens."""
    if "tokens" in linked.columns:
        one = lambda t, value, kind: F.when(t.src.isNotNull(), F.array(value)).otherwise(F.array().cast(kind))
        entry = lambda t: F.struct(
            t.idx.alias("idx"), t.token.alias("token"), F.lit("comesFrom").alias("relation"),
            one(t, t.token, "array<string>").alias("names"), one(t, t.src, "array<bigint>").alias("src_idx"),
        )
        return linked.select("doc_hash", F.transform("tokens", entry).alias("entries"))
    has = F.col("src").isNotNull()
    return linked.select(
        "doc_hash",
        "idx",
        "token",
        F.lit("comesFrom").alias("relation"),
        F.when(has, F.array("token")).otherwise(F.array().cast("array<string>")).alias("names"),
        F.when(has, F.array("src")).otherwise(F.array().cast("array<bigint>")).alias("src_idx"),
    )


def node_ids(numbered_nodes: DataFrame, vocabulary: DataFrame, unknown: int) -> DataFrame:
    """Node tokens as vocabulary ids, `unknown` for other tokens; takes one row per node."""
    terms = vocabulary.select(F.col("term").alias("token"), F.col("id").alias("token_id"))
    joined = numbered_nodes.join(terms, "token", "left")
    return joined.withColumn("token_id", F.coalesce("token_id", F.lit(unknown)))
