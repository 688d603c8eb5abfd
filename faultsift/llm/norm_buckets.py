"""Exact top-k search by norm-bucketed retrieval (operator 6)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultsift.session import stage

#: Buckets by length, and rows of a block of a bucket and of a block of queries, about.
BUCKETS = 16
BLOCK = 8192
QUERY_BLOCK = 2048
#: Local cosine threshold from which on coordinates prune; below it lengths do.
COORDINATES_FROM = 0.5
#: Coordinates that prune, the largest of the query.
FOCUS = 3


def quantised(vector: Column, factor: float = 256.0) -> Column:
    """floor(factor * x) of every component; null where the vector, or a component, is null or not finite."""
    real = F.transform(vector, lambda x: x.cast("double"))
    good = vector.isNotNull() & (F.size(vector) > 0) & F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(real, lambda x: F.floor(x * factor).cast("long")))


def _search(kept: int):
    """Best rows of one probe block for the queries of one query block."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            queries = np.stack(left["x"].to_numpy()).astype("int64")
            probes = np.stack(right["x"].to_numpy()).astype("int64")
            ids, lengths = right["vec_id"].to_numpy(), right["length"].to_numpy()
            order = np.argsort(-lengths, kind="stable")
            probes, ids, lengths = probes[order], ids[order], lengths[order]
            units = probes / np.where(lengths > 0, lengths, 1)[:, None]
            longest = lengths[0]
            for row in range(len(queries)):
                q, own, size, bound = queries[row], left["query_id"].iat[row], left["length"].iat[row], left["bound"].iat[row]
                chosen = slice(0, len(ids))
                if bound > 0:
                    if size * longest * (1 + 1e-9) < bound:
                        continue
                    local = bound / (size * longest)  # the cosine that the longest row needs, the others need more
                    if local >= COORDINATES_FROM:
                        chosen = _feasible(q / size, units, min(local, 1.0))
                    else:  # rows are in order of length
                        chosen = slice(0, int(np.searchsorted(-lengths, -bound / size * (1 - 1e-9), side="right")))
                scores, names = probes[chosen] @ q, ids[chosen]
                good = np.flatnonzero((names != own) & (scores >= bound))
                best = good[np.lexsort((names[good], -scores[good]))[:kept]]
                out.extend((own, left["qx"].iat[row], int(names[b]), int(scores[b])) for b in best)
        return pd.DataFrame(out, columns=["query_id", "qx", "vec_id", "score"])

    return run


def _feasible(q: np.ndarray, units: np.ndarray, cosine: float) -> np.ndarray:
    """Rows whose largest query coordinates allow the cosine."""
    chosen = np.ones(len(units), bool)
    for f in np.argsort(-np.abs(q))[:FOCUS]:
        room = np.sqrt(max(0.0, (1 - cosine**2) * (1 - q[f] ** 2)))
        low = q[f] * cosine - room if q[f] > -cosine else -1.0
        high = q[f] * cosine + room if q[f] < cosine else 1.0
        chosen &= (units[:, f] >= low - 1e-9) & (units[:, f] <= high + 1e-9)
    return np.flatnonzero(chosen)


_FOUND = "query_id long, qx long, vec_id long, score long"


def top_products(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest integer product for every query.

    Ties go to the smaller id. A row is no candidate of a query with its id; rows without an id or
    a usable vector take no part, vectors of different sizes never meet. Queries that repeat id
    and vector are one.

    Rows fall into buckets by length (quantiles of it, a few numbers on the driver), buckets into
    hashed blocks, queries into blocks. A pair of blocks meets in one task, both of bounded size.
    First every query meets the block of the longest rows; its k-th score there bounds what can
    still matter. Then it meets the buckets whose lengths can reach that bound, where either the
    feasible ranges of its largest coordinates or the lengths alone, as the cosine that the bucket
    needs suggests, leave few rows to multiply.
    """
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), quantised(F.col(f"`{vector}`")).alias("x"), is_query.alias("q"))
    rows = rows.where("vec_id IS NOT NULL AND x IS NOT NULL")
    square = F.aggregate("x", F.lit(0.0), lambda a, b: a + b.cast("double") * b)
    rows = stage(rows.select("vec_id", "x", "q", F.size("x").alias("dim"), F.sqrt(square).alias("length")), "vectors")
    marks = [i / BUCKETS for i in range(1, BUCKETS)]
    cuts = rows.groupBy("dim").agg(F.percentile_approx("length", marks, 1000).alias("cuts"), F.count("*").alias("n"))
    cuts = cuts.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    probes = rows.join(F.broadcast(cuts), "dim").withColumn("bucket", F.size(F.filter("cuts", lambda c: c >= F.col("length"))))
    counts = probes.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.max("length").alias("longest"))
    counts = counts.select("dim", "bucket", "longest", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    buckets = stage(counts, "buckets")  # sizes x buckets
    probes = probes.drop("cuts", "blocks").join(F.broadcast(buckets.drop("longest")), ["dim", "bucket"])
    probes = probes.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks").cast("long"))).select("dim", "bucket", "block", "vec_id", "x", "length")
    probes = stage(probes, "probes")
    asked = rows.where("q").select(F.col("vec_id").alias("query_id"), "x", F.xxhash64("x").alias("qx"), "dim", "length").dropDuplicates(["query_id", "qx"])
    groups = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = stage(asked.withColumn("qb", F.pmod(F.xxhash64("query_id", F.lit("q")), F.lit(groups).cast("long"))), "queries")
    names = ["dim", "bucket", "block", "qb"]
    spread = probes.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    top = buckets.groupBy("dim").agg(F.min("bucket").alias("bucket"))
    seeds = asked.join(F.broadcast(top), "dim").withColumn("block", F.lit(0).cast("long")).withColumn("bound", F.lit(-(1 << 62)).cast("long"))
    seed_rows = spread.where("block = 0").join(F.broadcast(top), ["dim", "bucket"])
    first = seeds.groupBy(*names).cogroup(seed_rows.groupBy(*names)).applyInPandas(_search(k), _FOUND)
    first = stage(first, "first")
    bounds = first.groupBy("query_id", "qx").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    bounds = bounds.select("query_id", "qx", F.when(F.col("n") >= k, F.col("least")).alias("bound"))
    known = asked.join(bounds, ["query_id", "qx"], "left").withColumn("bound", F.coalesce("bound", F.lit(-(1 << 62)).cast("long")))
    met = known.join(F.broadcast(buckets), "dim").where(F.col("length") * F.col("longest") * (1 + 1e-9) >= F.col("bound"))
    met = met.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    met = met.join(F.broadcast(top.withColumnRenamed("bucket", "seed")), "dim").where(~((F.col("bucket") == F.col("seed")) & (F.col("block") == 0)))
    met = met.select(*names, "query_id", "qx", "x", "length", "bound")
    rest = met.groupBy(*names).cogroup(spread.groupBy(*names)).applyInPandas(_search(k), _FOUND)
    best = Window.partitionBy("query_id", "qx").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
