"""Uniform shuffle into shards of exact sizes (operator 11)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultsift.operators.running import numbered
from faultsift.session import stage

#: Rows of a shard that one window puts into their final order, in the mean.
RUN_ROWS = 1 << 14
#: Bits of the random keys of the last order.
KEY_BITS = 62
#: Populations from here on are beyond numpy's sampler.
NUMPY_LIMIT = 10**9


def _log_weight(k: int, good: int, bad: int, drawn: int) -> float:
    ways = (k, good - k, drawn - k, bad - drawn + k)
    return -sum(math.lgamma(x + 1) for x in ways)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` things taken without return from `good` and `bad` ones are good.

    Very large populations are drawn by the ratio of uniforms: points of a box around the density's
    square root are taken until one lies below it.
    """
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn))
    total = good + bad
    mode = min(max((drawn + 1) * (good + 1) // (total + 2), low), high)
    share = good / total
    spread = math.sqrt(drawn * share * (1 - share) * (total - drawn) / (total - 1) + 0.5)
    middle, half, peak = drawn * share + 0.5, 3 * (spread + 1), _log_weight(mode, good, bad, drawn)
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(middle + half * (2 * v - 1) / u)
        if low <= k <= high and 2 * math.log(u) <= _log_weight(k, good, bad, drawn) - peak:
            return k


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes that differ by one at most and add up to `rows`."""
    return np.array([rows // shards + (j < rows % shards) for j in range(shards)], dtype=np.int64)


def matrix_row(block: int, ends: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """How many rows of a block go to each shard: one row of the communication matrix.

    `ends` are running totals of the blocks' rows, `sizes` those of the shards. The matrix has the law
    that a uniform shuffle of all rows would give it, with exact sums both ways. It is never
    built: blocks and shards are halved again and again, and each halving draws how many rows of the
    left blocks go to the left shards. A draw depends on the seed and its place alone, so every
    task that passes a place finds the same number there, and a block needs about
    shards * log2(blocks) draws.
    """
    spans = [(0, len(ends))]  # of blocks, from all down to this one
    while spans[-1][1] - spans[-1][0] > 1:
        low, high = spans[-1]
        middle = (low + high) // 2
        spans.append((low, middle) if block < middle else (middle, high))

    def rows(low: int, high: int) -> int:
        return int(ends[high - 1] - (ends[low - 1] if low else 0))

    row = np.zeros(len(sizes), dtype=np.int64)
    todo = [(0, len(sizes), [rows(*span) for span in spans])]
    while todo:
        first, last, here = todo.pop()  # shards, and the rows that the spans send to them
        if last - first == 1 or here[-1] == 0:
            row[first] = here[-1]
            continue
        half = (first + last) // 2
        left = [int(sizes[first:half].sum())]
        for (low, high), (inner_low, inner_high), outer, inner in zip(spans, spans[1:], here, here[1:]):
            on_left = inner_low == low
            in_left = inner if on_left else outer - inner
            rng = np.random.Generator(np.random.PCG64([seed, first, last, low, high]))
            drawn = hypergeometric(rng, in_left, outer - in_left, left[-1])
            left.append(drawn if on_left else left[-1] - drawn)
        todo.append((first, half, left))
        todo.append((half, last, [a - b for a, b in zip(here, left)]))
    return row


def _permuted(docs: DataFrame, seed: int) -> DataFrame:
    """`docs` with task and number of each row's block, its place in a random order there, and a random key."""
    own = T.StructType([T.StructField(name, T.LongType()) for name in ("_p", "_b", "_i", "_r")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            rng = np.random.default_rng([seed, task, number])
            new = [np.full(n, task), np.full(n, number), rng.permutation(n), rng.integers(0, 1 << KEY_BITS, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, new)], [*batch.schema.names, *own.names])
            number += n > 0

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + own.fields))


def shuffled_shards(docs: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """`docs` in a uniformly random order, dealt to `shards` whose row counts differ by one at most.

    Adds shard (int, from 0) and slot (long, gapless from 0 in every shard); columns of these names
    are replaced, all others stay whatever they hold, and no column decides a place. Rows that
    repeat are rows like any other. An empty table stays empty; with fewer rows than shards the
    last ones stay empty.

    A block is an Arrow batch of the input. Its rows are permuted where they are and written
    out, so that later steps see one order even if executors are lost. Then each block draws its row
    of the communication matrix, sends that many rows of its order to each shard, and the rows are
    put in random order again in their shard: by random keys, of which runs of leading bits are
    sorted each by itself. Rows are moved once. What every task gets is a running total per
    block, 8 bytes for each `spark.sql.execution.arrow.maxRecordsPerBatch` rows. The same seed
    over the same partitions gives the same places.
    """
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c not in ("shard", "slot")}
    local = stage(_permuted(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), seed), "permuted")
    blocks = local.groupBy("_p", "_b").agg(F.count("*").alias("n")).orderBy("_p", "_b").toPandas()
    ends = np.cumsum(blocks["n"].to_numpy(dtype=np.int64))
    rows = int(ends[-1]) if len(ends) else 0
    tasks, starts = np.unique(blocks["_p"].to_numpy(dtype=np.int64), return_index=True)
    known = docs.sparkSession.sparkContext.broadcast((ends, tasks, starts, shard_sizes(rows, shards)))

    @F.pandas_udf("int")
    def shard_of(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ends, tasks, starts, sizes = known.value
        edges: dict[int, np.ndarray] = {}
        for task, number, place in columns:
            block = starts[np.searchsorted(tasks, task)] + number.to_numpy()
            edges = {b: edges.get(b) for b in np.unique(block)}
            found = np.zeros(len(block), dtype=np.int32)
            for b in edges:
                if edges[b] is None:
                    edges[b] = np.cumsum(matrix_row(int(b), ends, sizes, seed))
                mine = block == b
                found[mine] = np.searchsorted(edges[b], place.to_numpy()[mine], "right")
            yield pd.Series(found)

    dealt = local.withColumn("shard", shard_of("_p", "_b", "_i")).drop("_p", "_b", "_i")
    bits = max(0, math.ceil(math.log2(max(1, rows / shards / RUN_ROWS))))
    placed = numbered(dealt, ["shard"], [F.col("_r")], F.shiftright("_r", KEY_BITS - bits), "slot")
    return placed.select(*[F.col(n).alias(c) for c, n in names.items()], "shard", (F.col("slot") - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 0, file_rows: int = 1 << 20) -> None:
    """`shuffled_shards` as Parquet in folders shard=0, shard=1, ..., whose files follow the slots, `file_rows` rows each."""
    dealt = shuffled_shards(docs, shards, seed).withColumn("_file", F.floor(F.col("slot") / file_rows))
    files = dealt.repartition("shard", "_file").sortWithinPartitions("shard", "_file", "slot")
    files.drop("_file").write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(path)
