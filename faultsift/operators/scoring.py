"""Length boost, score scaling and fusion of direct and indirect evidence."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from faultsift.functions import measures
from faultsift.operators.blocks import flat
from faultsift.operators.skew import hot_keys, skew_join

#: Vectors of a block, in the mean, and the fewest blocks of a side.
BLOCK_VECTORS = 16_384
MIN_BLOCKS = 8
#: Pairs whose vectors are held at a time.
BATCH_PAIRS = 4_096
#: Pairs of similar reports that may go to all tasks, and deals of their keys for each shuffle partition.
SENT_PAIRS = 200_000
KEY_DEALS = 4


def length_scores(sources: DataFrame, by: list[str] | None = None, size: str = "size") -> DataFrame:
    """Add length_score from the mean and sample deviation of `size`, per group `by` or overall."""
    if by:
        stats = sources.groupBy(*by).agg(F.avg(size).alias("_mean"), F.stddev_samp(size).alias("_sd"))
        joined = sources.join(stats, by)
        score = measures.length_score(F.col(size), F.col("_mean"), F.col("_sd"))
        return joined.withColumn("length_score", score).drop("_mean", "_sd")
    mean = sources.agg(F.avg(size)).scalar()
    sd = sources.agg(F.stddev_samp(size)).scalar()
    return sources.withColumn("length_score", measures.length_score(F.col(size), mean, sd))


def min_max(
    scored: DataFrame, keys: list[str], columns: list[str], constant: float | None = None, whole: DataFrame | None = None
) -> DataFrame:
    """Scale columns to [0, 1] per group. A constant column keeps its values or becomes `constant`.

    The range of a group is that of its rows, or of those of `whole`.
    """
    ranges = (scored if whole is None else whole).groupBy(*keys).agg(
        *[F.min(c).alias(f"_low_{c}") for c in columns], *[F.max(c).alias(f"_high_{c}") for c in columns]
    )
    joined = scored.join(ranges, keys)
    filler = None if constant is None else F.lit(constant)
    return joined.select(
        *[
            measures.min_max(F.col(c), F.col(f"_low_{c}"), F.col(f"_high_{c}"), filler).alias(c)
            if c in columns
            else F.col(c)
            for c in scored.columns
        ]
    )


def fused(scored: DataFrame, keys: list[str], first: str, second: str, name: str = "similarity") -> DataFrame:
    """Sum of two similarities, each scaled within the candidate pool of its report."""
    return min_max(scored, keys, [first, second]).withColumn(name, F.col(first) + F.col(second))


def dense_cosine(
    pairs: DataFrame, left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str],
    vector: str = "vector", name: str = "cosine",
) -> DataFrame:
    """Cosine of dense vectors for every pair of the pool.

    Both sides are cut into blocks by a hash of their keys. A pair goes to the cell of its two blocks, which
    holds the vectors of both once, so no vector travels with a pair.
    """
    first = list(dict.fromkeys([*right_keys, *left_keys]))
    kept = first + [c for c in pairs.columns if c not in first]
    n_left, n_right = (max(MIN_BLOCKS, math.ceil(side.count() / BLOCK_VECTORS)) for side in (left, right))
    cell = lambda i, j: (F.pmod(i, F.lit(n_left)) * n_right + F.pmod(j, F.lit(n_right))).alias("_cell")
    plain = len(left_keys) == len(right_keys) == 1 and all(isinstance(pairs.schema[k].dataType, T.IntegralType) for k in first)
    number = lambda keys: F.col(keys[0]).cast("long") if plain else F.xxhash64(*keys)
    block = F.xxhash64
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    l_vec = left.na.drop(subset=left_keys).select(number(left_keys).alias("_l"), F.col(vector).alias("_v"), every(n_right).alias("_to"))
    r_vec = right.na.drop(subset=right_keys).select(number(right_keys).alias("_r"), F.col(vector).alias("_v"), every(n_left).alias("_to"))
    asked = pairs.na.drop(subset=first).select(
        cell(block(number(left_keys)), block(number(right_keys))), F.lit(2).alias("_kind"), number(left_keys).alias("_l"), number(right_keys).alias("_r"), *kept
    )
    heads = [l_vec.select(cell(block("_l"), F.col("_to")), F.lit(0).alias("_kind"), "_l", "_v"), r_vec.select(cell(F.col("_to"), block("_r")), F.lit(1).alias("_kind"), "_r", "_v")]
    both = asked.unionByName(heads[0], allowMissingColumns=True).unionByName(heads[1], allowMissingColumns=True)
    dealt = both.select("_cell", "_kind", "_l", "_r", "_v", *kept).repartition("_cell").sortWithinPartitions("_cell", "_kind")
    schema = T.StructType([dealt.schema[c] for c in kept] + [T.StructField(name, T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, sides = None, ([], []), None
        for batch in batches:
            place, kind = (np.asarray(batch.column(i)) for i in (0, 1))
            cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(kind) != 0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(start, stop - start)
                if place[start] != now:
                    now, held, sides = place[start], ([], []), None
                if kind[start] < 2:
                    side = int(kind[start])
                    held[side].append((part.column(2 + side), part.column(4)))
                elif held[0] and held[1]:
                    sides = sides or [_Side(parts) for parts in held]
                    yield _pair_cosines(part, *sides, arrow)

    return dealt.mapInArrow(run, schema)


class _Side:
    """Vectors of a block in the order of their keys; equal keys are allowed."""

    def __init__(self, parts: list[tuple[pa.Array, pa.Array]]) -> None:
        keys = np.concatenate([np.asarray(k) for k, _ in parts])
        vectors = pa.concat_arrays([v for _, v in parts])
        ends, values = flat(vectors)
        size = np.diff(ends)
        width = int(size.max(initial=0))
        holes = np.asarray(values.is_null())
        numbers = values.fill_null(0).to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        table = np.zeros((len(size), width), numbers.dtype)
        table[row, np.arange(len(numbers)) - np.repeat(ends[:-1], size)] = numbers
        whole = np.bincount(row, holes, len(size)) == 0
        size = np.where(whole & ~np.asarray(vectors.is_null()), size, -1)
        order = np.argsort(keys, kind="stable")
        self.keys, self.vectors, self.sizes = keys[order], table[order], size[order]

    def found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the vectors of the keys start, and how many there are."""
        start = np.searchsorted(self.keys, keys, "left")
        return start, np.searchsorted(self.keys, keys, "right") - start


def _pair_cosines(part: pa.RecordBatch, left: _Side, right: _Side, arrow: pa.Schema) -> pa.RecordBatch:
    """The pairs whose vectors are there, each with all of theirs; null where one has gaps or no length."""
    (l_start, l_n), (r_start, r_n) = left.found(np.asarray(part.column(2))), right.found(np.asarray(part.column(3)))
    n = l_n * r_n
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at_left, at_right = l_start[row] + step // np.maximum(1, r_n[row]), r_start[row] + step % np.maximum(1, r_n[row])
    width = min(left.vectors.shape[1], right.vectors.shape[1])
    cosine, sizes = np.zeros(len(row)), left.sizes[at_left]
    absent = (sizes < 0) | (sizes != right.sizes[at_right])
    for low in range(0, len(row), BATCH_PAIRS):
        own = slice(low, low + BATCH_PAIRS)
        a, b = (side.vectors[at[own], :width].astype(float) for side, at in ((left, at_left), (right, at_right)))
        length = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
        absent[own] |= length == 0
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine[own] = np.einsum("ij,ij->i", a, b) / length
    columns = [c.take(pa.array(row)) for c in part.columns[5:]] + [pa.array(cosine, mask=absent)]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)


def direct_scores(scored: DataFrame, lengths: DataFrame, keys: list[str], similarity: str = "similarity") -> DataFrame:
    """Similarity times the length score of the file."""
    joined = scored.join(lengths.select(*keys, "length_score"), keys)
    return joined.withColumn("score", F.col(similarity) * F.col("length_score")).drop("length_score")


def links(candidates: DataFrame, fixes: DataFrame) -> DataFrame:
    """Pairs (report_id, other_id): the other report fixed a file of the report's pool.

    Both tables have (report_id, key). A key in very many pools is spread over salts; equal
    pairs are merged before they are shuffled again.
    """
    others = fixes.select(F.col("report_id").alias("other_id"), "key").distinct()
    pools = candidates.select("report_id", "key").distinct()
    joined = skew_join(pools, others, ["key"], hot_keys(pools, ["key"]))
    return joined.where(F.col("report_id") != F.col("other_id")).select("report_id", "other_id").distinct()


def indirect_scores(
    similar: DataFrame, fixes: DataFrame, similarity: str = "similarity", sent: bool = False, wanted: DataFrame | None = None
) -> DataFrame:
    """Per report and file key the best similarity of another report that fixed the key.

    `similar` has (report_id, other_id, similarity), `fixes` has (report_id, key). With `sent` the pairs, which
    must be few, go to all tasks; fixes are dealt by key and all scores of a key are made in one place.
    `wanted` (report_id, key) limits the scores to these.
    """
    others = fixes.select(F.col("report_id").alias("other_id"), "key").distinct()
    pairs = similar.where(F.col("report_id") != F.col("other_id")).select("report_id", "other_id", similarity)
    if wanted is not None:
        asked = wanted.select("report_id", "key").distinct()
        named = skew_join(asked, others, ["key"], hot_keys(asked, ["key"]))
        joined = named.join(F.broadcast(pairs) if sent else pairs, ["report_id", "other_id"])
    elif sent:
        deals = KEY_DEALS * int(similar.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        joined = others.repartition(deals, "key").join(F.broadcast(pairs), "other_id")
    else:
        joined = skew_join(pairs, others, ["other_id"], hot_keys(pairs, ["other_id"]))
    return joined.groupBy("report_id", "key").agg(F.max(similarity).alias("score"))


def distinct_fixes(fixes: DataFrame) -> DataFrame:
    """The fixes (report_id, key) of one key, the least, of all that the same reports fixed.

    Their indirect scores are those of all keys. Sets of reports are told apart by two sums of hashes and their size.
    """
    fixed = fixes.select("report_id", "key").distinct()
    hashes = F.sum(F.xxhash64("report_id").cast("decimal(38,0)")).alias("_sum"), F.bit_xor(F.xxhash64("report_id", F.lit(1))).alias("_xor")
    marks = fixed.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), *hashes)
    heads = marks.groupBy("_n", "_sum", "_xor").agg(F.min("key").alias("key")).select("key")
    return fixed.join(heads, "key", "left_semi").select("report_id", "key")


def synthesized(direct: DataFrame, indirect: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """Scale both score tables per report; 0.8 direct + 0.2 indirect where a key has both.

    A key with a direct score only keeps it in full; keys with an indirect score only are dropped. They count
    in the range of a report, which `whole` (report_id, score) gives where `indirect` has no such keys.
    """
    d = min_max(direct.select("report_id", "key", "score"), ["report_id"], ["score"], 1.0)
    i = min_max(indirect.select("report_id", "key", "score"), ["report_id"], ["score"], 1.0, whole)
    joined = d.join(i.withColumnRenamed("score", "_indirect"), ["report_id", "key"], "left")
    return joined.withColumn("score", measures.blended(F.col("score"), F.col("_indirect"))).drop("_indirect")
