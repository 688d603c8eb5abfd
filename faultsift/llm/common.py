"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from faultsift.session import stage, unstage

#: Rows of a table that is broadcast at most, after its rows are counted.
BROADCAST_ROWS = 100_000


class WordCache(dict):
    """Values by word, computed where missing; at most twice `limit` entries are held.

    The entries of the last `limit` misses stay when the cache turns over, so frequent words are
    seldom computed again.
    """

    def __init__(self, compute: Callable[[list[str]], list], limit: int = 400_000) -> None:
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def add(self, words: set[str]) -> None:
        """Compute what is missing of `words` in one go."""
        missing = [word for word in words if word not in self]
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()
            missing = list(words)
        found = [word for word in missing if word in self.older]
        self.update((word, self.older[word]) for word in found)
        new = [word for word in missing if word not in self.older] if found else missing
        self.update(zip(new, self.compute(new), strict=True))


class LookupCache(dict):
    """Values by word, each computed where it is looked up first; at most twice `limit` are held.

    When `limit` are there they become the older half, from which later lookups take them back.
    Words of over `LONGEST` characters are computed anew each time, so an entry is some hundred bytes.
    """

    LONGEST = 64

    def __init__(self, compute: Callable[[str], bytes], limit: int) -> None:
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def __missing__(self, word: str) -> bytes:
        if len(word) > self.LONGEST:
            return self.compute(word)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self.older.get(word)
        if value is None:
            value = self.compute(word)
        self[word] = value
        return value


def blocks(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `most` characters, one text at least."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if texts:
        yield start, len(texts)


def text_list(column: pa.Array) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return ["" if text is None else text for text in column.to_pylist()]


def by_document(
    docs: DataFrame, work: Callable[[list[str]], list[tuple]], schema: str, text: str, *keys: str, done: Callable[[], None] | None = None
) -> DataFrame:
    """The `keys` of every document as they are, and the columns of `schema` that `work` finds.

    `work` gets consecutive texts of about a million characters and returns a tuple for each; `done` is
    called when a task is over, to let go of what `work` has kept in the process.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_list(batch.column(0))
            for start, end in blocks(texts):
                found = zip(*work(texts[start:end]), strict=True)
                columns = [pa.array(values, kind) for values, kind in zip(found, kinds, strict=True)]
                own = [batch.column(1 + i).slice(start, end - start) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays(own + columns, names)
        if done is not None:
            done()

    struct = T.StructType.fromDDL(schema)
    kinds = [to_arrow_type(field.dataType) for field in struct]
    names = [*[f"_k{i}" for i in range(len(keys))], *struct.names]
    out = T.StructType([T.StructField(f"_k{i}", docs.schema[k].dataType) for i, k in enumerate(keys)] + struct.fields)
    taken = docs.select(F.col(text).cast("string").alias("_t"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    return taken.mapInArrow(run, out).withColumnsRenamed({f"_k{i}": k for i, k in enumerate(keys)})


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored table for broadcast where its counted rows stay within `most`, else as it is."""
    return F.broadcast(df) if df.count() <= most else df


def digest(text: Column) -> Column:
    """128 bits that name a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b) but the roots, each the least node that others reach.

    Alternates two steps until only stars are left: every node hands its larger neighbours the least
    node of its neighbourhood, then every node hands its smaller neighbours to the least of them.
    Both are grouped minima and joins back, so a node with very many neighbours is pre-aggregated
    and its join is one that adaptive execution splits. Every round is written out, so the plan
    stays short and lost executors cost one round at most. Null ends and loops are ignored.
    """
    pairs = stage(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    while not _is_forest_of_stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        up = both.where("v > u").join(least, "u")
        large = stage(up.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v"), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = stage(
            down.unionByName(least.select("u", F.col("m").alias("v")))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct(),
            "edges",
        )
        unstage(pairs)
        unstage(large)
        pairs = small
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _is_forest_of_stars(pairs: DataFrame) -> bool:
    """Whether every u has one v and no v is a u."""
    ends = pairs.select("u", F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(pairs.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    met = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return met.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()
