"""Similarity of reports with the files of a block.

Files are dealt to blocks of neighbours on a circle; a block may reach into the next ones, so that a walk stays
in the block where it starts. A block is one row: its postings (part, term, file, tf)
and its files. A report asks a block for some of its files; all questions to a block are answered from
its postings, a batch of them at a time, so no row per pair and term is ever moved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from faultsift.functions.measures import UNSHARED_IDF
from faultsift.operators.cells import flat
from faultsift.operators.terms import squares, vocabulary_ids

#: Places from the start of a block to that of the next.
BLOCK_FILES = 128
#: Questions that a share of a block answers, in the mean.
SHARE_ROWS = 2_000
#: Products of postings held at a time.
MOST_PRODUCTS = 1 << 21


def block_of(place: Column) -> Column:
    return F.floor(place / BLOCK_FILES)


def file_blocks(placed: DataFrame, parts: list[DataFrame], ids: DataFrame, reach: int = 0) -> DataFrame:
    """One row per block: `postings` and `members`.

    `placed` has (place, file), `parts` term frequencies (file, term, tf) of each text to compare,
    `ids` the numbers of the terms. A block has the files of its places and of the next `reach` ones.
    """
    total = placed.count()
    held, blocks = min(total, BLOCK_FILES + reach), max(1, math.ceil(total / BLOCK_FILES))
    back = F.sequence(F.lit(0), F.lit(math.ceil(reach / BLOCK_FILES) + 2))
    near = F.array_distinct(F.transform(back, lambda i: F.pmod(block_of(F.col("place")) - i, F.lit(blocks))))
    opened = placed.select("place", "file", F.explode(near).alias("block"))
    slot = F.pmod(F.col("place") - F.col("block") * BLOCK_FILES, F.lit(max(1, total))).cast("int").alias("slot")
    placed = opened.select("block", slot, "file").where(F.col("slot") < held)
    tagged = [tf.select("file", "term", "tf", F.lit(i).alias("part")) for i, tf in enumerate(parts)]
    rows = tagged[0]
    for other in tagged[1:]:
        rows = rows.unionByName(other)
    located = rows.join(ids, "term").join(placed, "file")
    entry = F.struct("part", "id", "slot", F.col("tf").cast("double").alias("tf"))
    postings = located.groupBy("block").agg(F.sort_array(F.collect_list(entry)).alias("postings"))
    members = placed
    for i, tf in enumerate(parts):
        members = members.join(squares(tf, ["file"]).withColumnRenamed("squares", f"all{i}"), "file", "left")
    totals = F.array(*[F.coalesce(F.col(f"all{i}"), F.lit(0.0)) for i in range(len(parts))])
    listed = members.groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("slot", "file", totals.alias("totals")))).alias("members")
    )
    return listed.join(postings, "block", "left")


class _Block:
    """Postings of one block, by part and term."""

    def __init__(self, postings: pa.Array, members: pa.Array, parts: int) -> None:
        part, ids, slot, tf = (np.asarray(postings.field(i)) for i in range(4)) if len(postings) else (np.zeros(0, np.int64),) * 4
        self.terms, self.starts, self.counts, self.slots, self.tfs = [], [], [], [], []
        for i in range(parts):
            mine = part == i
            terms, starts, counts = np.unique(ids[mine], return_index=True, return_counts=True)
            self.terms.append(terms)
            self.starts.append(starts)
            self.counts.append(counts)
            self.slots.append(slot[mine])
            self.tfs.append(tf[mine])
        self.files = members.field(1)  # by slot; places have no gaps
        self.size = len(self.files)
        self.rank = np.empty(self.size, np.int64)
        self.rank[np.asarray(pc.sort_indices(self.files))] = np.arange(self.size)
        self.totals = np.asarray(members.field(2).flatten()).reshape(-1, parts)

    def products(self, part: int, row: np.ndarray, ids: np.ndarray, tf: np.ndarray, rows: int) -> tuple[np.ndarray, ...]:
        """Sums over shared terms of tf * tf of both, of the report and of the file, by (row, slot)."""
        terms = self.terms[part]
        out = tuple(np.zeros(rows * self.size) for _ in range(3))
        if not len(terms) or not len(ids):
            return out
        at = np.minimum(np.searchsorted(terms, ids), len(terms) - 1)
        met = np.flatnonzero(terms[at] == ids)
        row, tf, at = row[met], tf[met], at[met]
        done, ends = 0, np.cumsum(self.counts[part][at])
        while done < len(at):
            stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + MOST_PRODUCTS, "right")))
            n = self.counts[part][at[done:stop]]
            first = np.repeat(self.starts[part][at[done:stop]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            entry = first + np.arange(len(first))
            key = np.repeat(row[done:stop], n) * self.size + self.slots[part][entry]
            left, right = np.repeat(tf[done:stop], n), self.tfs[part][entry]
            for total, value in zip(out, (left * right, left * left, right * right)):
                total += np.bincount(key, value, rows * self.size)
            done = stop
        return out

    def similarities(self, part: int, wanted: np.ndarray, row: np.ndarray, ids: np.ndarray, tf: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Two-text cosines of the wanted (row, slot) keys; NaN where neither text has a term."""
        c2 = UNSHARED_IDF**2
        dot, left, right = (x[wanted] for x in self.products(part, row, ids, tf, len(totals)))
        all_left, all_right = totals[wanted // self.size], self.totals[wanted % self.size, part]
        with np.errstate(divide="ignore", invalid="ignore"):
            found = dot / (np.sqrt(left + c2 * (all_left - left)) * np.sqrt(right + c2 * (all_right - right)))
        return np.where((all_left == 0) & (all_right == 0), np.nan, np.where(dot == 0, 0.0, found))


def block_similarities(
    questions: DataFrame, blocks: DataFrame, files: DataFrame, parts: int,
    places: Column | None = None, of: tuple[str, ...] = (), best: int | None = None, asked: int | None = None,
) -> DataFrame:
    """Answer `questions` (block, places, ids, tfs, total and further columns) from the `blocks`.

    Returns the further columns and `answers`, an array of (file, sims) for the places asked for;
    `sims` has a two-text cosine for every part, null where neither text has a term. A block is handed to
    as many tasks as its questions ask for, on the average of all blocks; its row comes first there, then
    questions pass by batch after batch. Where `places` is a column, it is made of the columns `of` after the
    questions have been dealt. With `best`, the files most similar by the first part come first and others
    than so many go; ties go to the smaller file, unknown ones last. `asked` is the number of questions.
    """
    given = ["places"] if places is None else list(of)
    kept = [c for c in questions.columns if c not in ("block", "ids", "tfs", "total", *given)]
    asked, size = questions.count() if asked is None else asked, files.count()
    shares = max(1, math.ceil(asked / max(1, size / BLOCK_FILES) / SHARE_ROWS))
    salt = F.pmod(F.xxhash64(*kept), F.lit(shares)) if kept else F.lit(0).cast("long")
    rows = questions.select("block", salt.alias("_share"), F.lit(1).alias("_kind"), *given, "ids", "tfs", "total", *kept)
    heads = blocks.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("_share"), F.lit(0).alias("_kind"), "postings", "members")
    both = rows.unionByName(heads, allowMissingColumns=True)
    named = (F.col("places") if places is None else F.when(F.col("_kind") == 1, places)).alias("places")
    order = ["block", "_share", "_kind", "ids", "tfs", "total", "postings", "members", *kept]
    dealt = both.select(*order, *given).repartition("block", "_share").sortWithinPartitions("block", "_share", "_kind")
    dealt = dealt.select(*order[:3], named, *order[3:])
    sims = [T.StructField("sims", T.ArrayType(T.DoubleType()))]
    answers = T.ArrayType(T.StructType([T.StructField("file", files.schema["file"].dataType), *sims]))
    schema = T.StructType([dealt.schema[c] for c in kept] + [T.StructField("answers", answers)])
    arrow = to_arrow_schema(schema)

    def answer(batch: pa.RecordBatch, block: _Block) -> pa.RecordBatch:
        (place_ends, named), (id_ends, ids), (_, tfs) = (flat(batch.column(i)) for i in (3, 4, 5))
        totals, n = np.asarray(batch.column(6).fill_null(0.0)), batch.num_rows
        row, asking = np.repeat(np.arange(n), np.diff(id_ends)), np.repeat(np.arange(n), np.diff(place_ends))
        start = np.asarray(batch.column(0))[asking] * BLOCK_FILES
        wanted = asking * block.size + (np.asarray(named) - start) % size
        args = (wanted, row, np.asarray(ids), np.asarray(tfs), totals)
        found = np.column_stack([block.similarities(i, *args) for i in range(parts)])
        if best is not None:
            unknown = np.isnan(found[:, 0])
            order = np.lexsort((block.rank[wanted % block.size], np.where(unknown, 0.0, -found[:, 0]), unknown, asking))
            chosen = order[np.arange(len(order)) - place_ends[asking[order]] < best]
            wanted, found = wanted[chosen], found[chosen]
            place_ends = np.concatenate([[0], np.cumsum(np.minimum(np.diff(place_ends), best))])
        flat_sims = found.ravel()
        listed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat_sims) + 1, parts), pa.int32()), pa.array(flat_sims, from_pandas=True))
        each = pa.StructArray.from_arrays([block.files.take(pa.array(wanted % block.size)), listed], ["file", "sims"])
        out = pa.ListArray.from_arrays(pa.array(place_ends, pa.int32()), each)
        return pa.RecordBatch.from_arrays([*batch.columns[9:], out.cast(arrow.field("answers").type)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            kind, name, share = (np.asarray(batch.column(i)) for i in (2, 0, 1))
            cuts = np.flatnonzero((np.diff(name) != 0) | (np.diff(share) != 0) | (np.diff(kind) != 0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                if kind[start] == 0:
                    part = batch.slice(start, 1)
                    block = _Block(part.column(7).flatten(), part.column(8).flatten(), parts)
                else:
                    for low in range(start, stop, 1_000):
                        yield answer(batch.slice(low, min(1_000, stop - low)), block)

    return dealt.mapInArrow(run, schema)


def term_numbers(parts: list[DataFrame]) -> DataFrame:
    """(term, id) of all terms of the parts."""
    terms = parts[0].select("term")
    for part in parts[1:]:
        terms = terms.unionByName(part.select("term"))
    return vocabulary_ids(terms, 0)


def report_arrays(tf: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per report: numbers of the terms that files have, their counts, and the squares of all its terms."""
    pairs = F.sort_array(F.collect_list(F.struct("id", F.col("tf").cast("double").alias("tf"))))
    known = tf.join(ids, "term").groupBy("report_id").agg(pairs.alias("_pairs"))
    return squares(tf, ["report_id"]).join(known, "report_id", "left").select(
        "report_id", F.col("_pairs.id").alias("ids"), F.col("_pairs.tf").alias("tfs"), F.col("squares").alias("total")
    )
