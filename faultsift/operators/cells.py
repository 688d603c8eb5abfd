"""Sums over the terms that the two documents of a pair share.

A sparse vector is a set of rows (document key, term, value). The left side is cut into blocks of a
bounded number of rows, the right side is dealt by a hash of its keys. A pair goes to the cell of its two
documents. There the left block is held and the right side passes in the order of its keys, each vector
followed by its pairs: no row per pair and term is ever made outside a batch.

Where all documents are short and the pairs few beside the copies that cells would take, the vectors go to the
pairs instead: each is one list, looked up by the key of its document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from faultsift.operators.skew import unsent
from faultsift.session import stage

#: Rows of a left block, in the mean.
BLOCK_TERMS = 1 << 20
#: Parts of the right side for each shuffle partition, so that partitions are even.
DEALS = 4
#: Shared terms of pairs looked up at a time.
MOST_PRODUCTS = 1 << 20
#: Copies of left terms up to which cells are taken without a further look.
FEW_COPIES = 1 << 22
#: Terms of the longest document that travels as a list.
SHORT = 256


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def shared_sums(
    pairs: DataFrame, left: DataFrame, rights: list[DataFrame], left_keys: list[str], right_keys: list[str], value: str,
    hot: DataFrame,
) -> DataFrame:
    """Add sums of doubles to every pair, for each table i of `rights`.

    _dot{i}, _ls{i}, _rs{i}: left times right, left squared and right squared over shared terms, null where
    nothing is shared. _la, _ra{i}: squares of all terms of a document, null where it has none. A pair that comes
    n times counts n times in the first three. `hot` has right documents of very many pairs (see `hot_keys`).
    """
    keys = list(dict.fromkeys([*left_keys, *right_keys]))
    plain = len(left_keys) == len(right_keys) == 1 and all(isinstance(pairs.schema[k].dataType, T.IntegralType) for k in keys)

    def number(names: list[str]) -> Column:
        typed = [F.col(k).cast(pairs.schema[k].dataType) for k in names]
        known = [F.col(k).isNotNull() for k in names]
        every = known[0]
        for one in known[1:]:
            every = every & one
        return F.when(every, typed[0].cast("long") if plain else F.xxhash64(*typed))

    def vectors(side: DataFrame, names: list[str], part: int) -> DataFrame:
        numbers = F.col(value).cast("double").alias("_value")
        return side.na.drop(subset=names).select(number(names).alias("_key"), "term", numbers, F.lit(part).alias("_part"), *names)

    terms, longest, documents = _sizes(left, left_keys)
    blocks = max(1, math.ceil(terms / BLOCK_TERMS))
    deals = DEALS * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if terms * deals > FEW_COPIES and longest <= SHORT:
        sizes = [_sizes(side, right_keys) for side in rights]
        if sum(n for _, n, _ in sizes) <= SHORT:
            pairs = stage(pairs, "pairs")
            with_each = terms / documents + sum(n / max(1, docs) for n, _, docs in sizes)
            if pairs.count() * with_each < terms * deals + sum(n for n, _, _ in sizes) * blocks:
                return _listed_sums(pairs, left, rights, left_keys, right_keys, value)
    row, column = F.pmod(F.xxhash64("_l"), F.lit(blocks)), F.pmod(F.xxhash64("_r"), F.lit(deals))
    # The pairs of a hot right document are dealt by both documents, and its vector goes to every part.
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    same = Window.partitionBy(*keys)
    asked = pairs.withColumn("_times", F.count(F.lit(1)).over(same)).join(hot, right_keys, "left").withColumns(
        {"_l": number(left_keys), "_r": number(right_keys)}
    )
    asked = asked.withColumn("_column", F.when(F.col("_hot") | F.col("_r").isNull(), F.pmod(F.xxhash64("_l", "_r"), F.lit(deals))).otherwise(column))
    asked = asked.select(
        (row * deals + F.col("_column")).alias("_cell"), F.lit(2).alias("_kind"), "_l", "_r",
        F.lit(None).cast("string").alias("term"), F.col("_times").cast("double").alias("_value"), F.lit(0).alias("_part"), *pairs.columns,
    )
    heads = vectors(left, left_keys, 0).select("_key", "term", "_value", "_part", _every(deals).alias("_column"))
    heads = heads.withColumnsRenamed({"_key": "_l"}).select(
        (row * deals + F.col("_column")).alias("_cell"), F.lit(0).alias("_kind"), "_l", F.lit(None).cast("long").alias("_r"), "term", "_value", "_part"
    )
    passing = vectors(rights[0], right_keys, 0)
    for i, side in enumerate(rights[1:], 1):
        passing = passing.unionByName(vectors(side, right_keys, i))
    passing = passing.withColumnsRenamed({"_key": "_r"}).join(hot, right_keys, "left")
    columns = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))).otherwise(F.array(column))
    passing = passing.select("_r", "term", "_value", "_part", F.explode(columns).alias("_column"))
    passing = passing.select("*", _every(blocks).alias("_row")).select(
        (F.col("_row") * deals + F.col("_column")).alias("_cell"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_l"), "_r", "term", "_value", "_part"
    )
    both = asked.unionByName(heads, allowMissingColumns=True).unionByName(passing, allowMissingColumns=True)
    dealt = both.repartition("_cell").sortWithinPartitions("_cell", F.col("_kind") > 0, "_r", "_kind")
    n_parts = len(rights)
    parts = range(n_parts)
    sums = ["_la", *[f"_{name}{i}" for i in parts for name in ("dot", "ls", "rs", "ra")]]
    schema = T.StructType([dealt.schema[c] for c in pairs.columns] + [T.StructField(c, T.DoubleType()) for c in sums])
    arrow = to_arrow_schema(schema)
    order = ["_cell", "_kind", "_l", "_r", "term", "_value", "_part", *pairs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block, tail = None, [], None, None
        for batch in batches:
            cells, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds > 0) != 0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                if cells[start] != now:
                    now, held, block, tail = cells[start], [], None, None
                piece = batch.slice(start, stop - start)
                if kinds[start] == 0:
                    held.append(piece.select([2, 4, 5]))
                    continue
                block = block or _Left(held)
                held = []
                out, tail = block.meet(piece, tail, n_parts)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, arrow)], schema=arrow)

    return dealt.select(*order).mapInArrow(run, schema)


def _sizes(side: DataFrame, names: list[str]) -> tuple[int, int, int]:
    """Number of terms, terms of the longest document, number of documents."""
    counted = side.na.drop(subset=names).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    return tuple(counted.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0)), F.count(F.lit(1))).first())


def _listed_sums(
    pairs: DataFrame, left: DataFrame, rights: list[DataFrame], left_keys: list[str], right_keys: list[str], value: str
) -> DataFrame:
    """`shared_sums` by joining both vectors, a list each, to every pair."""

    def lists(sides: list[DataFrame], names: list[str], name: str) -> DataFrame:
        typed = [F.col(k).cast(pairs.schema[k].dataType).alias(k) for k in names]
        entry = F.struct(F.lit(0).alias("part"), "term", F.col(value).cast("double").alias("value"))
        rows = sides[0].na.drop(subset=names).select(*typed, entry.alias("_entry"))
        for i, side in enumerate(sides[1:], 1):
            rows = rows.unionByName(side.na.drop(subset=names).select(*typed, entry.withField("part", F.lit(i)).alias("_entry")))
        return rows.groupBy(*names).agg(F.collect_list("_entry").alias(name))

    keys = list(dict.fromkeys([*left_keys, *right_keys]))
    met = pairs.join(unsent(lists(rights, right_keys, "_right")), right_keys, "left").join(unsent(lists([left], left_keys, "_left")), left_keys, "left")
    times = F.count(F.lit(1)).over(Window.partitionBy(*keys)).cast("double")
    parts = len(rights)
    sums = ["_la", *[f"_{name}{i}" for i in range(parts) for name in ("dot", "ls", "rs", "ra")]]
    schema = T.StructType([pairs.schema[c] for c in pairs.columns] + [T.StructField(c, T.DoubleType()) for c in sums])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [*batch.columns[3:], *_listed_products(*batch.columns[:3], parts)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(found, arrow)], schema=arrow)

    return met.select("_left", "_right", times.alias("_times"), *pairs.columns).mapInArrow(run, schema)


def _listed_products(left: pa.Array, right: pa.Array, times: pa.Array, parts: int) -> list[pa.Array]:
    """Sums of the pairs of a batch, whose vectors are lists of (part, term, value)."""
    n = len(left)
    (l_ends, l_entry), (r_ends, r_entry) = flat(left), flat(right)
    l_row, r_row = (np.repeat(np.arange(n), np.diff(ends)) for ends in (l_ends, r_ends))
    words = pa.concat_arrays([l_entry.field(1), r_entry.field(1)]).dictionary_encode()
    term, size = np.asarray(words.indices.fill_null(-1)).astype(np.int64), len(words.dictionary) + 1
    l_term, r_term = term[: len(l_row)], term[len(l_row) :]
    l_value, r_value, part = _doubles(l_entry.field(2)), _doubles(r_entry.field(2)), np.asarray(r_entry.field(0)).astype(np.int64)
    l_all = np.bincount(l_row, l_value * l_value, n)
    r_key = r_row * parts + part
    r_all, r_seen = np.bincount(r_key, r_value * r_value, n * parts), np.bincount(r_key, minlength=n * parts) > 0
    # A missing term counts among all terms of a document and is shared with none.
    known, asked = np.flatnonzero(l_term >= 0), np.flatnonzero(r_term >= 0)
    code = l_row[known] * size + l_term[known]
    order = np.argsort(code, kind="stable")
    code, known = code[order], known[order]
    wanted = r_row[asked] * size + r_term[asked]
    low = np.searchsorted(code, wanted, "left")
    met = np.searchsorted(code, wanted, "right") - low
    mine, other = known[_runs(low, met)], np.repeat(asked, met)
    key, a, b = r_key[other], l_value[mine], r_value[other]
    shared = np.bincount(key, minlength=n * parts) > 0
    often = np.repeat(np.asarray(times), parts)
    sums = [np.bincount(key, product, n * parts) * often for product in (a * b, a * a, b * b)]
    out = [pa.array(l_all, mask=np.diff(l_ends) == 0)]
    for i in range(parts):
        out += [pa.array(total[i::parts], mask=~shared[i::parts]) for total in sums]
        out.append(pa.array(r_all[i::parts], mask=~r_seen[i::parts]))
    return out


def _doubles(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(0.0))


def flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0 and values of a list column; a null list is empty."""
    offsets = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0)))])
    return offsets, column.flatten()


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0] ... start[0] + n[0] - 1, start[1] ..."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


class _Left:
    """Vectors of a left block in the order of their keys."""

    def __init__(self, pieces: list[pa.RecordBatch]) -> None:
        column = lambda i, kind: pa.chunked_array([p.column(i) for p in pieces], kind).combine_chunks()
        keys, words, values = np.asarray(column(0, pa.int64())), column(1, pa.string()), _doubles(column(2, pa.float64()))
        coded = words.dictionary_encode()
        self.words, term = coded.dictionary, np.asarray(coded.indices.fill_null(-1)).astype(np.int64)
        self.size = len(self.words) + 1
        # A missing term counts among all terms of a document and is shared with none.
        order = np.argsort(keys, kind="stable")
        keys, term, values = keys[order], term[order], values[order]
        self.keys, first = np.unique(keys, return_index=True)
        self.all = np.add.reduceat(values * values, first) if len(first) else np.zeros(0)
        known = term >= 0
        self.term, self.value = term[known], values[known]
        self.ends = np.concatenate([[0], np.cumsum(known)])[np.concatenate([first, [len(keys)]])]

    def meet(self, piece: pa.RecordBatch, tail: tuple | None, parts: int) -> tuple[list[pa.Array] | None, tuple]:
        """Sums of the pairs of a piece, and what the next piece needs of the last right document."""
        kind, right = np.asarray(piece.column(1)), piece.column(3)
        entry = np.flatnonzero(kind == 1)
        e_right, e_part = np.asarray(right.take(pa.array(entry))).astype(np.int64), np.asarray(piece.column(6))[entry]
        e_value = _doubles(piece.column(5))[entry]
        e_term = np.asarray(pc.index_in(piece.column(4).take(pa.array(entry)), self.words, skip_nulls=True).fill_null(-1)).astype(np.int64)
        docs, at = np.unique(e_right, return_inverse=True)
        if tail is not None and tail[0] is not None and tail[0] not in docs:
            docs = np.insert(docs, place := int(np.searchsorted(docs, tail[0])), tail[0])
            at = at + (at >= place)
        every, seen = np.zeros((len(docs), parts)), np.zeros((len(docs), parts), bool)
        np.add.at(every, (at, e_part), e_value * e_value)
        seen[at, e_part] = True
        met = e_term >= 0
        at, e_term, e_value, e_part = at[met], e_term[met], e_value[met], e_part[met]
        if tail is not None and tail[0] is not None:
            mine = int(np.searchsorted(docs, tail[0]))
            every[mine] += tail[1]
            seen[mine] |= tail[2]
            at = np.concatenate([np.full(len(tail[3]), mine), at])
            e_term, e_value, e_part = (np.concatenate([old, new]) for old, new in zip(tail[3:], (e_term, e_value, e_part)))
        order = np.lexsort((e_term, at))
        at, e_term, e_value, e_part = at[order], e_term[order], e_value[order], e_part[order]
        last = right[len(right) - 1].as_py()
        if last is None or not len(docs) or docs[-1] != last:
            rest = (None,)
        else:
            own = at == len(docs) - 1
            rest = (last, every[-1], seen[-1], e_term[own], e_value[own], e_part[own])
        asked = np.flatnonzero(kind == 2)
        if not len(asked):
            return None, rest
        pairs = piece.take(pa.array(asked))
        l_row, l_is = _found(self.keys, pairs.column(2))
        r_row, r_is = _found(docs, right.take(pa.array(asked)))
        sums, shared = self._products(np.where(l_is & r_is, l_row, -1), r_row, at, e_term, e_value, e_part, len(docs), parts)
        times = _doubles(pairs.column(5))
        l_all = self.all[l_row] if len(self.keys) else np.zeros(len(asked))
        r_all, r_seen = (every[r_row], seen[r_row]) if len(docs) else (np.zeros((len(asked), parts)), np.zeros((len(asked), parts), bool))
        out = [*pairs.columns[7:], pa.array(l_all, mask=~l_is)]
        for i in range(parts):
            out += [pa.array(sums[k][:, i] * times, mask=~shared[:, i]) for k in range(3)]
            out.append(pa.array(r_all[:, i], mask=~(r_is & r_seen[:, i])))
        return out, rest

    def _products(self, l_row, r_row, at, term, value, part, docs: int, parts: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """Sums by (pair, part). The shorter side of each pair's two vectors is looked up in the other."""
        n = len(l_row)
        sums, shared = tuple(np.zeros((n, parts)) for _ in range(3)), np.zeros((n, parts), bool)
        live = np.flatnonzero(l_row >= 0)
        if not len(live) or not len(at):
            return sums, shared
        r_ends = np.searchsorted(at, np.arange(docs + 1))
        # (document, term) of the right side as one number; entries are sorted by it.
        code = at * self.size + term
        l_start, l_n = self.ends[l_row[live]], np.diff(self.ends)[l_row[live]]
        done, ends = 0, np.cumsum(l_n)
        while done < len(live):
            stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + MOST_PRODUCTS, "right")))
            own = slice(done, stop)
            done = stop
            mine = _runs(l_start[own], l_n[own])
            pair = np.repeat(live[own], l_n[own])
            wanted = r_row[pair] * self.size + self.term[mine]
            low = np.searchsorted(code, wanted, "left")
            hit = np.flatnonzero(code[np.minimum(low, len(code) - 1)] == wanted)
            pair, mine, low = pair[hit], mine[hit], low[hit]
            times = np.searchsorted(code, wanted[hit], "right") - low
            other = _runs(low, times)
            pair, mine = np.repeat(pair, times), np.repeat(mine, times)
            key, a, b = pair * parts + part[other], self.value[mine], value[other]
            for total, product in zip(sums, (a * b, a * a, b * b)):
                total += np.bincount(key, product, n * parts).reshape(n, parts)
            shared.reshape(-1)[key] = True
        return sums, shared


def _found(keys: np.ndarray, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted numbers are among the sorted keys, and whether they are there."""
    numbers, known = np.asarray(wanted.fill_null(0)), ~np.asarray(wanted.is_null())
    if not len(keys):
        return np.zeros(len(numbers), np.int64), np.zeros(len(numbers), bool)
    at = np.minimum(np.searchsorted(keys, numbers), len(keys) - 1)
    return at, known & (keys[at] == numbers)
