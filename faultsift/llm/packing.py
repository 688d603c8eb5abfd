"""Best-fit packing by minimum bin slack (operator 4)."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from faultsift.llm.common import LookupCache, by_document
from faultsift.session import stage

CAPACITY = 2048
#: Pieces that share a rank group at most, on average.
GROUP = 20_000
#: Entries of half a cache of parts or atoms; four halves of about 200 bytes an entry are held by a process.
CACHED = 200_000
_ENCODERS: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of texts as packed little-endian unsigned 32-bit numbers.

    The tokenizer never joins what a space or line break separates, so a text's ids are those of
    its parts in order. Each part is encoded when it is met first and kept in a cache of bounded
    size. A part of plain ASCII signs and Latin letters is cut here as the tokenizer cuts it (runs
    of letters, single digits, runs of other signs, all in lower case) and only its atoms go
    through the model; any other part goes through the whole tokenizer. Caches go with the task.
    """

    PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
    ATOM = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        # the byte alphabet: printable bytes stand for themselves, the others follow from 256 on
        itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(itself)))}
        self.parts = LookupCache(self._part, CACHED)
        self.atoms = LookupCache(self._atom, CACHED)

    def _atom(self, atom: str) -> bytes:
        by_byte = atom if atom.isascii() else atom.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [token.id for token in self.model.tokenize(by_byte)]).tobytes()

    def _part(self, part: str) -> bytes:
        if self.PLAIN.fullmatch(part):
            return b"".join(map(self.atoms.__getitem__, self.ATOM.findall(part.lower())))
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes() if part else b""

    def forget(self) -> None:
        """Empty the caches; the worker may live on and do other work."""
        self.parts.forget()
        self.atoms.forget()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            yield b"".join(map(self.parts.__getitem__, text.replace("\n", " ").split(" ")))


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most `capacity` ids of every document: its ids, then id 0.

    Columns: the key, piece, start, length, ids_crc32. A null or empty text gives the one id 0.
    Repeated rows are documents of their own.
    """

    def cut(texts: list[str]) -> list[tuple]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = WordEncoder(tokenizer)
        step, out = 4 * capacity, []
        for data in _ENCODERS[tokenizer].encode(texts):
            data += bytes(4)
            parts = [data[at : at + step] for at in range(0, len(data), step)]
            out.append(([(i, i * capacity, len(part) // 4, zlib.crc32(part)) for i, part in enumerate(parts)],))
        return out

    def done() -> None:
        _ENCODERS[tokenizer].forget() if tokenizer in _ENCODERS else None

    kind = "struct<piece int, start long, length long, ids_crc32 long>"
    return by_document(docs, cut, f"_pieces array<{kind}>", text, key, done=done).select(key, F.inline("_pieces"))


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, each as often as it is left at most, whose sum comes nearest to `room` from below.

    Subset sums are the bits of one integer; a length is added as often as it fits and is left.
    Larger lengths go first, and the way back takes the larger ones where it can.
    """
    if counts.get(room):
        return [room]
    reached, layers = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        if length > room or not counts[length]:
            continue
        for _ in range(min(counts[length], room // length)):
            wider = (reached | reached << length) & mask
            if wider == reached:
                break
            layers.append((length, reached))
            reached = wider
        if reached >> room:
            break
    at, chosen = reached.bit_length() - 1, []
    for length, before in reversed(layers):
        if not before >> at & 1:
            chosen.append(length)
            at -= length
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths) of the bins that hold every piece of the histogram.

    Minimum bin slack: a bin starts with the largest length left, the fullest combination of the
    others fills it, and what it holds is removed. A combination is taken as often at once as all
    of its lengths are left; each step then uses up a length, so the number of steps depends on
    the capacity, not on the number of pieces.
    """
    left = {length: n for length, n in histogram.items() if n}
    bins = []
    while left:
        seed = max(left)
        left[seed] -= 1
        lengths = [seed, *fullest(left, capacity - seed)]
        left[seed] += 1
        need = {length: lengths.count(length) for length in set(lengths)}
        times = min(left[length] // n for length, n in need.items())
        for length, n in need.items():
            left[length] -= times * n
            if not left[length]:
                del left[length]
        bins.append((times, lengths))
    return bins


def slots(bins: list[tuple[int, list[int]]]) -> pd.DataFrame:
    """By length and rank: from which rank on the pieces go into which bins, and where."""
    rows, used, first = [], {}, 0
    for times, lengths in bins:
        at, places = 0, {}
        for length in lengths:
            places.setdefault(length, []).append(at)
            at += length
        for length, offsets in places.items():
            rows.append((length, used.get(length, 0), first, offsets))
            used[length] = used.get(length, 0) + times * len(offsets)
        first += times
    return pd.DataFrame(rows, columns=["length", "from_rank", "first", "offsets"])


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (with a column length, 1 to `capacity`) and each one's sequence_id and offset.

    Only the number of pieces by length, `capacity` rows at most, reaches the driver, where minimum
    bin slack lays out the sequences; that work does not grow with the corpus. A piece finds its
    place by its rank among the pieces of its length: ranks count inside hashed groups of bounded
    size, on top of the totals of the groups before. The layout handed to the tasks is bounded by
    the capacity as well. Other columns are kept; `pieces` should be stored, as it is read twice.
    An empty table gives an empty result.
    """
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    layout = slots(plan(histogram, capacity))
    by_length = {
        length: (part["from_rank"].to_numpy(), part["first"].to_numpy(), part["offsets"].tolist())
        for length, part in layout.groupby("length")
    }
    groups = max(1, sum(histogram.values()) // GROUP)
    names = {c: f"_p{i}" for i, c in enumerate(columns)}
    plain = pieces.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    length = names["length"]
    plain = plain.withColumn("_g", F.pmod(F.xxhash64(*names.values()), F.lit(groups)))
    totals = plain.groupBy(length, "_g").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(length).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(length, "_g").orderBy(*names.values())
    ranked = plain.withColumn("_rank", F.row_number().over(within) - 1).join(totals, [length, "_g"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("_rank").to_numpy() + batch.column("_before").to_numpy()
            lengths = batch.column(length).to_numpy()
            sequence, offset = np.zeros(len(rank), "int64"), np.zeros(len(rank), "int64")
            for size in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == size)
                start, first, offsets = by_length[size]
                which = np.searchsorted(start, rank[at], side="right") - 1
                for w in np.unique(which).tolist():
                    rows = at[which == w]
                    local = rank[rows] - start[w]
                    sequence[rows] = first[w] + local // len(offsets[w])
                    offset[rows] = np.array(offsets[w])[local % len(offsets[w])]
            own = [batch.column(n) for n in names.values()]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(offset)], out.names)

    fields = [T.StructField(names[c], pieces.schema[c].dataType) for c in columns]
    out = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    placed = ranked.select(*names.values(), "_rank", "_before").mapInArrow(place, out)
    return placed.select(*[F.col(n).alias(c) for c, n in names.items()], "sequence_id", "offset")


def packed_documents(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document and their places in as few sequences as minimum bin slack finds.

    One row per piece: the key, piece, start, length, ids_crc32, sequence_id, offset. Null keys and
    repeated rows are packed like any other.
    """
    return pack(stage(pieces(docs, tokenizer, text, key, capacity), "pieces"), capacity)
