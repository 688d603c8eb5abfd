"""Near-duplicate detection by ProbMinHash over weighted word shingles (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultsift.llm.common import bounded, by_document, components, digest
from faultsift.session import stage, unstage

WORDS = 5
SIMILARITY = 0.8
#: BANDS x ROWS components. At a similarity of 0.8 two texts share no band once in 200,000 pairs.
BANDS, ROWS = 40, 6
#: Distinct texts up to which a bucket is tested whole, and the members that all others of a larger one
#: are tested against in round 1.
SMALL, HEADS = 32, 4
#: Texts of a group of common prefix shingles that one task pairs with all others of the group.
PART = 2048
#: Slots in which shingles are counted to find the rarest of a text; any order of them gives right results.
SLOTS = 1 << 20
#: Ranges of slots that a task's counts are handed on by, one row a range.
RANGES = 256
#: Bits of the sketches that texts of large buckets compare before their sets are fetched, and the standard
#: deviations that two texts of just the similarity may fall short (once in a billion pairs they do).
BITS, DEVIATIONS = 2048, 6.0
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str], size: int = WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """By text: its distinct shingles (ascending 64-bit hashes) and how often each occurs.

    Words are the lower-case parts between white space. A text with fewer than `size` words is one
    shingle, a text without words has none.
    """
    split = [text.lower().split() for text in texts]
    flat = np.array([word for words in split for word in words], object)
    hashed = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, "uint64")
    out, at = [], 0
    for words in split:
        own = hashed[at : at + len(words)]
        at += len(words)
        count = max(len(own) - size + 1, min(len(own), 1))
        value = np.full(count, np.uint64(len(own) if len(own) < size else size))
        for k in range(min(size, len(own))):
            value = mix(value * _GOLDEN + own[k : k + count])
        out.append(np.unique(value, return_counts=True))
    return out


def signature(elements: np.ndarray, weights: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash signature: by component the element that arrives first.

    Every element arrives by a Poisson process whose rate is its weight, each time at a random
    component. Two sets agree in a component with the probability that is their probability
    Jaccard similarity. Arrivals are drawn from the element's hash, several of each element at a
    time; an element stops when its next arrival is later than every component's first. The place
    of an arrival comes from 11 bits, so `m` is 2048 at most.
    """
    assert m <= 2048
    first, at = np.full(m, np.inf), np.zeros(m, "uint64")
    active, rates = elements, weights.astype("float64")
    time, drawn = np.zeros(len(elements)), 0
    while len(active):
        block = max(1, -(-3 * m // len(active)))
        number = np.arange(drawn + 1, drawn + block + 1, dtype="uint64") * _GOLDEN
        bits = mix(active[:, None] + number[None, :])
        waits = -np.log(((bits >> np.uint64(11)).astype("float64") + 0.5) * 2.0**-53) / rates[:, None]
        times = time[:, None] + np.cumsum(waits, axis=1)
        places = (((bits & np.uint64(2047)) * np.uint64(m)) >> np.uint64(11)).astype("int64")
        flat, where, who = times.ravel(), places.ravel(), np.repeat(active, block)
        early = flat < first[where]
        flat, where, who = flat[early], where[early], who[early]
        order = np.argsort(-flat, kind="stable")  # of several arrivals at a component the last written is the earliest
        first[where[order]], at[where[order]] = flat[order], who[order]
        time, drawn = times[:, -1], drawn + block
        going = time < first.max()
        active, rates, time = active[going], rates[going], time[going]
    return at


def bands(signed: np.ndarray, count: int = BANDS) -> np.ndarray:
    """One 64-bit key per band."""
    rows = signed.reshape(count, -1)
    key = mix(np.arange(1, count + 1, dtype="uint64") * _GOLDEN)
    for r in range(rows.shape[1]):
        key = mix(key * _GOLDEN + rows[:, r])
    return key.view("int64")


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two weighted sets of ascending elements.

    The sum over common elements d of 1 / sum over e of max(wa(e) / wa(d), wb(e) / wb(d)). With
    the ratio r = wb / wa, elements up to r(d) count by wa, those above by wb.
    """
    common, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = wa[ia].astype("float64"), wb[ib].astype("float64")
    ratio = y / x
    levels, level = np.unique(ratio, return_inverse=True)
    low = np.cumsum(np.bincount(level, x, len(levels))) + (wa.sum() - x.sum())
    high = y.sum() - np.cumsum(np.bincount(level, y, len(levels))) + (wb.sum() - y.sum())
    return float((1.0 / (low[level] / x + high[level] / y)).sum())


def _banded(docs: DataFrame) -> DataFrame:
    """(k, name, bands) of every document; null bands for a text without words."""

    def work(texts: list[str]) -> list[tuple]:
        return [(bands(signature(*found)).tolist() if len(found[0]) else None,) for found in shingles(texts)]

    return by_document(docs, work, "bands array<long>", "t", "k", "name")


def _weighted(docs: DataFrame) -> DataFrame:
    """(name, elements, weights) of texts."""

    def work(texts: list[str]) -> list[tuple]:
        return [(e.view("int64").tolist(), w.tolist()) for e, w in shingles(texts)]

    return by_document(docs, work, "elements array<long>, weights array<int>", "t", "name")


def _values(column: pa.ListArray, row: int, kind: str) -> np.ndarray:
    start, end = column.offsets[row].as_py(), column.offsets[row + 1].as_py()
    return column.values.slice(start, end - start).to_numpy().astype(kind, copy=False)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of at least `similarity`, measured on the whole shingle sets."""
    left = sets.select(F.col("name").alias("a"), F.col("elements").alias("ea"), F.col("weights").alias("wa"))
    right = sets.select(F.col("name").alias("b"), F.col("elements").alias("eb"), F.col("weights").alias("wb"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ea, wa, eb, wb = (batch.column(c) for c in ("ea", "wa", "eb", "wb"))
            good = [
                i
                for i in range(batch.num_rows)
                if probability_jaccard(
                    _values(ea, i, "int64"), _values(wa, i, "int64"), _values(eb, i, "int64"), _values(wb, i, "int64")
                )
                >= similarity
            ]
            yield batch.select(["a", "b"]).take(pa.array(good, "int64"))

    few = bounded(pairs)
    if few is not pairs:  # only the sets that pairs name are shuffled
        right = right.join(F.broadcast(pairs.select("b")), "b", "left_semi")
    return few.join(left, "a").join(right, "b").mapInArrow(measure, "a binary, b binary")


def sketch(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """BITS bits of a set as 64-bit numbers: one of each component of a ProbMinHash signature.

    Two sets of similarity J agree in a bit with the probability (1 + J) / 2.
    """
    bits = (mix(signature(elements, weights, BITS)) & np.uint64(1)).astype(bool)
    return np.packbits(bits).view("int64")


def least_agreement(similarity: float) -> int:
    """Bits in which sketches agree at least, DEVIATIONS below the mean of two sets of `similarity`."""
    share = (1 + similarity) / 2
    return int(BITS * share - DEVIATIONS * (BITS * share * (1 - share)) ** 0.5)


def _with_root(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """`rows` with the root of their name, which is the name itself where no label says otherwise."""
    if labels is None:
        return rows.withColumn("root", F.col("name"))
    joined = rows.join(bounded(labels.withColumnRenamed("node", "name")), "name", "left")
    return joined.withColumn("root", F.coalesce("root", "name"))


def _heads(labelled: DataFrame, turn: int) -> DataFrame:
    """(band, heads) of the buckets that hold several classes: the members all others are tested against.

    Round 0: the one that meets the most texts in all its buckets; it is the same in most buckets of
    a group of copies, and near the middle of the group. Round 1: every member of a bucket of at
    most SMALL texts, the one that meets the most of each of HEADS parts of a larger one.
    """
    one, met = F.struct("name", "root"), F.struct("meets", "name")
    part = F.lit(0)
    if turn:
        part = F.when(F.col("n") <= SMALL, F.lit(-1)).otherwise(F.pmod(F.xxhash64("name"), F.lit(HEADS)).cast("int"))
    whole = F.collect_list(F.when(F.lit(turn > 0) & (F.col("n") <= SMALL), one))
    found = labelled.groupBy("band", part.alias("part")).agg(
        F.max_by(one, met).alias("first"), whole.alias("whole"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    heads = F.when(F.size("whole") > 0, F.col("whole")).otherwise(F.array("first"))
    found = found.select("band", heads.alias("heads"), "low", "high").groupBy("band")
    found = found.agg(F.flatten(F.collect_list("heads")).alias("heads"), F.min("low").alias("low"), F.max("high").alias("high"))
    return found.where(F.col("low") != F.col("high")).select("band", "heads")


def _unfinished(labelled: DataFrame) -> DataFrame:
    """(name, root) of the texts in buckets of more than SMALL texts that hold several classes."""
    large = labelled.where(F.col("n") > SMALL)
    open_ones = large.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("band")
    open_ones = stage(open_ones, "open")
    names = stage(large.join(bounded(open_ones), "band", "left_semi").select("name", "root").distinct(), "unfinished")
    unstage(open_ones)
    return names


def _holders(sets: DataFrame) -> np.ndarray:
    """How many texts hold a shingle of each slot, a slot being the last bits of a hash; SLOTS numbers.

    A task hands on the counts of a range of slots as one row, so rows follow tasks, not shingles.
    """

    width = SLOTS // RANGES

    def listed(ranges: list[int], slots: list[np.ndarray], n: list[np.ndarray]) -> list[pa.Array]:
        return [pa.array(ranges, pa.int32()), pa.array(slots, pa.list_(pa.int64())), pa.array(n, pa.list_(pa.int64()))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, "int64")
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            counts += np.bincount(values & (SLOTS - 1), minlength=SLOTS)
        found = np.flatnonzero(counts)
        ranges, starts = np.unique(found // width, return_index=True)
        slots = np.split(found, starts[1:]) if len(found) else []
        yield pa.RecordBatch.from_arrays(listed(ranges.tolist(), slots, [counts[s] for s in slots]), ["range", "slots", "n"])

    def add(rows: pa.Table) -> pa.Table:
        counts, low = np.zeros(width, "int64"), rows.column("range")[0].as_py() * width
        for batch in rows.to_batches():
            slots, n = (batch.column(c).flatten().to_numpy() for c in ("slots", "n"))
            np.add.at(counts, slots - low, n)
        found = np.flatnonzero(counts)
        return pa.Table.from_arrays(listed([low // width], [found + low], [counts[found]]), ["range", "slots", "n"])

    schema = "range int, slots array<long>, n array<long>"
    summed = sets.select("elements").mapInArrow(work, schema).groupBy("range").applyInArrow(add, schema).toArrow()
    holders = np.zeros(SLOTS, "int32")
    for batch in summed.to_batches():
        slots, n = (batch.column(c).flatten().to_numpy() for c in ("slots", "n"))
        holders[slots] = np.minimum(n, np.iinfo("int32").max)
    return holders


def prefix(elements: np.ndarray, weights: np.ndarray, holders: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a text, those of the rarest slots first, that other texts may hold as well.

    The probability Jaccard similarity of two sets is at most the sum over common elements of the
    lesser of their two shares, since each term 1 / sum of max(...) is at most either share. So the
    common elements of two sets of at least `similarity` make up at least that share of each, and
    cannot all lie behind the elements that take up more than the rest of it: in one order of all
    elements, whichever it is, the first common one is in the prefix of both.
    """
    held = holders[elements & (SLOTS - 1)]
    order = np.lexsort((elements, held))
    ahead = np.cumsum(weights[order], dtype="int64") - weights[order]
    return elements[order][(held[order] > 1) & (ahead <= (1 - similarity + 1e-9) * weights.sum(dtype="int64"))]


def _known(own: DataFrame, similarity: float) -> DataFrame:
    """(name, root, prefix, sketch) of shingle sets."""
    holders = _holders(own)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, w = batch.column("elements"), batch.column("weights")
            found = [(_values(e, i, "int64"), _values(w, i, "int32")) for i in range(batch.num_rows)]
            firsts = [prefix(x, y, holders, similarity) for x, y in found]
            bits = [sketch(x.view("uint64"), y) for x, y in found]
            columns = [pa.array(c, pa.list_(pa.int64())) for c in (firsts, bits)]
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("root"), *columns], ["name", "root", "prefix", "sketch"])

    taken = own.select("name", "root", "elements", "weights")
    return taken.mapInArrow(work, "name binary, root binary, prefix array<long>, sketch array<long>")


def _finished(names: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs of texts of different classes, of those named, that can reach `similarity`.

    Texts meet in the group of a shingle of both prefixes, at the first one only, and become a pair
    where their sketches agree as texts of `similarity` do. A group is cut into parts of about PART
    texts; each meets a copy of the whole group, so a large one is spread over tasks.
    """
    own = stage(sets.join(bounded(names), "name"), "sets")
    known = stage(_known(own, similarity), "known")
    unstage(own)
    single = known.select("root", "name", F.explode("prefix").alias("element"))
    groups = single.groupBy("element").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    groups = stage(groups.where("low != high").select("element", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "groups")
    placed = known.select("name", "root", "sketch", "prefix", F.posexplode("prefix").alias("place", "element"))
    placed = placed.withColumn("earlier", F.slice("prefix", F.lit(1), F.col("place"))).drop("prefix", "place")
    met = placed.join(bounded(groups), "element")
    mine = lambda x: [F.col("name").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("root", "sketch", "earlier")]]
    left = met.select("element", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("part"), *mine("a"))
    right = met.select("element", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *mine("b"))
    differ = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    l, r = left.alias("l"), right.alias("r")
    close = (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & (differ <= BITS - least_agreement(similarity))
    same = (F.col("l.element") == F.col("r.element")) & (F.col("l.part") == F.col("r.part"))
    pairs = stage(l.join(r, same & close & ~F.arrays_overlap("earlier_a", "earlier_b")).select("a", "b"), "pairs")
    unstage(known)
    unstage(groups)
    return pairs


def _linked(labels: DataFrame | None, pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """The classes after the stored `pairs` are tested; `pairs` and the classes before are let go."""
    new = stage(_verified(pairs, sets, similarity), "links")
    unstage(pairs)
    if new.isEmpty():
        unstage(new)
        return labels
    merged = _merged(labels, new)
    unstage(new)
    if labels is not None:
        unstage(labels)
    return merged


def _merged(labels: DataFrame | None, new: DataFrame) -> DataFrame:
    """(node, root) of the classes after the links (a, b) of texts are added."""
    if labels is None:
        return stage(components(new), "labels")
    ends = _with_root(_with_root(new.withColumnRenamed("a", "name"), labels).select(F.col("root").alias("a"), F.col("b").alias("name")), labels)
    joined = components(ends.select("a", F.col("root").alias("b")))  # links of classes, not of texts
    old = _with_root(labels.select(F.col("root").alias("name"), "node"), joined).select("node", "root")
    return stage(old.unionByName(joined.join(labels, "node", "left_anti")), "labels")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """(key, copy, class_id, class_size) of every document.

    Documents are linked where the probability Jaccard similarity of their weighted five-word
    shingles is at least `similarity`; a class is what links connect, class_id its least key,
    class_size its documents. Equal texts are one text from the start (`copy` is its digest) and
    never expanded into pairs. A text without words is linked to nothing but equal texts, and
    those not either: every such document is a class of its own with its own key. A class whose
    keys are all null has a null id.

    Texts that share a band meet in its bucket. Round 0 links the members of a bucket to the one that
    meets the most texts, not all with all. Buckets that hold several classes after it go on: those
    of at most SMALL texts link all of their members, so that none of their links is missed; larger
    ones link their members to HEADS of them. The texts of larger ones that hold several classes
    even then meet once more by their rarest shingles, which every pair that reaches `similarity`
    shares; pairs of different classes whose sketches agree are tested. Buckets are counted with
    partial aggregates and joined back on the bucket, which adaptive execution splits. Every
    candidate is verified on whole shingle sets, which are kept for candidates only.
    """
    plain = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"), digest(F.col(f"`{text}`")).alias("name"))
    banded = stage(_banded(plain), "bands")
    texts = banded.where("bands IS NOT NULL").groupBy("name").agg(F.first("bands").alias("bands"), F.min("k").alias("k"))
    opened = stage(texts.select("name", F.explode("bands").alias("band")), "bands")
    shared = opened.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = stage(shared, "shared")
    members = stage(opened.join(shared, "band"), "buckets")
    unstage(opened)
    unstage(shared)
    candidates = stage(members.groupBy("name").agg(F.sum("n").alias("meets")), "candidates")
    firsts = banded.join(bounded(candidates), "name", "left_semi").groupBy("name").agg(F.min("k").alias("k"))
    wanted = stage(firsts, "candidates")
    mine = (F.col("p.name") == F.col("c.name")) & F.col("p.k").eqNullSafe(F.col("c.k"))
    chosen = plain.alias("p").join(bounded(wanted).alias("c"), mine, "left_semi").select("p.t", "p.name")
    sets = stage(_weighted(chosen), "shingles")
    unstage(wanted)
    labels = None
    for turn in range(2):
        nodes = stage(_with_root(candidates, labels), "nodes")
        labelled = members.join(bounded(nodes), "name")
        heads = stage(_heads(labelled, turn), "heads")
        met = labelled.join(bounded(heads), "band").select("name", "root", F.explode("heads").alias("head"))
        met = met.where(F.col("root") != F.col("head.root"))
        pairs = met.select(F.least("name", "head.name").alias("a"), F.greatest("name", "head.name").alias("b")).distinct()
        labels = _linked(labels, stage(pairs, "pairs"), sets, similarity)
        unstage(heads)
        unstage(nodes)
    names = _unfinished(_with_root(members, labels))
    if not names.isEmpty():
        labels = _linked(labels, _finished(names, sets, similarity), sets, similarity)
    for table in (names, sets, members, candidates):
        unstage(table)
    mapped = _with_root(banded.select("k", "name", F.col("bands").isNull().alias("empty")), labels).withColumnRenamed("root", "class")
    sizes = stage(
        mapped.where("NOT empty").groupBy("class").agg(F.min("k").alias("class_id"), F.count("*").alias("class_size")).where("class_size > 1"),
        "classes",
    )
    joined = mapped.join(sizes, "class", "left")
    single = F.col("class_size").isNull() | F.col("empty")
    return joined.select(
        F.col("k").alias(key),
        F.col("name").alias("copy"),
        F.when(single, F.col("k")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(single, F.lit(1).cast("long")).otherwise(F.col("class_size")).alias("class_size"),
        F.when(F.col("empty"), F.lit(None)).otherwise(F.col("class")).alias("class"),
    )


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with one document of every class: the one of the least key, by digest among equal keys.

    Documents without words all stay. Of rows that repeat key and text one stays.
    """
    found = stage(near_duplicates(docs, text, key, similarity), "classes")
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], digest(F.col(f"`{text}`")).alias("_name"))
    own = found.select(F.col(key).alias("_k"), "copy", "class", "class_size")
    rank = F.struct(F.col("_k").isNull().alias("no_key"), "_k", "copy")
    stays = own.where("class_size > 1").groupBy("class").agg(F.min(rank).alias("s"))
    gone = own.where("class_size > 1").join(stays, "class").where(~rank.eqNullSafe(F.col("s"))).select("_k", "copy").distinct()
    gone = stage(gone, "gone")
    mine = F.col(names[key]).eqNullSafe(F.col("_k")) & (F.col("_name") == F.col("copy"))
    kept = plain.join(bounded(gone), mine, "left_anti")
    again = stage(own.where("class_size > 1").groupBy("_k", "copy").agg(F.count("*").alias("n")).where("n > 1").select("_k", "copy"), "repeated")
    if not again.isEmpty():  # equal rows: found in the small table, so the texts are shuffled only where there are some
        repeated = kept.join(bounded(again), mine, "left_semi").dropDuplicates([names[key], "_name"])
        kept = kept.join(bounded(again), mine, "left_anti").unionByName(repeated)
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
