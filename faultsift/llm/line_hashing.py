"""Substring deduplication by hashing lines, their sentences or paragraphs (operator 2)."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultsift.llm.common import by_document, digest
from faultsift.session import stage

#: What a unit is, with what ends it. Units follow each other without a gap. A sentence is a piece of a
#: line up to a full stop, question or exclamation mark with a space behind it.
UNITS = {
    "sentence": r"[^\n]*?(?:[.!?] |\n)|[^\n]+",
    "line": r"[^\n]*\n|[^\n]+",
    "paragraph": r"(?:[^\n]|\n(?!\n))*\n\n|(?:[^\n]|\n(?!\n))+",
}
#: Words that a run of repeated units needs together; shorter ones repeat by chance.
LEAST_WORDS = 25


def units(docs: DataFrame, text: str = "text", key: str = "doc_id", kind: str = "sentence") -> DataFrame:
    """(key, copy, unit_no, nth, start, stop, n_words, unit) of every unit with a word.

    `unit` is the digest of the normalised unit: lower case, runs of white space as one space.
    `copy` is the digest of the whole text; with the key it names a document, so rows that repeat
    both are one document. `nth` counts the units with a word. Offsets count code points of the
    original text, end exclusive, with what ends the unit.
    """
    pattern = re.compile(UNITS[kind])

    def cut(texts: list[str]) -> list[tuple]:
        out = []
        for whole in texts:
            found = []
            for number, unit in enumerate(pattern.finditer(whole)):
                words = unit.group().lower().encode().split()  # bytes split at ASCII blanks alone
                if words:
                    name = hashlib.md5(b" ".join(words)).digest()
                    found.append(
                        {"unit_no": number, "nth": len(found), "start": unit.start(), "stop": unit.end(), "n_words": len(words), "unit": name}
                    )
            out.append((found,))
        return out

    plain = docs.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_x"), digest(F.col(f"`{text}`")).alias("copy"))
    kinds = "_units array<struct<unit_no long, nth long, start long, stop long, n_words int, unit binary>>"
    return by_document(plain, cut, kinds, "_x", "_k", "copy").select(F.col("_k").alias(key), "copy", F.inline("_units"))


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", kind: str = "sentence", least_words: int = LEAST_WORDS) -> DataFrame:
    """The units to remove: occurrences of a unit but the earliest, in runs of `least_words` words.

    Occurrences rank by key (nulls last), then by text and unit number. A run are repeated units of
    a document with no other unit between them that has a word; each may be earliest somewhere else.
    Columns: key, copy, unit_no, start, stop, and first_key, first_unit_no of the occurrence that
    stays. Repeats inside one document count too; rows that repeat key and text are one document. Null
    and empty texts have no unit, an empty table no row; other columns are not read. Digests are
    counted with partial aggregates; the join back is on the digest, which adaptive execution
    splits where one unit is very frequent.
    """
    found = stage(units(docs, text, key, kind).withColumnRenamed(key, "_k"), "units")
    rank = F.struct(F.col("_k").isNull().alias("no_key"), "_k", "copy", "unit_no")
    firsts = found.groupBy("unit").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = found.join(stage(firsts, "firsts"), "unit").where(~rank.eqNullSafe(F.col("first"))).drop("unit")
    once = joined.repartition("_k", "copy").dropDuplicates(["_k", "copy", "unit_no"])
    inside = Window.partitionBy("_k", "copy")
    runs = once.withColumn("_run", F.col("nth") - F.row_number().over(inside.orderBy("nth")))
    words = F.sum("n_words").over(Window.partitionBy("_k", "copy", "_run"))
    return runs.withColumn("_words", words).where(F.col("_words") >= least_words).select(
        F.col("_k").alias(key),
        "copy",
        "unit_no",
        "start",
        "stop",
        F.col("first._k").alias("first_key"),
        F.col("first.unit_no").alias("first_unit_no"),
    )


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", kind: str = "sentence", least_words: int = LEAST_WORDS) -> DataFrame:
    """`docs` with the repeated units cut out of `text`, and the removed spans in `removed_spans`.

    A unit goes with what ends it. Null and empty texts stay as they are. A column `removed_spans` of
    `docs` is replaced, all others stay.
    """
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    gone = stage(repeats(docs, text, key, kind, least_words), "repeats")
    gone = gone.select(F.col(key).alias("_k"), "copy", "unit_no", "start", "stop")
    spans = gone.groupBy("_k", "copy").agg(F.sort_array(F.collect_list(F.struct("unit_no", "start", "stop"))).alias("_gone"))
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    mine = digest(F.col(names[text])).eqNullSafe(F.col("copy")) & F.col(names[key]).eqNullSafe(F.col("_k"))
    joined = plain.join(spans, mine, "left")
    parts = F.regexp_extract_all(names[text], F.lit(UNITS[kind]), F.lit(0))
    numbers = F.transform("_gone", lambda g: g["unit_no"].cast("int"))
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), numbers)
    rest = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "")
    cut = F.when(F.col("_gone").isNull(), F.col(names[text])).otherwise(rest)
    removed = F.coalesce(F.transform("_gone", lambda g: F.struct(g["start"].alias("start"), g["stop"].alias("stop"))), F.array())
    own = [(cut if c == text else F.col(n)).alias(c) for c, n in names.items() if c != "removed_spans"]
    return joined.select(*own, removed.cast("array<struct<start:long,stop:long>>").alias("removed_spans"))
