"""Interaction of document filters (operator 12): what every filter removes, in every order."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultsift.llm.common import bounded, digest
from faultsift.session import stage, unstage

BLANKS = r"[\x20\x09-\x0D]+"
#: Rows of a group of copies that share a join key; larger groups are dealt over several.
SHARE_ROWS = 256


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text; null counts as empty.

    A: under 100 words; B: under 80 % of the words are distinct; C: over 10 % of the code points are
    A to Z; D: holds one of `#$%&*|`. Words are what lies between ASCII blanks, case matters.
    """
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, BLANKS, -1), lambda w: w != "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * (F.char_length(whole) - F.char_length(F.regexp_replace(whole, "[A-Z]+", ""))) > 10 * F.char_length(whole),
        "D": whole.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, conditions: Mapping[str, Column], part: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, part, n, bits): the documents, with a bit for each condition that they fail.

    `conditions` are columns over `docs`, null counts as passed; bits follow their order. The last
    bit, after theirs, is for copies: the text is that of a smaller key anywhere in `docs`. Null texts count as
    empty. Rows that repeat key, part and text are one document with `n` rows; a null key is no
    smaller and no larger than any other, so it marks none and is never marked.

    Copies are found by a left-semi join on digest, whole text and smaller key. Only texts whose
    digest stands under several keys are moved. The other side of the join is the least key of every
    such text, and a group of copies is dealt over as many join keys as its rows ask for.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    bits = reduce(Column.bitwiseOR, [F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(conditions.values())])
    own = [F.col(f"`{key}`").alias("_k"), part.alias("_part"), digest(whole).alias("_h")]
    marked = stage(docs.select(*own, bits.alias("_bits")), "failures")
    groups = marked.groupBy("_h").agg(F.count("*").alias("_n"), F.min("_k").alias("lo"), F.max("_k").alias("hi"))
    repeated = stage(groups.where("lo < hi").select("_h", F.ceil(F.col("_n") / SHARE_ROWS).alias("_shares")), "repeated")
    texts = docs.select(*own, whole.alias("_x")).where("_k IS NOT NULL").join(bounded(repeated), "_h")
    dealt = stage(texts.withColumn("_share", F.pmod(F.xxhash64("_k"), "_shares")), "copies")
    least = dealt.groupBy("_h", "_x", "_shares").agg(F.min("_k").alias("_least"))
    least = least.select("_h", "_x", "_least", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1)).alias("_share"))
    a, b = dealt.alias("a"), least.alias("b")
    same = (F.col("a._h") == F.col("b._h")) & (F.col("a._share") == F.col("b._share")) & (F.col("a._x") == F.col("b._x"))
    later = a.join(b, same & (F.col("b._least") < F.col("a._k")), "left_semi").select("_k", "_part", "_h")
    failed = marked.select("_k", "_part", "_h", "_bits", F.lit(1).alias("_one")).unionByName(
        later.select("_k", "_part", "_h", F.lit(1 << len(conditions)).alias("_bits"), F.lit(0).alias("_one"))
    )
    found = failed.groupBy("_k", "_part", "_h").agg(F.sum("_one").alias("n"), F.bit_or("_bits").alias("bits"))
    result = stage(found.select(F.col("_k").alias(key), F.col("_part").alias("part"), "n", "bits"), "failures")
    for table in (marked, repeated, dealt):
        unstage(table)
    return result


def audit(failed: DataFrame, letters: str, labels: DataFrame | None = None, lost: Mapping[str, Column] | None = None, key: str = "doc_id") -> DataFrame:
    """What each filter does at each step of every order of `letters`, a row per part, order and step.

    `failed` is the result of `failures`, whose bits `letters` name. Columns: part, filter_order,
    step (from 1), and document counts: kept (after the step), removed (by it), redundant (failing
    it, removed before), unique_fails (failing it alone), one column per entry of `lost` (removed
    here, and some row of `labels` with the document's key meets the condition), shapley (removed by
    this filter, summed over all orders). Steps without documents are rows of zeros; a table
    without rows has no part and no row.

    The documents are counted by part and combination of bits first, so the orders meet at most
    2 ** letters rows a part. The orders are factorial in number: keep to about seven letters.
    """
    lost = dict(lost or {})
    flags = list(lost)
    rows = failed
    if labels is not None:
        marks = labels.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias(key))
        marks = marks.agg(*[F.max(F.when(c, 1).otherwise(0)).alias(f) for f, c in lost.items()])
        rows = failed.join(marks, key, "left")
    counts = rows.groupBy("part", "bits").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(F.col(f), F.lit(0))).alias(f) for f in flags])
    orders = F.array(*[F.lit("".join(order)) for order in permutations(letters)])
    steps = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    places = [F.instr("filter_order", letter) for letter in letters]
    earlier = reduce(Column.bitwiseOR, [F.when(p < F.col("step"), F.lit(1 << i)).otherwise(0) for i, p in enumerate(places)])
    here = reduce(Column.bitwiseOR, [F.when(p == F.col("step"), F.lit(1 << i)).otherwise(0) for i, p in enumerate(places)])
    fails, gone = F.col("bits").bitwiseAND(here) != 0, F.col("bits").bitwiseAND(earlier) != 0

    def total(condition: Column, value: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0)).cast("long")

    table = steps.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("bits") == here).alias("unique_fails"),
        *[total(fails & ~gone, f).alias(f) for f in flags],
    )
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    shapley = table.groupBy("part", letter.alias("_letter")).agg(F.sum("removed").alias("shapley"))
    return table.withColumn("_letter", letter).join(shapley, ["part", "_letter"]).drop("_letter")
