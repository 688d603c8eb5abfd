"""Porter stemming (M. F. Porter, "An algorithm for suffix stripping", 1980) as a Spark column.

The rules are regular expressions evaluated in the JVM, so stemming needs no Python worker and
no join with a vocabulary. `STEPS` holds the suffix tables; the two revisions Porter published
later (`bli`, `logi`) are included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A `y` that acts as a consonant is written `Y` while the rules run.
VOWEL = "[aeiouy]"
CONSONANT = "[^aeiouy]"
M_GT_0 = f"^{CONSONANT}*{VOWEL}+{CONSONANT}"
M_GT_1 = f"^{CONSONANT}*{VOWEL}+{CONSONANT}+{VOWEL}+{CONSONANT}"
M_EQ_1 = f"^{CONSONANT}*{VOWEL}+{CONSONANT}+{VOWEL}*$"
SHORT_END = f"{CONSONANT}{VOWEL}[^aeiouywxY]$"
DOUBLE_END = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yY)$"

# The suffix tables of steps 2, 3 and 4 of the published algorithm.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "logi": "log",
}
STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP4 = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once, so that `body` may use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _cut(word: Column, n: int | Column) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _swap_suffix(word: Column, table: dict[str, str]) -> Column:
    pattern = "(" + "|".join(table) + ")$"

    def swap(suffix: Column) -> Column:
        replacement = F.lit(None).cast("string")
        for old, new in table.items():
            replacement = F.when(suffix == old, F.lit(new)).otherwise(replacement)
        stem = _cut(word, F.length(suffix))
        return F.when((suffix != "") & stem.rlike(M_GT_0), F.concat(stem, replacement)).otherwise(word)

    return _let(F.regexp_extract(word, pattern, 1), swap)


def _step1a(w: Column) -> Column:
    return (
        F.when(w.rlike("(sses|ies)$"), _cut(w, 2))
        .when(w.rlike("[^s]s$"), _cut(w, 1))
        .otherwise(w)
    )


def _repair(w: Column) -> Column:
    return (
        F.when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e")))
        .when(w.rlike(DOUBLE_END), _cut(w, 1))
        .when(w.rlike(M_EQ_1) & w.rlike(SHORT_END), F.concat(w, F.lit("e")))
        .otherwise(w)
    )


def _step1b(w: Column) -> Column:
    return (
        F.when(w.rlike("eed$"), F.when(_cut(w, 3).rlike(M_GT_0), _cut(w, 1)).otherwise(w))
        .when(w.rlike(f"{VOWEL}.*ed$"), _let(_cut(w, 2), _repair))
        .when(w.rlike(f"{VOWEL}.*ing$"), _let(_cut(w, 3), _repair))
        .otherwise(w)
    )


def _step1c(w: Column) -> Column:
    return F.when(w.rlike(f"{VOWEL}.*[yY]$"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _step4(w: Column) -> Column:
    def drop(suffix: Column) -> Column:
        stem = _cut(w, F.length(suffix))
        keeps = (suffix == "") | ~stem.rlike(M_GT_1) | ((suffix == "ion") & ~stem.rlike("[st]$"))
        return F.when(keeps, w).otherwise(stem)

    return _let(F.regexp_extract(w, "(" + "|".join(STEP4) + ")$", 1), drop)


def _step5a(w: Column) -> Column:
    stem = _cut(w, 1)
    goes = stem.rlike(M_GT_1) | (stem.rlike(M_EQ_1) & ~stem.rlike(SHORT_END))
    return F.when(w.rlike("e$") & goes, stem).otherwise(w)


def _step5b(w: Column) -> Column:
    return F.when(w.rlike("ll$") & w.rlike(M_GT_1), _cut(w, 1)).otherwise(w)


STEPS = (
    _step1a,
    _step1b,
    _step1c,
    lambda w: _swap_suffix(w, STEP2),
    lambda w: _swap_suffix(w, STEP3),
    _step4,
    _step5a,
    _step5b,
)


def porter(word: Column) -> Column:
    """The stem of a lower-case word; words of one or two letters stay as they are."""

    def run(steps):
        def body(w: Column) -> Column:
            if len(steps) == 1:
                return F.lower(steps[0](w))
            return _let(steps[0](w), run(steps[1:]))

        return body

    marked = F.regexp_replace(F.regexp_replace(word, "(^|[aeiou])y", "$1Y"), "yy", "yY")
    return F.when(F.length(word) <= 2, word).otherwise(_let(marked, run(STEPS)))


FREQUENT_WORDS = 5_000


def with_stems(
    terms: DataFrame,
    word: str = "token",
    weight: Column | None = None,
    keep: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Replace `word` by its stem in an exploded table; rows whose stem fails `keep` go.

    The stems of the FREQUENT_WORDS most frequent words are computed once and broadcast (a table
    of at most that many rows). Only the remaining, rare words run the rules row by row.
    """
    weight = F.lit(1) if weight is None else weight
    counts = terms.groupBy(word).agg(F.sum(weight).alias("_n"))
    frequent = (
        counts.orderBy(F.desc("_n"), word).limit(FREQUENT_WORDS)
        .select(F.col(word).alias("_word"), porter(F.col(word)).alias("_stem"))
    )
    joined = terms.join(F.broadcast(frequent), F.col(word) == F.col("_word"), "left")
    # The test runs inside a generator: as a filter it would be pushed down with a second copy of
    # the rules in it.
    stem = F.coalesce(F.col("_stem"), porter(F.col(word)))
    kept = _let(stem, lambda s: F.when(keep(s), F.array(s)) if keep else F.array(s))
    rest = [c for c in terms.columns if c != word]
    return joined.select(*rest, F.explode(kept).alias(word))
