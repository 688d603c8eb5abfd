"""Word lists."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from faultsift.functions.stemming import porter

# Words of the Java language, then names so common in Java code that they carry
# no meaning for search.
JAVA_KEYWORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double "
    "else enum extends false final finally float for goto if implements import instanceof int "
    "interface long native new null package private protected public return short static "
    "strictfp super switch synchronized this throw throws transient true try void volatile while "
    "org eclipse swt string main args"
).split()

# Fixed value: the word HTML escapes leave behind.
MARKUP_WORDS = ["quot"]


@lru_cache(maxsize=1)
def english_stop_words() -> tuple[str, ...]:
    """The English list Spark ML ships. Pass your own list where another one is wanted."""
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


@lru_cache(maxsize=32)
def stemmed(words: tuple[str, ...]) -> tuple[str, ...]:
    """Stems of a word list. The list is a parameter of fixed size, not data."""
    spark = SparkSession.active()
    rows = spark.createDataFrame([(w.strip().lower(),) for w in words], "w string")
    return tuple(sorted({r[0] for r in rows.select(porter(F.col("w"))).collect()}))
