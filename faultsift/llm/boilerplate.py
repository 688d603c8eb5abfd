"""Line deduplication by site-relative frequency (operator 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultsift.llm.common import bounded
from faultsift.session import stage

#: Share of a host's pages over which a line is boilerplate.
RATIO = 0.1
#: Pages a line must stand on, whatever its share: what one page alone holds repeats nothing.
LEAST_PAGES = 2


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _name(line: Column) -> Column:
    """A line without blanks at its ends."""
    return F.xxhash64(_stripped(line))


def _stripped(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\x0b\x0c\r"))


def frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, line, pages, host_pages) of the lines on more than `ratio` of a host's pages.

    Every row is a page, also one that repeats; a page counts a line once. A null host is the host ''.
    The ratio decides alone, but for lines of one page only. Blank lines are no lines. Pages are
    counted with partial aggregates by host and line; only lines on `least_pages` pages meet the
    totals of the hosts.
    """
    pages = docs.select(F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"), F.col(f"`{text}`").alias("_t"))
    named = F.transform(F.filter(_lines(F.col("_t")), lambda x: _stripped(x) != ""), _name)
    counted = pages.select("host", F.explode(F.array_distinct(named)).alias("line")).groupBy("host", "line")
    counted = counted.agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    return counted.join(totals, "host").where(F.col("pages") > ratio * F.col("host_pages"))


def without_boilerplate(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """`docs` without boilerplate lines in `text`, and columns n_lines and n_dropped (lines that are not blank).

    A host's frequent lines are one row: their number is bounded by the mean number of lines of
    its pages divided by `ratio`. Counted, they are broadcast while few; beyond that the documents
    meet them in a join on the host, whose hot hosts adaptive execution splits. Blank lines and
    the order stay. A null text stays null, a text of boilerplate only becomes empty.
    """
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    found = stage(frequent_lines(plain, names[text], names[host], ratio, least_pages), "lines")
    by_host = found.groupBy("host").agg(F.collect_list("line").alias("_drop"))
    by_host = F.broadcast(by_host) if bounded(found) is not found else by_host
    own_host = F.coalesce(F.col(names[host]).cast("string"), F.lit(""))
    joined = plain.withColumn("_host", own_host).join(by_host.withColumnRenamed("host", "_host"), "_host", "left")
    parts = _lines(F.col(names[text]))
    blank = lambda x: _stripped(x) == ""
    kept = F.filter(parts, lambda x: blank(x) | ~F.array_contains("_drop", _name(x)))
    cut = F.when(F.col("_drop").isNull() | F.col(names[text]).isNull(), F.col(names[text])).otherwise(F.array_join(kept, "\n"))
    lines = F.size(F.filter(parts, lambda x: ~blank(x)))
    dropped = F.when(F.col("_drop").isNull(), 0).otherwise(F.size(parts) - F.size(kept))
    own = [(cut if c == text else F.col(n)).alias(c) for c, n in names.items() if c not in ("n_lines", "n_dropped")]
    return joined.select(*own, lines.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))
