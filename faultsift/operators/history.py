"""What earlier reports say about a file.

A touch is a row (report_id, file, report_time): the report led to a fix of the file. "Earlier"
means strictly earlier. The set of earlier reports of a touch is never built as pairs; every
feature is a running sum along the time axis of the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from faultsift.functions import measures
from faultsift.operators.blocks import flat
from faultsift.operators.running import running
from faultsift.operators.skew import dealt, hot_keys, skew_join, unsent
from faultsift.session import stage

#: Sums of `measures.pair_cosine` for a report and what came before.
PAST = ("_dot", "_ls", "_la", "_rs", "_ra")


def touches(reports: DataFrame) -> DataFrame:
    """One row per report and fixed file from reports with an array of files."""
    return (
        reports.select(F.col("id").alias("report_id"), "report_time", F.explode("files").alias("file"))
        .dropDuplicates(["report_id", "file"])
    )


def previous_reports(touched: DataFrame, file: Column, until: Column) -> DataFrame:
    """Touches of `file` strictly before `until`."""
    return touched.where((F.col("file") == file) & (F.col("report_time") < until))


def year(time: Column) -> Column:
    """Bucket of a time: report times have whole seconds, so a year holds 32 million at most."""
    return F.date_trunc("year", time)


def _axis(touched: DataFrame, asked: DataFrame | None) -> DataFrame:
    """Touches with weight 1 and questions with weight 0 on one time axis."""
    columns = ["report_id", "file", "report_time"]
    real = touched.select(*columns, F.lit(1).alias("weight"))
    return real if asked is None else real.unionByName(asked.select(*columns, F.lit(0).alias("weight")))


def prior_activity(touched: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Add prior_count and last_time to touches.

    `asked` may hold other rows (report_id, file, report_time) to answer instead; they see the
    touches before them but are seen by none. A row without a file or a time has no earlier
    touches and is earlier than none.
    """
    time, moment = F.col("report_time"), ["file", "report_time"]
    rows = stage(touched if asked is None else asked, "asked")
    real = rows if asked is None else stage(touched.select("report_id", *moment), "touches")
    size = rows.count() if asked is None else rows.count() + real.count()
    timed = _axis(real, None if asked is None else rows).where(time.isNotNull() & F.col("file").isNotNull())
    per_time = dealt(timed.select(*moment, "weight"), size, *moment).groupBy(*moment).agg(F.sum("weight").alias("_n"))
    before = running(
        per_time,
        ["file"],
        [time],
        year(time),
        sums={"prior_count": F.col("_n")},
        maxima={"last_time": F.when(F.col("_n") > 0, time)},
        inclusive=False,
        size=size,
    ).drop("_n")
    rows = dealt(rows, size, *moment).join(dealt(before, size, *moment), moment, "left")
    return rows.withColumn("prior_count", F.coalesce("prior_count", F.lit(0)))


def with_last_report(active: DataFrame, touched: DataFrame) -> DataFrame:
    """Add last_report, the latest earlier report of the file (the smallest id at that time)."""
    at_time = touched.groupBy("file", F.col("report_time").alias("last_time")).agg(
        F.min("report_id").alias("last_report")
    )
    return active.join(at_time, ["file", "last_time"], "left")


def recency_and_frequency(touched: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """bug_recency and bug_frequency of every touch, or of every row asked for."""
    active = prior_activity(touched, asked)
    return active.select(
        "report_id",
        "file",
        measures.recency(F.col("report_time"), F.col("last_time")).alias("bug_recency"),
        F.col("prior_count").alias("bug_frequency"),
    )


def collaborative_similarity(
    touched: DataFrame, report_tf: DataFrame, asked: DataFrame | None = None
) -> DataFrame:
    """Similarity of a report to the joined texts of the earlier reports of a file (collab_filter).

    The vector of the joined texts is the running sum of the term vectors of a file. A touch is one row
    with the counts of its report; a file passes through one task in order of time. Files with very many
    touches are summed by (file, term) instead, in tasks of a year each.
    """
    keys = ["report_id", "file", "report_time"]
    rows = stage(_axis(touched, asked).na.drop(subset=keys), "touches")
    hot = stage(hot_keys(rows, ["file"]), "hot")
    if hot.isEmpty():
        sums = _past_by_file(rows, report_tf)
    else:
        sums = _past_by_file(rows.join(F.broadcast(hot), "file", "left_anti"), report_tf).unionByName(
            _past_by_term(rows.join(F.broadcast(hot), "file", "left_semi").select(*rows.columns), report_tf)
        )
    answers = sums.where(F.col("weight") == (1 if asked is None else 0))
    value = measures.pair_cosine(*[F.col(c) for c in PAST])
    similar = answers.select("report_id", "file", value.alias("collab_filter"))
    answered = (touched if asked is None else asked).join(similar, ["report_id", "file"], "left")
    return answered.withColumn("collab_filter", F.coalesce("collab_filter", F.lit(0.0)))


def _past_by_term(rows: DataFrame, report_tf: DataFrame) -> DataFrame:
    """`rows` with the sums of PAST, from running sums per (file, term).

    The squared length of the joined texts is a running sum as well: adding x to a count s adds
    2 s x + x * x.
    """
    opened = skew_join(rows, report_tf, ["report_id"], hot_keys(rows, ["report_id"]))
    time, s, x, tf = F.col("report_time"), F.col("s"), F.col("x"), F.col("tf").cast("double")
    per_time = opened.groupBy("file", "term", "report_time").agg(F.sum(tf * F.col("weight")).alias("x"))
    summed = running(per_time, ["file", "term"], [time], year(time), sums={"s": x}, inclusive=False)
    known = s > 0
    # Reports of one moment share x, so the growth of the length adds up over their rows.
    sums = stage(
        opened.join(summed, ["file", "term", "report_time"])
        .groupBy("report_id", "file", "report_time", "weight")
        .agg(
            F.sum(tf * s).alias("_dot"),
            F.sum(F.when(known, tf * tf).otherwise(0.0)).alias("_ls"),
            F.sum(tf * tf).alias("_la"),
            F.sum(F.when(known, s * s).otherwise(0.0)).alias("_rs"),
            F.sum(tf * F.col("weight") * (2 * s + x)).alias("_g"),
        )
    )
    growth = sums.groupBy("file", "report_time").agg(F.sum("_g").alias("_growth"))
    lengths = running(growth, ["file"], [time], year(time), sums={"_ra": F.col("_growth")}, inclusive=False)
    joined = sums.join(lengths.drop("_growth"), ["file", "report_time"])
    return joined.select("report_id", "file", "weight", *PAST)


def _past_by_file(rows: DataFrame, report_tf: DataFrame) -> DataFrame:
    """`rows` with the sums of PAST; equal rows become one, their sums are added. `tf` are counts.

    The rows of a file come in order of time, a batch after the other; what goes from batch to batch is one
    sum per term of a file and the rows of its last moment.
    """
    listed = report_tf.where(F.col("term").isNotNull()).groupBy("report_id").agg(
        F.collect_list(F.struct("term", F.col("tf").cast("double").alias("tf"))).alias("_t")
    )
    joined = rows.join(unsent(listed.select("report_id", F.col("_t.term").alias("terms"), F.col("_t.tf").alias("tfs"))), "report_id")
    columns = ["file", "report_time", "report_id", "weight"]
    dealt = joined.select(*columns, "terms", "tfs").repartition("file").sortWithinPartitions(*columns)
    schema = T.StructType([dealt.schema[c] for c in ("report_id", "file", "weight")] + [T.StructField(c, T.DoubleType()) for c in PAST])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, carried = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            table = table.combine_chunks()
            last = int(np.flatnonzero(_changes(table, columns[:2]))[-1])
            if last:
                done, carried = _past_sums(table.slice(0, last), carried, table["file"][last], arrow)
                yield done
            held = table.slice(last)
        if held is not None and held.num_rows:
            yield _past_sums(held.combine_chunks(), carried, None, arrow)[0]

    return dealt.mapInArrow(run, schema)


def _changes(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Where a row differs from the one before in any of the columns."""
    out = np.zeros(table.num_rows, bool)
    out[:1] = True
    for name in columns:
        values = table[name].combine_chunks().dictionary_encode().indices.to_numpy()
        out[1:] |= values[1:] != values[:-1]
    return out


def _runs(flags: np.ndarray) -> np.ndarray:
    """For every place the start of its run, flags marking the starts."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), 0))


def _past_sums(table: pa.Table, carried, following, arrow: pa.Schema):
    """Sums of PAST of the rows, and the sums per term of the last file if `following` is the same file.

    `carried` has (file, terms, sums) of what came before the first file's rows.
    """
    table = table.combine_chunks()
    by_file = _changes(table, ["file"])
    by_slot = by_file | _changes(table, ["report_time"])
    by_group = by_slot | _changes(table, ["report_id", "weight"])
    file, slot, group = (np.cumsum(flags) - 1 for flags in (by_file, by_slot, by_group))
    weight = table["weight"].to_numpy().astype(float)
    ends, terms = flat(table["terms"].combine_chunks())
    tf = np.asarray(flat(table["tfs"].combine_chunks())[1], float)
    row = np.repeat(np.arange(table.num_rows), np.diff(ends))
    old_terms, old_sums = (carried[1], carried[2]) if carried and carried[0] == table["file"][0] else (terms.slice(0, 0), np.zeros(0))
    old = len(old_sums)

    # Entries by (file, term), in order of time; what was carried is before all of the first file.
    named = pa.concat_arrays([old_terms, terms]).dictionary_encode()
    code = named.indices.to_numpy()
    in_file = np.concatenate([np.zeros(old, np.int64), file[row]])
    in_slot = np.concatenate([np.full(old, -1), slot[row]])
    x = np.concatenate([old_sums, tf * weight[row]])
    key = in_file * max(1, len(named.dictionary)) + code
    order = np.argsort(key, kind="stable")
    key, at = key[order], in_slot[order]
    new_key = np.diff(key, prepend=-1) != 0
    new_slot = new_key | (np.diff(at, prepend=-2) != 0)
    total = np.concatenate([[0.0], np.cumsum(x[order])])
    before = total[_runs(new_slot)] - total[_runs(new_key)]
    s = np.empty(len(x))
    s[order] = before
    s = s[old:]

    # Squared length of the sums before every moment.
    starts = np.flatnonzero(new_slot)
    added = total[np.append(starts[1:], len(x))] - total[starts] if len(starts) else np.zeros(0)
    grown = np.cumsum(np.bincount(at[starts] + 1, added * (2 * before[starts] + added), slot[-1] + 2))
    firsts = np.flatnonzero(by_file)
    base = np.concatenate([[0.0], grown[slot[firsts[1:]]]])
    length = grown[slot] - base[file]

    heads, groups = np.flatnonzero(by_group), group[-1] + 1
    add = lambda values: np.bincount(group[row], values, groups)
    known = s > 0
    sums = [add(tf * s), add(np.where(known, tf * tf, 0.0)), add(tf * tf), add(np.where(known, s * s, 0.0)), length[heads]]
    columns = [table[c].combine_chunks().take(pa.array(heads)) for c in ("report_id", "file", "weight")] + [pa.array(v) for v in sums]
    done = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)
    kept = None
    if following is not None and following == table["file"][-1]:
        mine = in_file == file[-1]
        per_term = np.bincount(code[mine], x[mine], len(named.dictionary))
        found = np.flatnonzero(per_term)
        kept = (following, named.dictionary.take(pa.array(found)), per_term[found])
    return done, kept
