"""Data set jobs: combine projects, process texts, re-split by setting, prepare ranking samples."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultsift.functions import text
from faultsift.functions.stemming import with_stems
from faultsift.operators import interactions, sampling, tables
from faultsift.operators.skew import unsent
from faultsift.session import stage
from faultsift.sources import writers

REPORT_KEYS = ["bug_id", "commit", "project_name"]


def combined_reports(projects: Mapping[str, DataFrame]) -> DataFrame:
    """Reports of all projects with `report` = summary + description, missing parts empty."""
    merged = tables.union_projects({name: df.drop("project_name") for name, df in projects.items()})
    return merged.withColumn("report", text.report_text(F.col("summary"), F.col("description")))


def processed_reports(reports: DataFrame, stop_words: Iterable[str] | None = None, column: str = "report") -> DataFrame:
    """Add `report_processed`: words of the report."""
    return reports.withColumn("report_processed", text.preprocessed(F.col(column), "text", stop_words))


def processed_sources(sources: DataFrame, stop_words: Iterable[str] | None = None) -> DataFrame:
    """Add `file_content_processed` (words of the code and of its declared names) and `size`."""
    content = F.col("file_content")
    names = F.array_join(text.declared_names(content), " ")
    words = text.preprocessed(F.concat_ws(" ", text.code_text(content), names), "code", stop_words)
    done = sources.withColumn("file_content_processed", words)
    return done.withColumn("size", text.token_count(F.col("file_content_processed")))


def processed_candidates(
    reports: DataFrame, features: DataFrame, contents: DataFrame, stop_words: Iterable[str] | None = None
) -> DataFrame:
    """Candidates with contents and reports joined and both texts processed.

    Texts are processed before the joins, once per report and file.
    """
    ready = processed_reports(
        reports.withColumn("report", text.report_text(F.col("summary"), F.col("description"), null_safe=False)),
        stop_words,
    )
    sources = processed_sources(contents, stop_words)
    return tables.with_reports(tables.with_content(features, sources), ready)


def term_table(docs: DataFrame, keys: list[str], tokens: Column, mode: str, stop_words: Iterable[str] | None = None) -> DataFrame:
    """Rows (keys, term, tf) of stemmed, filtered words.

    For corpora that are only counted: frequent words are stemmed once, not per occurrence.
    """
    words = text.exploded(docs, keys, F.transform(tokens, F.lower))
    counted = words.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))
    dropped = list(text.dropped_stems(mode, stop_words))
    stems = with_stems(
        counted, "token", F.col("n"), keep=lambda s: ~s.isin(dropped) & (F.length(s) >= 2)
    )
    return stems.groupBy(*keys, F.col("token").alias("term")).agg(F.sum("n").alias("tf"))


def split_reports(reports: DataFrame, membership: DataFrame) -> DataFrame:
    """Processed reports of every (data_setting, split) from a membership table.

    `membership` has bug_id, commit, project_name, data_setting and split.
    """
    members = membership.select(*REPORT_KEYS, "data_setting", "split").distinct()
    return reports.join(members, REPORT_KEYS)


def aligned_sources(processed: DataFrame, unprocessed: DataFrame) -> DataFrame:
    """Processed and raw contents side by side on (cid, file_content)."""
    order = [F.col(c) for c in processed.columns if c not in ("cid", "file_content")]
    return tables.align(processed, unprocessed, ["cid", "file_content"], order)


def split_sources(features: DataFrame, sources: DataFrame, dropped: Iterable[str] = ()) -> DataFrame:
    """Candidate rows of every (data_setting, split) with the processed content of their file."""
    return tables.with_content(features.drop(*dropped), sources)


def write_settings(reports: DataFrame, sources: DataFrame, path: str) -> None:
    """Both tables in folders data_setting / project_name / split."""
    writers.data_set(reports, f"{path}/reports")
    writers.data_set(sources, f"{path}/sources")


def small_training_set(
    reports: DataFrame, features: DataFrame, contents: DataFrame, order: list[Column], bucket: Column,
    test_share: float = 0.4, negatives: int = 10,
) -> DataFrame:
    """Training rows of an ordered split: all matches and the first ten non-matches per bug.

    Rows are joined, split and ranked without texts; texts are joined to what is picked.
    """
    told = reports.withColumn("report", text.report_text(F.col("summary"), F.col("description"), null_safe=False))
    by_report = ["id", "project_name"] if "project_name" in reports.columns and "project_name" in features.columns else ["id"]
    told = stage(_numbered_copies(told.drop("summary", "description"), by_report, "_report"), "reports")
    files = _numbered_copies(contents, ["project_name", "cid"], "_content")
    full = stage(tables.with_reports(tables.with_content(features, files.drop("file_content")), told.drop("report")), "candidates")
    sides = sampling.ordered_split(full.where(F.col("match") == 1), order, bucket, test_share)
    train = tables.keep(full, sides.where(F.col("split") == "train"), ["bug_id"])
    picked = sampling.positives_and_negatives(train, "bug_id", order, negatives)
    keys = [*["report_id" if c == "id" else c for c in by_report], "_report"]
    of_report = told.withColumnRenamed("id", "report_id").select(*keys, "report")
    rows = picked.select("report_id", "project_name", "cid", "match", "_report", "_content").join(unsent(of_report), keys)
    whole = tables.with_content(rows, files.select("project_name", "cid", "_content", "file_content"), ["project_name", "cid", "_content"])
    return whole.select(F.col("report_id").alias("id"), "cid", "report", "file_content", "match")


def _numbered_copies(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add a number that tells rows of equal keys apart; equal rows may change places."""
    rest = [c for c in rows.columns if c not in keys]
    marked = rows.withColumn("_mark", F.xxhash64(*rest))
    return marked.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("_mark"))).drop("_mark")


def prepared_corpus(
    candidates: DataFrame, query_max: int, code_max: int, report: str = "report_processed", code: str = "file_content_processed"
) -> DataFrame:
    """Complete rows with token lists cut to the ranker's input size, and their lengths."""
    split = candidates.na.drop("any")
    for column in (report, code):
        if dict(split.dtypes)[column] == "string":
            split = split.withColumn(column, text.split_tokens(F.col(column)))
    cut = interactions.truncated(split, report, code, query_max, code_max)
    return cut.withColumns({f"{c}_len": text.token_count(F.col(c)) for c in (report, code)})


def ranking_samples(
    candidates: DataFrame, query_max: int, code_max: int, negatives: int, seed: str = "0",
    report: str = "report_processed", code: str = "file_content_processed",
) -> DataFrame:
    """One match and n non-matches per bug among the rows that fit the ranker."""
    fitting = interactions.fitting(candidates, report, code, query_max, code_max)
    return sampling.ranking_samples(fitting, "bug_id", "cid", negatives, seed)


def left_out_samples(candidates: DataFrame, query_max: int, code_max: int, negatives: int, report: str, code: str) -> DataFrame:
    """Rows (layout, unit, reason, n) of what has no sample: candidates without texts or with too long ones, bugs."""
    reason = F.when(F.col(report).isNull() | F.col(code).isNull(), "no text").when(
        (interactions.length(candidates, report) > query_max) | (interactions.length(candidates, code) > code_max), "too many words"
    )
    rows = candidates.select(*writers.LAYOUT, F.lit("candidate").alias("unit"), reason.alias("reason"))
    rows = rows.where(F.col("reason").isNotNull()).groupBy(*writers.LAYOUT, "unit", "reason").agg(F.count(F.lit(1)).alias("n"))
    fitting = interactions.fitting(candidates, report, code, query_max, code_max)
    bugs = sampling.skipped_bugs(fitting, "bug_id", negatives, tuple(writers.LAYOUT))
    return rows.unionByName(bugs.withColumn("unit", F.lit("bug")))


def sized_candidates(candidates: DataFrame, texts: Mapping[str, DataFrame]) -> DataFrame:
    """Candidates with the length of each text in place of its token list, stored, the rows of a bug together.

    `texts` maps the name of a token list to its table (key, list); `candidates` has the keys. A digest tells
    texts of the same key apart. Lists are many times as long as a candidate, so they are joined to what is
    drawn only; with the rows of a bug in one place, draws and counts are nearly done before they are shuffled.
    """
    joined = candidates
    for column, listed in texts.items():
        joined = joined.join(_digested(listed, column).withColumn(column, F.size(column)), _text_key(listed, column))
    return stage(joined.repartition("bug_id"), "candidates")


def _text_key(listed: DataFrame, column: str) -> str:
    return next(c for c in listed.columns if c != column)


def _digested(listed: DataFrame, column: str) -> DataFrame:
    return listed.withColumn(f"_{column}", F.xxhash64(column, F.size(column)))


def _with_lists(drawn: DataFrame, texts: Mapping[str, DataFrame], longest: Mapping[str, int]) -> DataFrame:
    """Token lists in place of the lengths that `sized_candidates` gave; none is longer than `longest`."""
    for column, listed in texts.items():
        keys = [_text_key(listed, column), f"_{column}"]
        short = listed.where(F.size(column) <= longest[column])
        drawn = drawn.drop(column).join(_digested(short, column).dropDuplicates(keys), keys).drop(*keys)
    return drawn


def add_sample_folders(
    candidates: DataFrame, path: str, query_max: int, code_max: int, negatives: int, seed: str = "0",
    report: str = "report_processed", code: str = "file_content_processed", texts: Mapping[str, DataFrame] | None = None,
) -> None:
    """Write the ranking samples of every (data_setting, project_name, split) that `path` does not have yet.

    `candidates` has these columns, bug_id, cid, match and two token lists. Per bug of a folder one match
    and `negatives` random non-matches among the rows that fit the ranker go to path/samples; what is left
    out is counted by reason in path/rejects, written before. Folders of samples that exist are not
    read, drawn anew or changed; a folder without samples is worked on again, with the same rejects.
    Where `texts` has the lists, `candidates` are made of `sized_candidates`.
    """
    new = writers.without_folders(candidates, f"{path}/samples")
    writers.folders(left_out_samples(new, query_max, code_max, negatives, report, code), f"{path}/rejects")
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*writers.LAYOUT, "bug_id")])
    fitting = interactions.fitting(new, report, code, query_max, code_max).withColumn("_sample", key)
    drawn = sampling.ranking_samples(fitting, "_sample", "cid", negatives, seed)
    whole = _with_lists(drawn, texts or {}, {report: query_max, code: code_max})
    writers.folders(whole.drop("_sample"), f"{path}/samples")
