"""Direct and indirect localisation of every report over its candidate pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultsift.functions import paths
from faultsift.operators import ranking, scoring, tables, terms
from faultsift.session import stage


def weighted(report_tf: DataFrame, source_tf: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """TF-IDF vectors of reports and sources over the vocabulary of the sources, written once."""
    source_tf = stage(source_tf)
    vocabulary = stage(terms.idf_table(source_tf, sources))
    return stage(terms.tfidf(report_tf, vocabulary)), stage(terms.tfidf(source_tf, vocabulary))


def similarities(
    pairs: DataFrame, left_weights: DataFrame, right_weights: DataFrame, left_vectors: DataFrame,
    right_vectors: DataFrame, left_keys: list[str], right_keys: list[str], query: list[str],
) -> DataFrame:
    """TF-IDF and dense cosine of every pair, scaled within the pool of the query and added."""
    lexical = terms.sparse_cosine(pairs, left_weights, right_weights, left_keys, right_keys, "lexical")
    both = scoring.dense_cosine(lexical, left_vectors, right_vectors, left_keys, right_keys, name="dense")
    return scoring.fused(stage(both), query, "lexical", "dense")


def localized(
    candidates: DataFrame,
    fixes: DataFrame,
    report_tf: DataFrame,
    source_tf: DataFrame,
    sources: DataFrame,
    report_vectors: DataFrame,
    source_vectors: DataFrame,
) -> DataFrame:
    """Rows (report_id, key, score): direct scores boosted by length, blended with the indirect.

    `candidates` has (report_id, file), `fixes` (report_id, file), `sources` (file, size). Files
    are known by their stem; files without a dot take no part. The indirect score compares a
    report with the other reports that fixed a file of its pool.
    """
    report_weights, source_weights = weighted(report_tf, source_tf, sources)
    pool = candidates.select("report_id", "file").distinct()
    fused = similarities(
        pool, report_weights, source_weights, report_vectors, source_vectors, ["report_id"], ["file"], ["report_id"]
    )
    lengths = scoring.length_scores(sources)
    scored = scoring.direct_scores(fused, lengths, ["file"]).withColumn("key", paths.file_stem(F.col("file")))
    direct = scored.where(F.col("key").isNotNull()).groupBy("report_id", "key").agg(F.max("score").alias("score"))

    fixed = fixes.select("report_id", paths.file_stem(F.col("file")).alias("key")).where(F.col("key").isNotNull())
    keyed = pool.select("report_id", paths.file_stem(F.col("file")).alias("key")).where(F.col("key").isNotNull())
    linked = stage(scoring.links(keyed, fixed))
    as_other = lambda df: df.withColumnRenamed("report_id", "other_id")
    similar = similarities(
        linked, report_weights, as_other(report_weights), report_vectors, as_other(report_vectors),
        ["report_id"], ["other_id"], ["report_id"],
    )
    # Scores are made for the keys of direct ones, the range of a report for every set of reports that fixed a key.
    sent = linked.count() <= scoring.SENT_PAIRS
    indirect = scoring.indirect_scores(similar, fixed, sent=sent, wanted=keyed)
    whole = scoring.indirect_scores(similar, scoring.distinct_fixes(fixed), sent=sent)
    return scoring.synthesized(direct, indirect, whole)


def ranked(scored: DataFrame, reports: DataFrame) -> DataFrame:
    """Rows (project_name, report_id, key, score, rank) of localised files, best first, ties by key.

    `reports` has (report_id, project_name), once a report. Files without a score rank last.
    """
    numbered = ranking.full_ranking(scored.select("report_id", "key", "score"), ["report_id"], "key")
    joined = numbered.join(reports.select("report_id", "project_name"), "report_id")
    return joined.select("project_name", "report_id", "key", "score", "rank")


def left_out(candidates: DataFrame, fixes: DataFrame) -> DataFrame:
    """Rows (side, reason, n) of the candidates and fixes that take no part, by reason.

    A file is known by its stem: those that are null or have no dot have none.
    """
    no_stem = {"no file": F.col("file").isNull(), "no stem": paths.file_stem(F.col("file")).isNull()}
    counted = [tables.rejects(df, no_stem).withColumn("side", F.lit(side)) for side, df in (("candidate", candidates), ("fix", fixes))]
    return counted[0].unionByName(counted[1]).select("side", "reason", "n")
