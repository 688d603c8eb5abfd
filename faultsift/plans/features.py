"""The feature table: five features for every fixed file and for hard negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultsift.functions import text
from faultsift.operators import blocks, history, sampling
from faultsift.operators.skew import unsent
from faultsift.operators.terms import term_frequencies
from faultsift.session import stage
from faultsift.sources.schemas import FEATURE_COLUMNS

#: Columns of the similarities of the whole text and of class names.
SIMILARITIES = ("rVSM_similarity", "classname_similarity")


def known_touches(touched: DataFrame, sources: DataFrame) -> DataFrame:
    """Touches of files that exist in the source table."""
    return touched.join(sources.select("file").distinct(), "file", "left_semi")


def unknown_files(touched: DataFrame, sources: DataFrame) -> DataFrame:
    """How many touches name a file that does not exist."""
    missing = touched.join(sources.select("file").distinct(), "file", "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown file").alias("reason"), "n")


def feature_table(
    reports: DataFrame,
    touched: DataFrame,
    sources: DataFrame,
    tokens=text.normalized_words,
    negatives: int = 50,
    seed: str = "0",
    inherit: bool = True,
) -> DataFrame:
    """Feature rows: `reports` (report_id, raw_text), `touched` (report_id, file, report_time),
    `sources` (file, file_content).

    Every touch of a known file is a match; the `negatives` most similar of twice as many random
    wrong files follow. They take history features from the match (`inherit`), as the published
    data set does, or have those of their own file. `tokens` turns a text column into words.
    """
    report_tf = term_frequencies(reports, ["report_id"], tokens(F.col("raw_text")))
    source_tf = term_frequencies(sources, ["file"], tokens(F.col("file_content")))
    names = text.class_name_text(F.col("file_content"))
    class_tf = term_frequencies(sources, ["file"], tokens(names))

    matches = stage(known_touches(touched, sources), "matches")
    past = with_history(matches, report_tf).select("report_id", "file", *FEATURE_COLUMNS[3:4], *FEATURE_COLUMNS[5:7])
    # Features of the match travel with its draws, so the many rows of wrong files are not joined.
    past = stage(past, "past") if inherit else past
    asked = matches.select("report_id", "file")
    own, negative = _similarities(asked, sources, report_tf, [source_tf, class_tf], negatives, seed, past if inherit else None)
    positive = own.join(past, ["report_id", "file"]).withColumn("match", F.lit(1))
    if not inherit:
        negative = stage(negative)
        negative = negative.join(with_history(touched, report_tf, asked_pairs(negative, touched)), ["report_id", "file"])
    return positive.select(*FEATURE_COLUMNS).unionByName(negative.select(*FEATURE_COLUMNS))


def _similarities(
    matches: DataFrame, sources: DataFrame, report_tf: DataFrame, parts: list[DataFrame], negatives: int, seed: str, past: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """Rows of similarities: of every match, and of the `negatives` hardest of twice as many random wrong files.

    The latter have the columns of `past`, a table by (report_id, file), of their match.
    """
    keys = ["report_id", "file"]
    parts = [stage(part) for part in parts]
    ids = stage(blocks.term_numbers(parts))
    placed = stage(sampling.circle(sources, seed))
    arrays = stage(blocks.report_arrays(report_tf, ids))
    walked = sampling.walks(matches, placed, 2 * negatives, seed)
    heads = stage(blocks.file_blocks(placed, parts, ids, walked.reach), "blocks")
    number = matches.count()

    def asked(rows: DataFrame, place: Column) -> DataFrame:
        return rows.withColumn("block", blocks.block_of(place)).join(unsent(arrays), "report_id", "left")

    own = asked(walked.own.where(F.col("place").isNotNull()).withColumn("places", F.array("place")), F.col("place")).drop("place")
    found = blocks.block_similarities(own, heads, placed, len(parts), asked=number)
    own = found.select(*keys, *[F.col("answers")[0]["sims"][i].alias(name) for i, name in enumerate(SIMILARITIES)])

    known = [] if past is None else past.columns[2:]
    inherited = (lambda rows: rows) if past is None else (lambda rows: rows.join(unsent(past), keys))
    of = ("_start", "_steps", "_own")
    going = asked(inherited(walked.usual), F.col("_start"))
    found = blocks.block_similarities(going, heads, placed, len(parts), walked.places, of, negatives, number)
    # A match that comes n times draws the same files n times.
    often = F.slice(F.flatten(F.transform("answers", lambda a: F.array_repeat(a, F.col("_times")))), 1, negatives)
    found = found.select("report_id", *known, F.inline(F.when(F.col("_times") == 1, F.col("answers")).otherwise(often)))
    if walked.has_listed:
        cut = walked.listed.withColumn("_block", F.explode(F.array_distinct(F.transform("places", blocks.block_of))))
        cut = cut.withColumn("places", F.filter("places", lambda p: blocks.block_of(p) == F.col("_block")))
        pieces = blocks.block_similarities(asked(cut, F.col("_block") * blocks.BLOCK_FILES).drop("_block"), heads, placed, len(parts))
        order = F.transform(
            F.flatten(F.collect_list("answers")),
            lambda a: F.struct(a["sims"][0].isNull().alias("unknown"), (-a["sims"][0]).alias("falling"), a["file"].alias("file"), a["sims"].alias("sims")),
        )
        whole = pieces.groupBy(*keys).agg(F.slice(F.sort_array(order), 1, negatives).alias("answers"))
        answers = F.transform("answers", lambda a: F.struct(a["file"].alias("file"), a["sims"].alias("sims")))
        found = found.unionByName(inherited(whole).select("report_id", *known, F.inline(answers)))
    sims = [F.col("sims")[i].alias(name) for i, name in enumerate(SIMILARITIES)]
    return own, found.select(*keys, *known, *sims, F.lit(0).alias("match"))


def with_history(touched: DataFrame, report_tf: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """bug_recency, bug_frequency and collab_filter per (report_id, file)."""
    keys = ["report_id", "file"]
    similar = history.collaborative_similarity(touched, report_tf, asked).select(*keys, "collab_filter")
    return history.recency_and_frequency(touched, asked).join(similar, keys)


def asked_pairs(drawn: DataFrame, touched: DataFrame) -> DataFrame:
    """The drawn files of a report with the time of the report."""
    times = touched.groupBy("report_id").agg(F.min("report_time").alias("report_time"))
    pairs = drawn.select("report_id", "file").distinct()
    return pairs.join(times, "report_id")
