"""Negative sampling, splits, folds and balancing. Every draw is a hash of keys, so it repeats."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultsift.operators.running import hash_block, numbered, running
from faultsift.operators.skew import unsent
from faultsift.operators.tables import keep
from faultsift.session import stage

HASH_DIGITS = 13
#: Places of the circle that are held together where draws become files.
DRAW_BLOCK = 512


def shuffle_key(seed: str, *keys: Column) -> Column:
    """Digest that orders rows at random, the same way every time."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]))


def shuffled(df: DataFrame, seed: str, keys: list[str]) -> DataFrame:
    """All rows in random order."""
    return df.orderBy(shuffle_key(seed, *[F.col(k) for k in keys]), *keys)


def hash_number(digest: Column) -> Column:
    """A non-negative number from the first digits of a digest."""
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("bigint")


def circle(files: DataFrame, seed: str = "0") -> DataFrame:
    """(place, file): the distinct files with a place 0 ... n - 1 in random order."""
    keyed = files.select("file").distinct().withColumn("_h", shuffle_key(seed, F.col("file")))
    placed = numbered(keyed, [], [F.col("_h"), F.col("file")], hash_block(F.col("_h")), "_rn")
    return placed.select((F.col("_rn") - 1).alias("place"), "file")


def drawn_places(positives: DataFrame, placed: DataFrame, n: int, seed: str = "0") -> DataFrame:
    """For every (report_id, file) of `positives`, `places`: n places of the circle `placed` in the order of the draw.

    All files lie on a circle in random order. A positive starts at a random place and takes the
    next n files that its report did not fix (all such files, where there are fewer than n). A
    walk past n plus the number of fixed files is always long enough. Where a report fixed at most 3 n
    files, their places travel with it and the walk is one array; other reports leave out what they
    fixed by an anti join, trying 4 n steps first; only positives still short of n go the whole way.
    No pairing of reports with all files takes place. A positive that draws nothing has no row.
    """
    walked = walks(positives, placed, n, seed)
    usual = _as_often(walked.usual).select("report_id", "file", walked.places.alias("places"))
    return usual.unionByName(walked.listed)


class Walks(NamedTuple):
    """Draws as `drawn_places` makes them, in two parts.

    `usual` has a row per (report_id, file), `_times` how often it comes, `_start` and `_steps`, where its walk
    begins and how far it may go; `places` is a column that makes its places of them and of `_own`. No walk goes
    further than `reach`. `listed` has `places`, for reports that fixed very many files; `has_listed` is
    whether it has rows. `own` has (report_id, file, place) of every positive once.
    """

    usual: DataFrame
    places: Column
    listed: DataFrame
    own: DataFrame
    reach: int
    has_listed: bool


def _as_often(usual: DataFrame) -> DataFrame:
    return usual.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times")))


def walks(positives: DataFrame, placed: DataFrame, n: int, seed: str = "0") -> Walks:
    size, most = placed.count(), 3 * n
    total = F.lit(size)
    start = F.pmod(hash_number(shuffle_key(seed, F.col("report_id"), F.col("file"))), total)
    # Made once: a row per report, or several where a report fixed more than `most` files.
    report = Window.partitionBy("report_id")
    rows = positives.select("report_id", "file").where(F.col("report_id").isNotNull()).join(placed, "file", "left")
    rows = rows.withColumns({"_fixed": F.count(F.lit(1)).over(report), "_rn": F.row_number().over(report.orderBy("file"))})
    piece = F.floor((F.col("_rn") - 1) / max(1, most)).alias("_piece")
    pieces = stage(rows.groupBy("report_id", "_fixed", piece).agg(F.collect_list(F.struct("file", "place")).alias("_all")), "positives")

    few = pieces.where(F.col("_fixed") <= most)
    each = few.select("report_id", "_fixed", "_all", F.explode(F.array_distinct("_all")).alias("_one"))
    times = F.size(F.filter("_all", lambda x: x["file"].eqNullSafe(F.col("_one.file"))))
    usual = each.select("report_id", "_fixed", F.array_compact("_all.place").alias("_places"), F.col("_one.file").alias("file"), times.alias("_times"))
    usual = usual.withColumns({"_start": start, "_steps": F.least(F.col("_fixed") + n, total)})
    usual = usual.where(F.size(F.array_distinct("_places")) < F.col("_steps"))
    # Of what the report fixed only steps on the way matter, mostly none.
    passed = F.filter(F.transform("_places", lambda p: F.pmod(p - F.col("_start"), total)), lambda s: s < F.col("_steps"))
    usual = usual.select("report_id", "file", "_times", "_start", "_steps", passed.alias("_own"))
    steps = F.sequence(F.lit(0).cast("bigint"), F.col("_steps") - 1)
    free = F.slice(F.array_except(steps, F.col("_own")), 1, n)
    places = F.transform(free, lambda s: (F.col("_start") + s) % total)

    many = pieces.where(F.col("_fixed") > most).select("report_id", "_fixed", F.inline("_all")).withColumn("_start", start)
    taken = many.where(F.col("place").isNotNull()).select("report_id", F.col("place").alias("_place")).distinct()

    def walk(rows: DataFrame, length: Column) -> DataFrame:
        step = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(length, total) - 1)).alias("_step")
        opened = rows.select("report_id", "file", "_start", step).withColumn("_place", (F.col("_start") + F.col("_step")) % total)
        kept = opened.join(taken, ["report_id", "_place"], "left_anti")
        order = Window.partitionBy("report_id", "file").orderBy("_step")
        drawn = kept.withColumn("_draw", F.row_number().over(order)).where(F.col("_draw") <= n)
        listed = F.sort_array(F.collect_list(F.struct("_step", "_place")))
        return drawn.groupBy("report_id", "file").agg(listed["_place"].alias("places"))

    tried = walk(many, F.lit(4 * n).cast("bigint"))
    complete = tried.where(F.size("places") == n)
    keys = ["report_id", "file"]
    rest = walk(many.join(complete, keys, "left_anti"), F.col("_fixed") + n)
    longest, some = pieces.agg(F.max(F.when(F.col("_fixed") <= most, F.col("_fixed"))), F.max(F.col("_fixed") > most)).first()
    own = few.select("report_id", F.inline(F.array_distinct("_all")))
    if some:
        own = own.unionByName(many.select(*own.columns).distinct())
    return Walks(usual, places, complete.unionByName(rest), own, min(size, (longest or 0) + n), bool(some))


def sampled_wrong_files(positives: DataFrame, files: DataFrame, n: int, seed: str = "0") -> DataFrame:
    """For every (report_id, file) of `positives`, n random files the report did not fix, as `drawn_places` draws them.

    Adds `candidate` and `draw` (1 ... n).
    """
    placed = stage(circle(files, seed), "circle")
    walked = walks(positives, placed, n, seed)
    total, block = F.lit(placed.count()), F.floor(F.col("place") / DRAW_BLOCK)
    held = placed.groupBy(block.alias("_block")).agg(F.sort_array(F.collect_list(F.struct("place", "file")))["file"].alias("_files"))
    # A positive goes to the blocks that its walk may touch and walks there, so no draw is shuffled.
    last = F.col("_start") + F.col("_steps") - 1
    blocks_of = lambda low, high: F.sequence(F.floor(low / DRAW_BLOCK), F.floor(high / DRAW_BLOCK))
    again = F.when(last >= total, blocks_of(F.lit(0).cast("bigint"), last - total)).otherwise(F.array().cast("array<bigint>"))
    met = F.array_distinct(F.concat(blocks_of(F.col("_start"), F.least(last, total - 1)), again))
    going = _as_often(walked.usual).select("report_id", "file", "_own", "_start", "_steps", F.explode(met).alias("_block"))
    known = walked.listed.withColumn("_block", F.explode(F.array_distinct(F.transform("places", lambda p: F.floor(p / DRAW_BLOCK)))))

    def opened(rows: DataFrame, places: Column) -> DataFrame:
        drawn = rows.join(unsent(held), "_block").select("report_id", "file", "_block", "_files", F.posexplode(places).alias("_at", "place"))
        candidate = F.get("_files", (F.col("place") % DRAW_BLOCK).cast("int")).alias("candidate")
        return drawn.where(block == F.col("_block")).select("report_id", "file", candidate, (F.col("_at") + 1).alias("draw"))

    return opened(going, walked.places).unionByName(opened(known, F.col("places")))


def hardest(scored: DataFrame, k: int, score: str = "rVSM_similarity") -> DataFrame:
    """The k candidates per (report_id, file) most similar to the report."""
    order = Window.partitionBy("report_id", "file").orderBy(F.desc(score), F.asc("candidate"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def positives_and_negatives(
    candidates: DataFrame, bug: str, order: Sequence[Column], negatives: int
) -> DataFrame:
    """All matches and the first `negatives` non-matches per bug in the given order."""
    rank = F.row_number().over(Window.partitionBy(bug).orderBy(*order))
    wrong = candidates.where(F.col("match") == 0).withColumn("_rn", rank).where(F.col("_rn") <= negatives)
    return candidates.where(F.col("match") == 1).unionByName(wrong.drop("_rn"))


def ranking_samples(
    candidates: DataFrame, bug: str, candidate: str, negatives: int, seed: str = "0"
) -> DataFrame:
    """Per bug the first match and `negatives` random non-matches.

    Bugs without a match or with fewer non-matches are left out; `skipped_bugs` counts them.
    """
    hashed = candidates.withColumn("_h", shuffle_key(seed, F.col(bug), F.col(candidate)))
    counts = _bug_counts(candidates, bug)
    complete = counts.where((F.col("_pos") > 0) & (F.col("_neg") >= negatives)).select(bug)
    rank = F.row_number().over(Window.partitionBy(bug).orderBy("_h", candidate))
    wrong = hashed.where(F.col("match") == 0).withColumn("_rn", rank).where(F.col("_rn") <= negatives)
    rest = [c for c in hashed.columns if c != bug]
    right = (
        hashed.where(F.col("match") == 1).groupBy(bug)
        .agg(F.min_by(F.struct(*rest), F.col(candidate)).alias("_row")).select(bug, "_row.*")
    )
    both = right.unionByName(wrong.drop("_rn").select(*right.columns))
    return both.join(complete, bug, "left_semi").select(*candidates.columns)


def _bug_counts(candidates: DataFrame, *bug: str) -> DataFrame:
    return candidates.groupBy(*bug).agg(
        F.sum((F.col("match") == 1).cast("int")).alias("_pos"),
        F.sum((F.col("match") == 0).cast("int")).alias("_neg"),
    )


def skipped_bugs(candidates: DataFrame, bug: str, negatives: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Number of bugs `ranking_samples` leaves out, per reason and value of the columns `by`."""
    reason = F.when(F.col("_pos") == 0, F.lit("no positive")).when(
        F.col("_neg") < negatives, F.lit("too few negatives")
    )
    return (
        _bug_counts(candidates, *by, bug).select(*by, reason.alias("reason")).where(F.col("reason").isNotNull())
        .groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))
    )


def neighbour_negatives(similar: DataFrame, query: str, other: str, top: int, n: int, seed: str = "0") -> DataFrame:
    """From the `top` most similar other queries, n at random; their code serves as negatives."""
    best = Window.partitionBy(query).orderBy(F.desc("similarity"), F.asc(other))
    near = similar.where(F.col(query) != F.col(other)).withColumn("rank", F.row_number().over(best))
    return drawn_neighbours(near.where(F.col("rank") <= top), query, other, n, seed)


def drawn_neighbours(near: DataFrame, query: str, other: str, n: int, seed: str = "0") -> DataFrame:
    """n random rows per query, numbered by `draw`."""
    hashed = near.withColumn("_h", shuffle_key(seed, F.col(query), F.col(other)))
    draw = F.row_number().over(Window.partitionBy(query).orderBy("_h", other))
    return hashed.withColumn("draw", draw).where(F.col("draw") <= n).drop("_h")


def ordered_split(positives: DataFrame, order: list[Column], bucket: Column, test_share: float) -> DataFrame:
    """Add `split`: the last ceil(test_share * n) rows are test, the others train."""
    rows = numbered(positives, [], order, bucket, "_rn", total="_n")
    train = F.col("_n") - F.ceil(F.lit(test_share) * F.col("_n"))
    return rows.withColumn("split", F.when(F.col("_rn") <= train, "train").otherwise("test")).drop("_rn", "_n")


def split_members(candidates: DataFrame, split: DataFrame, bug: str) -> DataFrame:
    """All candidate rows of the bugs of each side; a bug with rows on both sides is in both."""
    sides = [
        keep(candidates, split.where(F.col("split") == side), [bug]).withColumn("split", F.lit(side))
        for side in ("train", "test")
    ]
    return sides[0].unionByName(sides[1])


def folds(rows: DataFrame, order: list[Column], bucket: Column, k: int) -> DataFrame:
    """Add `fold` 0 ... : contiguous blocks of ceil(n / k) rows."""
    placed = numbered(rows, [], order, bucket, "_rn", total="_n")
    step = F.ceil(F.col("_n") / k)
    return placed.withColumn("fold", F.floor((F.col("_rn") - 1) / step).cast("int")).drop("_rn", "_n")


def report_folds(samples: DataFrame, report: str, order: Column, bucket: Column, k: int) -> DataFrame:
    """Add `fold`, all samples of a report in one fold, so that no report is on both sides."""
    reports = samples.select(report).distinct()
    by_report = folds(reports, [order], bucket, k)
    return samples.join(by_report, report)


def every_nth(rows: DataFrame, order: list[Column], bucket: Column, n: int = 51) -> DataFrame:
    """Add `flag` for rows 1, n + 1, 2 n + 1 ... of the given order."""
    placed = numbered(rows, [], order, bucket, "_rn")
    return placed.withColumn("flag", F.pmod(F.col("_rn") - 1, F.lit(n)) == 0).drop("_rn")


def oversampled(samples: DataFrame, flag: Column | None = None, times: int = 10) -> DataFrame:
    """Repeat flagged rows (matches, if no flag is given) `times` times."""
    flag = F.col("match") == 1 if flag is None else flag
    copies = F.when(flag, F.lit(times)).otherwise(F.lit(1))
    return samples.select("*", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))


def equal_share_sample(tables: Sequence[DataFrame], keys: list[str], total: int, seed: str = "0") -> DataFrame:
    """total / len(tables) random rows of every table."""
    share = total // len(tables)

    def draw(df: DataFrame) -> DataFrame:
        return df.orderBy(shuffle_key(seed, *[F.col(k) for k in keys]), *keys).limit(share)

    return reduce(DataFrame.unionByName, map(draw, tables))
