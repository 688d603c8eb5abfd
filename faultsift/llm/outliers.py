"""Quality rules and robust multivariate outliers (operator 8)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultsift.llm.common import bounded, by_document
from faultsift.session import stage, unstage

#: Share of a group that the estimates rest on.
COVERAGE = 0.75
#: Squared distance over which a document goes: a normal vector of five numbers is beyond it once
#: in a million.
CUTOFF = 35.9
#: Distinct vectors a group needs for estimates of its own.
LEAST = 50
#: Concentration steps.
STEPS = 4
#: Standard deviations, in transformed units, that stand in for smaller ones: of the log of words, log
#: of word length, signs a word, repeated lines a word, share of repeated words. Most texts repeat
#: nothing and hold no signs; without them every text that does would be an outlier. Each is small enough
#: that its number alone can reject within what the base rules leave.
FLOORS = (0.5, 0.06, 0.05, 0.01, 0.07)
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"


def _repeated(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], "uint64")
    n = np.uint64(len(number))
    if len(number) < 1 << 21:
        windows = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:
        pairs = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)[1].astype("uint64")
        windows = pairs * n + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(len(windows), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : k + len(windows)] |= twice
    return int(inside.sum())


def _counts(texts: list[str]) -> list[tuple]:
    rows = []
    for text in texts:
        words = text.encode().split()  # bytes split at the six ASCII blanks alone
        lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
        rows.append(
            (
                len(words),
                len(text) - sum(map(text.count, _BLANKS)),
                sum(map(text.count, SYMBOLS)),
                len(lines) - len(set(lines)),
                _repeated(words),
            )
        )
    return rows


def statistics(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys, counts of words, characters, signs and repeats of every whole text, and base_failed."""
    counted = by_document(docs, _counts, BASE, text, *keys)
    return counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def transformed() -> Column:
    """The statistic vector of a document with words."""
    n = F.col("n_words").cast("double")
    return F.array(
        F.log(n),
        F.log(F.col("word_chars") / n),
        F.col("n_symbols") / n,
        F.col("n_dup_lines") / n,
        F.col("n_repeat_words") / n,
    )


def _square(x: Column, model: Column) -> Column:
    """Squared Mahalanobis distance of the vector x: (x - m)' P (x - m), P row by row."""
    p = len(FLOORS)
    d = [x[i] - model["mean"][i] for i in range(p)]
    return sum((d[i] * d[j] * model["inverse"][i * p + j] for i in range(p) for j in range(p)), F.lit(0.0))


def _groups(column: str) -> Column:
    """A null language or source counts as the empty one."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def _estimate(rows: DataFrame, factor: float) -> DataFrame:
    """By group and start: mean, inverse and log determinant of `factor` times the covariance.

    All sums are partial aggregates. A variance below the square of its floor is raised to it, so that a
    number that hardly varies has an inverse and a meaningless difference in it no weight; others stay.
    """
    x, p = F.col("x"), len(FLOORS)
    sums = [F.avg(x[i]).alias(f"m{i}") for i in range(p)]
    sums += [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]
    found = rows.groupBy(*GROUP).agg(*sums)
    mean = F.array(*[f"m{i}" for i in range(p)])
    cover = F.array(*[f"c{min(i, j)}_{max(i, j)}" for i in range(p) for j in range(p)])
    return _inverted(found.select(*GROUP, mean.alias("mean"), F.transform(cover, lambda c: c * factor).alias("cover")))


def _inverted(found: DataFrame) -> DataFrame:
    p = len(FLOORS)

    @F.pandas_udf("struct<inverse array<double>, logdet double>")
    def inverse(matrices: pd.Series) -> pd.DataFrame:
        out = []
        for m in matrices:
            whole = np.array(m, float).reshape(p, p)
            least = np.square(FLOORS)  # a millionth of it is added anyway, for numbers that follow from others
            whole += np.diag(np.maximum(0, least - whole.diagonal()) + 1e-6 * least)
            out.append((np.linalg.inv(whole).ravel().tolist(), float(np.linalg.slogdet(whole)[1])))
        return pd.DataFrame(out, columns=["inverse", "logdet"])

    inverted = found.select(*GROUP, "mean", inverse("cover").alias("f"))
    return inverted.select(*GROUP, F.struct("mean", "f.inverse", "f.logdet").alias("model"))


def _robust_start(rows: DataFrame) -> DataFrame:
    """By group: medians, and variances that follow from the quartiles."""
    x, p = F.col("x"), len(FLOORS)
    quartiles = [F.percentile_approx(x[i], [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(p)]
    found = rows.groupBy(*GROUP).agg(*quartiles)
    spread = [((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349) ** 2 for i in range(p)]
    cover = F.array(*[spread[i] if i == j else F.lit(0.0) for i in range(p) for j in range(p)])
    return _inverted(found.select(*GROUP, F.array(*[F.col(f"q{i}")[1] for i in range(p)]).alias("mean"), cover.alias("cover")))


#: level 0: language and source; level 1: language.
GROUP = ["level", "g_lang", "g_source", "start"]


def models(stats: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(level, g_lang, g_source, model) by minimum covariance determinant.

    Rests on the documents that pass the base rules. Equal vectors of a group count once, so a
    large group of copies does not move its estimates. From two starts (medians and quartiles;
    plain mean and covariance) concentration steps keep the COVERAGE of a group nearest to the
    last estimate and estimate again from it; the smaller determinant wins. A last step takes all
    rows within the 97.5 % distance. Every step is grouped aggregates over the whole vectors:
    a quantile sketch for the bound, sums for the estimate; no group is gathered in a task.
    """
    vectors = (
        stats.where(~F.col("base_failed"))
        .select(_groups(lang).alias("g_lang"), _groups(source).alias("g_source"), transformed().alias("x"))
        .distinct()
    )
    levels = [vectors.select(F.lit(0).alias("level"), "g_lang", "g_source", "x")]
    levels.append(vectors.select(F.lit(1).alias("level"), "g_lang", F.lit("").alias("g_source"), "x").distinct())
    leveled = stage(levels[0].unionByName(levels[1]), "vectors")
    sizes = leveled.groupBy(*GROUP[:3]).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).drop("n")
    rows = stage(leveled.join(bounded(stage(sizes, "groups")), GROUP[:3]).crossJoin(_starts(stats)), "vectors")
    unstage(leveled)
    plain = _estimate(rows.where("start = 1"), 1.0)
    now = stage(_robust_start(rows.where("start = 0")).unionByName(plain), "models")
    for _ in range(STEPS):
        near = _near(rows, now, COVERAGE)
        after = stage(_estimate(near, 1.412), "models")  # 0.75 / P(chi2_7 <= chi2_5 quantile of 0.75)
        unstage(now)
        now = after
    best = now.groupBy(*GROUP[:3]).agg(F.min_by(F.struct("start", "model"), F.struct("model.logdet", "start")).alias("b"))
    chosen = stage(best.select(*GROUP[:3], "b.start", "b.model"), "models")
    measured = rows.join(bounded(chosen), GROUP).withColumn("d", _square(F.col("x"), F.col("model")))
    final = stage(_estimate(measured.where(F.col("d") <= 12.83), 1.055).drop("start"), "models")
    for used in (rows, now, chosen):
        unstage(used)
    return final


def _starts(like: DataFrame) -> DataFrame:
    """The two starts; each row is taken once for each."""
    return F.broadcast(like.sparkSession.range(2).select(F.col("id").cast("int").alias("start")))


def _near(rows: DataFrame, now: DataFrame, share: float) -> DataFrame:
    """The `share` of every group's rows nearest to its estimate."""
    measured = rows.join(bounded(now), GROUP).withColumn("d", _square(F.col("x"), F.col("model"))).drop("model")
    bound = measured.groupBy(*GROUP).agg(F.percentile_approx("d", share, 10_000).alias("bound"))
    bound = stage(bound, "bounds")
    return measured.join(bounded(bound), GROUP).where(F.col("d") <= F.col("bound"))


def judged(stats: DataFrame, found: DataFrame, lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """`stats` with distance (null without a model) and kept.

    A document goes by the model of its language and source, by that of its language where the
    source has fewer than LEAST distinct vectors, and stays where the language has fewer too.
    """
    by_source = found.where("level = 0").select(F.col("g_lang").alias("_l"), F.col("g_source").alias("_s"), F.col("model").alias("_m0"))
    by_lang = found.where("level = 1").select(F.col("g_lang").alias("_l"), F.col("model").alias("_m1"))
    keyed = stats.withColumns({"_l": _groups(lang), "_s": _groups(source)})
    keyed = keyed.join(bounded(by_source), ["_l", "_s"], "left").join(bounded(by_lang), "_l", "left")
    distance = F.when(F.col("n_words") > 0, _square(transformed(), F.coalesce("_m0", "_m1")))
    keyed = keyed.withColumn("distance", distance)
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("distance") > cutoff, F.lit(False))
    return keyed.withColumn("kept", kept).drop("_l", "_s", "_m0", "_m1")


def judged_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per document: the key, counts, base_failed, distance and kept.

    A null or empty text has no words and fails the base rules. Repeated rows get equal rows.
    """
    columns = {"_doc": key, "_text": text, "_lang": lang, "_source": source}
    plain = docs.select(*[F.col(f"`{c}`").alias(a) for a, c in columns.items()])
    stats = stage(statistics(plain, "_text", ("_doc", "_lang", "_source")), "statistics")
    found = models(stats, "_lang", "_source")
    return judged(stats, found, "_lang", "_source").drop("_lang", "_source").withColumnRenamed("_doc", key)


def kept_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that the rules keep, with their columns.

    The counts are taken twice, once for the estimates and once with the verdict, so that no text
    is shuffled or stored between.
    """
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    keys = (names[lang], names[source])
    stats = stage(statistics(plain, names[text], keys), "statistics")
    found = models(stats, *keys)
    unstage(stats)
    whole = judged(statistics(plain, names[text], tuple(names.values())), found, *keys)
    return whole.where("kept").select(*[F.col(n).alias(c) for c, n in names.items()])
