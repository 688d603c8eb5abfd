"""Toxicity by classifier chains (operator 1)."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultsift.llm.common import WordCache, by_document
from faultsift.session import stage, unstage

#: Labelled documents that the chain is fitted on at most, about; lowest hash of the key first.
FIT_ROWS = 10_000
FOLDS = 3
FEATURES = 1 << 16
#: Weight of the absolute sizes of the coefficients of words; most words get none. With few rows it
#: is as many rows' share as a word needs to count at all.
PENALTY, LEAST_SUPPORT = 0.0005, 4
ITERATIONS = 150
_WORD = re.compile(r"[^\W\d_]+")


def _buckets(words: list[str]) -> list[int]:
    hashed = pd.util.hash_array(np.array(words, object), categorize=False)
    return (hashed % np.uint64(FEATURES)).astype("int64").tolist()


_CACHE = WordCache(lambda words: _buckets(words) if words else [], 300_000)


def features(texts: list[str]) -> list[np.ndarray]:
    """Which hashed lower-case words each whole text holds."""
    split = [set(_WORD.findall(text.lower())) for text in texts]
    _CACHE.add(set().union(*split))
    return [np.unique(np.fromiter(map(_CACHE.__getitem__, words), "int64", len(words))) for words in split]


@dataclass
class Linear:
    """A logistic model over words and the probabilities of earlier categories."""

    words: np.ndarray
    earlier: np.ndarray
    bias: float

    def probability(self, found: np.ndarray, before: list[float]) -> float:
        z = self.words[found].sum() + float(np.dot(self.earlier, before)) + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))


def train(rows: list[np.ndarray], before: np.ndarray, truth: np.ndarray) -> Linear:
    """Logistic regression with an absolute penalty on the words, by accelerated proximal steps.

    Every coefficient has a step of its own: the curvature bound of a column is a quarter of the
    sum over its rows of what else they hold. One class alone gives its rate as bias.
    """
    n, extra = len(truth), before.shape[1]
    rate = (truth.sum() + 0.5) / (n + 1)
    bias = float(np.log(rate / (1 - rate)))
    width = FEATURES + extra + 1
    w = np.zeros(width)
    w[-1] = bias
    if truth.min(initial=1) == truth.max(initial=0):
        return Linear(w[:FEATURES], w[FEATURES:-1], bias)
    sizes = np.array([len(r) for r in rows])
    held = np.concatenate(rows) if sizes.sum() else np.zeros(0, "int64")
    of = np.repeat(np.arange(n), sizes)
    load = sizes + before.sum(axis=1) + 1
    bound = np.bincount(held, load[of], width)
    bound[FEATURES:-1], bound[-1] = (before * load[:, None]).sum(axis=0), load.sum()
    step = n / (0.25 * bound + 1e-9)
    shrink = max(PENALTY, LEAST_SUPPORT / n) * step
    shrink[FEATURES:] = 0
    ahead, t = w.copy(), 1.0
    for _ in range(ITERATIONS):
        z = np.bincount(of, ahead[held], n) + before @ ahead[FEATURES:-1] + ahead[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - truth) / n
        slope = np.bincount(held, error[of], width)
        slope[FEATURES:-1], slope[-1] = error @ before, error.sum()
        moved = ahead - step * slope
        new = np.sign(moved) * np.maximum(np.abs(moved) - shrink, 0)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / later * (new - w), new, later
    return Linear(w[:FEATURES], w[FEATURES:-1], float(w[-1]))


def _sample(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], text: str, key: str, most: int) -> DataFrame:
    """_k, _fold, held (words) and a 0 or 1 per category of about `most` labelled documents."""
    truths = [condition.cast("int").alias(name) for name, condition in categories.items()]
    known = labels.select(F.col(key).alias("_k"), *truths).na.drop()
    known = known.groupBy("_k").agg(*[F.max(name).alias(name) for name in categories])
    total = known.count()
    limit = (1 << 63) - 1 if total <= most else int(-(1 << 63) + (1 << 64) * (most / total))
    drawn = known.where(F.xxhash64("_k") <= limit)
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(drawn), "_k")
    held = by_document(rows, lambda texts: [(f.tolist(),) for f in features(texts)], "held array<int>", "_t", "_k", *categories)
    return held.withColumn("_fold", F.pmod(F.xxhash64("_k", F.lit("fold")), F.lit(FOLDS).cast("long")).cast("int"))


def _fitter(name: str, earlier: list[str]):
    """Fits the model that a group's number asks for: without that fold, or of all folds."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        model = int(group["model"].iat[0])
        rest, own = group[group["_fold"] != model], group[group["_fold"] == model]
        linear = train([np.asarray(h, "int64") for h in rest["held"]], rest[earlier].to_numpy(float), rest[name].to_numpy(float))
        before = own[earlier].to_numpy(float)
        scores = [linear.probability(np.asarray(h, "int64"), p) for h, p in zip(own["held"], before, strict=True)]
        out = own.drop(columns=["model", "_k"]).assign(q=scores, found=None)
        if model == FOLDS:
            whole = np.concatenate([linear.words, linear.earlier, [linear.bias]]).tobytes()
            out = pd.DataFrame([dict.fromkeys(out.columns) | {"found": whole}], dtype=object)
        return out

    return fit


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], text: str = "text", key: str = "doc_id", most: int = FIT_ROWS) -> list[tuple[str, Linear]]:
    """One linear model per category, in order; each sees the probabilities of those before.

    While fitting, the earlier probabilities are out of fold: every row's come from a model that
    has not seen its fold. `categories` are conditions over `labels`, true for a document of the
    category. Rows whose key or condition is null are not used, of several rows of a key the
    largest values count. About `most` documents are drawn by the hash of their key; they are
    broadcast as keys, so no text is shuffled. The models of a category, one per fold and one of
    all, are fitted in a task each; a model is one vector of FEATURES numbers. Without labelled
    documents there is no model and every probability is NaN.
    """
    sample = stage(_sample(docs, labels, categories, text, key, most), "labelled")
    chain, earlier, names = [], [], list(categories)
    for name in names:
        fit = _fitter(name, list(earlier))
        copies = sample.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))
        kinds = [f"{c} {t}" for c, t in sample.dtypes if c != "_k"]
        fitted = stage(copies.groupBy("model").applyInPandas(fit, ", ".join([*kinds, "q double", "found binary"])), "fitted")
        row = fitted.where("found IS NOT NULL").select("found").first()
        whole = np.frombuffer(row[0], "float64") if row else np.full(FEATURES + len(earlier) + 1, np.nan)
        chain.append((name, Linear(whole[:FEATURES], whole[FEATURES:-1], float(whole[-1]))))
        unstage(sample)
        earlier.append(f"p_{name}")
        sample = fitted.where("found IS NULL").drop("found").withColumnRenamed("q", earlier[-1]).withColumn("_k", F.lit(0))
    return chain


def score_chain(docs: DataFrame, chain: list[tuple[str, Linear]], text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key and p_<category> of every whole text; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # FEATURES numbers per category, whatever the corpus

    def score(texts: list[str]) -> list[tuple]:
        out = []
        for found in features(texts):
            before: list[float] = []
            for _, model in shared.value:
                before.append(model.probability(found, before))
            out.append(tuple(before))
        return out

    return by_document(docs, score, ", ".join(f"p_{name} double" for name, _ in chain), text, key)


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """The key, p_<category> and is_<category> (probability at least `threshold`) of every document.

    Null keys and repeated rows are scored like any other, a null text like an empty one; an empty
    table has no rows. Without labelled documents probabilities are null and verdicts false.
    """
    chain = fit_chain(docs, labels, categories, text, key)
    scored = score_chain(docs, chain, text, key)
    known = scored.withColumns({f"p_{name}": F.when(~F.isnan(f"p_{name}"), F.col(f"p_{name}")) for name in categories})
    return known.withColumns({f"is_{name}": F.coalesce(F.col(f"p_{name}") >= threshold, F.lit(False)) for name in categories})
