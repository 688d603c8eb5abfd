"""Language identification by segmentation-marginalised unigrams (operator 7)."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from faultsift.llm.common import WordCache, by_document
from faultsift.session import stage, unstage

#: Documents of each language that the probabilities are fitted on at most, about; lowest hash first.
FIT_DOCUMENTS = 2_000
#: Rounds of expectation and maximisation.
ROUNDS = 2
#: Added to every expected count.
SMOOTHING = 0.1
UNKNOWN = "und"
#: Start of a word, the sign that the vocabulary uses for it.
SPACE = "▁"
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters (Unicode category L), in composed form."""
    found = _LETTERS.findall(unicodedata.normalize("NFC", text).lower())
    if all(map(str.isalpha, found)):
        return found
    # The pattern takes numbers that are no digits for letters, such as one half or a Roman eight.
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def is_held_out(key: Column) -> Column:
    """Documents that nothing is learned from."""
    return F.crc32(key.cast("string")) % 4 == 2


class Pieces:
    """A fixed public vocabulary; characters outside it are spelled by byte pieces.

    A character that has to be spelled gets an arc of its own, numbered behind the vocabulary.
    """

    def __init__(self, path: str) -> None:
        model = SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.bytes = [0] * 256
        #: Number of a piece; -1 for what only starts one.
        self.table: dict[str, int] = {}
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not model.is_control(i) and not model.is_unknown(i) and SPACE not in piece[1:]:
                self.table[piece] = i
                for end in range(1, len(piece)):
                    self.table.setdefault(piece[:end], -1)

    def arcs(self, words: list[str]) -> "Arcs":
        """All ways to cut the words, each behind the sign of a space, which no piece reaches over."""
        table, get = self.table, self.table.get
        word, start, end, piece = [], [], [], []
        spelled: dict[str, int] = {}
        for w, text in enumerate(words):
            text = SPACE + text
            n = len(text)
            for s in range(n):
                if table.get(text[s], -1) < 0:
                    word.append(w)
                    start.append(s)
                    end.append(s + 1)
                    piece.append(spelled.setdefault(text[s], self.size + len(spelled)))
                for e in range(s + 1, n + 1):
                    i = get(text[s:e])
                    if i is None:
                        break
                    if i >= 0:
                        word.append(w)
                        start.append(s)
                        end.append(e)
                        piece.append(i)
        columns = [np.array(c, "int64") for c in (word, start, end, piece)]
        lengths = np.array([len(w) + 1 for w in words], "int64")
        return Arcs(*columns, lengths, [[self.bytes[b] for b in c.encode()] for c in spelled])


@dataclass
class Arcs:
    """Pieces that cover characters start to end of a word; `spelled` are those of several byte pieces."""

    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    lengths: np.ndarray
    spelled: list[list[int]]

    def weights(self, p: np.ndarray) -> np.ndarray:
        if not self.spelled:
            return p[self.piece]
        return np.concatenate([p, np.array([p[ids].prod(axis=0) for ids in self.spelled])])[self.piece]

    def by(self, position: np.ndarray) -> list[np.ndarray]:
        """Arcs by a position, in order of the words."""
        order = np.lexsort((self.word, position))
        return np.split(order, np.searchsorted(position[order], np.arange(1, self.lengths.max(initial=0) + 1)))


def _summed(words: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by word; the words are in order."""
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    return words[first], np.add.reduceat(values, first, axis=0)


def forward(arcs: Arcs, weights: np.ndarray) -> np.ndarray:
    """Log of the sum over all segmentations of every prefix, by word, position and language.

    All words go from position to position together.
    """
    logs = np.zeros((len(arcs.lengths), arcs.lengths.max(initial=0) + 1, weights.shape[1]))
    for at, chosen in enumerate(arcs.by(arcs.end)):
        if len(chosen):
            w, s = arcs.word[chosen], arcs.start[chosen]
            terms = weights[chosen] * np.exp(logs[w, s] - logs[w, at - 1])
            who, total = _summed(w, terms)
            logs[who, at] = logs[who, at - 1] + np.log(total)
    return logs


def _by_length(words: list[str], most: int = 1 << 18) -> Iterator[np.ndarray]:
    """Indices of words of like length, so that tables of words by positions stay small."""
    lengths = np.array([len(w) + 1 for w in words], "int64")
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        end = start + 1
        limit = 2 * lengths[order[start]] + 8
        while end < len(order) and lengths[order[end]] <= limit and (end - start) * limit < most:
            end += 1
        yield order[start:end]
        start = end


def word_scores(words: list[str], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Log probability of every word by language: the forward sum over all its segmentations."""
    out = np.zeros((len(words), p.shape[1]))
    for chosen in _by_length(words):
        arcs = pieces.arcs([words[i] for i in chosen])
        logs = forward(arcs, arcs.weights(p))
        out[chosen] = logs[np.arange(len(chosen)), arcs.lengths]
    return out


def expected(words: list[str], counts: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in the words of one language, over all segmentations."""
    uses = np.zeros(pieces.size)
    for chosen in _by_length(words):
        arcs = pieces.arcs([words[i] for i in chosen])
        weights = arcs.weights(p[:, None])
        logs = forward(arcs, weights)[:, :, 0]
        # the share of a word's segmentations that pass a position, from the last one back
        passing = np.zeros_like(logs)
        passing[np.arange(len(chosen)), arcs.lengths] = 1.0
        share = np.zeros(len(arcs.word))
        for at, some in reversed(list(enumerate(arcs.by(arcs.end)))):
            if len(some):
                w, s = arcs.word[some], arcs.start[some]
                share[some] = weights[some, 0] * np.exp(logs[w, s] - logs[w, at]) * passing[w, at]
                np.add.at(passing, (w, s), share[some])
        share *= counts[chosen][arcs.word]
        own = np.bincount(arcs.piece, share, pieces.size + len(arcs.spelled))
        uses += own[: pieces.size]
        for ids, use in zip(arcs.spelled, own[pieces.size :], strict=True):
            np.add.at(uses, ids, use)
    return uses


def fit(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", lang: str = "lang", per_language: int = FIT_DOCUMENTS) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (pieces x languages).

    Learned from text and language of documents that are not held out, at most `per_language` of
    each language, lowest hash of key and text first. Their words are counted by language in
    Spark; every round computes expected uses of the pieces where the words lie and sums them.
    What comes back is one row per language, as wide as the vocabulary.
    """
    spark = docs.sparkSession
    usable = docs.where(~F.coalesce(is_held_out(F.col(key)), F.lit(False)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    hashed = usable.select(F.col(lang).cast("string").alias("l"), F.xxhash64(F.col(key), F.col(text)).alias("h"), F.col(text).alias("t"))
    # the share of a language's hash range that holds about the documents wanted
    sizes = hashed.groupBy("l").agg(F.count("*").alias("n")).orderBy("l").collect()
    langs = [r["l"] for r in sizes]
    if not langs:
        return [], np.zeros((0, 0))
    limit = F.lit(None).cast("long")
    for r in sizes:
        most = (1 << 63) - 1 if r["n"] <= per_language else int(-(1 << 63) + (1 << 64) * (per_language / r["n"]))
        limit = F.when(F.col("l") == r["l"], F.lit(most).cast("long")).otherwise(limit)
    pieces = Pieces(vocabulary)
    number = {name: i for i, name in enumerate(langs)}

    def split(texts: list[str]) -> list[tuple]:
        return [(words_of(t),) for t in texts]

    chosen = by_document(hashed.where(F.col("h") <= limit), split, "w array<string>", "t", "l")
    counted = chosen.select("l", F.explode("w").alias("w")).groupBy("l", "w").agg(F.count("*").alias("n"))
    counted = stage(counted, "words")
    p = np.full((pieces.size, len(langs)), 1.0 / pieces.size)
    for _ in range(ROUNDS):
        before = p

        def expectation(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            uses: dict[str, np.ndarray] = {}
            for batch in batches:
                for name, part in batch.groupby("l"):
                    found = expected(part["w"].tolist(), part["n"].to_numpy(), pieces, before[:, number[name]])
                    uses[name] = uses.get(name, 0) + found
            for name, found in uses.items():
                at = np.flatnonzero(found)
                yield pd.DataFrame({"l": name, "piece": at, "uses": found[at]})

        sums = counted.mapInPandas(expectation, "l string, piece int, uses double").groupBy("l", "piece").agg(F.sum("uses").alias("uses"))
        table = sums.toPandas()
        p = np.full(p.shape, SMOOTHING)
        np.add.at(p, (table["piece"].to_numpy(), table["l"].map(number).to_numpy(dtype="int64")), table["uses"].to_numpy())
        p /= p.sum(axis=0)
    unstage(counted)
    return langs, p


def predicted(docs: DataFrame, langs: list[str], p: np.ndarray, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key, lang_pred and score of every whole text.

    The score of a language is the sum of its word scores; `score` is the probability of the best
    among equally likely languages. A null text or one without a letter is UNKNOWN with score 0,
    as is every text where no language was learned. Ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(p)  # vocabulary x languages, whatever the corpus
    token = uuid.uuid4().hex

    def score(texts: list[str]) -> list[tuple]:
        if not langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        own = _cache(token, vocabulary, shared)
        split = [words_of(t) for t in texts]
        own.add({w for words in split for w in words})
        rows = []
        for words in split:
            if not words:
                rows.append((UNKNOWN, 0.0))
                continue
            total = np.frombuffer(b"".join(map(own.__getitem__, words)), "float64").reshape(len(words), -1).sum(axis=0)
            best = int(total.argmax())
            rows.append((langs[best], float(1.0 / np.exp(total - total[best]).sum())))
        return rows

    return by_document(docs, score, "lang_pred string, score double", text, key)


#: The scores this process has computed with the last probabilities.
_CACHE: dict[str, WordCache] = {}


def _cache(token: str, vocabulary: str, shared: Broadcast) -> WordCache:
    if token not in _CACHE:
        pieces, p = Pieces(vocabulary), shared.value

        def compute(words: list[str]) -> list[bytes]:
            return [row.tobytes() for row in word_scores(words, pieces, p)]

        _CACHE.clear()
        _CACHE[token] = WordCache(compute, 300_000)
    return _CACHE[token]


def languages(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The key, held_out, lang_pred and score of every document, learned from those not held out.

    A null key is not held out. Repeated rows get equal rows; an empty table gives an empty one.
    """
    langs, p = fit(docs, vocabulary, text, key, lang)
    found = predicted(docs, langs, p, vocabulary, text, key)
    return found.withColumn("held_out", F.coalesce(is_held_out(F.col(key)), F.lit(False)))
