"""Byte-level BPE encoding and decoding (operator 10)."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultsift.llm.common import by_document

#: Characters handed to the tokenizer at once, about.
WINDOW = 1 << 16
_CODERS: dict[tuple[str, str], "ByteCoder"] = {}


class ByteCoder:
    """Encodes and decodes with the ranks of a local file, without special tokens."""

    #: A letter or digit before a space or line break: the pattern never matches across, it only
    #: takes white space at the start of a match or alone.
    BOUNDARY = re.compile(r"(?<=[0-9A-Za-z.,;:!?])(?=[ \n])")

    def __init__(self, ranks_path: str, pattern: str) -> None:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def windows(self, text: str, size: int = WINDOW) -> Iterator[str]:
        """Consecutive parts of a text, cut at safe boundaries only."""
        start = 0
        while len(text) - start > size:
            cut = self.BOUNDARY.search(text, start + size)
            if cut is None:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def encode(self, text: str) -> list[int]:
        if len(text) <= WINDOW:
            return self.encoding.encode_ordinary(text)
        return [i for part in self.windows(text) for i in self.encoding.encode_ordinary(part)]

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def coder(ranks_path: str, pattern: str) -> ByteCoder:
    """The coder of this process for a rank file."""
    if (ranks_path, pattern) not in _CODERS:
        _CODERS[ranks_path, pattern] = ByteCoder(ranks_path, pattern)
    return _CODERS[ranks_path, pattern]


def encoded(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with the ids of every whole text, an array of int. Null counts as empty.

    A column named `ids` that is there already is replaced, others are kept.
    """

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        own = coder(ranks_path, pattern)
        return pd.Series([own.encode("" if t is None else t) for t in texts])

    return docs.withColumn(ids, encode(F.col(text).cast("string")))


def decoded(docs: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`docs` with the raw bytes that the ids stand for. Null counts as no ids."""

    @F.pandas_udf("binary")
    def decode(lists: pd.Series) -> pd.Series:
        own = coder(ranks_path, pattern)
        return pd.Series([b"" if x is None else own.decode([int(i) for i in x]) for x in lists])

    return docs.withColumn(text, decode(ids))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: the key, number of ids, digest of the ids and digest of the decoded bytes.

    Every text is encoded and its ids decoded in one pass; only digests leave the task. Null texts
    count as empty, null keys and repeated rows are kept.
    """

    def work(texts: list[str]) -> list[tuple]:
        own, rows = coder(ranks_path, pattern), []
        for t in texts:
            ids = own.encode(t)
            listed = ",".join(map(str, ids)).encode()
            rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
        return rows

    return by_document(docs, work, "n_tokens long, ids_sha256 string, decoded_sha256 string", text, key)
