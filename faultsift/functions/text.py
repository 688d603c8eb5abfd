"""Text and identifier normalisation as column expressions.

Patterns avoid look-around, so that they mean the same in Java and in RE2.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultsift.functions.stemming import porter
from faultsift.functions.words import JAVA_KEYWORDS, MARKUP_WORDS, english_stop_words, stemmed

# Token patterns.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
NOT_SPACE = r"[^ \t\n\x0B\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
PROSE_WORD = r"[\p{L}\p{N}']+"
LOWER_UPPER = "([a-z])([A-Z])"
UPPER_WORD = "([A-Z])([A-Z][a-z])"
LETTERS = "[A-Za-z]+"
LONG_LETTERS = "[A-Za-z]{2,}"
COMMENT_OR_LITERAL = (
    r"""(?s)("[^\\"]*(?:\\.[^\\"]*)*"|'[^\\']*(?:\\.[^\\']*)*')|//[^\n]*|/\*.*?\*/"""
)
PACKAGE_OR_IMPORT = r"(^|\n)[ \t]*(package|import)[ \t][^\n]*"
TYPE_NAME = r"\b(?:class|interface|enum)\s+([A-Za-z_]\w*)"
METHOD_NAME = r"\b([A-Za-z_]\w*)\s*\([^()]*\)\s*(?:throws\s+[\w., \t]+)?\{"
TOKEN_SEPARATOR = "-|-"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Words after all ASCII punctuation is deleted (no space takes its place)."""
    return _all(F.regexp_replace(text, PUNCTUATION, ""), NOT_SPACE)


def prose_words(text: Column) -> Column:
    """Maximal runs of letters, digits and apostrophes; a missing text has none."""
    return _all(text, PROSE_WORD)


def split_camel_case(text: Column) -> Column:
    """Put a space where an identifier changes word: `parseHTMLFile` -> `parse HTML File`."""
    return F.regexp_replace(F.regexp_replace(text, LOWER_UPPER, "$1 $2"), UPPER_WORD, "$1 $2")


def code_words(source: Column) -> Column:
    """Words of two and more letters in source code, identifiers taken apart."""
    return _all(split_camel_case(source), LONG_LETTERS)


def identifier_tokens(
    text: Column, stop_words: Iterable[str] | None = None, stem: bool = False
) -> Column:
    """Lower-case words of any length, identifiers taken apart; stop words go before stemming."""
    tokens = F.transform(_all(split_camel_case(text), LETTERS), F.lower)
    if stop_words is not None:
        tokens = _without(tokens, stop_words)
    return F.transform(tokens, porter) if stem else tokens


def _without(tokens: Column, dropped: Iterable[str], min_length: int = 1) -> Column:
    dropped = sorted(set(dropped))
    return F.filter(tokens, lambda t: ~t.isin(dropped) & (F.length(t) >= min_length))


def normalized_words(text: Column, stop_words: Iterable[str] | None = None) -> Column:
    """Lower case, no punctuation, no stop words, stemmed."""
    stop_words = english_stop_words() if stop_words is None else stop_words
    return F.transform(_without(words(F.lower(text)), stop_words), porter)


def dropped_stems(mode: str, stop_words: Iterable[str] | None = None) -> tuple[str, ...]:
    """The stems `preprocessed` removes in `mode` (text or code)."""
    stop_words = english_stop_words() if stop_words is None else stop_words
    dropped = list(stop_words) + MARKUP_WORDS
    if mode == "code":
        dropped += JAVA_KEYWORDS
    elif mode != "text":
        raise ValueError(f"mode must be text or code, not {mode}")
    return stemmed(tuple(dropped))


def preprocessed(doc: Column, mode: str, stop_words: Iterable[str] | None = None) -> Column:
    """Split, lower, stem, then drop stemmed stop words and stems shorter than two letters.

    Java keywords go in code mode only.
    """
    split = prose_words(doc) if mode == "text" else code_words(doc)
    stems = F.transform(split, lambda t: porter(F.lower(t)))
    return _without(stems, dropped_stems(mode, stop_words), min_length=2)


def declared_names(source: Column) -> Column:
    """Lower-case names of declared types, then of declared methods."""
    plain = strip_comments(source)
    methods = F.filter(_all(plain, METHOD_NAME, 1), lambda n: ~n.isin(JAVA_KEYWORDS))
    return F.transform(F.concat(_all(plain, TYPE_NAME, 1), methods), F.lower)


def code_text(source: Column) -> Column:
    """Code without comments, package and import lines."""
    return F.regexp_replace(strip_comments(source), PACKAGE_OR_IMPORT, "$1")


def class_name_text(source: Column) -> Column:
    """The words that follow ` class `, joined by spaces."""
    pieces = F.split(source, " class ")
    names = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.substring_index(p, " ", 1))
    return F.array_join(names, " ")


def strip_comments(source: Column) -> Column:
    """Remove // and /* */ comments, keep literals, drop blank lines."""
    lines = F.split(F.regexp_replace(source, COMMENT_OR_LITERAL, "$1 "), "\n")
    return F.array_join(F.filter(lines, lambda line: F.trim(line) != ""), "\n")


def join_tokens(tokens: Column, separator: str = TOKEN_SEPARATOR) -> Column:
    return F.array_join(tokens, separator)


def split_tokens(text: Column, separator: str = TOKEN_SEPARATOR) -> Column:
    """Inverse of `join_tokens`; an empty text has no tokens."""
    quoted = r"\Q" + separator + r"\E"
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, quoted))


def token_count(tokens: Column) -> Column:
    """Number of tokens, 0 for an empty or missing list."""
    return F.coalesce(F.size(tokens), F.lit(0))


def report_text(summary: Column, description: Column, null_safe: bool = True) -> Column:
    """Summary and description with nothing between them."""
    if null_safe:
        summary, description = F.coalesce(summary, F.lit("")), F.coalesce(description, F.lit(""))
    return F.concat(summary, description)


def exploded(docs: DataFrame, key: str | list[str], tokens: Column) -> DataFrame:
    """One row per token: the key columns and `token`."""
    keys = [key] if isinstance(key, str) else key
    return docs.select(*keys, F.explode(tokens).alias("token"))
