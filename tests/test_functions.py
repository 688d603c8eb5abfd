"""Text, path, measure and array functions on literal input."""

import math
import posixpath
import string

from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultsift.functions import arrays, measures, paths, stemming, text


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("r")).first()["r"]


def each(spark, function, inputs, schema="x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, {schema}")
    rows = df.select("i", function(F.col("x")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


# A plain Porter stemmer, written from the published description, to compare with.


def _is_consonant(w, i):
    if w[i] in "aeiou":
        return False
    return not (w[i] == "y" and i > 0 and _is_consonant(w, i - 1))


def _m(w):
    kinds = ["c" if _is_consonant(w, i) else "v" for i in range(len(w))]
    return sum(1 for a, b in zip(kinds, kinds[1:]) if a == "v" and b == "c")


def _has_vowel(w):
    return any(not _is_consonant(w, i) for i in range(len(w)))


def _double(w):
    return len(w) > 1 and w[-1] == w[-2] and _is_consonant(w, len(w) - 1)


def _cvc(w):
    n = len(w)
    return (
        n > 2 and _is_consonant(w, n - 3) and not _is_consonant(w, n - 2) and _is_consonant(w, n - 1)
        and w[-1] not in "wxy"
    )


def _swap(w, table):
    for old in sorted(table, key=len, reverse=True):
        if w.endswith(old):
            stem = w[: len(w) - len(old)]
            return stem + table[old] if _m(stem) > 0 else w
    return w


def plain_porter(w):
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _m(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _m(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, stemming.STEP2), stemming.STEP3)
    for end in sorted(stemming.STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _m(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_m(w[:-1]) > 1 or (_m(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _m(w) > 1:
        w = w[:-1]
    return w


def test_porter_known_words(spark):
    known = {
        "caresses": "caress", "ponies": "poni", "agreed": "agre", "hopping": "hop", "falling": "fall",
        "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "rational": "ration",
        "vietnamization": "vietnam", "electrical": "electr", "adoption": "adopt", "controll": "control",
        "roll": "roll", "by": "by", "don't": "don't", "enjoy": "enjoi",
    }
    assert each(spark, stemming.porter, list(known)) == list(known.values())


def test_porter_matches_plain_version(spark):
    pieces = ["a", "b", "y", "yy", "ee", "st", "at", "iz", "ll", "ss", "o", "w", "n"]
    ends = ["", "s", "ed", "ing", "eed", "ies", "y", "e", "ion", *stemming.STEP2, *stemming.STEP3, *stemming.STEP4]
    words = sorted({p + q + r + e for p in pieces for q in pieces for r in ("", "at", "y", "b") for e in ends})
    got = each(spark, stemming.porter, words)
    wrong = [(w, g, plain_porter(w)) for w, g in zip(words, got) if g != plain_porter(w)]
    assert wrong == []


@settings(max_examples=3, deadline=None, phases=[Phase.generate])
@given(st.lists(st.text(alphabet="aeiouybcdlnstz'é", min_size=1, max_size=12), min_size=200, max_size=200))
def test_porter_matches_plain_version_on_random_words(spark, words):
    assert each(spark, stemming.porter, words) == [plain_porter(w) for w in words]


def test_with_stems_equals_row_wise_stems(spark, monkeypatch):
    monkeypatch.setattr(stemming, "FREQUENT_WORDS", 2)
    words = ["running"] * 5 + ["flies"] * 3 + ["national", "happily"]
    df = spark.createDataFrame([(w,) for w in words], "token string")
    got = sorted(r[0] for r in stemming.with_stems(df).collect())
    assert got == sorted(plain_porter(w) for w in words)
    long = stemming.with_stems(df, keep=lambda s: F.length(s) > 3)
    assert sorted(r[0] for r in long.collect()) == sorted(s for s in map(plain_porter, words) if len(s) > 3)


def camel(word):
    """Character walk: a new word starts at lower-upper and before the last upper of a run."""
    out, start = [], 0
    for i in range(1, len(word)):
        before_lower = word[i].isupper() and i + 1 < len(word) and word[i + 1].islower() and word[i - 1].isupper()
        if (word[i - 1].islower() and word[i].isupper()) or before_lower:
            out.append(word[start:i])
            start = i
    return out + [word[start:]]


def test_identifier_tokens(spark):
    inputs = ["parseHTMLFile", "aBCd", "HTMLParser", "ABcDe", "foo_bar1Baz"]
    expected = [["parse", "html", "file"], ["a", "b", "cd"], ["html", "parser"], ["a", "bc", "de"], ["foo", "bar", "baz"]]
    assert each(spark, text.identifier_tokens, inputs) == expected
    assert each(spark, text.code_words, ["ABcDe x int"]) == [["Bc", "De", "int"]]


@settings(max_examples=3, deadline=None, phases=[Phase.generate])
@given(st.lists(st.text(alphabet="abcABC", min_size=1, max_size=10), min_size=100, max_size=100))
def test_camel_case_matches_character_walk(spark, words):
    assert each(spark, text.identifier_tokens, words) == [[p.lower() for p in camel(w)] for w in words]


def test_stop_words_go_before_stemming(spark):
    got = one(spark, text.identifier_tokens(F.col("x"), stop_words=["the"], stem=True), x="TheRunningThes")
    assert got == ["run", "the"]


def test_prose_words(spark):
    assert each(spark, text.prose_words, ["don't stop é1", None, "", "a_b"]) == [["don't", "stop", "é1"], [], [], ["a", "b"]]


def test_words_drop_punctuation_without_space(spark):
    assert each(spark, text.words, ["foo.bar (x)  y", string.punctuation]) == [["foobar", "x", "y"], []]


def test_preprocessed(spark):
    code = "public class ParserTool { int sizeOf; }"
    assert one(spark, text.preprocessed(F.col("x"), "code", ["of"]), x=code) == ["parser", "tool", "size"]
    prose = "The class isn't running a b"
    got = one(spark, text.preprocessed(F.col("x"), "text", ["the", "isn't"]), x=prose)
    assert got == ["class", "run"]


def test_normalized_words(spark):
    assert one(spark, text.normalized_words(F.col("x"), ["the"]), x="The parser's RUNNING.") == ["parser", "run"]


def test_comments(spark):
    source = 'int a=1; // note\nString s="// keep";\n/* gone\n gone */\n\nchar c=\'"\'; // "x"\n'
    got = one(spark, text.strip_comments(F.col("x")), x=source)
    assert [line.strip() for line in got.split("\n")] == ["int a=1;", 'String s="// keep" ;', "char c='\"' ;"]


def test_long_literal_does_not_overflow(spark):
    source = 'x = "' + "a" * 200_000 + '"; // end'
    assert len(one(spark, text.strip_comments(F.col("x")), x=source)) > 200_000


def test_declared_and_class_names(spark):
    source = "package a.b;\nimport c.D;\npublic class FooBar {\n  int getSize(int n) { if (n) { return 1; } }\n}"
    assert one(spark, text.declared_names(F.col("x")), x=source) == ["foobar", "getsize"]
    assert "import" not in one(spark, text.code_text(F.col("x")), x=source)
    assert one(spark, text.class_name_text(F.col("x")), x="x class Foo y class Bar z") == "Foo Bar"
    assert one(spark, text.class_name_text(F.col("x")), x="none") == ""


def test_token_lists(spark):
    assert one(spark, text.split_tokens(F.col("x")), x="a-|-b c-|-d") == ["a", "b c", "d"]
    assert one(spark, text.token_count(text.split_tokens(F.col("x"))), x="") == 0


def test_report_text(spark):
    assert one(spark, text.report_text(F.col("x"), F.col("y")), x="a", y=None) == "a"
    assert one(spark, text.report_text(F.col("x"), F.col("y"), null_safe=False), x="a", y=None) is None


def test_paths(spark):
    raw = ["a//b/./c.java", "a/b/../c.java", "./x/y", "a/b/c/../../d", "a/./b/", "..", "../a", "../../a/..", "/../a", "/", "a/..", "."]
    assert each(spark, paths.normalized_path, raw) == [posixpath.normpath(p) for p in raw]


@settings(max_examples=3, deadline=None, phases=[Phase.generate])
@given(st.lists(st.lists(st.sampled_from(["a", "b", "..", ".", "", "..x"]), min_size=1, max_size=7), min_size=80, max_size=80))
def test_paths_match_posix_rules(spark, parts):
    raw = ["/".join(p) for p in parts]
    raw = [r for r in raw if r]
    assert each(spark, paths.normalized_path, raw) == [posixpath.normpath(p) for p in raw]


def test_file_stem(spark):
    assert each(spark, paths.file_stem, ["org.foo.Bar.java", "noext"]) == ["Bar", None]


def test_lists_and_numbers(spark):
    assert one(spark, paths.file_list(F.col("x")), x="  a//b  c/../d ") == ["a/b", "d"]
    assert one(spark, paths.file_list(F.col("x")), x="") == []
    assert one(spark, paths.list_literal(F.col("x")), x="['a', 'b']") == ["a", "b"]
    assert each(spark, paths.to_number, ["1.5", "x", None]) == [1.5, None, None]
    assert str(one(spark, paths.report_time(F.col("x")), x="2010-01-31 10:00:01")) == "2010-01-31 10:00:01"


def test_months_and_recency(spark):
    df = spark.sql("SELECT DATE'2010-01-31' a, DATE'2010-02-01' b, CAST(NULL AS DATE) n")
    row = df.select(
        measures.months_between(F.col("a"), F.col("b")).alias("m"),
        measures.recency(F.col("b"), F.col("a")).alias("r"),
        measures.recency(F.col("b"), F.col("n")).alias("z"),
    ).first()
    assert (row.m, row.r, row.z) == (1, 0.5, 0.0)


def test_weights(spark):
    row = spark.range(1).select(
        (measures.damped_tf(F.lit(2)) * measures.idf(F.lit(4), F.lit(2))).alias("w"),
        measures.idf(F.lit(4), F.lit(1), 2).alias("a"),
        measures.idf(F.lit(4), F.lit(3), 2).alias("b"),
        measures.margin(F.lit(1.0), F.lit(0.2), 0.25).alias("m"),
    ).first()
    assert math.isclose(row.w, 0.7615, abs_tol=1e-6) and row.a == 2.0 and math.isclose(row.b, 0.415037, abs_tol=1e-6)
    assert row.m == 1e-6


def test_arrays(spark):
    row = spark.range(1).select(
        arrays.pad(F.array(F.lit(7), F.lit(8)), 4).alias("p"),
        arrays.pad_matrix(F.array(F.array(F.lit(1.0), F.lit(2.0))), 2, 2).alias("m"),
        arrays.interleave(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("i"),
        arrays.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c"),
        arrays.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z"),
        arrays.core_term_id(F.lit(1)).alias("first"),
        arrays.core_term_id(F.lit(None).cast("int")).alias("other"),
    ).first()
    assert row.p == [7, 8, 0, 0] and row.m == [[1.0, 2.0], [0.0, 0.0]] and row.i == [1.0, 3.0, 2.0, 4.0]
    assert math.isclose(row.c, math.sqrt(0.5)) and row.z is None and (row["first"], row.other) == (2, 1)
