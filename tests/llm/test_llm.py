"""Corpus operators on small tables against brute force, and on awkward rows."""

import os
import random
import sys
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from faultsift.llm import (  # noqa: E402
    boilerplate,
    bpe,
    common,
    contextual_pii,
    language,
    line_hashing,
    norm_buckets,
    outliers,
    packing,
    probminhash,
    queries,
    toxicity,
)

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


LONG = words(1, 60)
AWKWARD = [
    (1, None, "en", "s", None),
    (2, "", None, None, 0),
    (None, LONG, "en", "s", 1),
    (4, LONG, "en", "s", 1),
    (4, LONG, "en", "s", 1),
    (5, "a" * 4_000 + " 1" * 2_000, "de", "t", 2),
    (6, "  \n\t \n\n", "de", "t", 3),
    (7, "\x01 é́ <|endoftext|> \U0001f600 ﬁ ΟΔΟΣ. don't\x85 x", "fr", "t", 3),
    (8, LONG + "\n" + LONG, "fr", "t", 3),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_oracles(spark, sf_dir):
    from compare import connect, differences

    con = connect(sf_dir)
    for name, sql in queries.ORACLES.items():
        assert differences(queries.QUERIES[name](spark, sf_dir), con, sql) is None, name


@pytest.mark.parametrize("name", ["documents", "awkward"])
def test_packing(name, request):
    docs = request.getfixturevalue(name)
    rows = packing.packed_documents(docs, WORD_BPE).collect()
    tokenizer = packing.WordEncoder(WORD_BPE).tokenizer
    expected = []
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            expected.append((r.doc_id or -1, piece, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    bins: dict = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    total = sum(bins.values())
    assert max(bins.values()) <= 2048 and len(bins) <= -(-total // 2048) * 1.02 + 1


def test_fullest_is_the_fullest():
    from itertools import combinations

    rng = random.Random(3)
    for _ in range(60):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        room = rng.randint(0, 70)
        counts = {n: lengths.count(n) for n in lengths}
        chosen = packing.fullest(counts, room)
        best = max(sum(c) for k in range(len(lengths) + 1) for c in combinations(lengths, k) if sum(c) <= room)
        assert sum(chosen) == best and all(chosen.count(n) <= counts[n] for n in chosen)


def test_byte_bpe(awkward, documents):
    import hashlib

    own = bpe.coder(BYTE_BPE, public_tokenizers.PATTERN)
    for docs in (awkward, documents):
        got = sorted(map(tuple, bpe.round_trip(docs, BYTE_BPE, public_tokenizers.PATTERN).collect()), key=repr)
        want = []
        for r in docs.collect():
            ids = own.encoding.encode_ordinary(r.text or "")
            sha = lambda b: hashlib.sha256(b).hexdigest()
            want.append((r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode())))
        assert got == sorted(want, key=repr)
    round_trip = bpe.decoded(bpe.encoded(awkward, BYTE_BPE, public_tokenizers.PATTERN), BYTE_BPE, public_tokenizers.PATTERN)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in round_trip.collect())
    text = words(9, 30_000)
    assert "".join(own.windows(text, 1000)) == text and own.encode(text) == own.encoding.encode_ordinary(text)


def test_quality_counts_and_verdict(spark, documents, awkward, empty):
    for docs in (documents, awkward):
        got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in outliers.judged_documents(docs).collect()}
        want = set()
        for r in docs.collect():
            c = brute.counts(r.text)
            want.add((r.doc_id, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
        assert got == want
    assert outliers.judged_documents(empty).count() == 0 and outliers.kept_documents(empty).count() == 0
    good = [(i, words(i, 80), "en", "s", 0) for i in range(300)] + [(900 + i, words(7, 80), "en", "s", 0) for i in range(200)]
    junk = [(1000 + i, " ".join(w + "###" for w in words(i, 80).split()), "en", "s", 0) for i in range(20)]
    docs = spark.createDataFrame(good + junk, SCHEMA)
    assert {r.doc_id for r in outliers.kept_documents(docs).collect()} == {r[0] for r in good}


def test_language(spark, documents, empty, awkward):
    rows = language.languages(documents, PIECES).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert language.languages(empty, PIECES).count() == 0
    got = {r.doc_id: r.lang_pred for r in language.languages(awkward, PIECES).collect()}
    assert got[1] == got[2] == got[6] == "und"


def test_forward_sums_all_segmentations():
    pieces = language.Pieces(PIECES)
    p = np.random.default_rng(1).random((pieces.size, 2))
    p /= p.sum(axis=0)

    def total(text: str) -> np.ndarray:
        if not text:
            return np.ones(2)
        out = np.zeros(2)
        for n in range(1, len(text) + 1):
            if pieces.table.get(text[:n], -1) >= 0:
                out = out + p[pieces.table[text[:n]]] * total(text[n:])
            elif n == 1:
                out = out + p[[pieces.bytes[b] for b in text[0].encode()]].prod(axis=0) * total(text[1:])
        return out

    some = ["the", "être", "\U0001f600x", "a", "schön"]
    want = np.log([total(language.SPACE + w) for w in some])
    assert np.allclose(language.word_scores(some, pieces, p), want)
    uses = language.expected(["the"], np.array([2.0]), pieces, p[:, 0])
    lengths = {i: len(t) for t, i in pieces.table.items() if i >= 0}
    assert abs(sum(uses[i] * lengths[i] for i in np.flatnonzero(uses)) - 2.0 * 4) < 1e-9


def test_personal_data(spark, documents, awkward, empty):
    tricky = [
        "a@b.c_d@e.f x@y a@b.c.d..e 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4 +1 (23) 456-789-0 +12 4111 1111 1111 1111-",
        "4111111111111111 4111 1111 1111 1112 1.2.3 +++1 234567890 \x01\x02 é@é.com " + "9" * 3000 + " " + "a" * 5000 + "@b.c",
        "\U0001f600 m.x@a-b.co 10.0.0.255",
    ]
    rows = [(100 + i, t, "en", "s", 0) for i, t in enumerate(tricky)]
    for docs in (documents, awkward, spark.createDataFrame(rows, SCHEMA)):
        got = sorted((tuple(r)[:6] for r in contextual_pii.personal_data(docs).collect()), key=repr)
        assert got == sorted(((r.doc_id, *brute.base_row(r.text)) for r in docs.collect()), key=repr)
    assert contextual_pii.personal_data(empty).count() == 0 and contextual_pii.masked(empty).count() == 0
    masked = {r.doc_id: r.text for r in contextual_pii.masked(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert masked[102] == "\U0001f600 [EMAIL] [IP]"


def test_contexts_find_unseen_identifiers(spark):
    seeds = [(i, f"please call me at +1 (234) 555-{1000 + i} now", "en", "s", 0) for i in range(6)]
    hidden = [(50, "please call me at (234) 555-7777 now", "en", "s", 0), (51, "version of 123 456 7890 rows", "en", "s", 0)]
    docs = spark.createDataFrame(seeds + hidden, SCHEMA)
    rows = {r.doc_id: r for r in contextual_pii.personal_data(docs).collect()}
    assert rows[50].spans == "phone:18:32" and rows[50].n_phone == 0 and rows[50].n_added == 1
    assert rows[51].n_added == 0 and rows[0].n_added == 0
    masked = {r.doc_id: r.text for r in contextual_pii.masked(docs).collect()}
    assert masked[50] == "please call me at [PHONE] now" and masked[51] == hidden[1][1]


def test_personal_data_runs_in_built_in_functions(documents):
    plan = contextual_pii.personal_data(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_near_duplicates(spark, documents, awkward, empty):
    base = [words(i, 120) for i in range(6)]
    rows = []
    for i, text in enumerate(base):
        rows.append((10 * i, text, "en", "s", 0))
        parts = text.split()
        for k in range(1, 6):  # a chain: each differs a little more from the first
            parts[15 * k : 15 * k + 1] = [f"zz{k}"]
            rows.append((10 * i + k, " ".join(parts), "en", "s", 0))
    for docs in (documents, spark.createDataFrame(rows, SCHEMA)):
        got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(docs).collect()}
        texts = {r.doc_id: r.text for r in docs.collect()}
        if docs is documents:  # brute force over candidates of half a text; the short ones suffice
            texts = {k: t for k, t in texts.items() if len(t) < 3000}
            got = {k: got[k] for k in texts if got[k] in texts}
            texts = {k: texts[k] for k in got}
        assert got == brute.classes(texts)
    assert probminhash.near_duplicates(empty).count() == 0
    rows = sorted(((r.doc_id, r.class_id, r.class_size) for r in probminhash.near_duplicates(awkward).collect()), key=repr)
    assert rows.count((4, 4, 3)) == 2 or rows.count((4, 4, 4)) == 2
    kept = sorted((r.doc_id for r in probminhash.one_of_each(awkward).collect()), key=repr)
    assert kept.count(4) == 1 and None not in kept and {1, 2, 6} <= set(kept)


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 1 << 63, 300).astype("uint64"))
    weights = rng.integers(1, 5, len(a))
    b, other = a[60:], np.maximum(weights[60:] - (np.arange(len(a) - 60) % 3 == 0), 1)
    exact = probminhash.probability_jaccard(a, weights, b, other)
    from collections import Counter

    assert abs(exact - brute.probability_jaccard(Counter(dict(zip(a.tolist(), weights.tolist()))), Counter(dict(zip(b.tolist(), other.tolist()))))) < 1e-9
    m = 1024
    same = (probminhash.signature(a, weights, m) == probminhash.signature(b, other, m)).mean()
    assert abs(same - exact) < 0.06


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(i, i + 1) for i in range(500, 560)] + [(600, i) for i in range(601, 700)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        one, two = find(a), find(b)
        root[max(one, two)] = min(one, two)
    assert got == {n: find(n) for n in root if find(n) != n}


def test_lines(spark, awkward, empty):
    cleaned = {(r.doc_id, r.text) for r in line_hashing.deduplicated(awkward).collect()}
    assert (4, LONG) in cleaned and (None, "") in cleaned and (8, "") in cleaned and (1, None) in cleaned
    assert line_hashing.deduplicated(empty).count() == 0
    pages = [(i, f"menu\n{words(i, 5)}\n menu ", "en", "h", 0) for i in range(10)] + [(20, None, "en", None, 0)]
    rows = {r.doc_id: r for r in boilerplate.without_boilerplate(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert rows[3].text == words(3, 5) and rows[3].n_dropped == 2 and rows[20].text is None
    assert boilerplate.without_boilerplate(empty).count() == 0


def test_broadcast_and_shuffled_joins_agree(spark, documents, monkeypatch):
    few = sorted(map(tuple, boilerplate.without_boilerplate(documents).collect()), key=repr)
    near = sorted(map(tuple, probminhash.near_duplicates(documents).collect()), key=repr)
    for module in (boilerplate, probminhash):
        monkeypatch.setattr(module, "bounded", lambda df: df)
    assert sorted(map(tuple, boilerplate.without_boilerplate(documents).collect()), key=repr) == few
    assert sorted(map(tuple, probminhash.near_duplicates(documents).collect()), key=repr) == near


def test_top_products(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, (rng.normal(size=8) * 3.0 ** (i % 6)).tolist()) for i in range(400)]
    odd = [(1000, None), (1001, [None] * 8), (1002, [float("nan")] * 8), (None, [1.0] * 8), (1050, [2.0, 1.0]), (1100, [1.0, 1.0]), (1101, [0.0] * 8)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in norm_buckets.top_products(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    usable = {i: np.floor(256 * np.array(v)).astype("int64") for i, v in [*vectors, odd[4], odd[5], odd[6]]}
    want = {}
    for q in usable:
        if q % 50 == 0:
            scored = [(c, int(usable[q] @ v)) for c, v in usable.items() if c != q and len(v) == len(usable[q])]
            want[q] = sorted(scored, key=lambda x: (-x[1], x[0]))[:5]
    assert got == want


def test_toxicity(spark, empty):
    bad = ["scum", "idiot", "trash"]
    docs = [(i, words(i, 40) + (f" {bad[i % 3]}" if i % 4 == 0 else ""), "en", "s", 0) for i in range(400)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(300)] + [(None, 1, 1), (1, None, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    frame = spark.createDataFrame([*docs, (None, None, None, None, None)], SCHEMA)
    rows = {r.doc_id: r for r in toxicity.toxicity(frame, table, chain).collect()}
    assert len(rows) == 401 and not rows[None].is_toxic
    assert all(rows[i].is_toxic == (i % 4 == 0) for i in range(400))
    assert toxicity.toxicity(empty, table, chain).count() == 0
    assert toxicity.toxicity(frame, table.limit(0), chain).count() == 401


def test_pipeline(spark, sf_dir, awkward, empty):
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.count() > 0
    for docs in (awkward, empty):
        for _, function in corpus_pipeline.STAGES[:-1]:
            out = function(spark, docs, sf_dir)
            assert out.columns == list(corpus_pipeline.COLUMNS)
            out.collect()


def test_small_buckets_are_tested_whole(spark, monkeypatch):
    """Where all texts meet in one bucket, every link between them is found."""
    monkeypatch.setattr(probminhash, "bands", lambda signed: np.zeros(1, "int64"))
    texts = [words(100 + i, 80) for i in range(24)]
    near = [f"{t} {words(900 + i, 2)}" for i, t in enumerate(texts[:5])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + near)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(docs).collect()}
    assert got == {i: i if i < 24 else i - 24 for i in range(29)}


def test_large_buckets_are_finished(spark, monkeypatch):
    """Several hundred texts in one bucket: links between few of them are found, those at the limit too."""
    monkeypatch.setattr(probminhash, "bands", lambda signed: np.zeros(1, "int64"))
    common = words(77, 50)  # every third text holds it, and some repeat it
    rows = {i: words(100 + i, 81) + f" {common}" * (i % 3 == 0) * (1 + i % 2) for i in range(300)}
    rows |= {300 + i: f"{rows[10 * i]} {words(900 + i, 2 + i)}" for i in range(30)}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(docs).collect()}
    assert got == brute.classes(rows)
    assert 10 < sum(k != v for k, v in got.items()) < 30


def test_accepted_identifiers_are_seeds_of_new_contexts(spark):
    """A form met only beside accepted identifiers, in no context of a base one, is found in the next generation."""
    texts = [f"please call me at +1 (234) 555-{1000 + i} now" for i in range(12)]
    texts += [f"please call me at (234) 555-700{i} now" for i in range(3)]
    texts += [f"my office line is (234) 555-700{i} today" for i in range(4)]
    texts += ["version of 123 456 7890 rows"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.n_added for r in contextual_pii.personal_data(docs).collect()}
    assert got == {i: int(12 <= i < 19) for i in range(20)}


def test_sketches_of_similar_sets_agree():
    """Sets at the limit stay above the least agreement, sets far from it fall below."""
    rng = np.random.default_rng(11)
    for size in (20, 200, 3000):
        a = np.unique(rng.integers(0, 1 << 63, size).astype("uint64"))
        ones = np.ones(len(a), "int64")
        for shared, near in ((0.9, True), (0.4, False)):
            own = np.unique(np.concatenate([a[: int(shared * len(a))], rng.integers(0, 1 << 63, int((1 - shared) * len(a))).astype("uint64")]))
            assert near == (probminhash.probability_jaccard(a, ones, own, np.ones(len(own), "int64")) >= 0.8)
            x, y = probminhash.sketch(a, ones), probminhash.sketch(own, np.ones(len(own), "int64"))
            agree = probminhash.BITS - int(np.unpackbits((x ^ y).view("uint8")).sum())
            assert near == (agree >= probminhash.least_agreement(0.8))


def test_prefixes_of_similar_sets_meet():
    """Whatever the counts of the slots, two sets at the limit share an element of both prefixes."""
    rng = np.random.default_rng(3)
    for turn in range(200):
        pool = rng.integers(-(1 << 63), 1 << 63, 60)
        a, b = (np.unique(rng.choice(pool, 57, replace=False)) for _ in range(2))
        wa, wb = (rng.integers(1, 3, len(x)).astype("int32") for x in (a, b))
        holders = rng.integers(2, 9, probminhash.SLOTS).astype("int32")
        near = probminhash.probability_jaccard(a, wa, b, wb)
        met = set(probminhash.prefix(a, wa, holders, near)) & set(probminhash.prefix(b, wb, holders, near))
        assert met, turn
