"""Added spans of operator 9 against a second scoring, and the rules of operators 5 and 8 on small groups."""

import math
import random
from collections import defaultdict

import brute
import numpy as np
import regex
from pyspark.sql import functions as F

from faultsift.llm import boilerplate, contextual_pii, outliers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _found(text: str, kind: str, pattern: str, test) -> list[tuple]:
    """(start, stop, value, contexts) of the matches of one kind."""
    matches = list(regex.finditer(pattern, text))
    out = []
    for i, m in enumerate(matches):
        left = text[matches[i - 1].end() if i else 0 : m.start()]
        right = text[m.end() : matches[i + 1].start() if i + 1 < len(matches) else len(text)]
        before, behind = left.lower().split()[-2:], right.lower().split()[:1]
        contexts = [" ".join(before)] if len(before) == 2 else []
        contexts += [f"{before[-1]} _ {behind[0]}"] if before and behind else []
        if test(m.group()):
            out.append((m.start(), m.end(), m.group(), {regex.sub("[0-9]", "0", c) for c in contexts}))
    return out


def _name(kind: str, value: str) -> str:
    return regex.sub("[^0-9]", "", value) if kind in ("card", "phone") else regex.sub(r"\s", "", value.lower())


def added_spans(texts: dict[int, str]) -> dict[int, set]:
    base, loose = defaultdict(list), defaultdict(list)
    for doc, text in texts.items():
        for kind in brute.KINDS:
            base[doc] += [(kind, *s) for s in _found(text, kind, brute.PATTERNS[kind], lambda v, k=kind: brute.passes(k, v))]
        for kind in brute.KINDS:
            right = (lambda v: brute.luhn(_name("card", v))) if kind == "card" else (lambda v: True)
            for s in _found(text, kind, contextual_pii.LOOSE[kind], right):
                if not any(b[1] < s[1] and s[0] < b[2] for b in base[doc]):
                    loose[doc].append((kind, *s))
    pairs = defaultdict(set)  # pattern -> instances
    for spans in (base, loose):
        for kind, _, _, value, contexts in (s for many in spans.values() for s in many):
            for c in contexts:
                pairs[kind, c].add((kind, _name(kind, value)))
    seeds = {(s[0], _name(s[0], s[3])) for many in base.values() for s in many}
    fine: set = set()
    while True:
        known = seeds | fine
        graph = {p: i for p, i in pairs.items() if len(i & known) >= contextual_pii.LEAST_SEEDS and i - known}
        confidence = {p: len(i & known) / len(i) for p, i in graph.items()}
        for _ in range(contextual_pii.ROUNDS):
            score = {x: 1 - math.prod(1 - min(confidence[p], 0.999999) for p, i in graph.items() if x in i) for i in graph.values() for x in i - known}
            confidence = {p: (len(i & known) + sum(score[x] for x in i - known)) / len(i) for p, i in graph.items()}
        new = {x for x in (score if graph else {}) if score[x] >= contextual_pii.CONFIDENCE}
        if not new:
            break
        fine |= new
    return {d: {(k, a, b) for k, a, b, v, _ in many if (k, _name(k, v)) in fine} for d, many in loose.items()}


def test_added_spans_against_a_second_scoring(spark):
    rng = random.Random(4)
    slots = ["please call me at {} now", "my phone is {} today", "order number {} of", "server at {} is down", "write to {} please", "card {} was charged"]
    values = [
        lambda: f"+49 30 {rng.randint(100000, 999999)}",
        lambda: f"0{rng.randint(20, 99)} {rng.randint(1000000, 9999999)}",
        lambda: f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
        lambda: f"10.0.{rng.randint(0, 255)}.{rng.randint(0, 255)}",
        lambda: f"2001:db8::{rng.randint(1, 999):x}",
        lambda: f"u{rng.randint(1, 40)}@mail.example",
        lambda: f"u{rng.randint(1, 40)} [at] mail.example",
        lambda: f"u{rng.randint(1, 40)}@localhost",
        lambda: "4111.1111.1111.1111",
        lambda: f"4{rng.randint(10**14, 10**15 - 1)}",
    ]
    often = [(0, 0), (0, 0), (0, 0), (0, 1), (1, 0), (1, 2), (2, 1), (3, 3), (3, 3), (3, 4), (4, 5), (4, 5), (4, 6), (4, 7), (5, 8), (5, 9)]
    texts = {i: " and ".join(slots[a].format(values[b]()) for a, b in rng.choices(often, k=rng.randint(1, 4))) for i in range(300)}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], SCHEMA)
    want = added_spans(texts)
    got = {r.doc_id: (r.spans, r.n_added) for r in contextual_pii.personal_data(docs).collect()}
    for i, text in texts.items():
        listed = {tuple(x if k == 0 else int(x) for k, x in enumerate(s.split(":"))) for s in got[i][0].split(",") if s}
        assert listed == want.get(i, set()) | set(brute.base_spans(text)), text
    kinds = {k for many in want.values() for k, _, _ in many}
    assert {"phone", "ip", "email"} <= kinds and sum(map(len, want.values())) < sum(map(len, texts.values()))


def test_slots_of_patterns_take_other_written_forms(spark):
    texts = [f"please call me at +49 30 555-10{i:02d} now" for i in range(40)] + [f"server at 10.0.0.{i} is down" for i in range(40)]
    hidden = ["please call me at 030 1234567 now", "server at 2001:db8::1 is down", "built 2024 01 15 at 12:30:45", "x" * 500 + " 030 7654321 " + "y" * 500]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts + hidden)], SCHEMA)
    got = {r.doc_id: (r.spans, r.n_added) for r in contextual_pii.personal_data(docs).where("doc_id >= 80").collect()}
    assert got == {80: ("phone:18:29", 1), 81: ("ip:10:21", 1), 82: ("", 0), 83: ("", 0)}


def test_many_spans_in_one_text(spark):
    """Candidates that meet base spans are found whatever their number; a long text ends soon."""
    text = " ".join(f"+1 234 555 {i:04d}; 030 123{i:04d};" for i in range(3000))
    rows = contextual_pii.personal_data(spark.createDataFrame([(1, text, "en", "s", 0)], SCHEMA)).collect()
    assert rows[0].n_phone == 3000
    both = spark.createDataFrame([(1, text)], "doc_id long, text string").select(contextual_pii.found_spans(F.col("text")).alias("f"))
    loose = both.select(F.explode("f.loose").alias("s")).where("s.kind = 'phone'").select("s.value").collect()
    assert sorted(r.value for r in loose) == [f"030 123{i:04d}" for i in range(3000)]


def test_ratio_decides_on_small_hosts(spark):
    pages = [(i, f"menu\nown {i}", "en", "small", 0) for i in range(4)] + [(9, "only\nonly", "en", "single", 0)]
    pages += [(20 + i, f"twice\nrow {i}" if i < 2 else f"row {i}", "en", "large", 0) for i in range(20)]
    got = {r.doc_id: r.text for r in boilerplate.without_boilerplate(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert [got[i] for i in range(4)] == [f"own {i}" for i in range(4)]
    assert got[9] == "only\nonly" and got[20] == "twice\nrow 0"


def _invertible(cover: np.ndarray) -> np.ndarray:
    least = np.array(outliers.FLOORS) ** 2
    out = cover.copy()
    for i, floor in enumerate(least):
        out[i, i] = max(out[i, i], floor) + floor / 1e6
    return out


def _distances(rows: np.ndarray, mean: np.ndarray, cover: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows - mean, np.linalg.solve(cover, (rows - mean).T).T)


def robust_distances(rows: np.ndarray) -> np.ndarray:
    """Distances of the rows by the minimum covariance determinant of the distinct ones."""
    some = np.unique(rows, axis=0)
    low, middle, high = np.quantile(some, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    starts = [(middle, np.diag(((high - low) / 1.349) ** 2)), (some.mean(0), np.cov(some.T, bias=True))]
    ends = []
    for mean, cover in starts:
        cover = _invertible(cover)
        for _ in range(outliers.STEPS):
            d = _distances(some, mean, cover)
            near = some[d <= np.quantile(d, outliers.COVERAGE, method="inverted_cdf")]
            mean, cover = near.mean(0), _invertible(1.412 * np.cov(near.T, bias=True))
        ends.append((np.linalg.slogdet(cover)[1], mean, cover))
    _, mean, cover = min(ends, key=lambda e: e[0])
    near = some[_distances(some, mean, cover) <= 12.83]
    return _distances(rows, near.mean(0), _invertible(1.055 * np.cov(near.T, bias=True)))


def test_verdict_against_a_second_estimate(spark):
    rng = random.Random(8)

    def text(i: int) -> str:
        out = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(60, 400))]
        out = [w + "#" * (i % 11 == 0) * rng.randint(0, 3) for w in out]
        return " ".join(out + out[: len(out) * (i % 7 == 0) // rng.randint(4, 9)])

    texts = [text(i) for i in range(240)]
    even = " ".join(f"w{i:04d}" for i in range(110))
    texts.append(even + " " + " ".join(f"v{i:04d}" for i in range(45)) + " " + " ".join(f"v{i:04d}" for i in range(45)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in outliers.judged_documents(docs).collect()}
    n = np.array([brute.counts(t) for t in texts], float)
    vectors = np.column_stack([np.log(n[:, 0]), np.log(n[:, 1] / n[:, 0]), n[:, 2] / n[:, 0], n[:, 3] / n[:, 0], n[:, 4] / n[:, 0]])
    want = robust_distances(vectors)
    assert np.allclose([got[i].distance for i in range(len(texts))], want, rtol=1e-6, atol=1e-9)
    assert [got[i].kept for i in range(len(texts))] == [not r for r in want > outliers.CUTOFF]
    assert 0 < sum(want > outliers.CUTOFF) < 60


def test_many_repeats_alone_reject(spark):
    own = lambda i, n: [f"w{i}x{k}" for k in range(n)]
    texts = [" ".join(own(i, 80 + i % 40)) for i in range(300)]
    texts.append(" ".join(own(900, 60) + own(901, 25) + own(901, 25)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id for r in outliers.judged_documents(docs).where("NOT kept AND NOT base_failed").collect()}
    assert got == {300}
