"""Sharding, filter audit and conversation repair against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultsift.llm import conversations, filter_audit, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
MORE = "_p string, _b long, _c0 int, _bucket int, _k string, _h int, _part int, shard string, slot string, part string"


# --- sharding -----------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_matrix_has_exact_sums(seed):
    rng = random.Random(seed)
    counts = [rng.choice([1, 3, 50, 1000]) for _ in range(rng.randint(1, 40))]
    ends, sizes = np.cumsum(counts), sharding.shard_sizes(sum(counts), rng.randint(1, 9))
    matrix = np.array([sharding.matrix_row(b, ends, sizes, seed) for b in range(len(counts))])
    assert (matrix >= 0).all() and list(matrix.sum(1)) == counts and list(matrix.sum(0)) == list(sizes)


def test_matrix_cells_follow_the_hypergeometric_law():
    ends, sizes = np.cumsum([6, 10, 4, 9]), sharding.shard_sizes(29, 3)
    cells = np.array([[sharding.matrix_row(b, ends, sizes, seed)[1] for b in (1, 3)] for seed in range(1500)])
    for column, rows in zip(cells.T, (10, 9)):
        for k in range(rows + 1):
            p = math.comb(10, k) * math.comb(19, rows - k) / math.comb(29, rows)
            assert abs((column == k).mean() - p) < 5 * math.sqrt(p * (1 - p) / 1500) + 0.002


@pytest.mark.parametrize("good, bad, drawn", [(5, 7, 4), (40, 3, 20), (1000, 3000, 100), (2, 5000, 600)])
def test_sampler_of_large_populations(good, bad, drawn, monkeypatch):
    monkeypatch.setattr(sharding, "NUMPY_LIMIT", 0)
    rng = np.random.default_rng(1)
    found = np.array([sharding.hypergeometric(rng, good, bad, drawn) for _ in range(6000)])
    for k in range(max(0, drawn - bad), min(drawn, good) + 1):
        p = math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn)
        assert abs((found == k).mean() - p) < 5 * math.sqrt(p * (1 - p) / 6000) + 0.001
    monkeypatch.undo()
    far = [sharding.hypergeometric(rng, 3 * 10**10, 7 * 10**10, 10**9) for _ in range(300)]
    assert abs(np.mean(far) - 3e8) < 5 * math.sqrt(1e9 * 0.21 / 300)


def test_every_row_has_one_place(spark):
    rows = [(i % 900, None if i % 7 == 0 else f"t{i % 5}", "en", None, i) for i in range(1003)] + [(None, "x" * 300_000, None, None, None)] * 3
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).select("*", *[F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in MORE.split(", "))])
    placed = sharding.shuffled_shards(docs, 8, 4)
    assert placed.columns == [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    got = placed.select("doc_id", "text", "n_chars", "shard", "slot").collect()
    assert sorted(repr((r.doc_id, r.text, r.n_chars)) for r in got) == sorted(repr((r[0], r[1], r[4])) for r in rows)
    for shard in range(8):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) in (125, 126)


def test_places_are_uniform(spark):
    docs = spark.range(400, numPartitions=4)
    found = np.array([[r.shard * 50 + r.slot for r in sharding.shuffled_shards(docs, 8, seed).orderBy("id").collect()] for seed in range(12)])
    assert all(sorted(row) == list(range(400)) for row in found)
    assert abs(np.corrcoef(np.tile(np.arange(400), 12), found.ravel())[0, 1]) < 5 / math.sqrt(4800)
    near = np.abs(np.diff(found, axis=1)) == 1  # rows that were neighbours stay so twice in 400
    assert near.mean() < 0.012


def test_shards_of_few_rows_and_of_none(spark, tmp_path):
    few = sharding.shuffled_shards(spark.range(3), 8).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert sharding.shuffled_shards(spark.createDataFrame([], SCHEMA)).collect() == []
    sharding.write_shards(spark.range(100), str(tmp_path / "shards"), 4, file_rows=10)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.groupBy("shard").count().where("count = 25").count() == 4


def test_large_shards_are_ordered_in_runs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN_ROWS", 16)
    got = sharding.shuffled_shards(spark.range(1000, numPartitions=3), 3, 1).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(3) for i in range(334 if s == 0 else 333)]


# --- filter audit -------------------------------------------------------------------------------


def audited(rows, labels):
    def fails(doc_id, text):
        x = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", x)
        return {
            c
            for c, bad in zip(
                "ABCDE",
                (
                    len(words) < 100,
                    100 * len(set(words)) < 80 * len(words),
                    100 * len(re.findall("[A-Z]", x)) > 10 * len(x),
                    bool(re.search(r"[#$%&*|]", x)),
                    doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == x for r in rows),
                ),
            )
            if bad
        }

    marks = {}
    for doc_id, quality, toxic in labels:
        if doc_id is not None:
            good, bad = marks.get(doc_id, (0, 0))
            marks[doc_id] = (max(good, quality == 1), max(bad, toxic == 1))
    out = {}
    parts = {}
    for doc_id, text, lang in rows:
        parts.setdefault(lang or "", []).append((fails(doc_id, text), marks.get(doc_id, (0, 0))))
    for part, docs in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, c in enumerate(order, 1):
                gone = [d for d in left if c in d[0]]
                left = [d for d in left if c not in d[0]]
                shapley[c] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(c in d[0] for d in docs) - len(gone), sum(d[0] == {c} for d in docs),
                    sum(d[1][0] for d in gone), sum(d[1][1] for d in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def audit_of(docs, labels):
    failed = filter_audit.failures(docs, filter_audit.text_conditions(F.col("text")), F.coalesce("lang", F.lit("")))
    return filter_audit.audit(failed, "ABCDE", labels, {"good_lost": F.col("quality") == 1, "toxic_lost": F.col("toxic") == 1})


@pytest.mark.parametrize("share", [256, 3])
def test_audit_against_every_order(spark, monkeypatch, share):
    monkeypatch.setattr(filter_audit, "SHARE_ROWS", share)
    rng = random.Random(share)
    long = " ".join(f"w{i}" for i in range(120))
    texts = [None, "", " \n\t", long, long.upper(), long + " #", "a b " * 60, "é\x85 " * 200, "Ab " * 150, long * 300]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(150)]
    rows += [rows[0]] * 3 + [(i + 100, "copied #", "fr") for i in range(60)]
    labels = [(rng.choice([None, *range(110)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    docs = docs.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in MORE.split(", "))])
    got = audit_of(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = audited(rows, labels)
    assert len(got) == len(want)
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step]


def test_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_of(spark.createDataFrame([], SCHEMA), none).collect() == []
    one = audit_of(spark.createDataFrame([(1, None, None, None, None)], SCHEMA), none)
    assert one.count() == 600 and one.where("good_lost + toxic_lost = 0 AND part = ''").count() == 600


# --- conversation repair ------------------------------------------------------------------------


def cheapest(codes):
    """Least (cost, audit) by trying the rows one after the other."""
    follows, nexts = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}, {0: 2, 1: 2, 2: 3, 3: 2}

    def with_puts(best):
        for _ in range(3):
            for s, (cost, text) in list(best.items()):
                found = (cost + 5, text + "I")
                best[nexts[s]] = min(best.get(nexts[s], found), found)
        return best

    best = with_puts({0: (0, "")})
    for code in codes:
        new = {}
        for s, (cost, text) in best.items():
            options = [(s, cost + 2, "D")]
            if code != "x":
                more = 5 if code.isupper() else 0
                options.append((nexts[s], cost + 1 + more, "R"))
                if s in follows.get(code.lower(), {}):
                    options.append((follows[code.lower()][s], cost + more, "K"))
            for to, c, letter in options:
                new[to] = min(new.get(to, (c, text + letter)), (c, text + letter))
        best = with_puts(new)
    return min(best[s] for s in (0, 3) if s in best)


@pytest.mark.parametrize("seed", range(4))
def test_edits_against_trying_all(seed):
    rng = random.Random(seed)
    for _ in range(400):
        letters = rng.choice(["xsuaoSUAO", "ua", "u", "suUa", "aA", "uax", "xo"])
        codes = "".join(rng.choice(letters) for _ in range(rng.randint(0, 90)))
        assert conversations.shortest_edits(codes) == cheapest(codes), codes


def test_long_conversations_are_repaired_in_proportion():
    rng = random.Random(1)
    for letters in ("u", "xsuaoSUAO", "aU"):
        codes = "".join(rng.choice(letters) for _ in range(20_000))
        cost, audit = conversations.shortest_edits(codes)
        assert len(audit.replace("I", "")) == len(codes)
        state, paid, at = 0, 0, 0
        for letter in audit:
            arcs = conversations.TAIL if at == len(codes) else conversations.ARCS[codes[at]]
            _, price, further, state = next(arc for arc in arcs[state] if arc[0] == letter)
            paid, at = paid + price, at + further
        assert paid == cost and at == len(codes) and state in (0, 3)


def report_of(turns):
    """The report by plain Python over (conv_id, turn, role, text)."""
    out, conversation_rows = {}, {}
    for conv, turn, role, text in turns:
        rows = conversation_rows.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        rule = zlib.crc32(name.encode()) % 20
        text = "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text
        rows += [(turn, "user" if rule == 4 else role, text)] * (0 if rule == 0 else 2 if rule == 3 else 1)
    for conv, rows in conversation_rows.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        count, codes, seen = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), "", set()
        for i, (_, role, text) in enumerate(rows):
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                count[fault] += 1
            count["illegal"] += i > 0 and rows[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "x" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        cost, audit = cheapest(codes)
        lines, legal, at = [], "", 0
        for letter in audit:
            due = "assistant" if legal.endswith("u") else "user"
            if letter in "KR":
                lines.append(f"{rows[at][1] if letter == 'K' else due}:{rows[at][2]}")
            elif letter == "I":
                lines.append(f"{due}:")
            at += letter != "I"
            if letter != "D":
                legal += lines[-1][0]
        assert re.fullmatch("(s?(ua)+)?", legal)
        turns_left = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns_left) - min(turns_left) + 1 - len(turns_left) if turns_left else 0
        out[conv] = (gaps, *count.values(), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_report_against_plain_python(spark):
    rng = random.Random(7)
    texts = [None, "", " \n", "Yes.", "No", "Well?\x0b ", "x" * 200_000, "é.\x85", "a\nb!", "..."]
    roles = [None, "", "user", "assistant", "system", "tool", "User"]
    turns = [
        (conv, rng.choice([None, rng.randint(-3, 2_000_000_000_000)]) if conv == 5 else i // rng.choice([1, 2]), rng.choice(roles[2:] * 3 + roles), rng.choice(texts + [f"t{i}."] * 8))
        for conv in [None, *range(40)]
        for i in range(rng.randint(1, 14))
    ]
    turns += turns[:9]
    docs = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(7)
    docs = docs.withColumns({"place": F.lit("x"), "fault": F.lit(1), "again": F.lit(1), "_text": F.lit(1), "_rule": F.lit(0)})
    report = conversations.repair_report(docs)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in report.collect()}
    assert got == report_of(turns)


def test_report_of_an_empty_table_and_of_dropped_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversations.repair_report(spark.createDataFrame([], schema)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = conversations.repair_report(spark.createDataFrame([(gone, 0, "user", "Yes.")], schema)).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
