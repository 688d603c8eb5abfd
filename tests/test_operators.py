"""Operators on literal tables and against brute force."""

import datetime as dt
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from faultsift.functions import measures
from faultsift.operators import (
    graphs,
    history,
    interactions,
    ranking,
    running,
    sampling,
    scoring,
    skew,
    tables,
    terms,
)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# Running sums


@pytest.mark.parametrize("block", [1, 7, 1000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_equals_brute_force(spark, block, inclusive):
    rng = random.Random(block)
    data = [("h" if rng.random() < 0.4 else rng.choice("abc"), i, rng.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(data, "k string, o int, v int")
    out = running.running(
        df, ["k"], [F.col("o")], F.floor(F.col("o") / block), sums={"s": F.col("v")}, maxima={"m": F.col("v")},
        inclusive=inclusive, totals={"s": "t"},
    )
    expected = []
    for k, o, v in data:
        seen = [w for j, p, w in data if j == k and (p <= o if inclusive else p < o)]
        expected.append((k, o, sum(seen), max(seen) if seen else None, sum(w for j, _, w in data if j == k)))
    assert rows(out, "k", "o", "s", "m", "t") == sorted(expected, key=lambda r: (r[0], r[1]))
    no_total = running.running(
        df, ["k"], [F.col("o")], F.floor(F.col("o") / block), sums={"s": F.col("v")}, inclusive=inclusive
    )
    assert rows(no_total, "k", "o", "s") == sorted((r[0], r[1], r[2]) for r in expected)


def test_numbered_without_group(spark):
    df = spark.range(100).withColumn("h", F.md5(F.col("id").cast("string")))
    out = running.numbered(df, [], [F.col("h")], running.hash_block(F.col("h")), "n", total="size").orderBy("h").collect()
    assert [r.n for r in out] == list(range(1, 101)) and {r.size for r in out} == {100}


def test_score_blocks_follow_the_score(spark):
    df = spark.createDataFrame([(math.sin(i) ** 9,) for i in range(500)], "s double")
    out = running.with_score_block(df, "s", buckets=16).orderBy("s").collect()
    blocks = [r._block for r in out]
    assert blocks == sorted(blocks) and len(set(blocks)) > 8


# Skew


def test_hot_keys_are_bounded(spark):
    df = spark.createDataFrame([(k,) for k in "aaaabbbccd"], "k string")
    assert rows(skew.hot_keys(df, ["k"], min_rows=2), "k") == [("a",), ("b",), ("c",)]
    assert rows(skew.hot_keys(df, ["k"], min_rows=2, limit=1), "k") == [("a",)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_join(spark, how):
    big = spark.createDataFrame([(k, i) for i, k in enumerate("aaaaaabbbcdx")], "k string, i int")
    other = spark.createDataFrame([(k, n) for n, k in enumerate("aabcde")], "k string, n int")
    hot = skew.hot_keys(big, ["k"], min_rows=3)
    got = skew.skew_join(big, other, ["k"], hot, how, salts=4)
    assert rows(got, "k", "i", F.coalesce("n", F.lit(-1))) == rows(big.join(other, "k", how), "k", "i", F.coalesce("n", F.lit(-1)))


def test_skew_join_spreads_a_hot_key(spark):
    big = spark.range(4000).select(F.lit(1).alias("k"), "id")
    hot = skew.hot_keys(big, ["k"], min_rows=100)
    other = spark.createDataFrame([(1, "x")], "k int, v string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.skew_join(big, other, ["k"], hot, salts=16).withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in joined.groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 4000 and len(sizes) > 1


# Text similarity


def literal_cosine(a, b):
    """TF-IDF cosine fitted on two texts: smoothed idf, length one."""
    ca, cb = Counter(a), Counter(b)
    vocabulary = sorted(set(ca) | set(cb))
    idf = {t: math.log(3 / (1 + (t in ca) + (t in cb))) + 1 for t in vocabulary}
    va, vb = [ca[t] * idf[t] for t in vocabulary], [cb[t] * idf[t] for t in vocabulary]
    norm = math.sqrt(sum(x * x for x in va)) * math.sqrt(sum(x * x for x in vb))
    return sum(x * y for x, y in zip(va, vb)) / norm if norm else 0.0


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_pair_cosine(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(terms, "hot_keys", lambda df, keys: skew.hot_keys(df, keys, min_rows=hot_rows))
    rng = random.Random(3)
    texts = [["a", "b", "c"], ["b", "c", "d"], ["a", "a", "b"], ["a", "c"], ["x"], []]
    texts += [[rng.choice("abcdefg") for _ in range(rng.randrange(1, 12))] for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, ts array<string>")
    tf = terms.term_frequencies(docs, ["i"], F.col("ts"))
    pairs = docs.select("i").crossJoin(docs.select(F.col("i").alias("j")))
    got = terms.pair_cosine(pairs, tf, tf.withColumnRenamed("i", "j"), ["i"], ["j"]).collect()
    assert len(got) == len(texts) ** 2
    for r in got:
        if not texts[r.i] and not texts[r.j]:
            assert r.similarity is None
        else:
            assert math.isclose(r.similarity, literal_cosine(texts[r.i], texts[r.j]), abs_tol=1e-9)
            assert 0 <= r.similarity <= 1 + 1e-9


def test_corpus_weights(spark):
    docs = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["b"]), (3, ["c"]), (4, ["c", "a"])], "d int, ts array<string>")
    tf = terms.term_frequencies(docs, ["d"], F.col("ts"))
    weights = {(r.d, r.term): r.weight for r in terms.tfidf(tf, terms.idf_table(tf, docs)).collect()}
    assert math.isclose(weights[(1, "a")], math.log(3) * math.log(2))
    other = spark.createDataFrame([(9, "zzz", 1), (9, "b", 1)], "d int, term string, tf int")
    assert [r.term for r in terms.tfidf(other, terms.idf_table(tf, docs)).collect()] == ["b"]
    unit = terms.unit_tfidf(tf, terms.idf_table(tf, docs, 2), ["d"])
    assert all(math.isclose(r.length, 1.0) for r in terms.lengths(unit, ["d"]).collect())
    ids = {r.term: r.id for r in terms.vocabulary_ids(tf).collect()}
    assert ids == {"a": 2, "b": 3, "c": 4}


# History


TIMES = [dt.datetime(2009, 12, 30), dt.datetime(2010, 1, 31), dt.datetime(2010, 1, 31), dt.datetime(2010, 2, 1)]


def touched_table(spark):
    data = [(i + 1, "f", t) for i, t in enumerate(TIMES)] + [(4, "g", TIMES[3])]
    return spark.createDataFrame(data, "report_id int, file string, report_time timestamp_ntz")


def test_prior_activity(spark):
    out = history.prior_activity(touched_table(spark))
    assert rows(out.where("file = 'f'"), "report_id", "prior_count") == [(1, 0), (2, 1), (3, 1), (4, 3)]
    last = history.with_last_report(out, touched_table(spark)).where("report_id = 4 AND file = 'f'").first()
    assert last.last_report == 2 and last.last_time == TIMES[1]
    both = history.recency_and_frequency(touched_table(spark))
    assert rows(both, "file", "report_id", "bug_recency")[:4] == [("f", 1, 0.0), ("f", 2, 0.5), ("f", 3, 0.5), ("f", 4, 0.5)]
    assert rows(both.where("file = 'g'"), "bug_recency", "bug_frequency") == [(0.0, 0)]


def history_case(spark, seed):
    rng = random.Random(seed)
    start = dt.datetime(2019, 12, 28)
    time = {r: start + dt.timedelta(days=rng.randrange(12)) for r in range(40)}
    words = {r: [rng.choice("abcde") for _ in range(rng.randrange(0, 5))] for r in range(40)}
    pairs = sorted({(r, rng.choice("FGH")) for r in range(40) for _ in range(2)})
    touched = spark.createDataFrame([(r, f, time[r]) for r, f in pairs], "report_id int, file string, report_time timestamp_ntz")
    texts = spark.createDataFrame(list(words.items()), "report_id int, ts array<string>")
    return time, words, pairs, touched, terms.term_frequencies(texts, ["report_id"], F.col("ts"))


def test_collaborative_similarity(spark):
    time, words, pairs, touched, tf = history_case(spark, 5)
    got = {(r.report_id, r.file): r.collab_filter for r in history.collaborative_similarity(touched, tf).collect()}
    assert set(got) == set(pairs)
    for r, f in pairs:
        past = [w for p, g in pairs if g == f and time[p] < time[r] for w in words[p]]
        assert math.isclose(got[(r, f)], literal_cosine(words[r], past) if past else 0.0, abs_tol=1e-9)


def test_history_of_other_files(spark):
    time, words, pairs, touched, tf = history_case(spark, 6)
    asked_pairs = [(r, f) for r in range(0, 40, 3) for f in "FGHZ" if (r, f) not in pairs]
    asked = spark.createDataFrame([(r, f, time[r]) for r, f in asked_pairs], "report_id int, file string, report_time timestamp_ntz")
    similar = {(r.report_id, r.file): r.collab_filter for r in history.collaborative_similarity(touched, tf, asked).collect()}
    counts = {(r.report_id, r.file): r.prior_count for r in history.prior_activity(touched, asked).collect()}
    assert set(similar) == set(counts) == set(asked_pairs)
    for r, f in asked_pairs:
        prior = [p for p, g in pairs if g == f and time[p] < time[r]]
        past = [w for p in prior for w in words[p]]
        assert counts[(r, f)] == len(prior)
        assert math.isclose(similar[(r, f)], literal_cosine(words[r], past) if past else 0.0, abs_tol=1e-9)


def test_touches_and_previous_reports(spark):
    reports = spark.createDataFrame([("1", TIMES[0], ["a", "a", "b"]), ("2", TIMES[3], ["a"])], "id string, report_time timestamp_ntz, files array<string>")
    assert rows(history.touches(reports), "report_id", "file") == [("1", "a"), ("1", "b"), ("2", "a")]
    until = F.lit(TIMES[3].isoformat()).cast("timestamp_ntz")
    assert rows(history.previous_reports(history.touches(reports), F.lit("a"), until), "report_id") == [("1",)]


# Scores


def test_length_scores(spark):
    sizes = spark.createDataFrame([(0,), (10,), (20,), (30,)], "size int")
    got = rows(scoring.length_scores(sizes), "size", F.round("length_score", 6))
    assert got == [(0, 0.0), (10, 0.753376), (20, 0.903209), (30, 0.966108)]
    low = spark.createDataFrame([(100,)] * 20 + [(1,)], "size int")
    assert set(rows(scoring.length_scores(low), "size", F.round("length_score", 6))) == {(100, 0.961888), (1, 0.5)}
    high = spark.createDataFrame([(10,)] * 20 + [(1000,)], "size int")
    assert set(rows(scoring.length_scores(high), "size", F.round("length_score", 6))) == {(10, 0.521256), (1000, 1.0)}


def test_min_max_rules(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0), ("a", 3.0, 3.0)], "q string, x double, y double")
    assert rows(scoring.min_max(df, ["q"], ["x", "y"]), "x", "y") == [(0.0, 3.0), (1.0, 3.0)]
    assert rows(scoring.min_max(df, ["q"], ["y"], 1.0), "x", "y") == [(1.0, 1.0), (3.0, 1.0)]


def test_synthesized(spark):
    direct = spark.createDataFrame([(1, "A", 2.0), (1, "B", 1.0)], "report_id int, key string, score double")
    indirect = spark.createDataFrame([(1, "B", 5.0), (1, "C", 4.0)], "report_id int, key string, score double")
    assert rows(scoring.synthesized(direct, indirect), "key", "score") == [("A", 1.0), ("B", 0.2)]


def test_indirect_scores_leave_the_report_itself_out(spark):
    similar = spark.createDataFrame([(1, 1, 9.0), (1, 2, 0.5), (1, 3, 0.7)], "report_id int, other_id int, similarity double")
    fixes = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (3, "B")], "report_id int, key string")
    assert rows(scoring.indirect_scores(similar, fixes), "report_id", "key", "score") == [(1, "A", 0.7), (1, "B", 0.7)]
    pools = spark.createDataFrame([(1, "A"), (2, "B")], "report_id int, key string")
    assert rows(scoring.links(pools, fixes), "report_id", "other_id") == [(1, 2), (1, 3), (2, 3)]


# Ranking


def scored_table(spark, queries):
    data = [(q, i, float(s), m) for q, cands in queries.items() for i, (s, m) in enumerate(cands)]
    return spark.createDataFrame(data, "query_id string, candidate_id int, score double, match int")


def test_average_precision(spark):
    df = scored_table(
        spark,
        {"t": [(0.9, 0), (0.8, 1), (0.8, 0), (0.1, 1)], "none": [(1, 0)], "lead": [(3, 1), (2, 1), (1, 0)]},
    )
    got = {r.query_id: r.average_precision for r in ranking.average_precision(df, ["query_id"]).collect()}
    assert math.isclose(got["t"], 0.416667, abs_tol=1e-6) and got["none"] == 0 and got["lead"] == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_rank_measures_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    queries = {f"q{i}": [(rng.randrange(8) / 4, int(rng.random() < 0.2)) for _ in range(rng.randrange(1, 40))] for i in range(12)}
    df = scored_table(spark, queries).repartition(4)
    precision = {r.query_id: r.average_precision for r in ranking.average_precision(df, ["query_id"], buckets=3).collect()}
    first = {r.query_id: r.first_rank for r in ranking.first_rank(df, ["query_id"], "candidate_id").collect()}
    ranks = {(r.query_id, r.candidate_id): r.rank for r in ranking.positive_ranks(df, ["query_id"], "candidate_id").collect()}
    places = {(r.query_id, r.candidate_id): r["rank"] for r in ranking.full_ranking(df, ["query_id"], "candidate_id").collect()}
    top = Counter(r.query_id for r in ranking.top_k(df, ["query_id"], "candidate_id", 3).collect())
    for q, cands in queries.items():
        total = sum(m for _, m in cands)
        ap = sum(
            sum(m for s, m in cands if s == t) * sum(m for s, m in cands if s >= t) / sum(s >= t for s, _ in cands)
            for t in {s for s, _ in cands}
        ) / total if total else 0
        assert math.isclose(precision[q], ap, abs_tol=1e-9)
        order = sorted(range(len(cands)), key=lambda i: (-cands[i][0], i))
        hits = [n + 1 for n, i in enumerate(order) if cands[i][1]]
        assert first[q] == (hits[0] if hits else None)
        assert [places[(q, i)] for i in order] == list(range(1, len(order) + 1))
        assert top[q] == min(3, len(cands))
        for i, (s, m) in enumerate(cands):
            if m:
                assert ranks[(q, i)] == 1 + sum(t >= s for t, n in cands if not n)


def test_hit_at_k_with_few_candidates(spark):
    df = scored_table(spark, {"q": [(3, 0), (2, 0), (1, 1)]})
    ranks = ranking.first_rank(df, ["query_id"], "candidate_id")
    hits = {r.k: r.hits for r in ranking.hit_at_k(ranks).collect()}
    assert hits[1] == hits[2] == 0 and all(hits[k] == 1 for k in range(3, 21))
    values = [hits[k] for k in sorted(hits)]
    assert values == sorted(values)


def test_no_match_has_no_reciprocal_rank(spark):
    df = scored_table(spark, {"a": [(1, 0), (2, 0)], "b": [(1, 1)]})
    ranks = ranking.first_rank(df, ["query_id"], "candidate_id")
    assert ranking.mean_reciprocal_rank(ranks).first().mrr == 0.5


def test_pessimistic_ranks_and_margin(spark):
    df = scored_table(spark, {"q": [(5, 0), (3, 1), (3, 0), (1, 0)]})
    assert ranking.pessimistic_rank(df, ["query_id"]).first()["rank"] == 3
    pos = scored_table(spark, {"q": [(0.4, 1), (0.9, 0), (0.4, 0), (0.1, 0)]})
    assert ranking.positive_ranks(pos, ["query_id"], "candidate_id").first()["rank"] == 3
    loss = ranking.margin_loss(scored_table(spark, {"q": [(1, 1), (0.5, 0), (0.9, 0), (0.2, 0)]}), ["query_id"], 0.25).first()
    assert math.isclose(loss.loss, 0.0500007, abs_tol=1e-6) and loss.pairs == 3


def test_path_precision(spark):
    ranked = spark.createDataFrame([("r", 1, "a/X.java"), ("r", 2, "b/Y.java"), ("r", 3, "c/Z.java"), ("s", 1, "a/X.java")], "q string, rank int, file string")
    fixes = spark.createDataFrame([("r", ["Y.java", "Z.java"]), ("s", ["Q.java"])], "q string, fixes array<string>")
    got = rows(ranking.path_precision(ranked, fixes, ["q"]), "q", F.round("average_precision", 6), "first_pos")
    assert got == [("r", 0.583333, 2), ("s", 0.0, -1)]


# Sampling


def test_wrong_files(spark):
    rng = random.Random(1)
    files = [f"f{i}" for i in range(40)]
    fixed = {r: rng.sample(files, n) for r, n in enumerate([1, 2, 5, 30, 37, 40])}
    positives = spark.createDataFrame([(r, f) for r, fs in fixed.items() for f in fs], "report_id int, file string")
    sources = spark.createDataFrame([(f,) for f in files], "file string")
    drawn = defaultdict(list)
    for r in sampling.sampled_wrong_files(positives, sources, 4).collect():
        drawn[(r.report_id, r.file)].append((r.draw, r.candidate))
    for r, fs in fixed.items():
        for f in fs:
            got = sorted(drawn[(r, f)])
            assert [d for d, _ in got] == list(range(1, min(4, 40 - len(fs)) + 1))
            names = {c for _, c in got}
            assert len(names) == len(got) and not names & set(fs)
    again = sampling.sampled_wrong_files(positives.repartition(3), sources.repartition(5), 4).collect()
    assert sorted(map(tuple, again)) == sorted((r, f, c, d) for (r, f), v in drawn.items() for d, c in v)


def test_every_file_is_drawn(spark):
    positives = spark.range(400).select(F.col("id").alias("report_id"), F.lit("f0").alias("file"))
    sources = spark.range(50).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"))
    counts = sampling.sampled_wrong_files(positives, sources, 5).groupBy("candidate").count().collect()
    assert len(counts) == 49 and min(r["count"] for r in counts) > 5


def candidates(spark):
    data = [("a", i, int(i == 3)) for i in range(12)] + [("b", i, 0) for i in range(12)] + [("c", i, int(i == 0)) for i in range(10)]
    return spark.createDataFrame(data, "bug string, cid int, match int")


def test_ranking_samples(spark):
    out = sampling.ranking_samples(candidates(spark), "bug", "cid", 10)
    assert Counter((r.bug, r.match) for r in out.collect()) == {("a", 1): 1, ("a", 0): 10}
    assert rows(sampling.skipped_bugs(candidates(spark), "bug", 10), "reason", "n") == [("no positive", 1), ("too few negatives", 1)]


def test_first_negatives(spark):
    out = sampling.positives_and_negatives(candidates(spark), "bug", [F.col("cid")], 2)
    assert rows(out.where("bug = 'a'"), "cid", "match") == [(0, 0), (1, 0), (3, 1)]


def test_folds(spark):
    out = sampling.folds(spark.range(10), [F.col("id")], F.floor(F.col("id") / 3), 3)
    assert Counter(r.fold for r in out.collect()) == {0: 4, 1: 4, 2: 2}


def test_ordered_split(spark):
    out = sampling.ordered_split(spark.range(7), [F.col("id")], F.col("id"), 0.4)
    assert rows(out, "id", "split") == [(i, "train" if i < 4 else "test") for i in range(7)]
    split = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "test")], "bug string, split string")
    both = sampling.split_members(candidates(spark), split, "bug")
    assert Counter((r.bug, r.split) for r in both.collect()) == {("a", "train"): 12, ("a", "test"): 12, ("b", "test"): 12}


def test_oversampled_and_flags(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "i int, match int")
    assert sampling.oversampled(df).count() == 12
    flagged = sampling.every_nth(spark.range(120), [F.col("id")], F.floor(F.col("id") / 10))
    assert rows(flagged.where("flag"), "id") == [(0,), (51,), (102,)]


def test_samples_and_shuffles_repeat(spark):
    tables_ = [spark.range(20).withColumn("t", F.lit(t)) for t in "ab"]
    first = sampling.equal_share_sample(tables_, ["t", "id"], 10)
    assert rows(first, "t", "id") == rows(sampling.equal_share_sample(tables_, ["t", "id"], 10), "t", "id")
    assert Counter(r.t for r in first.collect()) == {"a": 5, "b": 5}
    order = [r.id for r in sampling.shuffled(spark.range(50), "1", ["id"]).collect()]
    assert order != sorted(order) and sorted(order) == list(range(50))


# Tables


def test_tables(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), ("b", 1, "y")], "k string, o int, v string")
    assert rows(tables.first_by(df, ["k"], [F.col("o")]), "k", "o", "v") == [("a", 1, "x"), ("b", 1, "y")]
    assert tables.null_audit(df).first().asDict() == {"k": False, "o": False, "v": True}
    members = spark.createDataFrame([("a",), ("a",)], "k string")
    assert tables.keep(df, members, ["k"]).count() == 2 and tables.without(df, members, ["k"]).count() == 1
    aligned = tables.align(df.select("k", "o"), spark.createDataFrame([("c", 5)], "k string, n int"), ["k"], [F.col("o")])
    assert rows(aligned, "k", F.coalesce("o", F.lit(0)), F.coalesce("n", F.lit(0))) == [("a", 1, 0), ("b", 1, 0), ("c", 0, 5)]
    commons = spark.createDataFrame([("a", 2), ("a", 2), ("a", 1), ("b", 3), ("b", 1)], "k string, v int")
    assert rows(tables.most_common(commons, ["k"], "v"), "k", "v", "n") == [("a", 2, 2), ("b", 1, 1)]
    scores = spark.createDataFrame([("a", 0.5)], "k string, score double")
    assert rows(tables.with_default(members.distinct().union(df.select("k").where("k = 'b'")), scores, ["k"], "score"), "k", "score") == [("a", 0.5), ("b", 0.0)]
    merged = tables.union_projects({"p": members, "q": members})
    assert Counter(r.project_name for r in merged.collect()) == {"p": 2, "q": 2}


def test_cid_repeats_across_projects(spark):
    features = spark.createDataFrame([("p", 1, "r"), ("q", 1, "s")], "project_name string, cid int, report_id string")
    contents = spark.createDataFrame([("p", 1, "P"), ("q", 1, "Q")], "project_name string, cid int, file_content string")
    assert rows(tables.with_content(features, contents), "report_id", "file_content") == [("r", "P"), ("s", "Q")]


# Interactions


def test_matrix(spark):
    samples = spark.createDataFrame([(1, ["a", "b"], ["b", "c", "zz"])], "s int, q array<string>, c array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "token string, vector array<double>")
    idf = spark.createDataFrame([("a", 2.5)], "term string, idf double")
    cells = interactions.matrix(samples, ["s"], F.col("q"), F.col("c"), vectors, idf)
    assert rows(cells, "c_pos", "q_pos", F.round("sim", 4), "idf") == [
        (0, 0, 0.0, 2.5), (0, 1, 1.0, 1.0), (1, 0, 0.7071, 2.5), (1, 1, 0.7071, 1.0), (2, 0, 0.0, 2.5), (2, 1, 0.0, 1.0),
    ]
    arrays = {r.c_pos: r.row for r in interactions.matrix_rows(cells, ["s"], 3).collect()}
    assert arrays[0] == [0.0, 2.5, 1.0, 1.0, 0.0, 0.0] and len(arrays) == 3
    core = interactions.core_terms(spark.createDataFrame([("c",), (" b ",), ("",), ("b",)], "word string"))
    ids = interactions.core_term_ids(samples, ["s"], F.col("c"), core)
    assert rows(ids, "pos", "id") == [(0, 2), (1, 3), (2, 1)]
    assert interactions.padded_terms(ids, ["s"], 5).first().core_terms == [2, 3, 1, 0, 0]
    assert interactions.fitting(samples, "q", "c", 2, 2).count() == 0
    assert interactions.truncated(samples, "q", "c", 1, 2).first().c == ["b", "c"]


# Graphs


def test_links(spark):
    data = [("d", 0, "a", True), ("d", 1, "b", False), ("d", 2, "a", False), ("d", 3, "a", True), ("d", 4, "a", False)]
    tokens = spark.createDataFrame(data, "doc_hash string, idx bigint, token string, is_def boolean")
    linked = graphs.linked_uses(tokens)
    assert [r.src for r in linked.orderBy("idx").collect()] == [None, None, 0, 0, 3]
    entries = graphs.pruned(graphs.entries_from_links(linked))
    nodes = graphs.nodes(entries)
    assert rows(nodes, "node_idx", "idx") == [(0, 0), (1, 2), (2, 3), (3, 4)]
    edges = graphs.edges(entries, nodes)
    assert rows(edges, "src", "dst") == [(0, 1), (0, 2), (2, 3)]
    few, arrows = graphs.capped(nodes, edges, 3)
    assert few.count() == 3 and rows(arrows, "src", "dst") == [(0, 1), (0, 2)]


def test_links_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(graphs, "POSITION_BLOCK", 3)
    test_links(spark)


def test_merged_entries(spark):
    data = [("d", 1, "x", "comesFrom", ["b"], [4, 2]), ("d", 1, "x", "comesFrom", ["a", "b"], [2]), ("d", 1, "x", "computedFrom", [], [])]
    entries = spark.createDataFrame(data, "doc_hash string, idx int, token string, relation string, names array<string>, src_idx array<int>")
    merged = graphs.merged_entries(entries)
    assert rows(merged, "relation", "names", "src_idx") == [("comesFrom", ["a", "b"], [2, 4]), ("computedFrom", [], [])]


def test_pair_cosine_formula_is_one_for_equal_texts(spark):
    ones = [F.lit(float(v)) for v in (5, 5, 5, 5, 5)]
    assert math.isclose(spark.range(1).select(measures.pair_cosine(*ones).alias("c")).first().c, 1.0)


@pytest.mark.parametrize("n", [1, 3, 12, 60])
def test_wrong_files_of_reports_that_fixed_few_or_many(spark, n):
    """The first n files of the walk that the report did not fix; n = 1 sends most reports the long way."""
    import hashlib

    files = [f"f{i}" for i in range(40)]
    fixed = {1: files[:2], 2: files[5:30], 3: files, 4: files[:39], 5: files[7:12]}
    positives = spark.createDataFrame([(r, f) for r, fs in fixed.items() for f in fs], "report_id long, file string")
    sources = spark.createDataFrame([(f,) for f in files * 2], "file string")
    got = {}
    for r in sampling.sampled_wrong_files(positives, sources, n).collect():
        got.setdefault((r.report_id, r.file), []).append((r.draw, r.candidate))
    order = sorted(files, key=lambda f: (hashlib.md5(f"0|{f}".encode()).hexdigest(), f))
    want = {}
    for r, fs in fixed.items():
        for f in fs:
            start = int(hashlib.md5(f"0|{r}|{f}".encode()).hexdigest()[:13], 16) % 40
            free = [x for x in order[start:] + order[:start] if x not in fs][:n]
            if free:
                want[r, f] = list(enumerate(free, 1))
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize("products", [1 << 21, 7])
def test_block_similarities_against_pair_cosines(spark, monkeypatch, products):
    import random

    from faultsift.operators import blocks

    monkeypatch.setattr(blocks, "MOST_PRODUCTS", products)
    monkeypatch.setattr(blocks, "SHARE_ROWS", 40)
    rng = random.Random(products)
    tf = "i string, term string, tf long"
    files = [f"f{i:03d}" for i in range(300)]
    reports = [(f"r{r}", f"t{t}", rng.randint(1, 4)) for r in range(30) for t in rng.sample(range(60), rng.randint(0, 9))]
    texts = [[(f, f"t{t}", rng.randint(1, 3)) for f in files for t in rng.sample(range(50), rng.randint(0, k))] for k in (8, 2)]
    report_tf = spark.createDataFrame(reports, tf).withColumnRenamed("i", "report_id")
    parts = [spark.createDataFrame(rows, tf).withColumnRenamed("i", "file") for rows in texts]
    placed = sampling.circle(spark.createDataFrame([(f,) for f in files], "file string"))
    ids = blocks.term_numbers(parts)
    asked = [(f"r{r}", b, sorted(rng.sample(range(128 * b, min(300, 128 * b + 128)), 9))) for r in range(33) for b in range(3)]
    questions = spark.createDataFrame(asked, "report_id string, block long, places array<long>")
    questions = questions.join(blocks.report_arrays(report_tf, ids), "report_id", "left")
    got = blocks.block_similarities(questions, blocks.file_blocks(placed, parts, ids), placed, 2)
    got = got.select("report_id", F.inline("answers")).collect()
    names = {r.place: r.file for r in placed.collect()}
    pairs = spark.createDataFrame([(r, names[p]) for r, _, places in asked for p in places], "report_id string, file string")
    want = {(r.report_id, r.file): (r.s0, r.s1) for r in terms.pair_cosines(pairs, report_tf, {"s0": parts[0], "s1": parts[1]}, ["report_id"], ["file"]).collect()}
    assert len(got) == len(want) == 33 * 27
    for r in got:
        for a, b in zip(r.sims, want[r.report_id, r.file]):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-12)


@pytest.mark.parametrize("weighted", [False, True])
def test_history_by_file_equals_history_by_term(spark, monkeypatch, weighted):
    """Files that span batches, moments that do, repeated touches, missing times and reports without terms."""
    rng = random.Random(3)
    start = dt.datetime(2020, 12, 20)
    drawn = [(rng.randrange(60), rng.choice("FGH"), start + dt.timedelta(days=rng.randrange(30))) for _ in range(150)]
    schema = "report_id int, file string, report_time timestamp_ntz"
    touched = spark.createDataFrame(drawn + drawn[:20] + [(1, "F", None), (2, None, start), (None, "F", start)], schema)
    asked = spark.createDataFrame([(r, f, start + dt.timedelta(days=r)) for r in range(30) for f in "FZ"], schema) if weighted else None
    tf = spark.createDataFrame([(r, w, rng.randrange(1, 4)) for r in range(55) for w in rng.sample("abcdefg", 4)], "report_id int, term string, tf bigint")
    results = []
    for batch, hot in ((7, 1_000_000), (1_000, 1_000_000), (7, 60), (1_000, 1)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        monkeypatch.setattr(history, "hot_keys", lambda df, keys, n=hot: skew.hot_keys(df, keys, n))
        found = history.collaborative_similarity(touched, tf, asked).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        results.append(sorted((str(r.report_id), str(r.file), str(r.report_time), round(r.collab_filter, 12)) for r in found))
    assert results[0] == results[1] == results[2] == results[3]
    assert any(r[3] > 0 for r in results[0])


def test_terms_of_touches_are_not_shuffled(spark):
    """A touch travels as one row, whatever its report has of terms."""
    _, _, _, touched, tf = history_case(spark, 5)
    found = history.collaborative_similarity(touched, tf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file" in found and "term" not in "".join(line for line in found.splitlines() if "hashpartitioning(file" in line)


def test_blocks_of_samples_equal_joined_pairs(spark, monkeypatch):
    """Samples of equal keys, words with several vectors, none or one with gaps, null words and lists."""
    rng = random.Random(11)
    words = [*"abcdefgh", None]
    drawn = [(s, [rng.choice(words) for _ in range(rng.randrange(5))], [rng.choice(words) for _ in range(rng.randrange(6))]) for s in [*range(20), 3, 3, 4, None]]
    samples = spark.createDataFrame([*drawn, (50, None, ["a"]), (51, ["a"], None)], "s int, q array<string>, c array<string>")
    held = [("a", [1.0, 2.0]), ("a", [0.5, -1.0]), ("b", [2.0, 1.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [1.0, None]), ("f", [3.0, 1.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(held, "token string, vector array<double>")
    idf = spark.createDataFrame([("a", 2.5), ("d", 3.0), ("f", None), ("h", 0.5)], "term string, idf double")
    pairs = interactions.token_pairs(samples, ["s"], F.col("q"), F.col("c"))
    joined = pairs.join(interactions.word_similarity(pairs, vectors), ["q_token", "c_token"], "left").join(idf.withColumnRenamed("term", "q_token"), "q_token", "left")
    expected = joined.select("s", "c_pos", "q_pos", "q_token", "c_token", F.coalesce("sim", F.lit(0.0)).alias("sim"), F.coalesce("idf", F.lit(1.0)).alias("idf"))
    shown = ["s", "c_pos", "q_pos", "q_token", "c_token", F.round("sim", 9).alias("sim"), "idf"]
    listing = lambda df: sorted(map(tuple, df.select(*shown).collect()), key=repr)
    for size, most in ((3, 1 << 18), (100, 4)):
        monkeypatch.setattr(interactions, "BLOCK_SAMPLES", size)
        monkeypatch.setattr(interactions, "MOST_CELLS", most)
        args = (samples, ["s"], F.col("q"), F.col("c"), vectors, idf)
        assert listing(interactions.matrix(*args)) == listing(expected)
        rounded = lambda df: sorted((str(r.s), r.c_pos, [round(x, 9) for x in r.row]) for r in interactions.matrix_rows(df, ["s"], 9).collect())
        assert rounded(interactions.listed_matrix(*args)) == rounded(expected)
    found = interactions.matrix(*args)._jdf.queryExecution().executedPlan().toString()
    assert "q_token" not in "".join(line for line in found.splitlines() if "Exchange" in line)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_dense_cosine_in_cells_equals_joins(spark, kind):
    """Repeated keys on either side, missing keys, vectors with gaps, none, of no length or of other sizes."""
    from faultsift.functions import arrays

    rng = random.Random(5)
    vector = lambda k: [None, [0.0, 0.0], [1.0, None], [1.0], [float("nan"), 1.0]][k] if k < 5 else [rng.uniform(-1, 1), rng.uniform(-1, 1)]
    left = spark.createDataFrame([(k, vector(k)) for k in [*range(20), 7, 7, 8]], "a int, vector array<float>")
    right = spark.createDataFrame([(str(k), vector(k)) for k in [*range(20), 9, 9]] + [(None, [1.0, 1.0])], "b string, vector array<float>")
    drawn = [(rng.randrange(22), str(rng.randrange(22)), i) for i in range(300)] + [(None, "1", 0), (1, None, 0), (7, "9", 1), (7, "9", 1)]
    pairs = spark.createDataFrame(drawn, "a int, b string, more int")
    right, pairs = (df.withColumn("b", F.col("b").cast(kind)) for df in (right, pairs))
    sides = [df.withColumnsRenamed({"vector": f"v{i}"}) for i, df in enumerate((left, right))]
    expected = pairs.join(sides[0], "a").join(sides[1], "b").withColumn("cosine", arrays.cosine(F.col("v0"), F.col("v1"))).drop("v0", "v1")
    got = scoring.dense_cosine(pairs, left, right, ["a"], ["b"])
    assert got.columns == expected.columns
    listing = lambda df: sorted(((r.a, r.b, r.more, r.cosine if r.cosine is None else round(r.cosine, 9)) for r in df.collect()), key=repr)
    assert repr(listing(got)) == repr(listing(expected))
    found = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Join" not in found and found.count("Exchange hashpartitioning") == 1
