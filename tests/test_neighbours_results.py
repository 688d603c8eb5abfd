"""Nearest documents against all pairs; result files of many shapes as one table."""

import math
import random
from collections import Counter

import pytest

from faultsift.operators import neighbours
from faultsift.sources import readers, writers


def all_pairs(vectors, k):
    out = {}
    for a, v in vectors.items():
        near = [(-round(sum(w * u.get(t, 0) for t, w in v.items()), 9), b) for b, u in vectors.items() if b != a and v.keys() & u.keys()]
        out[a] = sorted(near)[:k]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_nearest_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    texts = {i: Counter(f"t{min(int(rng.expovariate(0.15)), 60)}" for _ in range(rng.randint(1, 9))) for i in range(120)}
    texts |= {200 + i: texts[3] for i in range(25)} | {300: Counter(["alone"]), 301: Counter(["t0"]), 302: Counter(["t0", "t1"])}
    df = Counter(t for words in texts.values() for t in words)
    vectors = {}
    for i, words in texts.items():
        raw = {t: n * math.log(len(texts) / df[t]) for t, n in words.items()}
        size = math.sqrt(sum(w * w for w in raw.values()))
        vectors[i] = {t: w / size for t, w in raw.items()}
    weights = spark.createDataFrame([(i, t, w) for i, v in vectors.items() for t, w in v.items()], "doc long, term string, weight double")
    got = {i: [] for i in vectors}
    for r in neighbours.nearest(weights.repartition(5), "doc", 6).orderBy("doc", "rank").collect():
        got[r.doc].append((-round(r.similarity, 9), r.other))
    for i, want in all_pairs(vectors, 6).items():
        assert [b for _, b in got[i]] == [b for _, b in want], i
        assert all(abs(a - b) < 1e-8 for (a, _), (b, _) in zip(got[i], want))
    assert neighbours.nearest(weights.limit(0), "doc", 6).count() == 0


def test_pairs_stay_in_the_task_of_their_block(spark, monkeypatch):
    """All documents share a term; of the pairs only the best of a block leave its task."""
    monkeypatch.setattr(neighbours, "LEAST_ENTRIES", 100)
    monkeypatch.setattr(neighbours, "MOST_CELLS", 500)
    vectors = {i: {"all": 0.0 if i % 50 == 0 else 0.1, f"t{i % 7}": (i % 11) / 20, f"u{i % 13}": 0.5} for i in range(150)}
    weights = spark.createDataFrame([(i, t, w) for i, v in vectors.items() for t, w in v.items()], "doc long, term string, weight double")
    assert 150 * 3 < neighbours._met(weights.withColumnRenamed("doc", "id"), 3).count() <= 150 * 3 * 5
    got = {}
    for r in neighbours.nearest(weights, "doc", 3).orderBy("doc", "rank").collect():
        got.setdefault(r.doc, []).append(r.other)
    assert got == {i: [b for _, b in near] for i, near in all_pairs(vectors, 3).items()}


def test_result_files_of_many_shapes(spark, tmp_path):
    root = str(tmp_path / "results")
    schema = "data_setting string, project_name string, split string, map double, mrr double, reports long"
    rows = [("within", "a b+c", "test", 0.5, 0.25, 7), ("within", "a b+c", "train", 0.75, 1.0, 9), ("cross", "d", "test", 1.0, 1.0, 1)]
    table = spark.createDataFrame(rows, schema)
    writers.result_files(table, root)
    writers.result_files(table.where("split = 'train'"), root)  # again: replaces its folder only
    for name, text in {"e": "\n", "f": "map,reports\n1,2\n", "g": "note,mrr,map,reports\nx,1,2,3\n1,2\n\n,,x,4\n", "h": "map,mrr,reports\n"}.items():
        folder = tmp_path / "results" / "data_setting=within" / f"project_name={name}" / "split=test"
        folder.mkdir(parents=True)
        (folder / "part.csv").write_text(text)
    (tmp_path / "results" / "loose.csv").write_text("map,mrr,reports\n1,1,1\n")
    got = sorted(readers.result_files(spark, root).drop("file").collect(), key=repr)
    want = [(*r, None) for r in rows] + [
        ("within", "e", "test", None, None, None, "empty file"),
        ("within", "f", "test", None, None, None, "no column mrr"),
        ("within", "g", "test", 2.0, 1.0, 3, None),
        ("within", "g", "test", None, None, None, "wrong number of fields"),
        ("within", "g", "test", None, None, 4, "not a number"),
        ("within", "h", "test", None, None, None, "no rows"),
        (None, None, None, 1.0, 1.0, 1, None),
    ]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
