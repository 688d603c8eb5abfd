"""Walks over the circle of files start from rows that are made once."""

import hashlib

from faultsift.operators import sampling


def digits(*keys):
    return int(hashlib.md5("|".join(["0", *map(str, keys)]).encode()).hexdigest()[:13], 16)


def test_draws_equal_plain_walks(spark, monkeypatch):
    n, names = 3, [*range(40)]
    # Reports that fixed few files, files off the circle, the same file twice, more than 3 n files, all files.
    touched = [(r, (r * 7 + i * 3) % 43) for r in range(12) for i in range(r % 4 + 1)] + [(20, f) for f in [*range(11), 41]]
    touched += [(21, f) for f in names] + [(22, f) for f in range(36)] + [(23, 1), (23, 1), (None, 2)]
    positives = spark.createDataFrame(touched, "report_id long, file long")
    files = spark.createDataFrame([(f,) for f in names + names[:5]], "file long")
    kept, plain = [], sampling.stage
    monkeypatch.setattr(sampling, "stage", lambda df, *name: kept.append(name) or plain(df, *name))
    got = {}
    for r in sampling.sampled_wrong_files(positives, files, n).collect():
        got.setdefault((r.report_id, r.file), []).append((r.draw, r.candidate))
    circle = sorted(names, key=lambda f: (hashlib.md5(f"0|{f}".encode()).hexdigest(), f))
    want = {}
    for report, file in touched:
        if report is None:
            continue
        own, start = {f for r, f in touched if r == report}, digits(report, file) % len(circle)
        walked = [circle[(start + s) % len(circle)] for s in range(len(circle))]
        want.setdefault((report, file), []).extend(enumerate([f for f in walked if f not in own][:n], 1))
    assert {k: sorted(set(v)) for k, v in got.items()} == {k: sorted(set(v)) for k, v in want.items() if v}
    assert len(got[20, 0]) == n and (21, 0) not in got and len(got[23, 1]) == 2 * n
    assert kept.count(("positives",)) == 1
