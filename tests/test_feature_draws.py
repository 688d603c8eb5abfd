"""Wrong files of the feature table: the hardest of each walk, found in the block where the walk starts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from faultsift.functions import text
from faultsift.operators import blocks, sampling, terms
from faultsift.plans import features

N = 2


def case(spark, many):
    """Reports that fixed few files, one file twice and, if `many`, more files than walks take along; some without words."""
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    day = lambda r: dt.datetime(2020, 1, 1) + dt.timedelta(days=9 * r)
    fixed = {r: rng.sample(range(40), r % 5 + 1) for r in range(14)} | {14: [1, 1]} | ({15: [*range(6, 30)], 16: [*range(39)], 17: [*range(40)]} if many else {})
    reports = spark.createDataFrame([(r, words(r % 4)) for r in fixed], "report_id long, raw_text string")
    touched = spark.createDataFrame([(r, f, day(r)) for r, own in fixed.items() for f in own], "report_id long, file long, report_time timestamp_ntz")
    sources = spark.createDataFrame([(f, words(f % 6) + f" class {words(1)} x") for f in range(40)], "file long, file_content string")
    return reports, touched, sources


@pytest.mark.parametrize("block, many", [(128, True), (4, True), (7, False)])
def test_wrong_files_are_the_hardest_of_the_draws(spark, monkeypatch, block, many):
    monkeypatch.setattr(blocks, "BLOCK_FILES", block)
    reports, touched, sources = case(spark, many)
    out = features.feature_table(reports, touched, sources, text.identifier_tokens, negatives=N)
    assert many or "flatten(collect_list(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = [r for r in out.collect()]
    tf = lambda df, key, column: terms.term_frequencies(df, [key], text.identifier_tokens(F.col(column)))
    drawn = sampling.sampled_wrong_files(touched.select("report_id", "file").distinct(), sources, 2 * N)
    names = sources.withColumn("names", text.class_name_text(F.col("file_content")))
    rights = {"a": tf(sources, "file", "file_content"), "b": tf(names, "file", "names")}
    pairs = drawn.select("report_id", F.col("candidate").alias("file")).distinct()
    sims = {(r.report_id, r.file): (r.a, r.b) for r in terms.pair_cosines(pairs, tf(reports, "report_id", "raw_text"), rights, ["report_id"], ["file"]).collect()}
    draws = {}
    for r in drawn.collect():
        draws.setdefault((r.report_id, r.file), []).append(r.candidate)
    want, twice = [], (14, 1)
    for (report, file), found in draws.items():
        times = 2 if (report, file) == twice else 1
        order = sorted(found * times, key=lambda c: (sims[report, c][0] is None, -(sims[report, c][0] or 0), c))[:N]
        want += [(report, c, *sims[report, c]) for c in order] * times**2
    rounded = lambda rows: sorted(str((r, f, a if a is None else round(a, 9) + 0.0, b if b is None else round(b, 9) + 0.0)) for r, f, a, b in rows)
    assert rounded((r.report_id, r.file, r.rVSM_similarity, r.classname_similarity) for r in got if r.match == 0) == rounded(want)
    own = sorted((r.report_id, r.file) for r in got if r.match == 1)
    assert set(own) == {tuple(r) for r in touched.select("report_id", "file").collect()} and len(want) > 60
