"""Readers, writers and composed plans."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from test_operators import literal_cosine

from faultsift.functions import text
from faultsift.operators import models, ranking
from faultsift.plans import datasets, evaluation, features, localization
from faultsift.session import scratch_path, shared_dir, stage
from faultsift.sources import readers, schemas, writers


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


class ClusterSession:
    """A session of a cluster, as far as the choice of the folder asks."""

    def __init__(self, folder):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master = "yarn"

    def getCheckpointDir(self):
        return None


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_dir(ClusterSession("hdfs:///shared")) == "hdfs:///shared"
    assert scratch_path(ClusterSession("hdfs:///shared"), "x").startswith("hdfs:///shared/x-")
    with pytest.raises(RuntimeError):
        shared_dir(ClusterSession(None))
    assert shared_dir(spark) == shared_dir(spark)
    staged = stage(spark.range(3).withColumn("x", F.col("id") * 2))
    assert rows(staged, "id", "x") == [(0, 0), (1, 2), (2, 4)]


def test_reports_from_text(spark, tmp_path):
    file = tmp_path / "r.txt"
    file.write_text(
        "id\tbug_id\tcommit\tsummary\tdescription\treport_time\tfiles\n"
        '1\t10\tabc\tCrash\t"two\nlines ""quoted"""\t2010-01-31 10:00:00\ta//B.java x/../C.java\n'
        "2\t11\tdef\tSlow\t\t2010-02-01 00:00:00\t\n"
    )
    got = readers.reports(spark, str(file), "p").orderBy("id").collect()
    assert got[0].raw_text == 'Crashtwo\nlines "quoted"' and got[0].files == ["a/B.java", "C.java"]
    assert got[0].report_time == dt.datetime(2010, 1, 31, 10) and got[0].project_name == "p"
    assert got[1].raw_text == "Slow" and got[1].files == []


def test_source_tree(spark, tmp_path):
    for name, content in {"a/B.java": "class B {}", "a/c d/E+F.java": "x\ny", "n.txt": "no"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    assert rows(readers.source_tree(spark, str(tmp_path)), "file", "file_content") == [
        ("a/B.java", "class B {}"), ("a/c d/E+F.java", "x\ny"),
    ]


def test_text_tables(spark, tmp_path):
    lines = tmp_path / "lines.txt"
    lines.write_text("1\tint a\tb\n2\tx\nno tab\n")
    assert rows(readers.keyed_text(spark, str(lines)), "id", "text") == [("1", "int a\tb"), ("2", "x")]
    assert [r.line for r in readers.unkeyed_text(spark, str(lines)).collect()] == ["no tab"]
    table = tmp_path / "t.csv"
    table.write_text("b,a\n1,x\n")
    assert readers.as_text(spark, str(table), ["b", "a"]).first().asDict() == {"b": "1", "a": "x"}
    local = readers.local_table(spark, [("b1", 1, "1", "c", "p")], schemas.CID_TO_BUG)
    assert local.first().match == "1"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("s", "p", "train", 1), ("s", "p", "test", 2)], "data_setting string, project_name string, split string, n int")
    writers.data_set(df, str(tmp_path / "d"))
    assert (tmp_path / "d/data_setting=s/project_name=p/split=test").is_dir()
    assert rows(readers.table(spark, str(tmp_path / "d")).where("split = 'test'"), "n") == [(2,)]
    writers.data_set(df, str(tmp_path / "d"))
    assert readers.table(spark, str(tmp_path / "d")).count() == 2
    scored = spark.createDataFrame([("q", "c", 0.5)], "query_id string, candidate_id string, score double")
    writers.scores(scored, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).first().value == "q c 0.5"
    assert rows(writers.missing_from(spark.range(4), spark.range(2), ["id"]), "id") == [(2,), (3,)]
    samples = spark.createDataFrame([(1, ["a"], ["b", "c"])], "key int, report_tokens array<string>, code_tokens array<string>")
    assert rows(writers.corpus(samples, samples), "split", "side") == [("test", "code"), ("test", "report"), ("train", "code"), ("train", "report")]


def small_case(spark):
    times = {i: dt.datetime(2020, 1 + i, 1) for i in range(6)}
    texts = {0: "alpha crash", 1: "beta slow", 2: "alpha beta", 3: "gamma Foo", 4: "alpha", 5: "gamma gamma"}
    fixed = {0: ["f0"], 1: ["f0", "f1"], 2: ["f0"], 3: ["f2", "gone"], 4: ["f1"], 5: ["f2"]}
    code = {f"f{i}": f"x class Foo{i} alpha {'gamma ' * i} z" for i in range(9)}
    reports = spark.createDataFrame([(i, t) for i, t in texts.items()], "report_id int, raw_text string")
    touched = spark.createDataFrame([(r, f, times[r]) for r, fs in fixed.items() for f in fs], "report_id int, file string, report_time timestamp_ntz")
    sources = spark.createDataFrame(list(code.items()), "file string, file_content string")
    return times, texts, fixed, code, reports, touched, sources


def words(s):
    import re

    return [w.lower() for part in re.findall("[A-Za-z]+", s) for w in re.findall("[A-Z]+(?![a-z])|[A-Z]?[a-z]+", part)]


def test_feature_table(spark):
    times, texts, fixed, code, reports, touched, sources = small_case(spark)
    for inherit in (True, False):
        got = features.feature_table(reports, touched, sources, text.identifier_tokens, negatives=2, inherit=inherit).collect()
        matches = {(r.report_id, r.file): r for r in got if r.match == 1}
        assert set(matches) == {(r, f) for r, fs in fixed.items() for f in fs if f != "gone"}
        assert len(got) == 3 * len(matches)
        for r in got:
            assert (r.file in fixed[r.report_id]) == (r.match == 1)
            assert math.isclose(r.rVSM_similarity, literal_cosine(words(texts[r.report_id]), words(code[r.file])), abs_tol=1e-9)
            names = words(code[r.file].split(" class ")[1].split(" ")[0])
            assert math.isclose(r.classname_similarity, literal_cosine(words(texts[r.report_id]), names), abs_tol=1e-9)
            if r.match == 1 or not inherit:
                prior = [p for p, fs in fixed.items() if r.file in fs and times[p] < times[r.report_id]]
                assert r.bug_frequency == len(prior)
                months = min((times[r.report_id].month - times[p].month for p in prior), default=None)
                assert r.bug_recency == (0 if months is None else 1 / (months + 1))
                past = [w for p in prior for w in words(texts[p])]
                assert math.isclose(r.collab_filter, literal_cosine(words(texts[r.report_id]), past) if past else 0, abs_tol=1e-9)
    lost = features.unknown_files(touched, sources).first()
    assert (lost.reason, lost.n) == ("unknown file", 1)


def test_localized(spark):
    tf = "i int, term string, tf int"
    reports = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "b", 1), (3, "c", 1), (3, "a", 1)], tf).withColumnRenamed("i", "report_id")
    files = spark.createDataFrame([("x.A.java", "a", 1), ("x.B.java", "b", 2), ("x.C.java", "c", 1), ("plain", "a", 9)], "file string, term string, tf int")
    sizes = spark.createDataFrame([("x.A.java", 10), ("x.B.java", 20), ("x.C.java", 30), ("plain", 5)], "file string, size int")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0])], "report_id int, vector array<double>")
    file_vectors = spark.createDataFrame([(f, [float(i + 1), 1.0]) for i, f in enumerate(("x.A.java", "x.B.java", "x.C.java", "plain"))], "file string, vector array<double>")
    pool = sizes.select("file").crossJoin(vectors.select("report_id"))
    fixes = spark.createDataFrame([(1, "x.A.java"), (2, "x.B.java"), (3, "x.C.java")], "report_id int, file string")
    out = localization.localized(pool, fixes, reports, files, sizes, vectors, file_vectors).collect()
    assert {(r.report_id, r.key) for r in out} == {(r, k) for r in (1, 2, 3) for k in "ABC"}
    assert all(0 <= r.score <= 1 for r in out)


def test_processing_jobs(spark):
    raw = spark.createDataFrame([("1", "Crash", "in Parser", "p"), ("2", None, "slow", "p")], "id string, summary string, description string, project_name string")
    combined = datasets.combined_reports({"p": raw})
    done = datasets.processed_reports(combined, ["in"])
    assert rows(done, "id", "report_processed") == [("1", ["crashin", "parser"]), ("2", ["slow"])]
    features_ = spark.createDataFrame([("1", 7, 1, "p")], "report_id string, cid int, match int, project_name string")
    contents = spark.createDataFrame([("p", 7, "package q.r;\nclass FooBar { int getIt() { return 1; } }")], "project_name string, cid int, file_content string")
    one = datasets.processed_candidates(raw, features_, contents, ["it"]).first()
    assert one.file_content_processed == ["foo", "bar", "get", "foobar", "getit"] and one.size == 5
    plain = spark.createDataFrame([(1, "Running runs The a")], "d int, t string")
    tf = datasets.term_table(plain, ["d"], text.prose_words(F.col("t")), "text", ["the"])
    assert rows(tf, "term", "tf") == [("run", 2)]


def test_aligned_and_split_sources(spark):
    processed = spark.createDataFrame([(1, "x", ["a"]), (1, "x", ["a"])], "cid int, file_content string, tokens array<string>")
    unprocessed = spark.createDataFrame([(1, "x", "p"), (2, "y", "p")], "cid int, file_content string, project_name string")
    both = datasets.aligned_sources(processed, unprocessed)
    assert rows(both, "cid", F.size(F.coalesce("tokens", F.array().cast("array<string>")))) == [(1, 1), (2, 0)]
    features_ = spark.createDataFrame([("p", 1, "within_project", "train", 0.5)], "project_name string, cid int, data_setting string, split string, bug_recency double")
    got = datasets.split_sources(features_, both, ["bug_recency"])
    assert "bug_recency" not in got.columns and got.first().tokens == ["a"]


def test_prepared_corpus_and_samples(spark):
    data = [("b", i, int(i == 0), "a-|-b-|-c", "x-|-y") for i in range(5)] + [("b", 9, 0, None, "x")]
    df = spark.createDataFrame(data, "bug_id string, cid int, match int, report_processed string, file_content_processed string")
    done = datasets.prepared_corpus(df, 2, 5)
    assert rows(done, "cid", "report_processed_len", "file_content_processed_len") == [(i, 2, 2) for i in range(5)]
    samples = datasets.ranking_samples(done, 2, 5, 3)
    assert samples.where("match = 1").count() == 1 and samples.where("match = 0").count() == 3


def test_settings_are_written_in_folders(spark, tmp_path):
    reports = spark.createDataFrame([(1, "c", "p", "t")], "bug_id int, commit string, project_name string, report string")
    members = spark.createDataFrame([(1, "c", "p", s, "train") for s in schemas.DATA_SETTINGS], "bug_id int, commit string, project_name string, data_setting string, split string")
    split = datasets.split_reports(reports, members)
    datasets.write_settings(split, split, str(tmp_path))
    assert readers.table(spark, str(tmp_path / "reports")).groupBy("data_setting").count().count() == 3


def test_write_results(spark, tmp_path):
    scored = spark.createDataFrame([("p", "q", 1, 0.9, 1), ("p", "q", 2, 0.1, 0)], "project string, query string, cid int, score double, match int")
    evaluation.write_results(scored, ["project", "query"], "cid", ["project"], str(tmp_path))
    long = spark.read.json(str(tmp_path / "metrics"))
    assert long.where("metric = 'map'").first().value == 1.0 and long.count() == 23
    assert spark.read.json(str(tmp_path / "results")).count() == 1


def test_models(spark, tmp_path):
    data = [(i, float(i % 10), float(i % 3), int(i % 10 >= 7)) for i in range(300)]
    samples = spark.createDataFrame(data, "i int, a double, b double, match int")
    model = models.train_scorer(samples, ["a", "b"], hidden=6, iterations=60)
    models.save(model, str(tmp_path / "m"))
    out = models.scored(models.load(str(tmp_path / "m")), samples).withColumn("q", F.lit(1))
    assert out.where("score < 0 OR score > 1").count() == 0
    assert ranking.average_precision(out, ["q"]).first().average_precision > 0.9
    folds = list(models.cross_validated(samples.withColumn("fold", F.col("i") % 2), 2, columns=["a", "b"], hidden=4, iterations=10))
    assert [n for n, _ in folds] == [0, 1] and sum(df.count() for _, df in folds) == 300


def test_word_vectors(spark):
    corpus = spark.createDataFrame([(i, ["a", "b", "c"]) for i in range(30)], "d int, tokens array<string>")
    model = models.train_word_vectors(corpus, size=8)
    vectors = {r.token: r.vector for r in models.word_vectors(model).collect()}
    assert set(vectors) == {"a", "b", "c"}
    doc = models.document_vectors(model, corpus).first().vector
    assert all(math.isclose(d, sum(v[i] for v in vectors.values()) / 3, abs_tol=1e-6) for i, d in enumerate(doc))


def test_delimited_text_is_matched_by_name(spark, tmp_path):
    file = tmp_path / "f.csv"
    file.write_text("extra,score,name\nx,1.5,a\ny,,b\n")
    got = readers.delimited(spark, str(file), "name string, score double, other int")
    assert [tuple(r) for r in got.collect()] == [("a", 1.5, None), ("b", None, None)]


def test_ranked_files_are_written_by_project(spark, tmp_path):
    scored = spark.createDataFrame(
        [("r1", "A", 0.5), ("r1", "B", 0.9), ("r1", "C", 0.5), ("r1", "D", None), ("r2", "A", 0.1)], "report_id string, key string, score double"
    )
    reports = spark.createDataFrame([("r1", "p"), ("r2", "q")], "report_id string, project_name string")
    out = localization.ranked(scored, reports)
    path = str(tmp_path / "localized")
    writers.localized(out, path)
    first = rows(spark.read.parquet(path), "project_name", "report_id", "rank", "key")
    assert first == [("p", "r1", 1, "B"), ("p", "r1", 2, "A"), ("p", "r1", 3, "C"), ("p", "r1", 4, "D"), ("q", "r2", 1, "A")]
    writers.localized(out.where("report_id = 'r2'").withColumn("key", F.lit("Z")), path)  # replaces its project only
    assert rows(spark.read.parquet(path), "project_name", "rank", "key") == [("p", i + 1, k) for i, k in enumerate("BACD")] + [("q", 1, "Z")]


def test_files_without_a_stem_are_counted(spark):
    candidates = spark.createDataFrame([("r", "a/B.java"), ("r", "LICENSE"), ("r", None), ("s", "LICENSE")], "report_id string, file string")
    got = rows(localization.left_out(candidates, candidates.limit(1)), "side", "reason", "n")
    assert got == [("candidate", "no file", 1), ("candidate", "no stem", 2)]


def test_sample_folders_that_exist_stay(spark, tmp_path):
    """A second run adds the missing folders only; nulls, long texts and bugs without samples are counted."""
    columns = "data_setting string, project_name string, split string, bug_id int, cid int, match int, report_processed array<string>, file_content_processed array<string>"
    whole = lambda project, bug: [("s", project, "train", bug, c, int(c == 0), ["a"], ["b"]) for c in range(6)]
    first = whole("1", 1) + [("s", "1", "train", 2, 0, 1, None, ["b"]), ("s", "1", "train", 2, 1, 0, ["a"] * 9, ["b"]), ("s", "1", "train", 2, 2, 0, ["a"], ["b"])]
    more = whole("1", 5) + whole(None, 7) + whole("2", 8)[:3]
    path = str(tmp_path / "set")

    def rows(name):
        return sorted(map(tuple, spark.read.schema(spark.read.parquet(f"{path}/{name}").schema).parquet(f"{path}/{name}").collect()), key=repr)

    for chosen, seed in ((first, "0"), (first + more, "1"), ((first + more)[:0], "2")):
        before = rows("samples") if chosen is not first else []
        datasets.add_sample_folders(spark.createDataFrame(chosen, columns), path, 4, 4, 3, seed)
        assert [r for r in rows("samples") if r in before] == before
    got = spark.read.parquet(f"{path}/samples").groupBy("bug_id").count().collect()
    assert {tuple(r) for r in got} == {(1, 4), (7, 4)}
    rejects = spark.read.parquet(f"{path}/rejects").select("project_name", "unit", "reason", "n").collect()
    assert {tuple(r) for r in rejects} == {
        (1, "candidate", "no text", 1), (1, "candidate", "too many words", 1), (1, "bug", "no positive", 1), (2, "bug", "too few negatives", 1)
    }


def test_samples_are_drawn_from_lengths(spark, tmp_path):
    """Lists joined to what is drawn give the folders that whole candidates give; a key may have two texts."""
    files = [(c, ["w"] * (c % 6)) for c in range(40)] + [(3, ["x"] * 7), (5, None), (7, ["w"])]
    texts = {
        "report_processed": spark.createDataFrame([(0, ["a"]), (1, ["a"] * 9)], "item int, report_processed array<string>"),
        "file_content_processed": spark.createDataFrame(files, "doc int, file_content_processed array<string>"),
    }
    plain = spark.range(400).selectExpr(
        "'s' AS data_setting", "concat('p', id % 2) AS project_name", "'train' AS split", "cast(id % 10 AS int) AS bug_id", "cast(id AS int) AS cid",
        "cast(id % 40 < 10 AS int) AS match", "cast(id % 9 = 8 AS int) AS item", "cast(id div 10 AS int) AS doc",
    )
    whole = plain.join(texts["report_processed"], "item").join(texts["file_content_processed"], "doc").drop("item", "doc")
    sized = datasets.sized_candidates(plain, texts)
    assert not [f for f in sized.schema if f.dataType.typeName() == "array"]
    found = []
    for name, candidates, lists in (("whole", whole, None), ("sized", sized, texts)):
        path = str(tmp_path / name)
        datasets.add_sample_folders(candidates, path, 4, 4, 3, texts=lists)
        read = [spark.read.parquet(f"{path}/{part}") for part in ("samples", "rejects")]
        found.append([sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr) for df in read])
    assert found[0] == found[1] and found[0][0] and found[0][1]
