"""The small training set is ranked without its texts."""

import pytest
from pyspark.sql import functions as F

from faultsift.operators import sampling, tables
from faultsift.operators.running import id_block
from faultsift.plans import datasets

ORDER = ["report_id", "line", "cid"]


@pytest.fixture
def parts(spark):
    """Files and reports that come twice with other texts, rows without a key, texts that are missing."""
    reports = [(i, i % 9, "p" if i % 2 else "q", f"s{i}", f"d{i}") for i in range(18)] + [(3, 3, "p", "other", "x"), (4, 4, "q", None, "y"), (None, 1, "p", "n", "n")]
    rows = [(i * 5 % 19, i % 4, i % 8, "p" if i * 5 % 19 % 2 else "q", int(i % 3 == 0)) for i in range(150)] + [(None, 1, 1, "p", 1), (3, 1, None, "p", 0)]
    contents = [(p, c, f"{p}{c}") for p in "pq" for c in range(7)] + [("p", 1, "again"), ("q", 2, None), (None, 1, "none"), ("p", None, "none")]
    return (
        spark.createDataFrame(reports, "id long, bug_id long, project_name string, summary string, description string"),
        spark.createDataFrame(rows, "report_id long, line int, cid long, project_name string, match int"),
        spark.createDataFrame(contents, "project_name string, cid long, file_content string"),
    )


@pytest.mark.parametrize("negatives", [3, 1_000])
def test_rows_equal_those_ranked_with_texts(spark, parts, negatives, monkeypatch):
    reports, features, contents = parts
    order, bucket = [F.col(c) for c in ORDER], id_block(F.col("report_id"), 4)
    kept, plain = [], datasets.stage
    monkeypatch.setattr(datasets, "stage", lambda df, *name: kept.append((df.columns, name)) or plain(df, *name))
    got = datasets.small_training_set(reports, features, contents, order, bucket, negatives=negatives)
    full = tables.with_reports(tables.with_content(features, contents), reports).withColumn("report", F.concat("summary", "description"))
    sides = sampling.ordered_split(full.where("match = 1"), order, bucket, 0.4)
    train = tables.keep(full, sides.where("split = 'train'"), ["bug_id"])
    want = sampling.positives_and_negatives(train, "bug_id", order, negatives)
    columns = ["report_id", "cid", "match"] + (["report", "file_content"] if negatives == 1_000 else [])  # which copy comes first is open
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(got.withColumnRenamed("id", "report_id")) == rows(want) and want.count() > 20
    ranked = next(columns for columns, name in kept if name == ("candidates",))
    assert not {"file_content", "summary", "description", "report"} & set(ranked)
