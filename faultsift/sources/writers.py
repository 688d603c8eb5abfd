"""Writers. A rerun replaces what it wrote before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultsift.session import path_exists
from faultsift.sources.schemas import FEATURE_COLUMNS

#: Folders of a data set that are broadcast at most, after they are counted.
FOLDERS = 10_000
LAYOUT = ["data_setting", "project_name", "split"]


def table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet; `partition_by` names folder columns."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def data_set(df: DataFrame, path: str) -> None:
    """Parquet in folders data_setting / project_name / split."""
    table(df, path, LAYOUT)


def without_folders(df: DataFrame, path: str, layout: list[str] | None = None) -> DataFrame:
    """Rows of `df` whose folder below `path` does not exist yet; all of them where `path` does not.

    Folders appear when the job that writes them ends, so one that exists is whole. A null in a layout
    column is a folder like any other.
    """
    layout = layout or LAYOUT
    spark = df.sparkSession
    if not path_exists(spark, path):
        return df
    names = [f"_there{i}" for i in range(len(layout))]
    there = spark.read.schema(df.select(*layout).schema).parquet(path).distinct().toDF(*names)
    there = F.broadcast(there) if there.count() <= FOLDERS else there
    same = [F.col(own).eqNullSafe(F.col(name)) for own, name in zip(layout, names, strict=True)]
    return df.join(there, same, "left_anti")


def folders(df: DataFrame, path: str, layout: list[str] | None = None) -> None:
    """Parquet in folders; those that `df` has rows of are replaced, all others stay as they are."""
    layout = layout or LAYOUT
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*layout).parquet(path)


def delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    """Delimited text with a header; white space of the values is kept."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("sep", sep)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def features(df: DataFrame, path: str) -> None:
    """The feature table as text with its eight columns."""
    delimited(df.select(*FEATURE_COLUMNS), path)


def result_files(df: DataFrame, path: str, layout: list[str] | None = None) -> None:
    """Results as text in one folder per project, setting and split; other folders below `path` stay."""
    layout = layout or LAYOUT
    writer = df.repartition(*layout).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("header", True).partitionBy(*layout).csv(path)


def localized(df: DataFrame, path: str) -> None:
    """Ranked files as Parquet in one folder per project, sorted by report and rank.

    Ranges of (project, report, rank) are the tasks, so a large project is cut into several files; a
    rerun replaces the folders of its own projects only.
    """
    order = ["project_name", "report_id", "rank"]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_name").parquet(path)


def metrics(df: DataFrame, path: str) -> None:
    """The long metrics table as JSON lines."""
    df.write.mode("overwrite").json(path)


def metrics_json(df: DataFrame, group: list[str]) -> DataFrame:
    """One JSON document per group: {"map": ..., "mrr": ..., "hit": {k: rate}}.

    A group has one row per metric and k, 23 in all.
    """
    value = F.col("value")
    entries = F.array_sort(F.collect_list(F.when(F.col("metric") == "hit", F.struct("k", "value"))))
    out = df.groupBy(*group).agg(
        F.max(F.when(F.col("metric") == "map", value)).alias("map"),
        F.max(F.when(F.col("metric") == "mrr", value)).alias("mrr"),
        F.max(F.when(F.col("metric") == "evaluated", value)).cast("bigint").alias("evaluated"),
        F.map_from_entries(entries).alias("hit"),
    )
    return out.select(*group, F.to_json(F.struct("map", "mrr", "evaluated", "hit")).alias("metrics"))


def ranking(df: DataFrame, path: str) -> None:
    """Per report ranking: cid, match, predicted, bug_id."""
    delimited(df.select("cid", "match", "predicted", "bug_id"), path)


def score_lines(df: DataFrame, query: str = "query_id", candidate: str = "candidate_id", score: str = "score") -> DataFrame:
    """Lines `query candidate score`."""
    parts = [F.col(c).cast("string") for c in (query, candidate, score)]
    return df.select(F.concat_ws(" ", *parts).alias("value"))


def scores(df: DataFrame, path: str, **columns: str) -> None:
    score_lines(df, **columns).write.mode("overwrite").text(path)


def corpus(train: DataFrame, test: DataFrame | None = None) -> DataFrame:
    """Rows (split, side, key, tokens) of the texts to learn word vectors from.

    `train` and `test` have (key, report_tokens, code_tokens); the side tells report from code.
    """

    def sides(df: DataFrame, split: str) -> DataFrame:
        pairs = F.array(
            F.struct(F.lit("report").alias("side"), F.col("report_tokens").alias("tokens")),
            F.struct(F.lit("code").alias("side"), F.col("code_tokens").alias("tokens")),
        )
        return df.select(F.lit(split).alias("split"), "key", F.inline(pairs))

    out = sides(train, "train")
    return out if test is None else out.unionByName(sides(test, "test"))


def missing_from(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows still to be written: those whose key the output does not have yet."""
    return df.join(existing.select(*keys), keys, "left_anti")


def graphs_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON document per graph: {"nodes": [...], "edges": [[src...], [dst...]]}.

    A graph is that of one source file. Listed edges hold their nodes; given as both tables, they are not
    joined with themselves.
    """
    if "nodes" in nodes.columns:
        listed_nodes = F.array_sort(F.transform("nodes", lambda x: F.struct(x.node_idx, x.token.alias("token")))).alias("_n")
        listed_edges = F.array_sort(F.transform("edges", lambda x: F.struct(x.dst.alias("dst"), x.src.alias("src")))).alias("_e")
        n = nodes.where(F.size("nodes") > 0).select("doc_hash", *([listed_nodes, listed_edges] if nodes is edges else [listed_nodes]))
        e = edges.select("doc_hash", listed_edges)
    else:
        n = nodes.groupBy("doc_hash").agg(F.array_sort(F.collect_list(F.struct("node_idx", "token"))).alias("_n"))
        e = edges.groupBy("doc_hash").agg(F.array_sort(F.collect_list(F.struct("dst", "src"))).alias("_e"))
    joined = n if nodes is edges else n.join(e, "doc_hash", "left")
    none = F.array().cast("array<bigint>")
    both = F.array(F.coalesce("_e.src", none), F.coalesce("_e.dst", none))
    return joined.select(
        "doc_hash", F.to_json(F.struct(F.col("_n.token").alias("nodes"), both.alias("edges"))).alias("graph")
    )
