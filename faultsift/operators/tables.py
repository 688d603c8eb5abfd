"""Table operators: alignment, set membership, audits, duplicates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultsift.operators.skew import unsent


def in_project(df: DataFrame, project: str) -> DataFrame:
    """Add the project as a column."""
    return df.withColumn("project_name", F.lit(project))


def union_projects(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One table from one table per project."""
    return reduce(DataFrame.unionByName, (in_project(df, p) for p, df in tables.items()))


def keep(df: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs in `members`."""
    return df.join(members.select(*keys).distinct(), keys, "left_semi")


def without(df: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key does not occur in `members`."""
    return df.join(members.select(*keys).distinct(), keys, "left_anti")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key. A partial aggregate keeps one row per key and task before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def align(left: DataFrame, right: DataFrame, keys: list[str], order: list[Column], how: str = "full_outer") -> DataFrame:
    """Put two tables side by side on a key after dropping repeated keys on the left."""
    return first_by(left, keys, order).join(right, keys, how)


def with_content(features: DataFrame, contents: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Inner join of candidate rows with file contents.

    Keyed by project and cid: cid alone repeats across projects.
    """
    keys = keys or ["project_name", "cid"]
    return features.join(unsent(contents), keys)


def with_reports(candidates: DataFrame, reports: DataFrame) -> DataFrame:
    """Inner join on reports.id = candidates.report_id, within the project where both sides name one."""
    keyed = reports.withColumnRenamed("id", "report_id")
    both_name_it = "project_name" in keyed.columns and "project_name" in candidates.columns
    return candidates.join(unsent(keyed), ["report_id", "project_name"] if both_name_it else ["report_id"])


def qualified(sources: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sources with bug_id, commit and match of the mapping, joined on project and cid."""
    keys = ["project_name", "cid"]
    columns = mapping.select(*keys, "bug_id", "commit", "match")
    return sources.join(unsent(columns), keys).select(
        *sources.columns, "bug_id", "commit", "match"
    )


def null_audit(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row: for every column whether it has a null."""
    columns = list(columns or df.columns)
    return df.agg(*[F.bool_or(F.col(c).isNull()).alias(c) for c in columns])


def most_common(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value per key; among equals the smallest."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value)))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(*keys, f"_b.{value}", "_b.n")


def with_default(df: DataFrame, updates: DataFrame, keys: list[str], column: str, default: float = 0.0) -> DataFrame:
    """Take `column` from `updates` where the key has one, else `default`."""
    kept = df.drop(column)
    joined = kept.join(updates.select(*keys, column), keys, "left")
    return joined.withColumn(column, F.coalesce(column, F.lit(default)))


def distinct_contents(sources: DataFrame, content: str = "file_content") -> DataFrame:
    """One row per content hash; of equal contents the one smallest in its other columns."""
    hashed = sources.withColumn("doc_hash", F.md5(F.col(content)))
    order = [F.col(c) for c in sources.columns if c != content]
    return first_by(hashed, ["doc_hash"], order) if order else hashed.dropDuplicates(["doc_hash"])


def rejects(df: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
    """Count rows per reason to leave them out; the first reason that applies counts."""
    reason = F.coalesce(*[F.when(test, F.lit(name)) for name, test in reasons.items()])
    return (
        df.select(reason.alias("reason")).where(F.col("reason").isNotNull())
        .groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    )
