"""Readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.functions import paths, text
from faultsift.sources import schemas
from faultsift.sources.writers import LAYOUT


def delimited(spark: SparkSession, path: str | list[str], schema: str, sep: str = ",", multiline: bool = False) -> DataFrame:
    """Delimited text with a header; a quote in a quoted field is doubled.

    Columns are matched by the names in the header, so files that share a header may have more of
    them in any order; a missing one is null. Quoted fields span lines only with `multiline`,
    which reads a file in one task; without it a large file is split.
    """
    options = {"header": True, "sep": sep, "quote": '"', "escape": '"', "multiLine": multiline}
    raw = spark.read.options(**options).csv(path)
    wanted = spark.createDataFrame([], schema).schema
    typed = [
        (F.col(f"`{f.name}`").cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in wanted
    ]
    return raw.select(*typed)


def as_text(spark: SparkSession, path: str, columns: list[str], sep: str = ",", multiline: bool = False) -> DataFrame:
    """Delimited text with every column as a string."""
    return delimited(spark, path, ", ".join(f"`{c}` string" for c in columns), sep, multiline)


def parsed_reports(raw: DataFrame) -> DataFrame:
    """Typed reports: parsed time, normalised file list, raw_text."""
    return raw.withColumns(
        {
            "report_time": paths.report_time(F.col("report_time")),
            "files": paths.file_list(F.coalesce("files", F.lit(""))),
            "raw_text": text.report_text(F.col("summary"), F.col("description")),
        }
    )


def reports(spark: SparkSession, path: str, project: str | None = None) -> DataFrame:
    """Bug reports from tab separated text."""
    out = parsed_reports(delimited(spark, path, schemas.REPORT_FILE, "\t", multiline=True))
    return out if project is None else out.withColumn("project_name", F.lit(project))


def features(spark: SparkSession, path: str) -> DataFrame:
    return delimited(spark, path, schemas.FEATURES)


def source_tree(spark: SparkSession, root: str, suffix: str = ".java") -> DataFrame:
    """All source files below a folder: (file, file_content), file relative to the folder."""
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{suffix}")
        .text(root, wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("path"))
    )
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    local = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    start = F.instr(local, base) + len(base)
    return files.select(F.substring(local, start, F.length(local)).alias("file"), F.col("value").alias("file_content"))


def keyed_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines `id TAB text`, cut at the first tab: (id, text). `unkeyed_text` has the other lines."""
    parts = F.split("value", "\t", 2)
    lines = spark.read.text(path).where(F.contains("value", F.lit("\t")))
    return lines.select(parts[0].alias("id"), parts[1].alias("text"))


def unkeyed_text(spark: SparkSession, path: str) -> DataFrame:
    """The lines that `keyed_text` leaves out as they have no tab: (line)."""
    lines = spark.read.text(path).where(~F.contains("value", F.lit("\t")))
    return lines.select(F.col("value").alias("line"))


def result_files(spark: SparkSession, root: str, columns: str = "map double, mrr double, reports long", layout: list[str] | None = None) -> DataFrame:
    """The rows of all result files below a folder as one table, and what could not be read.

    `layout` names the folder columns (name=value) that every file's path gives. A file is comma
    separated text of a few rows with a header of its own; columns are taken by name, so files may
    have more of them in any order. Rows have `reason` null. A file without a column or a row without
    a number where one is due is a row with a `reason` and the path in `file`, so nothing is lost; a file
    of no bytes has no row.
    """
    layout = layout or LAYOUT
    wanted = spark.createDataFrame([], columns).schema
    files = spark.read.options(recursiveFileLookup=True, pathGlobFilter="*.csv").text(root, wholetext=True)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    keys = [F.nullif(F.regexp_extract(path, f"/{name}=([^/]*)/", 1), F.lit("")).alias(name) for name in layout]
    lines = F.filter(F.split("value", "\r?\n"), lambda line: line != "")
    named = files.select(*keys, path.alias("file"), lines.alias("_lines")).withColumn("_names", F.split(F.get("_lines", F.lit(0)), ","))
    lost = F.array_except(F.array(*[F.lit(f.name) for f in wanted]), F.coalesce("_names", F.array()))
    rows = named.withColumn("_lost", lost).withColumn("_line", F.explode_outer(F.slice("_lines", 2, F.greatest(F.size("_lines"), F.lit(1)))))
    cells = F.split("_line", ",", -1)
    fit = (F.size("_lost") == 0) & F.col("_line").isNotNull() & (F.size(cells) == F.size("_names"))
    rows = rows.withColumn("_values", F.when(fit, cells))
    values = {f.name: F.expr(f"try_cast(get(_values, array_position(_names, '{f.name}') - 1) AS {f.dataType.simpleString()})") for f in wanted}
    read = rows.select(*layout, "file", "_lost", "_line", "_values", "_names", *[v.alias(n) for n, v in values.items()])
    reason = (
        F.when(F.col("_names").isNull(), "empty file")
        .when(F.size("_lost") > 0, F.concat(F.lit("no column "), F.array_join("_lost", ", ")))
        .when(F.col("_line").isNull(), "no rows")
        .when(F.col("_values").isNull(), "wrong number of fields")
        .when(F.expr(" OR ".join(f"{f.name} IS NULL" for f in wanted)), "not a number")
    )
    return read.select(*layout, *values, reason.alias("reason"), "file")


def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def local_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small local table (pandas frame or rows) with a declared schema."""
    return spark.createDataFrame(rows, schema)


def spread(df: DataFrame) -> DataFrame:
    """Give a small scan one partition per core, so that costly expressions run in parallel.

    A scan of many files has more partitions than that and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
