"""File paths, list columns and time stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def normalized_path(path: Column) -> Column:
    """POSIX path normal form: no `.`, no empty part, `..` resolved as far as possible."""
    root = F.when(path.rlike("^//([^/]|$)"), F.lit("//")).when(path.startswith("/"), F.lit("/")).otherwise("")

    def step(done: Column, part: Column) -> Column:
        stuck = (F.size(done) == 0) | (F.element_at(done, F.greatest(F.size(done), F.lit(1))) == "..")
        return (
            F.when((part == "") | (part == "."), done)
            .when((part == "..") & ~stuck, F.slice(done, 1, F.size(done) - 1))
            .when((part == "..") & path.startswith("/"), done)
            .otherwise(F.concat(done, F.array(part)))
        )

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.concat(root, F.array_join(parts, "/"))
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def file_list(text: Column) -> Column:
    """Normalised paths of a white-space separated list; an empty text has none."""
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda p: p != "")
    return F.transform(parts, normalized_path)


def file_stem(file: Column) -> Column:
    """Second to last dot component (`org.foo.Bar.java` -> `Bar`); null when there is no dot."""
    parts = F.split(file, r"\.")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2))


def list_literal(text: Column) -> Column:
    """Read a list of plain strings written like `['a', 'b']`."""
    return F.from_json(F.translate(text, "'", '"'), "array<string>")


def report_time(text: Column) -> Column:
    return F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def to_number(text: Column) -> Column:
    """A double, or null where the text is no number."""
    return text.try_cast("double")
