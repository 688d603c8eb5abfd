"""Session defaults and lineage cutting."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

_STAGED: dict[str, SparkSession] = {}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("faultsift")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Where the setting is missing a local session, as in tests, gets a folder of its own, which goes
    when the process ends; any other session must name one.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_DIR} is not set; name a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="faultsift-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` once as Parquet to the shared folder and read it back.

    Used where several branches read one costly intermediate result. The files survive the loss of
    executors, later reads prune columns and skip row groups. `unstage` removes them; what is left
    goes when the session's process ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    if not _STAGED:
        atexit.register(_remove_all)
    _STAGED[path] = spark
    return staged


def unstage(df: DataFrame) -> None:
    """Remove the files behind a staged table that nothing reads any more."""
    path = getattr(df, "staged_path", None)
    if path in _STAGED:
        _delete(_STAGED.pop(path), path)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _remove_all() -> None:
    for path, spark in list(_STAGED.items()):
        with contextlib.suppress(Exception):  # the session may be gone
            _delete(spark, path)
