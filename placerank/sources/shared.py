"""Intermediate tables in the folder that the cluster shares (`spark.checkpoint.dir`)."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEY, _CLEANUP = "spark.checkpoint.dir", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_root: dict[str, str] = {}
_open_scopes: list[list[str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder. Only a session on this machine alone (tests) may be without one; it
    gets a folder of its own."""
    root = spark.conf.get(_KEY, None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {_KEY} to a folder that all executors can reach")
        app = spark.sparkContext.applicationId
        if app not in _local_root:
            _local_root[app] = tempfile.mkdtemp(prefix="placerank-")
        root = _local_root[app]
    path = f"{root.rstrip('/')}/placerank/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    for scope in _open_scopes:
        scope.append(path)
    return path


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Removes at its end all intermediate tables that were stored inside it. Results that read them
    have to be written or collected before."""
    paths: list[str] = []
    _open_scopes.append(paths)
    try:
        yield
    finally:
        _open_scopes.remove(paths)
        hadoop = spark._jsc.hadoopConfiguration()
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(hadoop).delete(where, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside removes its shuffle files as soon as it is written, not when the driver next collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: short lineage that outlives an
    executor, columnar re-reads and real size statistics for the joins that follow."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
