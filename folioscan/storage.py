"""The folder that driver and executors share, and lineage cuts in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_temporary: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    A local session without one gets a temporary folder, as in tests; on a cluster that would be a
    folder of the driver alone, so there it is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _temporary:
        _temporary[sc.applicationId] = tempfile.mkdtemp(prefix="folioscan-")
        sc.setCheckpointDir(_temporary[sc.applicationId])
    return _temporary[sc.applicationId]


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of the file system that Spark would take it from."""
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return out.replace("file:/", "file:///", 1) if out.startswith("file:/") and not out.startswith("file://") else out


def stamp(spark: SparkSession, path: str) -> str:
    """What changes when a table's files do: names, lengths and times of a path, or of what lies in its folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)
    return " ".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in found))


def folders(spark: SparkSession, path: str) -> set[str]:
    """The names of what lies in a folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return {f.getPath().getName() for f in hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)}


def cut(df: DataFrame) -> DataFrame:
    """Materialise a small frame in the shared folder; larger ones are ``stored``."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's setting by which a query's shuffle files go when it ends; else they stay until the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files behind; the session's own setting comes back."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str, *parts: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write a frame as a Parquet table in the shared folder, by columns ``parts`` if given, and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = (df.write.partitionBy(*parts) if parts else df.write).options(**options or {})
    with shuffles_removed(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def discard(df: DataFrame) -> None:
    """Remove the stored tables that a frame reads, once nothing will read them again."""
    spark = df.sparkSession
    ours = qualified(spark, shared_dir(spark))
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if qualified(spark, folder).startswith(f"{ours}/"):
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
