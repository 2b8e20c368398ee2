"""Keyed state in the shared folder: commits with a version check, and counted views that follow them.

A state is split by its key into buckets of Parquet files. A version is a small file that names each bucket's
folder and each view's; it is created once and never changed, so of several writers one alone makes the next
version. A writer reads the newest version, merges its changes into the buckets that they touch, writes those,
and creates the next version; if another was first, it reads, merges and prunes again, three times in all.
Readers see whole versions: files of writers that lost, or failed, belong to none.

Views are counts by a value of the live records. A commit takes the old records of the keys it changes off and
puts the new ones on, so a view is never counted anew.

Defined results: changes without rows make no version; rows that repeat a key are merged by ``state.merge``'s rules; a null
key is a key of its own; a state that was never written reads as empty, given its schema. A change applied twice under
one ``writer`` and ``batch`` counts once, so a stream's repeated batch does nothing.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import state
from ..storage import qualified, stored

# Attempts of a commit.
ATTEMPTS = 3
BUCKETS = 16


class Conflict(Exception):
    """Other writers were first at every attempt."""


def _files(spark: SparkSession, path: str):
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(sc._jsc.hadoopConfiguration()), hadoop


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its text, whole; False if it exists. Of several writers one gets True.

    The text is written under another name first. On a local disk a link gives it its name, elsewhere a rename
    that doesn't replace, which is atomic in HDFS; an object store needs a committer that refuses to overwrite.
    """
    other = f"{path}.{uuid.uuid4().hex}.new"
    fs, hadoop = _files(spark, other)
    fs.mkdirs(hadoop.getParent())
    out = fs.create(hadoop)
    out.write(bytearray(text.encode()))
    out.close()
    url = urlparse(qualified(spark, path))
    if url.scheme == "file":
        try:
            os.link(urlparse(qualified(spark, other)).path, url.path)
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(hadoop, False)
    java = spark.sparkContext._jvm
    context = java.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri())
    options = spark.sparkContext._gateway.new_array(getattr(java.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(hadoop), fs.makeQualified(_files(spark, path)[1]), options)
        return True
    except Exception as e:  # the one exception that means another writer; all others are errors
        if "FileAlreadyExistsException" not in str(e):
            raise
        fs.delete(hadoop, False)
        return False


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a state's versions, in order."""
    fs, hadoop = _files(spark, f"{path}/versions")
    if not fs.exists(hadoop):
        return []
    names = (f.getPath().getName() for f in fs.listStatus(hadoop))
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def describe(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What a version, or the newest, is made of; version 0 is the empty state."""
    known = versions(spark, path)
    number = version if version is not None else known[-1] if known else 0
    if not number:
        return {"version": 0, "buckets": {}, "views": {}, "batches": {}, "schema": None}
    text = spark.read.text(f"{path}/versions/{number:08}.json", wholetext=True).first()[0]
    return json.loads(text)


def read(spark: SparkSession, path: str, schema: StructType | str | None = None, version: int | None = None) -> DataFrame:
    """The records of a version, tombstones included."""
    told = describe(spark, path, version)
    if told["schema"] is None and schema is None:
        raise ValueError(f"{path} has no state")
    kind = StructType.fromJson(told["schema"]) if told["schema"] else schema
    return _read(spark, told, kind, list(told["buckets"]))


def _read(spark: SparkSession, told: dict, schema, buckets: list[str]) -> DataFrame:
    paths = [told["buckets"][b] for b in buckets if b in told["buckets"]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_view(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """(value, n) of a view."""
    told = describe(spark, path, version)["views"]
    return spark.read.parquet(told[name]) if name in told else spark.createDataFrame([], "value string, n long")


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def commit(
    spark: SparkSession,
    path: str,
    changes: DataFrame,
    key: str = "paper_id",
    seq: str | None = "seq",
    now_ms: int | None = None,
    merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    views: dict[str, Column] | None = None,
    writer: str = "",
    batch: int | None = None,
    before_create: Callable[[int], None] = lambda attempt: None,
) -> int:
    """Merge ``changes`` into a state and return its version; old tombstones of the buckets touched go, if ``now_ms`` is given.

    ``merge`` takes the changes and the old records of their buckets; without one it is ``state.merge``, the changes being the
    local side. ``views`` are array columns of a record: a view counts the live records by each value of its array; views
    that a commit doesn't name go. ``before_create`` is called at each attempt, for tests.
    """
    changes = stored(changes, "changes")
    touched = [str(r[0]) for r in changes.select(bucket_of(key)).distinct().collect()]  # BUCKETS numbers at most
    if not touched:
        return describe(spark, path)["version"]
    for attempt in range(ATTEMPTS):
        told = describe(spark, path)
        if batch is not None and told["batches"].get(writer, -1) >= batch:
            return told["version"]
        schema = StructType.fromJson(told["schema"]) if told["schema"] else changes.schema
        old = _read(spark, told, schema, touched)
        merged = merge(changes, old) if merge else state.merge(changes, old, key, seq)
        if now_ms is not None:
            merged = state.prune(merged, now_ms)
        folder = f"{path}/data/{uuid.uuid4().hex}"
        merged.select(*schema.names, bucket_of(key).alias("_bucket")).write.partitionBy("_bucket").parquet(folder)
        written = {b: f"{folder}/_bucket={b}" for b in touched}
        kept = {b: p for b, p in written.items() if _files(spark, p)[0].exists(_files(spark, p)[1])}
        buckets = {b: p for b, p in told["buckets"].items() if b not in touched} | kept
        new = told | {"version": told["version"] + 1, "buckets": buckets, "schema": schema.jsonValue()}
        new["views"] = {name: _viewed(spark, path, told, name, values, old, _read(spark, new, schema, touched)) for name, values in (views or {}).items()}
        if batch is not None:
            new["batches"] = told["batches"] | {writer: batch}
        before_create(attempt)
        if create_once(spark, f"{path}/versions/{new['version']:08}.json", json.dumps(new)):
            return new["version"]
    raise Conflict(f"{path}: {ATTEMPTS} attempts, and another writer was first at each")


def _viewed(spark: SparkSession, path: str, told: dict, name: str, values: Column, old: DataFrame, new: DataFrame) -> str:
    """A view's next table: counts of the touched buckets' old records off, of their new ones on, values of none left out."""
    signed = lambda rows, n: state.live(rows).select(F.explode(values.cast("array<string>")).alias("value"), F.lit(n).cast("long").alias("n"))
    before = spark.read.parquet(told["views"][name]) if name in told["views"] else spark.createDataFrame([], "value string, n long")
    folder = f"{path}/views/{name}-{uuid.uuid4().hex}"
    after = before.unionByName(signed(old, -1)).unionByName(signed(new, 1)).groupBy("value").agg(F.sum("n").alias("n"))
    after.filter("n <> 0").write.parquet(folder)
    return folder


def clear(spark: SparkSession, path: str, keep: int = 10) -> int:
    """Remove versions but the newest ``keep``, and tables that none of those has; returns how many tables went.

    Not while a commit runs: its tables belong to no version yet.
    """
    known = versions(spark, path)
    for number in known[:-keep]:
        fs, hadoop = _files(spark, f"{path}/versions/{number:08}.json")
        fs.delete(hadoop, False)
    told = [describe(spark, path, n) for n in known[-keep:]]
    used = {p for t in told for p in [*t["views"].values(), *(p.rsplit("/", 1)[0] for p in t["buckets"].values())]}
    gone = 0
    for part in ("data", "views"):
        fs, hadoop = _files(spark, f"{path}/{part}")
        for f in fs.listStatus(hadoop) if fs.exists(hadoop) else []:
            if f"{path}/{part}/{f.getPath().getName()}" not in used:
                gone += fs.delete(f.getPath(), True)
    return gone
