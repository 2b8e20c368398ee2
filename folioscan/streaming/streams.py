"""Structured Streaming: state and views by commits, resuming a harvest, debounced saves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import state
from ..sources import commits


def committed(path: str, key: str = "paper_id", now_ms: int | None = None, views: dict[str, Column] | None = None):
    """A ``foreachBatch`` sink: each batch is a commit to the state at ``path``, with its views.

    A batch reads and writes the buckets that it touches. A repeated batch does nothing: the state knows the query, by
    the name that its checkpoint has, and its last batch.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        merge = lambda new, old: state.latest(new.unionByName(old), key)
        commits.commit(spark, path, batch, key, None, now_ms, merge, views, query, epoch)

    return write


def run_commits(log: DataFrame, path: str, checkpoint: str, key: str = "paper_id", views: dict[str, Column] | None = None) -> None:
    """Drive a streamed log into the state at ``path`` to its end, a commit a micro-batch."""
    query = log.writeStream.foreachBatch(committed(path, key, None, views)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def bookmark(log: DataFrame, group: str = "set", stamp: str = "datestamp") -> DataFrame:
    """Where each set's harvest resumes: its latest day, which is read again, as more may have come that day."""
    return log.groupBy(group).agg(F.max(stamp).alias("resume_from"))


def since_bookmark(feed: DataFrame, bookmarks: DataFrame, start: str, group: str = "set", stamp: str = "datestamp") -> DataFrame:
    """Feed rows from each set's bookmark on, that day included; sets without one from ``start``."""
    marks = bookmarks.select(F.col(group).alias("_g"), "resume_from")
    rows = feed.join(marks, feed[group] == marks["_g"], "left").filter(F.col(stamp) >= F.coalesce("resume_from", F.lit(start)))
    return rows.drop("_g", "resume_from")


def harvest(log: DataFrame, out: str, checkpoint: str):
    """Append a streamed feed to the harvest log; the checkpoint is its progress."""
    return log.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def run_harvest(feed: DataFrame, out: str, marks: str, checkpoint: str, group: str = "set", stamp: str = "datestamp") -> None:
    """Drive a streamed feed to its end: rows go to the log at ``out``, then their sets' marks to the state at ``marks``.

    A batch has a folder of its own in the log, so one that is done again replaces its rows; a mark never goes back.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")
        seen = bookmark(spark.read.parquet(f"{out}/batch={epoch}"), group, stamp)
        latest = lambda new, old: new.unionByName(old).groupBy(group).agg(F.max("resume_from").alias("resume_from"))
        commits.commit(spark, marks, seen, group, None, None, latest, None, spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "", epoch)

    feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def sessions(events: DataFrame, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Reading sessions of a streamed event table with a TIMESTAMP ``ts``; late events are dropped past a watermark."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def debounced(requests: DataFrame, quiet: int = 900, most: int = 1200) -> DataFrame:
    """(key, saved_at) of streamed requests (key, at timestamp, and perhaps flush boolean): a trailing debounce with a longest wait.

    State for a key is its first and last unsaved request. A timer in event time fires once the watermark has
    passed the time that is due. A flush saves what is unsaved at its own time, and requests nothing itself.
    """
    if "flush" not in requests.columns:
        requests = requests.withColumn("flush", F.lit(False))

    def step(key, parts: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        first, last = kept.get if kept.exists else (None, None)
        saves = []
        times = [] if kept.hasTimedOut else sorted((int(t.timestamp() * 1000), bool(f)) for part in parts for t, f in zip(part["at"], part["flush"]))
        for t, flush in times:
            if first is not None and min(last + quiet, first + most) <= t:
                saves.append(min(last + quiet, first + most))
                first = None
            if flush:
                if first is not None:
                    saves.append(t)
                first = None
            else:
                first, last = t if first is None else first, t
        if kept.hasTimedOut and first is not None:
            saves.append(min(last + quiet, first + most))
            first = None
        if first is None:
            kept.remove()
        else:
            kept.update((first, last))
            kept.setTimeoutTimestamp(max(min(last + quiet, first + most), kept.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]] * len(saves), "saved_at": saves})

    return requests.withWatermark("at", "2 seconds").groupBy("key").applyInPandasWithState(step, "key string, saved_at long", "first long, last long", "append", "EventTimeTimeout")
