"""Commits of keyed state: conflicts, retries, views, and streams that commit."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from folioscan.operators import state as st
from folioscan.sources import commits
from folioscan.streaming import streams

KIND = "paper_id string, seq long, is_local boolean, deleted boolean, updated_at long, tags array<string>"


def log(n, keys, seed, local=True):
    r = random.Random(seed)
    return [(f"p{r.randrange(keys)}", seed * 10_000 + k, local, r.random() < 0.2, r.randrange(1000), r.sample(["a", "b", "c", "d"], r.randrange(3))) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND)


def rows_of(df):
    return sorted((r.paper_id, r.seq, r.deleted) for r in df.collect())


def tags_of(df):
    return dict(collections.Counter(t for r in st.live(df).collect() for t in r.tags))


@pytest.mark.parametrize("scheme", ["file", "hdfs"])
def test_only_one_writer_makes_a_version(spark, tmp_path, monkeypatch, scheme):
    """By a link on a local disk; elsewhere by a rename that doesn't replace."""
    if scheme != "file":
        monkeypatch.setattr(commits, "urlparse", lambda x: type("Url", (), {"scheme": scheme}))
    path = str(tmp_path / "v" / "1.json")
    assert [commits.create_once(spark, path, x) for x in ("one", "two")] == [True, False]
    assert (tmp_path / "v" / "1.json").read_text() == "one"


def test_two_writers_lose_nothing(spark, tmp_path):
    """Each of two writers is overtaken by the other between reading and writing."""
    path, mine, theirs, third = str(tmp_path / "s"), *(frame(spark, log(60, 25, k)) for k in (1, 2, 3))
    commits.commit(spark, path, mine)
    overtaken = []

    def overtake(attempt):
        if attempt < 2:
            overtaken.append(commits.commit(spark, path, third if attempt else frame(spark, log(5, 4, 9))))

    version = commits.commit(spark, path, theirs, before_create=overtake)
    assert overtaken == [2, 3] and version == 4 and commits.versions(spark, path) == [1, 2, 3, 4]
    want = mine.limit(0)
    for part in (mine, frame(spark, log(5, 4, 9)), third, theirs):
        want = st.merge(part, want, "paper_id", "seq")
    latest = {r.paper_id: r.updated_at for r in want.collect()}
    got = commits.read(spark, path)
    assert {r.paper_id: r.updated_at for r in got.collect()} == latest and got.count() == len(latest)
    assert commits.read(spark, path, version=1).count() == st.latest(mine, "paper_id", ("updated_at", "seq")).count()


def test_three_attempts(spark, tmp_path):
    path, k = str(tmp_path / "s"), iter(range(100, 200))
    other = lambda attempt: commits.commit(spark, path, frame(spark, log(1, 1, next(k))))
    with pytest.raises(commits.Conflict):
        commits.commit(spark, path, frame(spark, log(3, 3, 1)), before_create=other)
    assert commits.describe(spark, path)["version"] == 3


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "s")
    commits.commit(spark, path, frame(spark, log(200, 90, 1)))
    before = commits.describe(spark, path)["buckets"]
    commits.commit(spark, path, frame(spark, [("p1", 1, True, False, 5000, [])]))
    after = commits.describe(spark, path)["buckets"]
    assert len(before) == commits.BUCKETS and sum(before[b] != after[b] for b in before) == 1


def test_views_follow_commits(spark, tmp_path):
    """A view's counts are those of the state after each commit, tombstones and retracted tags included; a repeated batch does nothing."""
    path, views = str(tmp_path / "s"), {"tags": F.col("tags")}
    for k in range(4):
        version = commits.commit(spark, path, frame(spark, log(40, 20, k)), views=views, writer="w", batch=k, now_ms=1200 if k == 3 else None)
        assert {r.value: r.n for r in commits.read_view(spark, path, "tags").collect()} == tags_of(commits.read(spark, path))
    assert commits.commit(spark, path, frame(spark, log(40, 20, 9)), views=views, writer="w", batch=3) == version == 4
    assert commits.commit(spark, path, frame(spark, []), views=views) == 4
    assert commits.clear(spark, path, keep=1) >= 6 and commits.versions(spark, path) == [4]
    assert {r.value: r.n for r in commits.read_view(spark, path, "tags").collect()} == tags_of(commits.read(spark, path))


def test_states_without_rows(spark, tmp_path):
    path = str(tmp_path / "none")
    assert commits.read(spark, path, KIND).count() == 0 and commits.read_view(spark, path, "tags").count() == 0
    with pytest.raises(ValueError):
        commits.read(spark, path)
    commits.commit(spark, path, frame(spark, [(None, 1, True, False, 5, None), (None, 2, True, False, 6, ["x"])]), views={"tags": F.col("tags")})
    assert rows_of(commits.read(spark, path)) == [(None, 2, False)] and commits.read_view(spark, path, "tags").first().n == 1


def test_a_stream_commits_by_micro_batches(spark, tmp_path):
    """Several batches, a second run over the same checkpoint with more files, and a new checkpoint that reads all again."""
    src, path, parts = tmp_path / "in", str(tmp_path / "s"), [log(50, 30, k, local=bool(k % 2)) for k in range(5)]
    for k in range(3):
        frame(spark, parts[k]).coalesce(1).write.parquet(str(src / f"part={k}"))
    stream = lambda: spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    views = {"tags": F.col("tags")}

    def holds(n):
        want = st.latest(frame(spark, [r for p in parts[:n] for r in p]))
        assert rows_of(commits.read(spark, path)) == rows_of(want)
        assert {r.value: r.n for r in commits.read_view(spark, path, "tags").collect()} == tags_of(want)

    streams.run_commits(stream(), path, str(tmp_path / "c"), views=views)
    assert commits.describe(spark, path)["version"] == 3
    holds(3)
    for k in (3, 4):
        frame(spark, parts[k]).coalesce(1).write.parquet(str(src / f"part={k}"))
    streams.run_commits(stream(), path, str(tmp_path / "c"), views=views)
    assert commits.describe(spark, path)["version"] == 5
    holds(5)
    streams.run_commits(stream(), path, str(tmp_path / "other"), views=views)
    assert commits.describe(spark, path)["version"] == 10
    holds(5)
    # A batch that is done again after a lost acknowledgement.
    query = next(iter(commits.describe(spark, path)["batches"]))
    commits.commit(spark, path, frame(spark, log(9, 9, 77)), writer=query, batch=0)
    holds(5)
