"""A paged metadata feed as a Spark data source: one partition a set, resumption tokens, retries."""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .feeds import FEED, records

# Attempts, and waits in seconds after a refusal.
ATTEMPTS, BUSY, BUSY_LEAST = 6, 20, 5


class Refused(Exception):
    """The feed says that a request itself is wrong; another attempt would not help."""


def fetch(url: str, sleep: Callable[[float], None] = time.sleep, timeout: float = 120) -> str:
    """A page, by up to six attempts: a busy feed (503) names its wait, other failures wait twice as long each time."""
    last: Exception | None = None
    for attempt in range(ATTEMPTS):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                return answer.read().decode("utf-8")
        except urllib.error.HTTPError as e:
            if e.code == 400:
                raise Refused(f"{url}: {e.code}") from e
            named = e.headers.get("Retry-After", "") if e.headers else ""
            wait = max(int(named) if named.isdigit() else BUSY, BUSY_LEAST) if e.code == 503 else 2**attempt
            last = e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            wait, last = 2**attempt, e
        if attempt + 1 < ATTEMPTS:
            sleep(wait)
    raise RuntimeError(f"{url}: no answer in {ATTEMPTS} attempts") from last


def pages(base: str, params: dict[str, str], get: Callable[[str], str] = fetch) -> Iterator[str]:
    """A list's pages: the first by its parameters, each next by the token that the one before ends with."""
    url = f"{base}?{urllib.parse.urlencode({'verb': 'ListRecords'} | params)}"
    while True:
        page = get(url)
        yield page
        token = re.search(r"<resumptionToken[^>]*>([^<]*)</resumptionToken>", page)
        if not token or not token[1].strip():
            return
        url = f"{base}?{urllib.parse.urlencode({'verb': 'ListRecords', 'resumptionToken': token[1].strip()})}"


class SetPartition(InputPartition):
    def __init__(self, name: str, since: str, until: str):
        self.name, self.since, self.until = name, since, until


class _Sets:
    """What both readers share: a partition is one set and a range of days."""

    def __init__(self, options):
        self.options = dict(options)
        self.sets = [s for s in self.options["sets"].split(",") if s]

    def pages(self, name: str, since: str, until: str) -> Iterator[str]:
        pause = float(self.options.get("pause", "1"))
        params = {"metadataPrefix": self.options.get("format", "arXiv"), "set": name, "from": since, "until": until}
        return pages(self.options["url"], {k: v for k, v in params.items() if v}, lambda url: fetch(url, lambda s: time.sleep(s * pause)))

    def read(self, partition):
        for page in self.pages(partition.name, partition.since, partition.until):
            for record in re.findall(r"<record>.*?</record>", page, re.S):
                yield (partition.name, record)


class FeedReader(_Sets, DataSourceReader):
    def partitions(self):
        return [SetPartition(s, self.options.get("from", ""), self.options.get("until", "")) for s in self.sets]


class FeedStream(_Sets, DataSourceStreamReader):
    """An offset has a mark for each set: the day up to which it was harvested.

    A set's next range begins with its mark's day, that day included, as more may have come on it. A set that gives
    no first page keeps its mark, and the others go on; it is asked again at the next trigger. A set that fails
    later, within a task, fails the batch, which Spark does again from the same marks. One that fails at a restart has the
    first day as its mark again: records come twice then, and none is lost.
    """

    def initialOffset(self):
        return dict.fromkeys(self.sets, self.options.get("from", ""))

    def latestOffset(self):
        until = self.options.get("until") or time.strftime("%Y-%m-%d", time.gmtime())
        self.marks = getattr(self, "marks", None) or self.initialOffset()
        for name in self.sets:
            if self.marks[name] != until:
                try:
                    next(self.pages(name, self.marks[name], until))
                except (RuntimeError, Refused):
                    continue
                self.marks[name] = until
        return dict(self.marks)

    def partitions(self, start, end):
        self.marks = dict(end)
        return [SetPartition(s, start.get(s, ""), end[s]) for s in self.sets if end[s] > start.get(s, "")] or [SetPartition("", "", "")]

    def read(self, partition):
        return super().read(partition) if partition.name else iter(())

    def commit(self, end):
        pass


class FeedSource(DataSource):
    @classmethod
    def name(cls):
        return "paged_feed"

    def schema(self):
        return "set string, record string"

    def reader(self, schema):
        return FeedReader(self.options)

    def streamReader(self, schema):
        return FeedStream(self.options)


def options(url: str, sets: list[str], since: str, until: str, pause: float) -> dict[str, str]:
    return {"url": url, "sets": ",".join(sets), "from": since, "until": until, "pause": str(pause)}


def stream_live(spark: SparkSession, url: str, sets: list[str], since: str = "", until: str = "", pause: float = 1) -> DataFrame:
    """A live feed's sets as a stream of (set, record), each set with a mark of its own; ``harvested`` reads the records."""
    spark.dataSource.register(FeedSource)
    return spark.readStream.format("paged_feed").options(**options(url, sets, since, until, pause)).load()


def harvested(raw: DataFrame) -> DataFrame:
    """Records of (set, record), as ``read_feed`` gives them."""
    return records(raw.select(F.from_xml("record", FEED).alias("r")).select("r.*"))


def read_live(spark: SparkSession, url: str, sets: list[str], since: str = "", until: str = "", pause: float = 1) -> DataFrame:
    """Records of a live feed's sets, as ``read_feed`` gives them; every set is a partition that Spark retries by itself."""
    spark.dataSource.register(FeedSource)
    return harvested(spark.read.format("paged_feed").options(**options(url, sets, since, until, pause)).load())
