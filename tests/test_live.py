import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from folioscan.sources import live

RECORD = "<record><header><identifier>oai:x:{0}</identifier><datestamp>2024-01-01</datestamp></header><metadata><arXiv><id>{0}</id><created>2023-01-01</created><title>Paper {0}</title><categories>cs.AI</categories></arXiv></metadata></record>"


asked: list[tuple[str, str, str]] = []
down: set[str] = set()


@pytest.fixture(scope="module")
def feed():
    busy = {"left": 1}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            asked.append((q.get("set", [""])[0], q.get("from", [""])[0], q.get("until", [""])[0]))
            if q.get("set", [""])[0] in down:
                self.send_response(500)
                self.end_headers()
                return
            if q.get("set") == ["bad"]:
                self.send_response(400)
                self.end_headers()
                return
            if "resumptionToken" in q and busy["left"]:
                busy["left"] -= 1
                self.send_response(503)
                self.send_header("Retry-After", "1")
                self.end_headers()
                return
            second = "resumptionToken" in q
            body = RECORD.format(2 if second else 1) + ("<resumptionToken/>" if second else "<resumptionToken cursor='0'>tok</resumptionToken>")
            self.send_response(200)
            self.end_headers()
            self.wfile.write(f"<OAI-PMH><ListRecords>{body}</ListRecords></OAI-PMH>".encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/oai"
    server.shutdown()


def test_pages_tokens_and_retries(spark, feed):
    got = live.read_live(spark, feed, ["cs:cs:AI"], since="2024-01-01", pause=0)
    assert sorted((r.id, r.title) for r in got.collect()) == [("1", "Paper 1"), ("2", "Paper 2")]


def test_waits():
    waited = []
    with pytest.raises(RuntimeError):
        live.fetch("http://127.0.0.1:9/none", waited.append, 1)
    assert waited == [1, 2, 4, 8, 16]


def test_refusal(feed):
    with pytest.raises(live.Refused):
        live.fetch(f"{feed}?set=bad", lambda s: None)


def test_a_streamed_feed_keeps_a_mark_for_each_set(spark, feed, tmp_path):
    """Two runs over one checkpoint: the set that fails in the first is harvested from its old mark in the second."""

    def run(until):
        asked.clear()
        stream = live.stream_live(spark, feed, ["cs:cs:AI", "stat"], "2024-01-01", until, 0)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        ranges = {a for a in asked if a[0]}
        return ranges, sorted((r["set"], r.n) for r in spark.read.parquet(str(tmp_path / "out")).groupBy("set").count().withColumnRenamed("count", "n").collect())

    down.add("stat")
    ranges, rows = run("2024-02-01")
    assert ("cs:cs:AI", "2024-01-01", "2024-02-01") in ranges and rows == [("cs:cs:AI", 2)]
    down.clear()
    ranges, rows = run("2024-03-01")
    assert ranges == {("cs:cs:AI", "2024-02-01", "2024-03-01"), ("stat", "2024-01-01", "2024-03-01")}
    assert rows == [("cs:cs:AI", 4), ("stat", 2)]
    assert run("2024-03-01")[1] == rows
    got = live.harvested(spark.read.parquet(str(tmp_path / "out")))
    assert {r.id for r in got.collect()} == {"1", "2"}
