"""WARC archives by a chunked record table.

Archives are written from, and read back as, a table of chunks: (record_id, chunk, data, seen, digest). A
payload larger than a chunk is many rows, each with the payload bytes and the SHA-1 so far; writers and
readers hold one chunk at a time. Each task writes archives of its own, one gzip member per record,
under a name of its attempt in the shared folder; a manifest of the files of finished tasks decides
which count, so that a lost or repeated task leaves nothing in the result. The folder must be on a file
system that pyarrow opens.

Records with equal payloads of at least ``least`` bytes: the one with the largest id is a
``response``, the others are ``revisit`` records that refer to it and hold no payload. A revisit
keeps the payload's digest, and the length in its HTTP header. Only digests are grouped. The groups, up to
``joins.HOT`` of them, are broadcast, so that payloads are written where they are read; only payloads that
may be in one of the other groups are shuffled.

Defined results: a null payload is the empty one; a null URL is ``urn:page:<id>``; every row has a
record, rows of one id too, and those with a null id, which counts as the smallest; of several rows of
the largest id one is the response, of the largest URL. Equality of payloads is that of SHA-1 and length.
Other columns aren't archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, qualified, shared_dir, stored
from .joins import hot_from, lookup

CHUNK = 1 << 20
#: Bytes of chunks that a task holds before it hands them on.
HELD = 4 << 20
FILE_BYTES = 1 << 30
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "record_id string, chunk int, page_id long, url string, sha1 string, bytes long, revisit boolean, refers_to long, data binary, seen long, digest string, last boolean"
SCHEMA = pa.schema([("record_id", pa.string()), ("chunk", pa.int32()), ("page_id", pa.int64()), ("url", pa.string()), ("sha1", pa.string()), ("bytes", pa.int64()), ("revisit", pa.bool_()), ("refers_to", pa.int64()), ("data", pa.binary()), ("seen", pa.int64()), ("digest", pa.string()), ("last", pa.bool_())])


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> DataFrame:
    """What to write: (page_id, url, payload, sha1, bytes, revisit, refers_to), without payload for revisits."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(html, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.length("payload").cast("long"))
    rows = rows.withColumn("same", F.when(F.col("bytes") >= least, F.concat_ws(":", "sha1", F.col("bytes").cast("string"))))
    each = rows.filter(F.col("same").isNotNull()).groupBy("same", "page_id").agg(F.count("same").alias("m"))
    groups = each.groupBy("same").agg(F.max(F.struct("page_id", "m")).alias("top"), F.sum("m").alias("count")).filter("count > 1")
    groups = stored(groups.select("same", F.col("top.page_id").alias("first"), F.col("top.m").alias("tied"), "count"), "groups")

    facts = F.struct("first", "tied").alias("group")
    from_ = hot_from(groups, least=2)
    hot, cold = groups.filter(F.col("count") >= from_), groups.filter(F.col("count") < from_)
    told = rows.join(F.broadcast(hot.select(F.col("same").alias("_s"), facts)), F.col("same") == F.col("_s"), "left").drop("_s")
    if cold.isEmpty():
        found = told
    else:
        alone, maybe = lookup(told.withColumn("same", F.when(F.col("group").isNull(), F.col("same"))), ["same"], cold.select("same", facts.alias("cold")))
        found = alone.unionByName(maybe.withColumn("group", F.coalesce("group", "cold")).drop("cold"))
    is_first = F.col("page_id").eqNullSafe(F.col("group.first"))
    revisit = F.col("group").isNotNull() & ~is_first
    out = ["page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "sha1", "bytes", revisit.alias("revisit"), F.when(revisit, F.col("group.first")).alias("refers_to")]
    tied = F.col("group").isNotNull() & is_first & (F.col("group.tied") > 1)
    several = groups.filter("tied > 1")
    if several.isEmpty():
        return found.select(*out)
    # Of rows that share the largest id and the payload, one is the response; what is left of each URL's are revisits.
    copies = found.filter(tied)
    names = copies.groupBy("page_id", "sha1", "bytes", "url").agg(F.count("sha1").alias("m"))
    top = names.groupBy(F.col("page_id").alias("_p"), F.col("sha1").alias("_s"), F.col("bytes").alias("_b")).agg(F.max("url").alias("_u"))
    last = F.col("url").eqNullSafe(F.col("_u"))
    left = names.join(top, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("sha1") == F.col("_s")) & (F.col("bytes") == F.col("_b"))).withColumn("m", F.col("m") - F.when(last, 1).otherwise(0))
    again = left.filter("m > 0").select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "sha1", "bytes", F.lit(True).alias("revisit"), F.col("page_id").alias("refers_to"), F.explode(F.sequence(F.lit(1), F.col("m").cast("int")))).drop("col")
    one = copies.groupBy("page_id", "sha1", "bytes").agg(F.max(F.struct("url", "payload")).alias("r")).select("page_id", "r.url", "r.payload", "sha1", "bytes", F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("refers_to"))
    return found.filter(~tied).select(*out).unionByName(one).unionByName(again)


def name_of(page_id: int | None, sha1: str, response: bool, least: bool) -> str:
    """A record's identifier: a payload of at least the least size has one response of an id, others get a number."""
    return f"urn:page:{'' if page_id is None else page_id}:{sha1 if response and least else uuid.uuid4().hex}"


def chunks(rows: DataFrame, chunk: int = CHUNK, least: int = 1000) -> DataFrame:
    """The chunk table of ``records``, the chunks of a record together and in order.

    A revisit has one row without data; a response has one for each ``chunk`` bytes of its payload, with the bytes
    and the SHA-1 up to there.
    """

    def cut_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in parts:
            facts = {c: batch.column(c).to_pylist() for c in ("page_id", "url", "sha1", "bytes", "revisit", "refers_to")}
            payloads = batch.column("payload")
            for k in range(len(batch)):
                page, url, sha1, length, revisit, refers = (facts[c][k] for c in facts)
                row = (name_of(page, sha1, not revisit, length >= least),)
                if revisit:
                    held.append((*row, 0, page, url, sha1, length, True, refers, None, 0, None, True))
                    size += 256
                else:
                    data, done = memoryview(payloads[k].as_buffer() or b""), hashlib.sha1()
                    for number, at in enumerate(range(0, max(1, length), chunk)):
                        piece = bytes(data[at : at + chunk])
                        done.update(piece)
                        end = at + len(piece)
                        held.append((*row, number, page, url, sha1, length, False, None, piece, end, done.hexdigest(), end == length))
                        size += len(piece) + 256
                        if size >= HELD:
                            yield batch_of(held)
                            held, size = [], 0
        if held:
            yield batch_of(held)

    return rows.mapInArrow(cut_up, CHUNKS)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SCHEMA.types)], schema=SCHEMA)


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def head(record_id: str, url: str | None, sha1: str, length: int, refers_to: str | None) -> bytes:
    """The WARC header of a record, up to where its block begins, and the block's HTTP header."""
    http = http_head(length)
    kind = "response" if refers_to is None else "revisit"
    target = re.sub(r"[\x00-\x20\x7f]+", "%20", url) if url else record_id
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (length if refers_to is None else 0)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


class Archive:
    """A growing archive file: one gzip member per record, written as its chunks come."""

    def __init__(self, folder: str):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        self.out = system.open_output_stream(f"{path}/{self.path.rsplit('/', 1)[-1]}", compression=None)
        self.records = self.bytes = 0

    def begin(self) -> None:
        self.gzip = zlib.compressobj(1, zlib.DEFLATED, 31)

    def write(self, data: bytes) -> None:
        got = self.gzip.compress(data)
        self.bytes += len(got)
        self.out.write(got)

    def end(self) -> None:
        self.write(b"\r\n\r\n")
        got = self.gzip.flush()
        self.bytes += len(got)
        self.out.write(got)
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.records, self.bytes


def write(table: DataFrame, folder: str) -> DataFrame:
    """Write a chunk table, the rows of a record together and in order. Returns the manifest: (path, records, bytes).

    The manifest is materialised, so the files are written once; a file starts anew past ``FILE_BYTES``.
    """
    columns = ["record_id", "chunk", "page_id", "url", "sha1", "bytes", "revisit", "refers_to", "digest", "last"]

    def written(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, archive = [], None
        for batch in parts:
            facts, payload = zip(*[batch.column(c).to_pylist() for c in columns]), batch.column("data")
            for k, (record, chunk, page, url, sha1, length, revisit, refers, digest, last) in enumerate(facts):
                if chunk == 0:
                    if archive is not None and archive.bytes >= FILE_BYTES:
                        done.append(archive.close())
                        archive = None
                    archive = archive or Archive(folder)
                    archive.begin()
                    archive.write(head(record, url, sha1, length, name_of(refers, sha1, True, True) if revisit else None))
                if not revisit:
                    archive.write(payload[k].as_buffer())
                if last:
                    if not revisit and digest != sha1:
                        raise ValueError(f"the chunks of {record} do not match its digest")
                    archive.end()
        if archive is not None:
            done.append(archive.close())
        paths, records, size = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(records, pa.int64()), pa.array(size, pa.int64())], names=["path", "records", "bytes"])

    return cut(table.mapInArrow(written, "path string, records long, bytes long"))


class Source:
    """Reads an archive of gzip members or plain text as one stream, ``size`` bytes at a time."""

    def __init__(self, path: str, size: int):
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path)
        self.file, self.size = system.open_input_stream(name, compression=None), size
        self.gzip, self.raw, self.ahead = None, b"", b""
        self.packed = None

    def more(self) -> bool:
        """Append at most ``size`` decompressed bytes to ``ahead``; False at the end."""
        while True:
            if not self.raw:
                self.raw = self.file.read(self.size)
                if not self.raw:
                    return False
            if self.packed is None:
                self.packed = self.raw[:2] == b"\x1f\x8b"
            if not self.packed:
                got, self.raw = self.raw, b""
            else:
                self.gzip = self.gzip or zlib.decompressobj(31)
                got = self.gzip.decompress(self.raw, self.size)
                self.raw = self.gzip.unconsumed_tail
                if self.gzip.eof:
                    self.raw, self.gzip = self.gzip.unused_data + self.raw, None
            if got:
                self.ahead += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with ``mark``; None at a clean end."""
        while (at := self.ahead.find(mark)) < 0:
            if not self.more():
                if self.ahead.strip():
                    raise ValueError("the archive ends within a header")
                return None
        out, self.ahead = self.ahead[: at + len(mark)], self.ahead[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        while not self.ahead and self.more():
            pass
        out, self.ahead = self.ahead[:n], self.ahead[n:]
        if not out:
            raise ValueError("the archive ends within a record")
        return out


def fields(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").strip("\r\n").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read(path: str, size: int = CHUNK) -> Iterator[dict]:
    """The records of an archive, streamed, as chunk rows.

    Each row has the record's id and fields, its chunk number and data, the payload bytes and the
    SHA-1 so far; the last row of a record has ``last`` set and its digest complete.
    """
    source = Source(path, size)
    while (block := source.until(b"\r\n\r\n")) is not None:
        block = block.lstrip(b"\r\n")
        if not block:
            continue
        warc = fields(block)
        left = int(warc["content-length"])
        http = source.until(b"\r\n\r\n")
        left -= len(http)
        row = {"record_id": warc["warc-record-id"], "type": warc["warc-type"], "refers_to": warc.get("warc-refers-to"), "digest": warc.get("warc-payload-digest"), "length": int(fields(http).get("content-length", left))}
        sha1, seen, chunk = hashlib.sha1(), 0, 0
        while True:
            data = source.take(min(left, size)) if left else b""
            left -= len(data)
            seen += len(data)
            sha1.update(data)
            yield row | {"chunk": chunk, "data": data, "seen": seen, "last": not left, "sha1": None if left else sha1.hexdigest()}
            chunk += 1
            if not left:
                break
        if source.until(b"\r\n\r\n") != b"\r\n\r\n":
            raise ValueError("a record must end with two line breaks")


def read_chunks(manifest: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunk table of archives: (record_id, chunk, type, refers_to, data, seen, last, sha1); ``sha1`` when ``last``."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["record_id", "chunk", "type", "refers_to", "data", "seen", "last", "sha1"]
        for part in parts:
            for path in part.path:
                for r in read(path, size):
                    yield pd.DataFrame([[r[c] for c in columns]], columns=columns)

    return spread(manifest).mapInPandas(rows, "record_id string, chunk int, type string, refers_to string, data binary, seen long, last boolean, sha1 string")


def spread(manifest: DataFrame) -> DataFrame:
    """One archive to a task, as far as there are cores."""
    return manifest.select("path").repartition(max(1, manifest.count()), "path")


def read_index(manifest: DataFrame, size: int = CHUNK) -> DataFrame:
    """One row per archived record: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Digests of responses are computed from the payload as its chunks stream by, and must equal the
    header's; those of revisits are the header's.
    """

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        number = re.compile(r"<urn:page:(-?\d*)(?::[^>]*)?>")
        page = lambda name: int(n) if (n := number.fullmatch(name)[1]) else None
        for part in parts:
            for path in part.path:
                out = []
                for r in read(path, size):
                    if not r["last"]:
                        continue
                    named = base64.b32decode(r["digest"].removeprefix("sha1:")).hex()
                    if r["type"] == "response" and (named, r["length"]) != (r["sha1"], r["seen"]):
                        raise ValueError(f"{r['record_id']} in {path} does not match its digest")
                    to = page(r["refers_to"]) if r["refers_to"] else None
                    out.append((page(r["record_id"]), r["length"], named, r["type"], to))
                    if len(out) == 4096:
                        yield pd.DataFrame(out, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
                        out = []
                yield pd.DataFrame(out, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    return spread(manifest).mapInPandas(rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, folder: str | None = None) -> DataFrame:
    """Write all pages as archives under ``folder`` (by default one in the shared folder). Returns the manifest."""
    folder = qualified(pages.sparkSession, folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}")
    return write(chunks(records(pages, key, url, html, least), least=least), folder)
