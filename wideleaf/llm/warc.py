"""WARC archives of gzip members: a writer with payload revisits, and a splittable reader.

Writer: each row becomes one record in one gzip member.  Spark's own text writer puts the members behind one another
(committed whole, on any file system that Spark knows): each row is a member less its last byte, and the
line separator is that byte, zero, for it is the top byte of the size of a record below 16 MiB; a larger record
is followed by an empty member, which ends in zero too.

Reader: a task takes a byte range of a file, scans it for the gzip magic, takes a candidate for a member if its
decoded head is that of a WARC record, and owns the records whose members start in its range, reading on
beyond its end for the last one.

Defined results: a null html is an empty payload; of the records of one payload of at least ``least`` bytes, the first by
page_id (nulls last; among equal ids the first row) is the response and the others are revisits of it; null urls are
left out of the header; a null page_id comes back null; further columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wideleaf.llm.common import map_batches, row_id, ship, sieved, spool_path

MAGIC = b"\x1f\x8b\x08"
_EMPTY = gzip.compress(b"", mtime=0)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: As many payloads, the most frequent ones, meet their first record by a broadcast.
HOT = 4096


def _record(kind: str, page: int | None, url: str | None, digest: str, size: int, refers: int | None, payload: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(size))]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{'' if refers is None else refers}>")]
    body = _HTTP + (payload if kind == "response" else b"")
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    data = gzip.compress(record, 6, mtime=0)
    return data if len(record) < 1 << 24 else data + _EMPTY


def write(pages: DataFrame, path: str, *, least: int = 100) -> None:
    """Archive ``pages`` (page_id, url, html) under ``path``."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    full = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("payload"), row_id().alias("rid"))
    full = full.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    firsts = full.where(F.col("size") >= least).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "rid")).alias("first"), F.count("*").alias("n")).where("n > 1")
    # Payloads stay where they are but for those that a sieve tells may stand elsewhere too; of these, the most frequent ones meet
    # their first by a broadcast of as many rows, and only the others are shuffled.  All in one job, so a row has one rid.
    told = sieved(full, firsts, ["digest"], "_maybe")
    maybe, hot = told.where("_maybe").drop("_maybe"), firsts.orderBy(F.desc("n"), "digest").limit(HOT)
    alone = told.where("not _maybe").drop("_maybe").withColumn("first", F.lit(None).cast(firsts.schema["first"].dataType))
    frequent = maybe.join(F.broadcast(hot.drop("n")), "digest")
    others = maybe.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(firsts.drop("n").hint("shuffle_merge"), "digest", "left")
    joined = alone.unionByName(frequent).unionByName(others).withColumn("again", F.col("first").isNotNull() & (F.col("first.rid") != F.col("rid")))
    rows = joined.select("page_id", "url", "digest", "size", "again", F.when(F.col("again"), F.col("first.page_id")).alias("refers"), F.when(~F.col("again"), F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, url, digest, size, again, refers, payload in zip(*(c.to_pylist() for c in batch.columns)):
                out.append(_member(_record("revisit" if again else "response", page, url, digest, size, refers, payload or b""))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    map_batches(rows, run, "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [(str(x.getPath().toString()), x.getLen()) for x in system.listStatus(where) if x.isFile() and x.getPath().getName()[0] not in "_." and x.getLen()]


class _Window:
    """Bytes of a file from some place on, read as they are asked for."""

    def __init__(self, file, start: int, size: int, chunk: int = 1 << 20):
        self.file, self.at, self.data, self.size, self.chunk = file, start, b"", size, chunk

    def drop(self, upto: int) -> None:
        self.data, self.at = self.data[upto - self.at :], upto

    def more(self) -> bool:
        here = self.at + len(self.data)
        if here >= self.size:
            return False
        self.file.seek(here)
        self.data += self.file.read(min(self.chunk, self.size - here))
        return True


def _decode(window: _Window, at: int, head: bool) -> tuple[bytes, int] | None:
    """The member at ``at`` and where it ends; with ``head`` only its first bytes.  None if it is no member of a record."""
    machine, out, place = zlib.decompressobj(31), [], at
    got = 0
    while True:
        data = window.data[place - window.at :]
        if not data:
            if not window.more():
                return None
            continue
        try:
            out.append(machine.decompress(data, 64 - got) if head else machine.decompress(data))
        except zlib.error:
            return None
        got += len(out[-1])
        place += len(data) - len(machine.unused_data) - len(machine.unconsumed_tail)
        if head and (got >= 8 or machine.eof):
            return b"".join(out), place
        if machine.eof:
            return b"".join(out), place


def scan_range(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """The records whose members start in [start, end), with their places."""
    window, at = _Window(file, start, size), start
    while at < end:
        found = window.data.find(MAGIC, at - window.at)
        if found < 0:
            at = max(at, window.at + len(window.data) - len(MAGIC) + 1)
            window.drop(min(at, window.at + len(window.data)))
            if at >= end or not window.more():
                return
            continue
        at = window.at + found
        if at >= end:
            return
        window.drop(at)
        head = _decode(window, at, True)
        if head is None or not head[0].startswith(b"WARC/1."):
            at += 1
            continue
        whole = _decode(window, at, False)
        if whole is None:
            at += 1
            continue
        yield at, whole[0]
        at = whole[1]


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    return fields, rest[: int(fields.get("content-length", len(rest)))]


def read(spark: SparkSession, path: str, *, split: int = 32 << 20) -> DataFrame:
    """The records under ``path``: file, offset, record_type, record_id, refers_to, target_uri, payload_digest and
    payload_length as the header states them, and payload (of revisits null)."""
    ranges = [(name, size, a, min(a + split, size)) for name, size in _files(spark, path) for a in range(0, size, split)]
    frame = spark.createDataFrame(ranges or [("", 0, 0, 0)], "file string, size long, start long, stop long").repartition(max(1, len(ranges)))
    schema = "file string, offset long, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_length long, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                if not name:
                    continue
                system, inner = pafs.FileSystem.from_uri(name)
                rows, held = [], 0
                with system.open_input_file(inner) as file:
                    for offset, record in scan_range(file, size, start, stop):
                        fields, content = parse(record)
                        revisit = fields.get("warc-type") == "revisit"
                        length = fields.get("x-payload-length")
                        rows.append((name, offset, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-payload-digest"), int(length) if length else None, None if revisit else content.partition(b"\r\n\r\n")[2]))
                        held += len(record)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    ship(spark)
    return frame.mapInArrow(run, schema)


def report(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` to archives, read these back: page_id, payload_bytes, payload_digest, record_type and refers_to."""
    spark = pages.sparkSession
    path = path or spool_path(spark, "warc")
    kind = pages.schema["page_id"].dataType.simpleString()
    write(pages, path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) as {kind})")
    records = read(spark, path, split=4 << 20)
    response = F.col("record_type") == "response"
    return records.select(
        number("record_id").alias("page_id"), F.when(response, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.regexp_extract("payload_digest", "^sha256:(.*)$", 1)).alias("payload_digest"),
        "record_type", F.when(~response, number("refers_to")).alias("refers_to"),
    )
