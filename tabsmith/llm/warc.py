"""WARC archives of pages, and a two-level index of their captures.

Writing: a page is a ``response`` record, or, if its payload has at least ``least_bytes`` and equals that of another
page, a ``revisit`` record without payload that refers to the page with the largest id. Records are laid out by
column expressions and written by Spark's text writer, whose line separator is the blank lines that end a record, so
archives appear whole or not at all and payloads are not shuffled.

Index: captures are sorted by their reversed-host URL key (``com,example,www)/path``) into blocks of ``block_rows``
lines, each compressed on its own; a sparse directory holds the first and last key of every block, in order, in files of
at most ``DIRECTORY_ROWS`` lines. ``find`` takes a table of keys: they are sorted by range, each task halves the list of
directory files and the file itself for each of its keys, the keys meet their blocks by block number, and each
block is unpacked once and searched by halving. ``read_captures`` then reads the byte ranges of the records.
Of the directory a task holds two files at a time, and the driver one line per file.

Archives are read with seeks by ``pyarrow.fs``, so they must lie where that reaches (local or shared disks, HDFS, S3,
GCS). Edge cases: a null page is empty; a null URL has the empty key; an empty table makes no archive, and its index is
empty; pages that repeat an id and a payload are all responses; null ids lose to others and are kept as null;
white space and control characters of a URL are percent-encoded. Columns beside page_id, url and html are not read.
"""

from __future__ import annotations

import functools
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm.common import bounded, scratch_path, stored

END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
READ_BYTES = 8 << 20
"""Captures of one archive are read in ranges of about these bytes."""
DIRECTORY_ROWS = 50_000
"""Lines of one directory file."""
CAPTURE = "key string, url string, type string, digest string, page_id long, file string, offset long, length long"


def written_url(url: Column) -> Column:
    """A URL as its record names it."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, " ", "%20"), "\n", "%0A"), "[\\x00-\\x1F\\x7F]", "%00")


def record(kind: Column, page_id: Column, url: Column, payload: Column, digest: Column, size: Column, refers: Column, date: str) -> Column:
    """One WARC record without the blank lines behind it."""
    identity = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    body = F.when(kind == "response", F.concat(http, payload)).otherwise(http)
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind,
        F.lit("\r\nWARC-Record-ID: "), identity(page_id),
        F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), written_url(url)), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), digest,
        F.when(kind == "revisit", F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
            identity(refers))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit(END), body,
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = 1000, date: str = DATE) -> None:
    """Write ``pages(page_id, url, html)`` as uncompressed WARC files below ``path``."""
    payload = F.coalesce("html", F.lit(""))
    slim = pages.select("page_id", F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size"))
    large = stored(slim.where(F.col("size") >= least_bytes).groupBy("digest", "page_id").agg(F.count("*").alias("times")), "payloads")
    copies = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("ids")).where("ids > 1")
    copies = stored(copies.select(F.col("digest").alias("__digest"), F.col("first").alias("__first")), "payload-copies")
    side = F.broadcast(copies) if bounded(copies) else copies.hint("merge")
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"),
                        F.octet_length(payload).cast("long").alias("size"))
    rows = rows.join(side, F.col("digest") == F.col("__digest"), "left")
    revisit = F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    kind = F.when(revisit, "revisit").otherwise("response")
    line = record(kind, F.col("page_id"), F.col("url"), F.col("html"), F.col("digest"), F.col("size"), F.col("__first"), date)
    rows.select(line.alias("value")).write.option("lineSep", END).text(path)


def url_key(url: str) -> str:
    """Reversed-host key that sorts the pages of a domain together."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    path = (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + f"{port}){path}"


def opened(file: str) -> pa.NativeFile:
    system, path = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", file))
    return system.open_input_file(path)


def head(data: bytes) -> dict[str, str]:
    """Fields of a record's header."""
    lines = data.decode("utf-8").split("\r\n")
    return dict(x.split(": ", 1) for x in lines[1:] if ": " in x)


def record_id(field: str) -> int | None:
    name = field.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def _captures(file: str) -> Iterator[tuple]:
    """Captures of one archive: headers are read, payloads are skipped."""
    stop = END.encode()
    with opened(file) as source:
        size, at = source.size(), 0
        while at < size:
            source.seek(at)
            data = source.read(2048)
            while (cut := data.find(stop)) < 0:
                more = source.read(65536)
                if not more:
                    raise ValueError(f"{file}: no record at byte {at}")
                data += more
            fields = head(data[:cut])
            length = cut + len(stop) + int(fields["Content-Length"])
            url = fields.get("WARC-Target-URI")
            yield (url_key(url or ""), url, fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                   record_id(fields["WARC-Record-ID"]), file, at, length)
            at += length + len(stop)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)


CAPTURES = pa.schema([("key", pa.string()), ("url", pa.string()), ("type", pa.string()), ("digest", pa.string()),
                      ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def captures(spark: SparkSession, archives: str) -> DataFrame:
    """One row per record of the archives below a path, in any order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(archives).select("path")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                yield from _batches(_captures(file), CAPTURES)

    return files.mapInArrow(scan, CAPTURE)


class CaptureIndex:
    """The two-level index below ``path``: ``blocks`` and ``directory``, both Parquet tables."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, spark: SparkSession, archives: str, path: str, block_rows: int = 3000) -> CaptureIndex:
        """Sort the captures by (key, url, page_id) over all tasks, and pack each task's rows block by block."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                held.append(batch)
                while sum(b.num_rows for b in held) >= block_rows:
                    table = pa.Table.from_batches(held)
                    yield _block(table.slice(0, block_rows))
                    held = table.slice(block_rows).to_batches()
            if held and sum(b.num_rows for b in held):
                yield _block(pa.Table.from_batches(held))

        ordered = stored(captures(spark, archives), "captures").repartitionByRange("key", "url", "page_id", "file", "offset")
        blocks = ordered.sortWithinPartitions("key", "url", "page_id", "file", "offset").mapInArrow(
            pack, "first_key string, last_key string, rows int, data binary")
        numbered = blocks.withColumn("block", F.monotonically_increasing_id())
        numbered.write.parquet(f"{path}/blocks")
        lines = spark.read.parquet(f"{path}/blocks").select("block", "first_key", "last_key", "rows").orderBy("block")
        lines.write.option("maxRecordsPerFile", DIRECTORY_ROWS).parquet(f"{path}/directory")
        return cls(spark, path)

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    def captures(self) -> DataFrame:
        """All captures, unpacked."""
        return self.blocks().select("data").mapInArrow(_unpack, CAPTURE)

    def directory(self) -> DataFrame:
        """(block, first key, last key, rows): a line per block. Blocks are numbered in the order of their keys."""
        return self.spark.read.parquet(f"{self.path}/directory")

    def _files(self) -> list[tuple]:
        """(first key, last key, file) of the directory's files, in the order of their blocks."""
        named = self.directory().groupBy(F.input_file_name().alias("file"))
        rows = named.agg(F.min("first_key").alias("first"), F.max("last_key").alias("last"), F.min("block").alias("block")).collect()
        return [(r["first"], r["last"], unquote(r["file"])) for r in sorted(rows, key=lambda r: r["block"])]

    def find(self, keys: DataFrame) -> DataFrame:
        """The captures of all ``keys(key)``, each once however often its key is asked for."""
        files = self._files()
        firsts, lasts = [f for f, _, _ in files], [last for _, last, _ in files]

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            @functools.lru_cache(2)
            def lines(file: str) -> tuple[list, list, list]:
                with opened(file) as source:
                    table = pq.read_table(source, columns=["first_key", "last_key", "block"]).sort_by("block")
                return tuple(c.to_pylist() for c in table.columns)

            def hits() -> Iterator[tuple]:
                for batch in batches:
                    for key in batch.column(0).to_pylist():
                        for i in range(bisect_left(lasts, key), bisect_right(firsts, key)):
                            first, last, block = lines(files[i][2])
                            for at in range(bisect_left(last, key), bisect_right(first, key)):
                                yield block[at], key

            yield from _batches(hits(), pa.schema([("block", pa.int64()), ("key", pa.string())]))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for wanted, data in zip(*batch.columns):
                    rows = _rows(data.as_py())
                    held = rows.column("key").to_pylist()
                    for key in wanted.as_py():
                        at = bisect_left(held, key)
                        yield from rows.slice(at, bisect_right(held, key) - at).to_batches()

        ordered = keys.where("key is not null").select("key").distinct().repartitionByRange("key").sortWithinPartitions("key")
        # A block holds no more different keys than rows.
        wanted = ordered.mapInArrow(search, "block long, key string").groupBy("block").agg(F.collect_list("key").alias("keys"))
        return wanted.join(self.blocks().select("block", "data"), "block").select("keys", "data").mapInArrow(pick, CAPTURE)

    def find_urls(self, pages: DataFrame) -> DataFrame:
        """The captures of the URLs of ``pages(url)``; a null URL finds the captures that have none."""

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([url_key(u or "") for u in batch.column(0).to_pylist()], pa.string())], ["key"])

        return self.find(pages.select(written_url(F.col("url")).alias("url")).mapInArrow(keyed, "key string"))

    def lookup(self, url: str) -> DataFrame:
        """The captures of one URL."""
        return self.find_urls(self.spark.createDataFrame([(url,)], "url string"))


def _block(table: pa.Table) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, CAPTURES) as writer:
        writer.write_table(table.cast(CAPTURES))
    data = zlib.compress(sink.getvalue().to_pybytes(), 6)
    keys = table.column("key")
    return pa.RecordBatch.from_arrays(
        [pa.array([keys[0].as_py()]), pa.array([keys[-1].as_py()]), pa.array([table.num_rows], pa.int32()), pa.array([data], pa.binary())],
        ["first_key", "last_key", "rows", "data"])


def _rows(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zlib.decompress(data)).read_all()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            yield from _rows(data.as_py()).to_batches()


def read_record(file: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header fields and body of one record, by one range read."""
    with opened(file) as source:
        source.seek(offset)
        return _parse(source.read(length))


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    cut = data.index(END.encode())
    return head(data[:cut]), data[cut + 4 :]


RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
                     ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_captures(found: DataFrame) -> DataFrame:
    """The records of ``found`` (rows of the index), read by ranges: captures that lie together are read together.

    ``payload`` is null for a revisit; its digest and size are those of the payload it refers to.
    """
    part = F.floor(F.col("offset") / READ_BYTES)
    near = found.repartition("file", part).sortWithinPartitions("file", "offset").select("file", "offset", "length")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part_of = batch.slice(at, 500)
                out = []
                for file, offset, length in zip(*(c.to_pylist() for c in part_of.columns)):
                    if file != name:
                        if source:
                            source.close()
                        name, source = file, opened(file)
                    source.seek(offset)
                    fields, body = _parse(source.read(length))
                    http, _, payload = body.partition(END.encode())
                    refers = fields.get("WARC-Refers-To")
                    out.append((record_id(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"],
                                fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(head(http)["Content-Length"]),
                                None if refers is None else record_id(refers), payload if refers is None else None))
                yield from _batches(iter(out), RECORDS)
        if source:
            source.close()

    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
    return near.mapInArrow(read, schema)


def archived(pages: DataFrame, least_bytes: int = 1000) -> tuple[str, CaptureIndex]:
    """Write the archives of ``pages`` and their index below the checkpoint folder."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, f"{path}/archives", least_bytes)
    return f"{path}/archives", CaptureIndex.build(pages.sparkSession, f"{path}/archives", f"{path}/index")
