"""WARC archives: a writer for pages, and a Python data source that reads records back.

The data source plans a partition per archive file, takes over filters on record type and other
headers, and parses headers before anything else: a record that the filters rule out, or whose
payload isn't asked for, is skipped without being decoded. Archives are gzipped by record; the writer
puts a record's length, packed and unpacked, into an extra field of its gzip header, so that the
reader goes on to the next one without inflating the rest. In archives without that field, what is
skipped is inflated and dropped. Files are reached through pyarrow's file systems, by URI.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from akzentor.llm.common import keep, slices, work_path

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Extra field of a gzip header with the member's length, packed and unpacked.
SKIP = b"SL"
#: Bytes that are inflated of a record before its headers have been looked at.
PEEK = 1024
#: Bytes of records after which a writer's gzip buffer goes to the file.
FLUSH = 1 << 20

FIELDS = ["warc_file", "warc_type", "record_id", "target_uri", "refers_to_uri", "refers_to_id", "payload_digest", "content_type", "page_id", "refers_to", "payload_bytes"]
SCHEMA = T.StructType([T.StructField(f, T.LongType() if f in ("page_id", "refers_to", "payload_bytes") else T.StringType()) for f in FIELDS] + [T.StructField("payload", T.BinaryType())])
#: Where a column's value stands among a record's headers, for filters.
HEADER = {
    "warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to_uri": "warc-refers-to-target-uri",
    "refers_to_id": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type", "page_id": "page-id", "refers_to": "refers-to-page-id",
}


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, url: str) -> str:
    h = hashlib.md5(f"{page_id} {digest} {url}".encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _clean(value: str) -> str:
    """A header's value on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, refers_to_url: str | None = None) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP headers alone, whose
    Content-Length still tells the full payload's size; it names the record that it revisits."""
    url = _clean(url or "")
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    heads = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest, url)), ("WARC-Date", "2000-01-01T00:00:00Z"),
        ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        heads.append(("Page-ID", str(page_id)))
    if revisit:
        first = _clean(refers_to_url or "")
        heads += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, first)), ("WARC-Refers-To-Target-URI", first), ("WARC-Refers-To-Date", "2000-01-01T00:00:00Z"), ("Refers-To-Page-ID", str(refers_to))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per row into gzipped archives below `path`; returns (file, records), already
    written. Of payloads of at least `least_bytes` that are equal, the record with the smallest
    key is a response and the others revisit it; smaller payloads are all responses. Rows that
    share that key and payload are all responses; revisits name the one with the least url. Null html is
    an empty payload; null keys are responses without a page id. An empty table gives no files. Other columns aren't read.

    A file is written under a name of its own for each attempt of a task; the returned table names
    those of the attempts that counted.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("hex", F.sha1(F.col("html").cast("binary")))
    first = rows.filter((F.octet_length("html") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("hex").agg(F.min(F.struct("page_id", F.coalesce("url", F.lit("")).alias("url"))).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("hex", F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url"))
    marked = rows.join(keep(first, "copied"), "hex", "left").withColumn("refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        there, base = fs.FileSystem.from_uri(path)
        there.create_dir(base, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        n = 0
        out = None
        for batch in slices(batches):
            for page_id, u, h, hexed, refers, there_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = there.open_output_stream(f"{base}/{name}", compression=None, buffer_size=FLUSH)
                digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                out.write(member(record(page_id, u, h.encode("utf-8", "surrogatepass"), digest, refers, there_url)))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])

    return keep(marked.select("page_id", "url", "html", "hex", "refers_to", "first_url").mapInArrow(run, "file string, records long"), "archives")


def member(data: bytes) -> bytes:
    """A gzip member of one record, so that records can be found and read one by one; its header tells
    its length, packed and unpacked, where four bytes hold them."""
    z = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    tail = zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
    if max(size, len(data)) >> 32:
        return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + tail
    extra = SKIP + (8).to_bytes(2, "little") + size.to_bytes(4, "little") + len(data).to_bytes(4, "little")
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + len(extra).to_bytes(2, "little") + extra + body + tail


class _Stream:
    """The bytes of an archive, gzipped by record or as a whole, or plain; read or skipped."""

    def __init__(self, raw: Any, size: int = 1 << 18) -> None:
        self.raw, self.size, self.held, self.z = raw, size, bytearray(), None
        self.spare = raw.read(2)
        self.zipped = self.spare == b"\x1f\x8b"
        #: Members begun, bytes inflated, and of the member at hand what its header tells: packed bytes left, unpacked length.
        self.members, self.inflated, self.left, self.whole = 0, 0, None, None

    def _begin(self) -> None:
        """Look at the header of a member, which starts at what is spare."""
        def need(n: int) -> bool:
            while len(self.spare) < n and (data := self.raw.read(self.size)):
                self.spare += data
            return len(self.spare) >= n

        self.members, self.left, self.whole, self.z = self.members + 1, None, None, zlib.decompressobj(31)
        if need(12) and self.spare[3] & 4 and need(12 + (n := int.from_bytes(self.spare[10:12], "little"))):
            at = 12
            while at + 4 <= 12 + n:
                size = int.from_bytes(self.spare[at + 2 : at + 4], "little")
                if self.spare[at : at + 2] == SKIP and size == 8:
                    self.left, self.whole = (int.from_bytes(self.spare[at + k : at + k + 4], "little") for k in (4, 8))
                at += 4 + size

    def _more(self) -> bool:
        if not self.spare:
            self.spare = self.raw.read(self.size)
            if not self.spare:
                return False
        if not self.zipped:
            self.held += self.spare
            self.spare = b""
            return True
        begun = self.z is None
        if begun:
            self._begin()
        before = len(self.spare)
        out = self.z.decompress(self.spare, PEEK if begun else self.size)
        self.held += out
        self.inflated += len(out)
        self.spare = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        if self.left is not None:
            self.left -= before - len(self.spare)
        if self.z.eof:
            self.z = None
        return True

    def leave(self) -> None:
        """Go on to the next member, whatever is left of this one; its packed length must be known."""
        self.held.clear()
        self.z = None
        if self.left <= len(self.spare):
            self.spare = self.spare[self.left :]
        else:
            self.raw.seek(self.left - len(self.spare), 1)
            self.spare = b""

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (i := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends within a record")
                return None
        out = bytes(self.held[:i])
        del self.held[: i + len(mark)]
        return out

    def http_head(self, size: int) -> bytes | None:
        """The HTTP headers at the start of a block of `size` bytes; None, and nothing read, if it
        has none."""
        while (i := self.held.find(b"\r\n\r\n", 0, size)) < 0:
            if len(self.held) >= size:
                return None
            if not self._more():
                raise ValueError("the archive ends within a record")
        return self.take(i + 4)[:-4]

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        if len(self.held) < n:
            raise ValueError("the archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip(self, n: int) -> None:
        while n:
            if not self.held and not self._more():
                raise ValueError("the archive ends within a record")
            k = min(n, len(self.held))
            del self.held[:k]
            n -= k


def _heads(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "surrogatepass").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read_records(raw: Any, file: str, wanted: list[tuple[str, str, Any]], payload: bool, verify: bool) -> Iterator[tuple]:
    """The rows of one archive. wanted: (column, "eq" | "in" | "prefix" | "there", value)."""
    yield from _records(_Stream(raw), file, wanted, payload, verify)


def _records(stream: _Stream, file: str, wanted: list[tuple[str, str, Any]], payload: bool, verify: bool) -> Iterator[tuple]:
    while True:
        before, fresh = stream.members, not stream.held and stream.z is None
        head = stream.until(b"\r\n\r\n")
        if head is None:
            return
        heads = _heads(head.lstrip(b"\r\n"))
        size = int(heads.get("content-length", 0))
        # The member at hand is this record and no more, and tells its packed length.
        alone = fresh and stream.members == before + 1 and stream.left is not None and stream.whole == len(head) + 4 + size + 4
        if not all(_passes(heads.get(HEADER[c]), how, v) for c, how, v in wanted):
            stream.leave() if alone else stream.skip(size + 4)
            continue
        http = None
        body, full, left = None, size, size
        if heads.get("content-type", "").startswith("application/http") and size:
            http_head = stream.http_head(size)
            if http_head is not None:
                left = size - len(http_head) - 4
                http = _heads(http_head)
                full = int(http.get("content-length", left))
        digest = heads.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if (payload or verify) and heads.get("warc-type") != "revisit":
            body = stream.take(left)
            if verify:
                full, found = len(body), base32_sha1(body)
                if digest is not None and found != digest:
                    raise ValueError(f"{file}: payload digest {found}, header {digest}")
                digest = found
        if alone:
            stream.leave()
        else:
            stream.skip((left if body is None else 0) + 4)
        number = lambda k: int(heads[k]) if heads.get(k) else None
        yield (
            file, heads.get("warc-type"), heads.get("warc-record-id"), heads.get("warc-target-uri"), heads.get("warc-refers-to-target-uri"), heads.get("warc-refers-to"), digest,
            (http or heads).get("content-type"), number("page-id"), number("refers-to-page-id"), full, body if payload else None,
        )


def _passes(value: str | None, how: str, against: Any) -> bool:
    if value is None:
        return False
    if how == "there":
        return True
    value = value.removeprefix("sha1:")
    if how == "prefix":
        return value.startswith(against)
    return value in against if how == "in" else value == against


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.files = options.get("files")
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.wanted: list[tuple[str, str, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in HEADER or column == "content_type":  # that of the payload stands further in
                yield f
            elif isinstance(f, EqualTo):
                self.wanted.append((column, "eq", str(f.value)))
            elif isinstance(f, In):
                self.wanted.append((column, "in", tuple(map(str, f.value))))
            elif isinstance(f, StringStartsWith):
                self.wanted.append((column, "prefix", f.value))
            elif isinstance(f, IsNotNull):
                self.wanted.append((column, "there", None))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        there, base = fs.FileSystem.from_uri(self.path)
        if self.files is not None:
            return [_File(f"{base}/{n}") for n in self.files.split(",") if n]
        info = there.get_file_info(base)
        if info.type == fs.FileType.File:
            return [_File(base)]
        found = there.get_file_info(fs.FileSelector(base, recursive=True))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith((".warc", ".warc.gz"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        there, _ = fs.FileSystem.from_uri(self.path)
        with there.open_input_file(partition.value) as raw:
            yield from read_records(raw, partition.value.rpartition("/")[2], self.wanted, self.payload, self.verify)


class WarcSource(DataSource):
    """spark.read.format("warc").load(path): options `payload` (false: no payload column's values),
    `verify` (digest and size from the payload's bytes), `files` (names below path, by commas)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WarcReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_and_read(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archive pages in the shared folder and read all records back: responses with their payloads,
    whose digests and sizes are taken from the bytes, and revisits from their headers alone. Either is a
    filter on the record type, which the reader takes over, so neither decodes the other's records."""
    spark = pages.sparkSession
    path = work_path(spark, "warc")
    written = write_archives(pages, path, least_bytes)
    names = [r["file"] for r in written.toLocalIterator()]  # one a task
    register(spark)
    if not names:
        return spark.createDataFrame([], SCHEMA)
    data = spark.read.format("warc").option("files", ",".join(names)).option("payload", "false")
    responses = data.option("verify", "true").load(path).filter("warc_type = 'response'")
    return responses.unionByName(data.option("verify", "false").load(path).filter("warc_type = 'revisit'"))
