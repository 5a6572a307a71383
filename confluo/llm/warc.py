"""WARC archives as a PySpark Python data source, with revisit records for equal payloads.

Writing: files of bounded size, each record a gzip member, under names of the job and the task. Beside each archive lies an
index, 16 bytes a record: where its member starts and how long it is. A job that ends well keeps the files of the tasks that
counted and removes what its own lost attempts left; archives of other jobs stay, unless the mode is overwrite.

Reading: `spark.read.format("warc").load(folder)` plans partitions of about `partitionbytes`. An archive with an index is split
anywhere; one without is read in one task from its start, until `index_archives` has made one. Equality and IN filters
on record_type, record_id, target_uri and page_id are taken over by the reader: a record's headers are parsed first, and a
record that a filter rules out is not decoded: the next member is found by the index, or the next record of a plain file
by the length of this one. So it is with every payload when `payloads` is "false". Payloads that are read are held
against the SHA-256 in their headers. All goes through pyarrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .shared import Workspace, columns

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_type string, record_id string, target_uri string, page_id string, payload_digest string, payload_length long, refers_to string, payload binary, file string"
#: The header of each column, in lower case, as names of headers are read in any case.
HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "page_id": "x-page-id", "payload_digest": "warc-payload-digest", "payload_length": "x-payload-length", "refers_to": "warc-refers-to"}
PUSHED = {"record_type", "record_id", "target_uri", "page_id"}
INDEX = ".idx"
Head = dict[str, str]


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def escaped(value: str) -> str:
    """A value of our own headers (X-), on one line and without blanks at its ends."""
    return quote(value, safe="".join(map(chr, range(33, 127))).replace("%", ""))


def record_id(page_id: str) -> str:
    return f"<urn:page:{quote(page_id, safe='')}>"


def record(kind: str, page_id: str | None, url: str | None, digest: str, length: int, payload: bytes, refers_to: str | None) -> bytes:
    """The bytes of one record: headers, the HTTP response with its payload (none for a revisit), two line ends.

    A URL that is no single line (or has blanks at its ends) is written with its control characters percent-encoded, and
    as it was in a header of our own.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + (b"" if kind == "revisit" else payload)
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{uuid.uuid4().urn}>" if page_id is None else record_id(page_id), "WARC-Date": "2024-01-01T00:00:00Z"}
    if page_id is not None:
        head["X-Page-Id"] = escaped(page_id)
    if url is not None:
        plain = "".join(quote(c) if c <= " " or c == "\x7f" else c for c in url)
        odd = url != url.strip() or any(c < " " for c in url)
        head |= {"WARC-Target-URI": plain if odd else url} | ({"X-Page-Url": escaped(url)} if odd else {})
    head |= {"WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": str(length), "Content-Type": "application/http;msgtype=response"}
    if refers_to is not None:
        head |= {"WARC-Refers-To": record_id(refers_to), "WARC-Profile": REVISIT_PROFILE}
    head["Content-Length"] = str(len(block))
    return b"\r\n".join([VERSION.encode(), *[f"{k}: {v}".encode() for k, v in head.items()], b"", b""]) + block + b"\r\n\r\n"


def value_of(head: Head, column: str) -> str | None:
    """What a record's headers say of a column."""
    if column == "target_uri" and "x-page-url" in head:
        return unquote(head["x-page-url"])
    found = head.get(HEADER_OF[column])
    return unquote(found) if column == "page_id" and found is not None else found


class Unzipped(io.RawIOBase):
    """The bytes of a file of gzip members, as a stream; `members` has the place of each member that was begun."""

    def __init__(self, raw, step: int = 1 << 18):
        self.raw, self.step, self.z, self.rest, self.out = raw, step, zlib.decompressobj(31), b"", b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.out:
            self.rest = self.rest or self.raw.read(self.step)
            if not self.rest:
                return 0
            self.out = self.z.decompress(self.rest)
            self.rest = b""
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
        n = min(len(into), len(self.out))
        into[:n], self.out = self.out[:n], self.out[n:]
        return n


class Plain(io.RawIOBase):
    """A pyarrow file as a stream of Python's, that can seek."""

    def __init__(self, raw):
        self.raw = raw

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        got = self.raw.read(len(into))
        into[: len(got)] = got
        return len(got)

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.raw.seek(offset, whence)
        return self.raw.tell()

    def tell(self) -> int:
        return self.raw.tell()


def parse_head(lines: Iterator[bytes]) -> Head:
    """Header names in lower case, and values; a line that begins with a blank goes on with the value before it."""
    head: Head = {}
    name = ""
    for line in lines:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and name:
            head[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        head[name] = value.strip()
    return head


def payload_of(head: Head, block: bytes) -> bytes:
    """What follows the HTTP headers, or the whole block of other records."""
    if "application/http" not in head.get("content-type", "").lower():
        return block
    body = block.find(b"\r\n\r\n")
    return block[body + 4 :] if body != -1 else b""


def records(stream: io.BufferedReader, wanted: Callable[[Head], bool], payloads: bool = True, stop: int | None = None) -> Iterator[tuple[Head, bytes | None]]:
    """Headers and payload of each record for whose headers `wanted` holds. Others are skipped by their length. With `stop`,
    only records that start before that place."""
    while (stop is None or stream.tell() < stop) and (line := stream.readline()):
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:40]!r}")
        head = parse_head(iter(lambda: line if (line := stream.readline()).strip() else b"", b""))
        left = int(head["content-length"])
        if payloads and wanted(head):
            yield head, payload_of(head, stream.read(left))
            continue
        if stream.seekable():
            stream.seek(left, io.SEEK_CUR)
        else:
            while left and (got := stream.read(min(left, 1 << 20))):
                left -= len(got)
        if wanted(head):
            yield head, None


def member_records(raw, places: np.ndarray, wanted: Callable[[Head], bool], payloads: bool = True, first: int = 4096) -> Iterator[tuple[Head, bytes | None]]:
    """As records, of gzip members at known places (offset, length), a record each. Of a member only as much is read and
    inflated as its headers need, unless its payload is wanted."""
    for offset, length in places.tolist():
        raw.seek(offset)
        part = raw.read(min(first, length))
        z = zlib.decompressobj(31)
        data, got = z.decompress(part), len(part)
        while (end := data.find(b"\r\n\r\n")) == -1:
            part = raw.read(min(first, length - got))
            if not part:
                raise ValueError(f"a record without end of headers at {offset}")
            data, got = data + z.decompress(part), got + len(part)
        head = parse_head(iter(data[:end].splitlines()[1:]))
        if not wanted(head):
            continue
        if not payloads:
            yield head, None
            continue
        data += z.decompress(raw.read(length - got)) if got < length else b""
        yield head, payload_of(head, data[end + 4 : end + 4 + int(head["content-length"])])


def member_places(raw, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(offset, length) of each gzip member. Members that are no single record raise ValueError."""
    begin = at = 0
    z, rest = zlib.decompressobj(31), b""
    head, size = b"", 0
    while rest or (rest := raw.read(step)):
        out = z.decompress(rest)
        size += len(out)
        if b"\r\n\r\n" not in head:
            head += out
        used = len(rest) - len(z.unused_data)
        at += used
        rest = z.unused_data if z.eof else b""
        if z.eof:
            end = head.find(b"\r\n\r\n")
            own = parse_head(iter(head[:end].splitlines()[1:]))
            if end == -1 or not head.startswith(b"WARC/") or end + 4 + int(own.get("content-length", -1)) + 4 != size:
                raise ValueError(f"the member at {begin} is no single record")
            yield begin, at - begin
            begin, z, head, size = at, zlib.decompressobj(31), b"", 0


def record_places(stream: io.BufferedReader) -> Iterator[tuple[int, int]]:
    """(offset, length) of each record of a plain archive."""
    begin = None
    while True:
        at = stream.tell()
        line = stream.readline()
        if begin is not None and (not line or line.startswith(b"WARC/")):
            yield begin, at - begin
            begin = None
        if not line:
            return
        if line.startswith(b"WARC/"):
            begin = at
            head = parse_head(iter(lambda: line if (line := stream.readline()).strip() else b"", b""))
            stream.seek(int(head["content-length"]), io.SEEK_CUR)


@dataclass
class Ranges(InputPartition):
    parts: list[tuple[str, int, int | None]]  #: file, first byte, and the byte before which records start; None: the whole file, in order


def archives(path: str) -> tuple[list, set[str]]:
    """The archives of a folder, by name, and which of their names have an index."""
    from pyarrow import fs

    files, own = file_system(path)
    found = sorted(files.get_file_info(fs.FileSelector(own, allow_not_found=True)), key=lambda x: x.path)
    return [x for x in found if x.base_name.endswith((".warc", ".warc.gz"))], {x.path.removesuffix(INDEX) for x in found if x.base_name.endswith(INDEX)}


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.bytes = int(options.get("partitionbytes", 32 << 20))
        self.payloads = options.get("payloads", "true").lower() != "false"
        self.verify = options.get("verify", "true").lower() != "false"
        self.equal: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                values = [f.value] if isinstance(f, EqualTo) else f.value
                self.equal.append((f.attribute[0], frozenset(values)))
            else:
                yield f

    def partitions(self):
        """By file sizes alone: what the driver holds grows with files and their bytes, not with records."""
        found, indexed = archives(self.path)
        parts: list[list] = [[]]
        size = 0
        for x in found:
            for a in range(0, max(1, x.size), self.bytes) if x.path in indexed else (0,):
                b = min(x.size, a + self.bytes) if x.path in indexed else None
                own = (x.size if b is None else b) - a
                if size and size + own > self.bytes:
                    parts.append([])
                    size = 0
                parts[-1].append((x.path, a, b))
                size += own
        return [Ranges(p) for p in parts]

    def wanted(self, head: Head) -> bool:
        return all(value_of(head, c) in values for c, values in self.equal)

    def found(self, path: str, begin: int, end: int | None) -> Iterator[tuple[Head, bytes | None]]:
        files, _ = file_system(self.path)
        zipped = path.endswith(".gz")
        if end is None and zipped:
            with files.open_input_stream(path, compression=None) as raw:
                yield from records(io.BufferedReader(Unzipped(raw), 1 << 18), self.wanted, self.payloads)
            return
        with files.open_input_file(path) as raw:
            if end is None:
                yield from records(io.BufferedReader(Plain(raw), 1 << 16), self.wanted, self.payloads)
                return
            with files.open_input_stream(path + INDEX, compression=None) as index:
                places = np.frombuffer(index.read(), "<u8").astype(np.int64).reshape(-1, 2)
            places = places[(places[:, 0] >= begin) & (places[:, 0] < end)]
            if zipped:
                yield from member_records(raw, places, self.wanted, self.payloads)
            elif len(places):
                stream = io.BufferedReader(Plain(raw), 1 << 16)
                stream.seek(int(places[0, 0]))
                yield from records(stream, self.wanted, self.payloads, int(places[-1].sum()))

    def check(self, head: Head, payload: bytes, path: str) -> None:
        """A full payload is what its headers say."""
        kind, _, digest = head.get("warc-payload-digest", "").partition(":")
        if self.verify and head.get("warc-type") != "revisit" and kind == "sha256" and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {head.get('warc-record-id')} in {path} is not what its digest says")

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        names = pa.schema([(c, {"payload_length": pa.int64(), "payload": pa.binary()}.get(c, pa.string())) for c in [*HEADER_OF, "payload", "file"]])
        rows, size = [], 0
        for path, begin, end in partition.parts:
            for head, payload in self.found(path, begin, end):
                if payload is not None:
                    self.check(head, payload, path)
                row = {c: value_of(head, c) for c in HEADER_OF} | {"payload": payload, "file": path}
                row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else None
                row["payload_digest"] = row["payload_digest"].partition(":")[2] if row["payload_digest"] else None
                rows.append(row)
                size += len(payload or b"")
                if size > 8 << 20 or len(rows) >= 5000:
                    yield pa.RecordBatch.from_pylist(rows, names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, names)


@dataclass
class Written(WriterCommitMessage):
    paths: list[str] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    """Input columns: record_type, page_id, target_uri, payload_digest, payload_length, payload, refers_to (a page_id)."""

    def __init__(self, options, overwrite: bool):
        self.path, self.level, self.overwrite, self.most = options["path"], int(options.get("level", 3)), overwrite, int(options.get("filebytes", 1 << 30))
        self.prefix = f"part-{uuid.uuid4().hex}-"  # of this job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, path = file_system(self.path)
        files.create_dir(path, recursive=True)
        paths: list[str] = []
        out, places, at = None, [], 0

        def close() -> None:
            out.close()
            with files.open_output_stream(paths[-1] + INDEX, compression=None) as index:
                index.write(b"".join(places))

        for x in iterator:
            for r in x.to_pylist():
                if out is None or at >= self.most:
                    if out is not None:
                        close()
                    paths.append(f"{path}/{self.prefix}{uuid.uuid4().hex}.warc.gz")
                    out, places, at = files.open_output_stream(paths[-1], compression=None), [], 0
                z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                one = record(r["record_type"], r["page_id"], r["target_uri"], r["payload_digest"], r["payload_length"], r["payload"] or b"", r["refers_to"])
                one = z.compress(one) + z.flush()
                out.write(one)
                places.append(struct.pack("<QQ", at, len(one)))
                at += len(one)
        if out is not None:
            close()
        return Written(paths)

    def _remove(self, which: Callable[[str], bool], kept: set[str]) -> None:
        from pyarrow import fs

        files, path = file_system(self.path)
        for x in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if x.path not in kept and which(x.base_name):
                files.delete_file(x.path)

    def commit(self, messages) -> None:
        """Of this job's files those of tasks that counted stay; what its lost attempts left goes. In mode overwrite, all other
        archives go, too."""
        kept = {p + end for m in messages if m is not None for p in m.paths for end in ("", INDEX)}
        ends = (".warc", ".warc.gz", ".warc" + INDEX, ".warc.gz" + INDEX)
        self._remove(lambda name: name.startswith(self.prefix) or (self.overwrite and name.endswith(ends)), kept)

    def abort(self, messages) -> None:
        self._remove(lambda name: name.startswith(self.prefix), set())


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def index_archives(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Make the index of each archive of a folder that has none, a task each, so that later reads are split and skip without
    inflating. Returns (file, records), with -1 for archives whose members are no single records, which stay without."""
    found, indexed = archives(path)
    todo = [(x.path,) for x in found if x.path not in indexed]
    if not todo:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = file_system(path)
        for b in batches:
            for own in b.column(0).to_pylist():
                places: list[bytes] | None = []
                try:
                    if own.endswith(".gz"):
                        with files.open_input_stream(own, compression=None) as raw:
                            places = [struct.pack("<QQ", *x) for x in member_places(raw)]
                    else:
                        with files.open_input_file(own) as raw:
                            places = [struct.pack("<QQ", *x) for x in record_places(io.BufferedReader(Plain(raw), 1 << 16))]
                except ValueError:
                    places = None
                if places is not None:
                    part = f"{own}.{uuid.uuid4().hex}.tmp"
                    with files.open_output_stream(part, compression=None) as out:
                        out.write(b"".join(places))
                    files.move(part, own + INDEX)
                yield pa.RecordBatch.from_pylist([{"file": own, "records": -1 if places is None else len(places)}])

    return [tuple(r) for r in spark.createDataFrame(todo, "file string").repartition(len(todo)).mapInArrow(run, "file string, records long").collect()]


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, mode: str = "append") -> None:
    """Write a record per page. Of pages with equal payloads of at least `least_bytes`, that with the smallest id is the
    response and the others are revisits of it, without payload.

    Null html is an empty payload, a null url no header. Rows that share an id are records of their own; of several with
    the smallest id and an equal payload, each is a response. Pages with a null id are responses without page id. An
    empty table adds nothing. Other columns are ignored, whatever their names. Payloads are compared among these pages,
    not with archives that are there already, which stay (or go, in mode "overwrite").
    """
    spark = pages.sparkSession
    register(spark)
    own = columns(pages, [id_col, url_col, html_col]).toDF("id", "target_uri", "html")
    own = own.withColumn("payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8")).drop("html")
    own = own.withColumns({"payload_digest": F.sha2("payload", 256), "payload_length": F.octet_length("payload").cast("long")})
    firsts = own.filter(F.col("payload_length") >= least_bytes).groupBy("payload_digest", "payload_length").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    with Workspace(spark) as stash:
        firsts = stash(firsts.filter("n > 1 and first_id is not null").drop("n"), "firsts")
        found = firsts.limit(1).count()
        out = own.join(firsts, ["payload_digest", "payload_length"], "left") if found else own.withColumn("first_id", F.lit(None).cast(own.schema["id"].dataType))
        revisit = F.coalesce(F.col("first_id") < F.col("id"), F.lit(False))
        out = out.select(
            F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("id").cast("string").alias("page_id"), "target_uri", "payload_digest", "payload_length",
            F.when(~revisit, F.col("payload")).alias("payload"), F.when(revisit, F.col("first_id").cast("string")).alias("refers_to"),
        )
        out.write.format("warc").mode(mode).save(path)


def read_archive(spark: SparkSession, path: str, payloads: bool = True, verify: bool = True) -> DataFrame:
    """The records of the archives in a folder: SCHEMA. payload_digest and payload_length are those of the headers; `verify`
    holds each payload that is read against them, and fails where they differ."""
    register(spark)
    return spark.read.format("warc").option("payloads", str(payloads).lower()).option("verify", str(verify).lower()).load(path)
