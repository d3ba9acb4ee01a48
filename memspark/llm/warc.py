"""WARC archives: a PySpark Python data source that writes them and reads them back.

A record is a gzip member of its own, whose header says how long it is (the "sl" extra field of the WARC standard's annex
on compression), and a manifest lists the committed files with the places where they may be split. So the source plans
partitions inside of files, takes predicates on the record type and on headers, inflates a record's headers first, and
seeks over the payloads of records that the predicates refuse, or of all where none is asked for.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import materialize, scratch_dir

END = b"\r\n\r\n"
HEADERS = {  # column of the source: header of the record
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Bytes",
}
SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
BLOCK = 1 << 18
MEMBER = struct.Struct("<2sBBIBBH2sHII")  # a gzip header with one extra field: lengths of the member and of the record
CONTROL = "".join(map(chr, (*range(32), 127)))
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class WarcPartition(InputPartition):
    """Bytes [start, end) of a file, which begin at a record; end None is the file's end."""

    path: str
    start: int = 0
    end: int | None = None


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: name, size, and the places about every `split` bytes where a record begins."""

    files: list[tuple[str, int, list[int]]]


def filesystem(path: str):
    """The file system of a uri, and the path on it: local disks, HDFS and the stores that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder), df.write.format("warc").mode("append").save(folder).

    Option payload=false reads headers alone; pushdown=true takes filters, in sessions that push them to Python sources.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        pushing = str(self.options.get("pushdown", "false")).lower() == "true"
        return (FilteredReader if pushing else WarcReader)(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are appended to; write into a new folder")
        return WarcWriter(self.options)


def member(record: bytes) -> bytes:
    """A record as a gzip member that says how long it is."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = MEMBER.size + len(body) + 8
    head = MEMBER.pack(b"\x1f\x8b", 8, 4, 0, 0, 255, 12, b"sl", 8, size, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def header_value(value: str) -> str:
    """Header values are one line: control characters are percent-encoded."""
    return quote(value, safe="".join(set(value) - set(CONTROL))) if any(c in value for c in CONTROL) else value


def record(kind: str, key: str, uri: str | None, refers: str | None, digest: str | None, size: int | None, payload: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {key}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {header_value(uri)}")
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers}"]
    if digest is not None:
        lines.append(f"WARC-Payload-Digest: {digest}")
    lines += [f"X-Payload-Bytes: {len(payload) if size is None else size}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + END + payload + END


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files under names of its own; the manifest that the commit writes lists those of the tasks that
    Spark took, so files of lost or repeated tasks are never read."""

    def __init__(self, options):
        self.path = options["path"]
        self.split = int(options.get("split", 32 << 20))
        self.largest = int(options.get("largest", 1 << 30))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        disk, root = filesystem(self.path)
        disk.create_dir(root, recursive=True)
        files: list[tuple[str, int, list[int]]] = []
        f, at, splits = None, 0, []
        for b in batches:
            columns = [b.column(c).to_pylist() for c in (*HEADERS, "payload")]
            for *named, payload in zip(*columns, strict=True):
                if f is None:
                    name, at, splits = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]
                    f = disk.open_output_stream(f"{root}/{name}", compression=None)
                elif at - splits[-1] >= self.split:
                    splits.append(at)
                own = member(record(*named, payload or b""))
                f.write(own)
                at += len(own)
                if at >= self.largest:
                    f.close()
                    files.append((name, at, splits))
                    f = None
        if f is not None:
            f.close()
            files.append((name, at, splits))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        disk, root = filesystem(self.path)
        disk.create_dir(root, recursive=True)
        with disk.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        disk, root = filesystem(self.path)
        for m in messages:
            for name, _, _ in m.files if m else ():
                disk.delete_file(f"{root}/{name}")


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.wanted: dict[str, set] = {}
        self.inflated = 0  # bytes that this reader has inflated

    def partitions(self) -> list[WarcPartition]:
        """The parts between the split places of all files in the folder's manifests; without any, its files."""
        from pyarrow import fs

        disk, root = filesystem(self.path)
        top = disk.get_file_info(root)
        found = [top] if top.is_file else disk.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f for f in found if f.is_file and f.size), key=lambda f: f.path)
        listed = [f for f in files if f.base_name.startswith("_manifest-")]
        if not listed:
            return [WarcPartition(f.path) for f in files if f.base_name[0] not in "_."]
        parts = []
        for f in listed:
            with disk.open_input_stream(f.path, compression=None) as stream:
                manifest = json.loads(stream.read())
            for name, size, splits in manifest:
                parts += [WarcPartition(f"{root}/{name}", a, b) for a, b in zip(splits, [*splits[1:], size], strict=True)]
        return parts

    def read(self, partition: WarcPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without records
            return
        disk, _ = filesystem(self.path)
        rows: list[tuple] = []
        size = 0
        for headers, take in records(disk, partition, self):
            named = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
            if any(named[c] not in values for c, values in self.wanted.items()):
                continue
            payload = take() if self.payload else None
            n = named.pop("payload_bytes")
            rows.append((*named.values(), int(n) if n else int(headers["content-length"]), payload))
            size += len(payload or b"") + 200
            if size > 8 << 20:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)


class FilteredReader(WarcReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and IN on header columns; leaves the rest to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, IsNotNull) and column in ("record_type", "record_id"):
                continue  # every record has them
            if column in HEADERS and column != "payload_bytes" and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*HEADERS, "payload"])


def records(disk, part: WarcPartition, reader: WarcReader):
    """(headers, function that gives the payload) of each record; what is not asked for is passed over."""
    with disk.open_input_file(part.path) as f:
        first = f.read(MEMBER.size)
    known = len(first) == MEMBER.size and first[:2] == b"\x1f\x8b" and first[3] == 4 and first[12:14] == b"sl"
    stream = Stream(disk, part.path, part.start, packed=part.path.endswith(".gz") and not known)
    if not known:
        while (headers := stream.headers()) is not None:
            n = int(headers["content-length"])
            taken = []

            def take(n=n, taken=taken):
                taken.append(n)
                return stream.take(n)

            yield headers, take
            stream.skip(n - sum(taken) + len(END))
    while known and (part.end is None or stream.place() < part.end) and stream.fill(MEMBER.size):
        size = MEMBER.unpack(stream.peek(MEMBER.size))[-2]
        held = Member(stream, size - MEMBER.size - 8, reader)
        stream.skip(MEMBER.size)
        headers = parsed(held.until(END))
        yield headers, lambda: held.take(int(headers["content-length"]))
        stream.skip(held.left + 8)  # what is left of the member, and its check sum
    stream.close()


class Member:
    """A record's deflated bytes, inflated as far as they are asked for."""

    def __init__(self, stream: Stream, left: int, reader: WarcReader, step: int = 2048):
        self.stream, self.left, self.reader, self.step = stream, left, reader, step
        self.inflate, self.data = zlib.decompressobj(-15), b""

    def more(self, n: int) -> bool:
        """Inflate n bytes, less at the member's end."""
        raw = self.inflate.unconsumed_tail
        if not raw and self.left:
            raw = self.stream.take(min(self.left, max(512, n)))
            self.left -= len(raw)
        out = self.inflate.decompress(raw, n)
        self.data += out
        self.reader.inflated += len(out)
        return bool(out) or bool(self.left)

    def until(self, mark: bytes) -> bytes:
        while (k := self.data.find(mark)) < 0:
            if not self.more(self.step):
                raise ValueError("a record is cut short")
        found, self.data = self.data[:k], self.data[k + len(mark) :]
        return found

    def take(self, n: int) -> bytes:
        parts, held = [self.data], len(self.data)
        while held < n:
            self.data = b""
            if not self.more(max(BLOCK, n - held)):
                raise ValueError("a record is cut short")
            parts.append(self.data)
            held += len(self.data)
        return b"".join(parts)[:n]


def parsed(head: bytes) -> dict[str, str]:
    """Headers by lower-case name."""
    if not head.startswith(b"WARC/1."):
        raise ValueError("no record begins where one should")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


class Stream:
    """Reads an archive forward through a buffer. Skipped bytes are sought over, or in an archive that was compressed as
    a whole inflated and dropped a block at a time."""

    def __init__(self, disk, path: str, start: int = 0, packed: bool = False):
        self.packed = packed
        self.f = disk.open_input_stream(path, compression="gzip") if packed else disk.open_input_file(path)
        if start:
            self.f.seek(start)
        self.data, self.at = b"", 0  # what is read, and how much of it is used

    def place(self) -> int:
        return self.f.tell() - len(self.data) + self.at

    def fill(self, n: int) -> bool:
        """Hold n unused bytes if the archive has them."""
        if len(self.data) - self.at < n:
            parts = [self.data[self.at :]]
            held = len(parts[0])
            while held < n:
                parts.append(self.f.read(max(BLOCK, n - held)))
                held += len(parts[-1])
                if not parts[-1]:
                    break
            self.data, self.at = b"".join(parts), 0
        return len(self.data) - self.at >= n

    def peek(self, n: int) -> bytes:
        return self.data[self.at : self.at + n]

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise ValueError("a record is cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def skip(self, n: int) -> None:
        held = min(n, len(self.data) - self.at)
        self.at, n = self.at + held, n - held
        if n and not self.packed:
            self.f.seek(self.f.tell() + n)
            n = 0
        while n:
            self.take(min(n, BLOCK))
            n -= min(n, BLOCK)

    def headers(self) -> dict[str, str] | None:
        """Headers of the record that begins here; None at the archive's end."""
        n = 2048
        if not self.fill(1):
            return None
        while True:
            more = self.fill(n)
            k = self.data.find(END, self.at)
            if k >= 0 or not more:
                break
            n *= 8
        if k < 0:
            raise ValueError("no record begins where one should")
        return parsed(self.take(k + len(END) - self.at)[: -len(END)])

    def close(self) -> None:
        self.f.close()


def with_roles(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload and, for each row, its digest, length and `refers_to`: the page it repeats, else null.

    Equal payloads are found by SHA-1 and length. The largest page_id by payload is a partial aggregate of one row a
    payload and task, so a payload that a third of the pages share costs no task more than others; only payloads that
    several pages hold are joined back, and the join key carries a salt, so that such a payload's pages spread.
    """
    payload = F.coalesce("html", F.lit(""))
    hashed = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")}
    )
    salts = 16  # beyond them, adaptive execution splits the partition
    large = hashed.where(F.col("payload_bytes") >= min_bytes)
    owners = large.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("copies"))
    shared = owners.where("owner is not null and copies > 1").select(
        "payload_digest", "payload_bytes", "owner", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    )
    salted = hashed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    joined = salted.join(shared, ["payload_digest", "payload_bytes", "salt"], "left")
    repeats = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    return joined.withColumn("refers_to", F.when(repeats, F.col("owner"))).drop("owner", "salt")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 1000) -> None:
    """Write a WARC/1.1 record for each row of pages(page_id, url, html), UTF-8, into gzip files of folder `path`.

    Of records with equal payloads of min_bytes or more, those but the largest page_id's become revisit records without
    a payload.
    """
    rows = with_roles(pages, min_bytes)
    revisit = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    found = rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").cast("string").alias("target_uri"),
        F.when(revisit, urn(F.col("refers_to"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), F.col("payload_digest")).alias("payload_digest"),
        "payload_bytes",
        F.when(~revisit, F.col("payload").cast("binary")).alias("payload"),
    )
    pages.sparkSession.dataSource.register(WarcSource)
    found.write.format("warc").mode("append").save(path)


@contextmanager
def pushing_filters(spark: SparkSession):
    """Have Spark push filters to Python data sources, as long as plans that read archives are made and run."""
    old = spark.conf.get(PUSHDOWN, None)
    spark.conf.set(PUSHDOWN, "true")
    try:
        yield
    finally:
        spark.conf.unset(PUSHDOWN) if old is None else spark.conf.set(PUSHDOWN, old)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives in a folder, a row each, with the columns of SCHEMA.

    Archives of others are read as well, as files that can't be split: plain ones, and ones compressed as a whole. A
    folder without records gives no rows, a missing header a null; a record that is cut short is an error. Repeated
    records are rows of their own. Filters reach the reader in sessions that push them (see pushing_filters).
    """
    spark.dataSource.register(WarcSource)
    pushing = str(spark.conf.get(PUSHDOWN, "false")).lower()
    return spark.read.format("warc").option("payload", str(payload).lower()).option("pushdown", pushing).load(path)


def archive_round_trip(pages: DataFrame, min_bytes: int = 1000, path: str | None = None) -> DataFrame:
    """Write pages as archives, read those back and report each record.

    Returns page_id, payload_bytes, payload_digest (lower-case hex SHA-1 of the full payload), record_type, refers_to.
    Responses report the length and digest of the payload that was read; revisits those in their headers. A null html
    is an empty payload; null urls have no target header. Rows of one page_id and payload are all responses if that is
    the payload's largest page_id; a null page_id refers to it. An empty table gives an empty table.
    """
    spark = pages.sparkSession
    if path is None:
        path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path, min_bytes)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    with pushing_filters(spark):
        responses = read_archive(spark, path).where("record_type = 'response'")
        read = responses.select(
            number("record_id").alias("page_id"),
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.sha1("payload").alias("payload_digest"),
            "record_type",
            F.lit(None).cast("long").alias("refers_to"),
        )
        revisits = read_archive(spark, path, payload=False).where("record_type = 'revisit'").select(
            number("record_id").alias("page_id"),
            "payload_bytes",
            F.regexp_extract("payload_digest", "^sha1:(.*)$", 1).alias("payload_digest"),
            "record_type",
            number("refers_to").alias("refers_to"),
        )
        return materialize(read.unionByName(revisits), "records")  # read while filters are pushed
