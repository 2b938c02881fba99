"""WARC archives as a PySpark data source: files are partitions, headers are read before payloads."""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from skyledger.llm.common import keyed
from skyledger.session import scratch_path, stage

# Fixed values of the file format: header names of the columns that come from a record's header.
NAMES = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "content_type": "Content-Type",
    "content_length": "Content-Length",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
TYPES = {c: "string" for c in NAMES} | {
    "content_length": "long", "headers": "map<string,string>", "http_status": "int", "payload_bytes": "long",
    "payload": "binary", "file": "string", "offset": "long",
}
ARROW = {
    "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(),
    "map<string,string>": pa.map_(pa.string(), pa.string()),
}
# what the writer takes
RECORD = ["record_id", "record_type", "target_uri", "payload_digest", "refers_to", "payload_bytes", "payload"]
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
DATE = "1970-01-01T00:00:00Z"  # of records without a date: archives of equal pages are equal

MANIFEST = "_manifest-"  # one a commit: the files it made, with their records by type
FILE = 64 << 20  # compressed bytes after which a task begins another file
PART = 128 << 20  # bytes of small files that one read partition holds
CHUNK = 1 << 16
HEAD = 1024  # bytes decoded at a time to see a record's header
SMALL = 1000  # bytes: equal payloads below this are stored again


# ---------------------------------------------------------------- writing


def member(data: list[bytes], level: int = 6) -> bytes:
    """One gzip member. Its extra field ``sl`` tells the member's and the data's length, so that a
    reader can step over a record that it doesn't want without inflating it."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    crc = size = 0
    body = []
    for piece in data:
        crc, size = zlib.crc32(piece, crc), size + len(piece)
        body.append(deflate.compress(piece))
    body.append(deflate.flush())
    inner = sum(map(len, body))
    whole = 10 + 2 + 12 + inner + 8
    if max(whole, size) < 1 << 32:
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, whole, size)
    else:
        head = b"\x1f\x8b\x08\0\0\0\0\0\0\xff"
    return b"".join([head, *body, struct.pack("<II", crc, size & 0xFFFFFFFF)])


def uri(text: str) -> str:
    """A URI for a header line: blanks and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(kind: str, ident: str, headers: dict[str, str | None], block: list[bytes]) -> list[bytes]:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{uri(ident)}>", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers.items() if v is not None]
    lines.append(f"Content-Length: {sum(map(len, block))}")
    return ["\r\n".join([*lines, "", ""]).encode(), *block, b"\r\n\r\n"]


@dataclass
class Written(WriterCommitMessage):
    files: list


class Writer(DataSourceArrowWriter):
    """One or more files a task, named anew by every attempt; only a commit makes them count."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.limit = int(options.get("filebytes", FILE))

    def write(self, iterator):
        folder, at = arrow_fs.FileSystem.from_uri(self.path)
        folder.create_dir(at, recursive=True)
        files, out = [], None

        def close():
            nonlocal out
            if out is not None:
                out.close()
                files[-1]["types"] = dict(files[-1]["types"])
            out = None

        def put(kind: str, pieces: list[bytes]) -> None:
            nonlocal out
            if out is None:
                name = f"part-{uuid.uuid4().hex}.warc.gz"
                out = folder.open_output_stream(f"{at}/{name}", compression=None)
                files.append({"file": name, "bytes": 0, "types": Counter()})
                info = b"format: WARC File Format 1.1\r\n"
                put("warcinfo", record("warcinfo", f"urn:uuid:{uuid.uuid4()}",
                                       {"Content-Type": "application/warc-fields"}, [info]))
            data = member(pieces)
            out.write(data)
            files[-1]["bytes"] += len(data)
            files[-1]["types"][kind] += 1
            if files[-1]["bytes"] >= self.limit:
                close()

        try:
            for batch in iterator:
                for row in zip(*(batch.column(c) for c in RECORD), strict=True):
                    put(row[1].as_py(), page_record(*row))
        finally:
            close()
        return Written(files)

    def commit(self, messages) -> None:
        folder, at = arrow_fs.FileSystem.from_uri(self.path)
        folder.create_dir(at, recursive=True)
        before = manifests(folder, at) if self.overwrite else []
        files = [f for m in messages if m is not None for f in m.files]
        with folder.open_output_stream(f"{at}/{MANIFEST}{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps({"files": files}).encode())
        for old in before:
            folder.delete_file(old)  # its files no longer belong to the archive

    def abort(self, messages) -> None:
        pass  # files that no manifest names are not part of the archive


def page_record(ident, kind, target, digest, refers, size, payload) -> list[bytes]:
    """A response with its payload, or a revisit that has only the HTTP header of the response."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {size.as_py()}\r\n\r\n"
    ).encode()
    revisit = kind.as_py() == "revisit"
    headers = {
        "WARC-Target-URI": uri(target.as_py()) if target.is_valid else None,
        "WARC-Payload-Digest": f"sha1:{digest.as_py()}",
        "WARC-Profile": REVISIT if revisit else None,
        "WARC-Refers-To": f"<{uri(refers.as_py())}>" if refers.is_valid else None,
        "Content-Type": HTTP,
    }
    block = [http] if revisit or not payload.is_valid else [http, payload.as_buffer().to_pybytes()]
    return record(kind.as_py(), ident.as_py(), headers, block)


# ---------------------------------------------------------------- reading


def manifests(folder, at: str) -> list[str]:
    found = folder.get_file_info(arrow_fs.FileSelector(at, allow_not_found=True))
    return [f.path for f in found if f.base_name.startswith(MANIFEST)]


class Stream:
    """The bytes of a WARC file, plain or as gzip members, read forwards; ``skip`` decodes as little as
    it can."""

    def __init__(self, source, name: str):
        self.source, self.name = source, name
        self.size = source.size()
        self.inflated = 0  # bytes that were decoded, for tests
        start = source.read(2)
        source.seek(0)
        self.packed = start == b"\x1f\x8b"
        self.buffer, self.inflate, self.end = b"", None, None
        self.member = self.check = 0  # where the gzip member begins, crc32 of its data so far

    def _more(self, most: int = CHUNK) -> bool:
        """Reads on; false at the end of the file."""
        if not self.packed:
            data = self.source.read(most)
            self.buffer += data
            return bool(data)
        while True:
            if self.inflate is None and not self._open():
                return False
            got = self.inflate.decompress(self.inflate.unconsumed_tail, most)
            if not got and not self.inflate.eof:
                data = self.source.read(most)
                if not data:
                    raise ValueError(f"{self.name}: a gzip member is cut off")
                got = self.inflate.decompress(data, most)
            self.inflated += len(got)
            self.check = zlib.crc32(got, self.check)
            if self.inflate.eof:
                # what is left of the input belongs to the trailer and the next member
                self.source.seek(self.source.tell() - len(self.inflate.unused_data))
                self.inflate, trailer = None, self.source.read(8)
                if trailer[:4] != struct.pack("<I", self.check):
                    raise ValueError(f"{self.name}: the gzip member at {self.member} is damaged")
            if got:
                self.buffer += got
                return True

    def _open(self) -> bool:
        """Reads the header of a gzip member."""
        begin = self.source.tell()
        head = self.source.read(10)
        if not head:
            return False
        if len(head) < 10 or head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"{self.name}: no gzip member at {begin}")
        flags, self.end, self.member, self.check = head[3], None, begin, 0
        if flags & 4:
            extra = self.source.read(struct.unpack("<H", self.source.read(2))[0])
            at = 0
            while at + 4 <= len(extra):
                key, size = struct.unpack_from("<2sH", extra, at)
                if key == b"sl" and size == 8:
                    whole, data = struct.unpack_from("<II", extra, at + 4)
                    self.end = (begin + whole, data)
                at += 4 + size
        for bit in (8, 16):  # a name, a comment: up to a zero byte
            if flags & bit:
                while self.source.read(1) not in (b"\0", b""):
                    pass
        if flags & 2:
            self.source.read(2)
        self.inflate = zlib.decompressobj(-15)
        return True

    def member_length(self) -> int | None:
        """The bytes that the member at hand holds, if its header tells."""
        return self.end[1] if self.packed and self.end else None

    def until(self, mark: bytes) -> bytes | None:
        """Everything up to and with ``mark``; None at the end of the file."""
        while mark not in self.buffer:
            if not self._more(HEAD):
                if self.buffer.strip():
                    raise ValueError(f"{self.name}: the last record is cut off")
                return None
        cut = self.buffer.index(mark) + len(mark)
        out, self.buffer = self.buffer[:cut], self.buffer[cut:]
        return out

    def read(self, n: int) -> bytes:
        parts = [self.buffer]
        have = len(self.buffer)
        self.buffer = b""
        while have < n:
            if not self._more():
                raise ValueError(f"{self.name}: the last record is cut off")
            parts.append(self.buffer)
            have += len(self.buffer)
            self.buffer = b""
        data = b"".join(parts)
        self.buffer = data[n:]
        return data[:n]

    def skip(self, n: int, ends_member: bool) -> None:
        """Steps over ``n`` bytes. If they end a member of known length nothing of it is decoded."""
        if ends_member and self.end:
            self.source.seek(self.end[0])
            self.buffer, self.inflate = b"", None
        elif not self.packed:
            ahead = n - len(self.buffer)
            if ahead > 0:
                if self.source.tell() + ahead > self.size:
                    raise ValueError(f"{self.name}: the last record is cut off")
                self.source.seek(self.source.tell() + ahead)
            self.buffer = self.buffer[n:]
        else:
            while n > len(self.buffer):
                n -= len(self.buffer)
                self.buffer = b""
                if not self._more():
                    raise ValueError(f"{self.name}: the last record is cut off")
            self.buffer = self.buffer[n:]


def header_of(raw: bytes) -> dict[str, str]:
    """Header lines by lower-case name; folded lines go on, of a repeated name the first counts."""
    found: dict[str, str] = {}
    last = None
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            key, value = line.split(":", 1)
            last = key.strip().lower()
            if last in found:
                last = None
            else:
                found[last] = value.strip()
    return found


def columns_of(header: dict[str, str]) -> dict:
    """The typed columns of a record's header, the ones that filters are pushed down on."""
    row: dict = {c: header.get(name.lower()) for c, name in NAMES.items()}
    for c in ("record_id", "refers_to", "target_uri"):
        if row[c] and row[c].startswith("<") and row[c].endswith(">"):
            row[c] = row[c][1:-1]
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].split(":", 1)[-1]
    row["content_length"] = int(row["content_length"] or 0)
    return row


TESTS = {
    EqualTo: lambda x, v: x is not None and x == v,
    EqualNullSafe: lambda x, v: x == v,
    GreaterThan: lambda x, v: x is not None and x > v,
    GreaterThanOrEqual: lambda x, v: x is not None and x >= v,
    LessThan: lambda x, v: x is not None and x < v,
    LessThanOrEqual: lambda x, v: x is not None and x <= v,
    In: lambda x, v: x is not None and x in v,
    StringStartsWith: lambda x, v: x is not None and x.startswith(v),
    StringEndsWith: lambda x, v: x is not None and x.endswith(v),
    StringContains: lambda x, v: x is not None and v in x,
    IsNull: lambda x, v: x is None,
    IsNotNull: lambda x, v: x is not None,
}


@dataclass
class Files(InputPartition):
    names: list

    def __init__(self, names):
        super().__init__(0)
        self.names = names


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path = options["path"]
        self.columns = [f.name for f in schema.fields]
        unknown = [c for c in self.columns if c not in TYPES]
        if unknown:
            raise ValueError(f"no such columns in a WARC record: {', '.join(unknown)}")
        self.part = int(options.get("partitionbytes", PART))
        self.wanted: list = []  # (test, column, value)

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in TESTS and column in NAMES:
                self.wanted.append((type(f).__name__, column, getattr(f, "value", None)))
            else:
                yield f

    def fits(self, row: dict) -> bool:
        return all(CALLS[test](row[column], value) for test, column, value in self.wanted)

    def listed(self) -> list[tuple[str, int]]:
        """(path, bytes) of the files of the archive. Where manifests stand, files that no commit made are
        left out, and those without a record of a wanted type."""
        folder, at = arrow_fs.FileSystem.from_uri(self.path)
        info = folder.get_file_info(at)
        if info.type == arrow_fs.FileType.File:
            return [(at, info.size)]
        if info.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        stored = manifests(folder, at)
        if not stored:
            found = folder.get_file_info(arrow_fs.FileSelector(at, recursive=True))
            return sorted((f.path, f.size) for f in found if f.base_name.endswith((".warc", ".warc.gz")))
        out = []
        for name in stored:
            with folder.open_input_stream(name, compression=None) as source:
                for f in json.loads(source.read())["files"]:
                    types = [(test, value) for test, column, value in self.wanted if column == "record_type"]
                    if any(all(CALLS[t](k, v) for t, v in types) for k in f["types"]):
                        out.append((f"{at}/{f['file']}", f["bytes"]))
        return sorted(out)

    def partitions(self):
        """Files are read whole; small ones share a partition up to a number of bytes."""
        parts, now, held = [], [], 0
        for name, size in self.listed():
            if now and held + size > self.part:
                parts.append(Files(now))
                now, held = [], 0
            now.append(name)
            held += size
        return [*parts, Files(now)] if now else parts or [Files([])]

    def read(self, partition):
        folder, _ = arrow_fs.FileSystem.from_uri(self.path)
        arrow = pa.schema([(c, ARROW[TYPES[c]]) for c in self.columns])
        rows, held = [], 0

        def batch():
            made = [pa.array([r[c] for r in rows], arrow.field(c).type) for c in self.columns]
            return pa.RecordBatch.from_arrays(made, schema=arrow)

        for name in partition.names:
            with folder.open_input_file(name) as source:
                for row in self.records(Stream(source, name)):
                    rows.append(row)
                    held += len(row.get("payload") or b"") + 512
                    if held >= 8 << 20:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    def records(self, stream: Stream):
        """The wanted records of a file: the header first, then only what the columns ask for."""
        inner = {"http_status", "payload_bytes", "payload"} & set(self.columns)
        while True:
            while stream.buffer[:2] == b"\r\n":
                stream.buffer = stream.buffer[2:]
            offset = stream.source.tell() - len(stream.buffer)
            raw = stream.until(b"\r\n\r\n")
            if raw is None:
                return
            offset = stream.member if stream.packed else offset
            if not raw.startswith(b"WARC/"):
                raise ValueError(f"{stream.name}: no record at {offset}")
            header = header_of(raw)
            row = columns_of(header)
            length = row["content_length"]
            alone = stream.member_length() == len(raw) + length + 4
            if not self.fits(row):
                stream.skip(length + 4, alone)
                continue
            row |= {"headers": list(header.items()), "file": stream.name, "offset": offset}
            row |= {"http_status": None, "payload_bytes": length, "payload": None}
            left = length
            if inner and (row["content_type"] or "").startswith("application/http") and length:
                http = stream.until(b"\r\n\r\n")
                left -= len(http)
                found = header_of(http)
                status = re.match(rb"HTTP/\S+ (\d{3})", http)
                row["http_status"] = int(status[1]) if status else None
                # a revisit has no payload; the header that it repeats tells the length
                told = found.get("content-length", "")
                again = row["record_type"] == "revisit" and told.isdigit()
                row["payload_bytes"] = int(told) if again else left
            if "payload" in inner and row["record_type"] != "revisit":
                row["payload"] = stream.read(left)
                left, alone = 0, False  # the checksum behind it is read too
            stream.skip(left + 4, alone)
            yield row


CALLS = {kind.__name__: test for kind, test in TESTS.items()}


class WarcDataSource(DataSource):
    """``spark.read.format("warc")``: a file or folder of ``.warc`` and ``.warc.gz``.

    With a schema of some of the columns only these are made, so a schema without ``payload`` decodes
    no payload. Filters on the columns of ``NAMES`` are tested on headers, before anything else of a
    record is decoded. ``df.write.format("warc")`` takes rows of ``RECORD``.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self):
        return ", ".join(f"{c} {t}" for c, t in TYPES.items())

    def reader(self, schema):
        return Reader(self.options, schema)

    def writer(self, schema, overwrite: bool):
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records of an archive, with all columns of ``TYPES`` or those named."""
    register(spark)
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    source = spark.read.format("warc").option("partitionbytes", str(most))
    if columns is not None:
        source = source.schema(", ".join(f"{c} {TYPES[c]}" for c in columns))
    return source.load(path)


# ---------------------------------------------------------------- pages


def _name(page_id: Column, row: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), row)


def page_of(record_id: Column) -> Column:
    """The page_id in a record id of ``archive``."""
    return F.regexp_extract(record_id, "^urn:page:(-?[0-9]*):", 1).try_cast("long")


def archive(pages: DataFrame, path: str) -> None:
    """Writes a record per row of ``pages`` (page_id, url, html); payload is the html in UTF-8.

    Of rows with equal payloads of at least 1,000 bytes, the one with the largest page_id becomes a
    response, the others revisit it; rows with smaller payloads are all responses. A null html is an
    empty payload, a null url leaves the header out, blanks and control characters of a url are
    percent-encoded. A null page_id is below all others; rows with equal ids are records of their own,
    told apart by a row number in the record id, whose largest decides. Other columns are ignored. No
    rows make an archive without files.

    The html is hashed where it lies; only keys are grouped, and copies go to the writers without html.
    """
    spark = pages.sparkSession
    register(spark)
    rows, row = keyed(
        pages.select(
            F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
            F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
        ),
        "warc-pages",
    )
    keys = stage(
        rows.select(
            row, "page_id", F.sha1("payload").alias("digest"), F.length("payload").cast("long").alias("bytes")
        ),
        "warc-keys",
    )
    last = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", row))
    kept = (
        keys.where(F.col("bytes") >= SMALL)
        .groupBy("digest", "bytes")
        .agg(last.alias("last"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "bytes", F.col("last.page_id").alias("of"), F.col(f"last.{row}").alias("of_row"))
    )
    again = stage(
        keys.join(kept, ["digest", "bytes"]).where(F.col(row) != F.col("of_row"))
        .select(row, _name(F.col("of"), F.col("of_row").cast("string")).alias("refers_to")),
        "warc-revisits",
    )
    records = (
        rows.withColumn("payload_digest", F.sha1("payload"))
        .withColumn("payload_bytes", F.length("payload").cast("long"))
        .join(again.hint("merge"), row, "left")  # copies grow with the pages: one plan at every size
        .select(
            _name(F.col("page_id"), F.col(row).cast("string")).alias("record_id"),
            F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"),
            F.col("url").alias("target_uri"), "payload_digest", "refers_to", "payload_bytes",
            F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
        )
    )
    records.write.format("warc").mode("append").save(path)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of ``pages`` as an archive tells
    them: ``archive`` writes it (below the shared folder, if no path is given), then it is read back.

    Length and digest of a response are those of the payload as read; those of a revisit stand in its
    headers, and nothing else of it is decoded.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    archive(pages, path)
    whole = read(spark, path, ["record_id", "record_type", "payload"]).where("record_type = 'response'")
    again = read(spark, path, ["record_id", "record_type", "payload_digest", "refers_to", "payload_bytes"])
    return whole.select(
        page_of(F.col("record_id")).alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"),
    ).unionByName(
        again.where("record_type = 'revisit'").select(
            page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
            page_of(F.col("refers_to")).alias("refers_to"),
        )
    )
