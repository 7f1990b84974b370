"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Writing: every task writes its own ``.warc.gz`` files, one gzip member per record, each with the skip-length extra
field (compressed and plain size), and names them by task attempt. The commit lists the files of the attempts that count in a
manifest; files of failed attempts are never read. Reading: one partition per file. The reader parses a record's headers
first; records that the pushed predicates (equality or membership on header columns) reject are left by a seek, and payloads
are decoded only on request (option ``payload``). Foreign archives, plain or gzipped, without manifest or skip lengths, are read too.
Paths go through pyarrow's file systems, so any shared store it knows will do.

Damage: stray bytes, a record cut short, a wrong checksum or size, and a payload unlike its SHA-256 digest are errors that name the
file and the byte. With option ``damaged`` set to ``mark`` the reader goes on at the next whole record header and gives one row
of type ``damaged`` for what it passed over (``http_length``: how many bytes), or for the record whose digest differs (``record_id`` kept).
Records that are passed over without decoding are checked for their place and size only.

Cases: null payload counts as empty, null ``page_id`` gives a record without id that nothing refers to; null url gives no target header. Repeated
rows give repeated records. An empty table gives an archive without records. Control characters of a url are percent-encoded.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from chartloom.llm.common import only, table
from chartloom.session import cut_lineage, shared_dir

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, http_length long, payload binary"
ROLL_BYTES, BATCH_BYTES, HEAD, WINDOW = 256 << 20, 4 << 20, 1024, 1 << 20
DEDUP_BYTES = 100
# Fixed names of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
_ARROW = pa.schema([*((c, pa.string()) for c in _HEADERS), ("http_length", pa.int64()), ("payload", pa.binary())])


# -- records


def record(row: dict) -> bytes:
    """A response or revisit record; a revisit carries the HTTP headers only."""
    length = row["http_length"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}"]
    if row["record_id"] is not None:
        lines.append(f"WARC-Record-ID: <{row['record_id']}>")
    if row["target_uri"] is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in row["target_uri"]))
    lines += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{row['payload_digest']}"]
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{row['refers_to']}>"]
    else:
        block += row["payload"] or b""
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*lines, "\r\n"]).encode() + block + b"\r\n\r\n"


def info_record() -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    """``data`` as one gzip member whose extra field ``sl`` holds its compressed and plain sizes."""
    box = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = box.compress(data) + box.flush()
    size = 24 + len(body) + 8
    if max(size, len(data)) < 1 << 32:
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data))
    else:  # the field cannot hold it
        head = b"\x1f\x8b\x08\0\0\0\0\0\0\xff"
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parsed(head: bytes) -> dict[str, str]:
    """Header names, lowered, with their values, after the version line."""
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, sep, value in pairs if sep}


def damaged_payload(headers: dict[str, str], http: dict[str, str], body: bytes) -> bool:
    """Whether the payload of a response has another SHA-256 than its header says; other kinds of digests are not checked."""
    name, _, value = headers.get("warc-payload-digest", "").partition(":")
    if headers.get("warc-type") != "response" or name.lower() != "sha256" or not re.fullmatch("[0-9a-fA-F]{64}", value):
        return False
    return "transfer-encoding" not in http and hashlib.sha256(body).hexdigest() != value.lower()


class Damaged(ValueError):
    """The bytes at this place are no whole record."""


class Archive:
    """Sequential reader of one archive: headers first, then the block or a jump to the next record."""

    def __init__(self, file: pa.NativeFile, mark: bool = False):
        self.file, self.size, self.mark = file, file.size(), mark
        self.window, self.window_at = b"", 0
        self.gzipped = self._read(2, 0) == b"\x1f\x8b"
        self.decoded = 0  # plain bytes of blocks worked out

    def _read(self, n: int, at: int) -> bytes:
        """Bytes of the file, by way of a window, so that a store sees few requests."""
        low = at - self.window_at
        if low < 0 or low + n > len(self.window):
            if at >= self.size:
                return b""
            self.window, self.window_at, low = self.file.read_at(max(n, WINDOW), at), at, 0
        return self.window[low : low + n]

    def records(self, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """Headers and block of each record; ``wanted(headers)``: None to pass over it, else whether its block is needed."""
        at = 0
        while at < self.size:
            try:
                at, headers, block = (self._zipped if self.gzipped else self._plain)(at, wanted)
            except (Damaged, zlib.error) as error:
                if not self.mark:
                    raise Damaged(f"damaged record at byte {at}: {error}") from error
                lead = self._read(HEAD, at)
                after = self._next(at + len(lead) - len(lead.lstrip(b"\r\n")) + 1)
                headers, block, at = {"warc-type": "damaged", "content-length": str(after - at)}, None, after
                if wanted(headers) is None:
                    continue
            if headers is not None:
                yield headers, block

    def _next(self, at: int) -> int:
        """The next place that looks like the start of a record."""
        sign = b"\x1f\x8b\x08" if self.gzipped else b"WARC/1."
        while at < self.size:
            data = self._read(WINDOW, at)
            found = data.find(sign)
            if found < 0:
                at += max(1, len(data) - len(sign) + 1)
                continue
            at += found
            try:
                if not self.gzipped or zlib.decompressobj(31).decompress(self._read(HEAD, at)).startswith(b"WARC/"):
                    return at
            except zlib.error:
                pass
            at += 1
        return self.size

    def _headers(self, plain: bytes) -> tuple[dict[str, str], int, int]:
        """Headers, where they end, and the length of the block."""
        stop = plain.find(b"\r\n\r\n")
        if stop < 0 or not plain.startswith(b"WARC/"):
            raise Damaged("no record header")
        headers = parsed(plain[:stop])
        length = headers.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            raise Damaged("no length of the block")
        return headers, stop + 4, int(length)

    def _plain(self, at: int, wanted):
        data = b""
        while b"\r\n\r\n" not in data.lstrip(b"\r\n"):
            more = self._read(max(HEAD, len(data)), at + len(data))
            if not more:
                break
            data += more
        head = data.lstrip(b"\r\n")
        if not head:
            return self.size, None, None
        headers, stop, length = self._headers(head)
        start = at + len(data) - len(head) + stop
        if start + length > self.size:
            raise Damaged("cut short")
        need = wanted(headers)
        block = None
        if need:
            block = self._read(length, start)
            self.decoded += length
        return start + length, headers if need is not None else None, block

    def _zipped(self, at: int, wanted):
        first = self._read(HEAD, at)
        if len(first) < 18 or first[:2] != b"\x1f\x8b":
            raise Damaged("no gzip member")
        length = None
        if first[3] & 4:
            extra = first[12 : 12 + struct.unpack_from("<H", first, 10)[0]]
            if extra[:2] == b"sl" and len(extra) >= 12:
                length = struct.unpack_from("<I", extra, 4)[0]
        box = zlib.decompressobj(31)
        plain, taken = box.decompress(first), len(first)

        def more() -> bool:
            nonlocal plain, taken
            data = self._read(1 << 16, at + taken)
            taken += len(data)
            plain += box.decompress(data)
            return bool(data)

        while b"\r\n\r\n" not in plain and not box.eof and more():
            pass
        headers, stop, size = self._headers(plain)
        need = wanted(headers)
        block = None
        if need or length is None:
            held, plain = [plain], b""
            while not box.eof and more():
                if need:
                    held.append(plain)
                plain = b""
            if not box.eof:
                raise Damaged("cut short")
            if length not in (None, taken - len(box.unused_data)):
                raise Damaged("another size than its header says")
            length = taken - len(box.unused_data)
            if need:
                block = b"".join(held)[stop : stop + size]
                self.decoded += size
                if len(block) < size:
                    raise Damaged("cut short")
        elif at + length > self.size or length < 18:
            raise Damaged("cut short")
        return at + length, headers if need is not None else None, block


# -- data source


@dataclass
class _File(InputPartition):
    path: str

    def __init__(self, path: str):
        self.path = path


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, mark: bool):
        self.path, self.payload, self.mark, self.equal = path, payload, mark, {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in _HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.equal[name] = self.equal.get(name, values) & values
            else:
                yield f

    def partitions(self):
        store, root = fs.FileSystem.from_uri(self.path)
        files = [x.path for x in store.get_file_info(fs.FileSelector(root)) if x.is_file]
        manifests = [f for f in files if posixpath.basename(f).startswith("_manifest-")]
        if manifests:
            names = [n for m in manifests for n in json.loads(store.open_input_stream(m).read())]
            files = [f"{root}/{n}" for n in names]
        else:
            files = [f for f in files if f.endswith((".warc", ".warc.gz"))]
        return [_File(f) for f in sorted(files)]

    def read(self, partition):
        if partition is None or partition.path is None:
            return
        store, _ = fs.FileSystem.from_uri(self.path)

        def row(headers: dict[str, str]) -> dict:
            values = {c: headers.get(h) for c, h in _HEADERS.items()}
            for c in ("record_id", "refers_to"):
                values[c] = values[c] and values[c].strip("<>")
            values["payload_digest"] = values["payload_digest"] and values["payload_digest"].removeprefix("sha256:")
            return values

        def fits(values: dict) -> bool:
            return all(values[c] in allowed for c, allowed in self.equal.items())

        # Which payloads differ from their digests shows only once they are decoded.
        decode_all = self.mark and self.payload and "damaged" in self.equal.get("record_type", ())

        def wanted(headers: dict[str, str]) -> bool | None:
            return self.payload if decode_all or fits(row(headers)) else None

        rows, held = [], 0
        with store.open_input_file(partition.path) as file:
            for headers, block in Archive(file, self.mark).records(wanted):
                values = row(headers)
                if block is not None:
                    head, _, body = block.partition(b"\r\n\r\n") if "application/http" in headers.get("content-type", "") else (b"", b"", block)
                    http = parsed(head)
                    length = http.get("content-length")
                    values["http_length"] = int(length) if length else len(body)
                    values["payload"] = None if values["record_type"] == "revisit" else body
                    if damaged_payload(headers, http, body):
                        if not self.mark:
                            raise Damaged(f"payload of {values['record_id']} in {partition.path} differs from its digest")
                        values |= {"record_type": "damaged", "payload": None, "http_length": len(body)}
                    held += len(body)
                elif values["record_type"] == "damaged":
                    values["http_length"] = int(headers["content-length"])
                if not fits(values):
                    continue
                rows.append(values)
                if held > BATCH_BYTES or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        store, root = fs.FileSystem.from_uri(self.path)
        context, names, out = TaskContext.get(), [], None
        try:
            for batch in iterator:
                for r in batch.to_pylist():
                    if out is None:
                        names.append(f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{len(names)}.warc.gz")
                        out = store.open_output_stream(f"{root}/{names[-1]}", compression=None)
                        out.write(member(info_record()))
                    out.write(member(record(r)))
                    if out.tell() > ROLL_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return _Written(names)

    def commit(self, messages):
        store, root = fs.FileSystem.from_uri(self.path)
        names = [n for m in messages if m is not None for n in m.files]
        with store.open_output_stream(f"{root}/_manifest-{uuid4().hex}") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages):
        """Files of a failed job stay unlisted, so no reader sees them."""


class WarcSource(DataSource):
    """Options: ``path``; ``payload`` (default true): whether blocks are decoded; ``damaged``: ``fail`` (default) or ``mark``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        damaged = self.options.get("damaged", "fail").lower()
        if damaged not in ("fail", "mark"):
            raise ValueError("damaged: fail or mark")
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true", damaged == "mark")

    def writer(self, schema, overwrite):
        store, root = fs.FileSystem.from_uri(self.options["path"])
        if overwrite:
            raise ValueError("archives are only appended to")
        store.create_dir(root, recursive=True)
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_archive(spark: SparkSession, path: str, payload: bool = True, damaged: str = "fail") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("damaged", damaged).load(path)


def _uri(number) -> F.Column:
    return F.concat(F.lit("urn:page:"), number.cast("string"))


def page_records(pages: DataFrame, least: int = DEDUP_BYTES) -> DataFrame:
    """Rows for the writer from ``page_id, url, html``: equal payloads of ``least`` bytes or more are kept once.

    The digests that occur more than once are found by a partial aggregate and joined back between plain
    exchanges, so a digest that very many pages share is split.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = only(pages, "page_id", "url", "html").select("page_id", "url", payload.alias("payload")).withColumns(
        {"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")}
    )
    repeated = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    repeated = cut_lineage(repeated.filter("n > 1 AND first IS NOT NULL").select("digest", "first"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(repeated, "digest", "left").select(
        _uri(F.col("page_id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(again, _uri(F.col("first"))).alias("refers_to"),
        F.col("digest").alias("payload_digest"),
        F.col("bytes").alias("http_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_archive(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid4().hex}"
    write_archive(page_records(table(spark, sf_dir, "pages")), path)
    back = read_archive(spark, path).filter(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return back.select(
        number("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), "http_length").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "payload_digest").alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
