"""WARC records in ZIP-packaged archives, written and read by range.

An archive is a ZIP file whose members are *stored*: ``archive/data.warc.gz`` (each record a gzip
member of its own), ``indexes/index.cdxj`` (one line for each record: page, offset and length inside
the archive member) and ``datapackage.json``. Sizes and offsets above 4 GiB use ZIP64 fields. Readers
seek to the end record, follow the ZIP64 locator if there is one, parse the central directory and read
only the index and then the byte ranges of the records; nothing is extracted.

Tasks write their archives to a folder that all executors share (by pyarrow file systems, so any
store that they reach will do) under a fresh name for each attempt; a table of contents, itself
written to the shared folder, lists the archives of the attempts that counted.

Records with equal payloads of ``min_revisit`` bytes or more are written once: the one with the
largest page_id is the response, the others are revisits that refer to it.

Defined results: a null html is an empty payload; smaller payloads are all responses; repeated rows
with the largest page_id are all responses; a null page_id counts as smaller than all others, and if a group has
only null ids they are all responses; an empty table writes no archive and gives an empty result;
ids that are no whole numbers are an error; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.common import check_ids, cut, shared_dir

MIN_REVISIT = 1000
ARCHIVE_BYTES = 256 << 20
BROADCAST_ROWS = 500_000
SALTS = 32
MAX_TASKS = 50_000
MEMBER, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
LIMIT32 = 0xFFFFFFFF
# Signatures of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"


# --- ZIP -------------------------------------------------------------------------------------


class StoredZip:
    """Writes stored members one after the other. Sizes follow each member in a data descriptor."""

    def __init__(self, sink, force64: bool = False) -> None:
        self.sink, self.at, self.members, self.force64 = sink, 0, [], force64

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.start, self.crc, self.size = name.encode(), self.at, 0, 0
        # Flag 8: sizes come in a descriptor; the ZIP64 field says that they have eight bytes there.
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 8, 0, 0, 33, 0, LIMIT32, LIMIT32, len(self.name), len(extra)) + self.name + extra)

    def write(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self.size += len(data)
        self._put(data)

    def finish(self) -> None:
        self._put(b"PK\x07\x08" + struct.pack("<IQQ", self.crc, self.size, self.size))
        self.members.append((self.name, self.start, self.crc, self.size))

    def close(self) -> None:
        begin = self.at
        for name, start, crc, size in self.members:
            large_size, large_start = self.force64 or size >= LIMIT32, self.force64 or start >= LIMIT32
            extra = (struct.pack("<QQ", size, size) if large_size else b"") + (struct.pack("<Q", start) if large_start else b"")
            extra = struct.pack("<HH", 1, len(extra)) + extra if extra else b""
            short = LIMIT32 if large_size else size
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 8, 0, 0, 33, crc, short, short, len(name), len(extra), 0, 0, 0, 0, LIMIT32 if large_start else start) + name + extra)
        size, n = self.at - begin, len(self.members)
        if self.force64 or begin >= LIMIT32 or n >= 0xFFFF:
            at = self.at
            self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, begin))
            self._put(LOCATOR64 + struct.pack("<IQI", 0, at, 1))
            n, size, begin = min(n, 0xFFFF), LIMIT32, LIMIT32
        self._put(END + struct.pack("<HHHHIIH", 0, 0, n, n, size, begin, 0))


def _range(source, at: int, size: int) -> bytes:
    source.seek(at)
    return source.read(size)


def central_directory(source) -> dict[str, tuple[int, int, int]]:
    """Offset of the local header, size and method of each member."""
    total = source.size()
    tail_at = max(0, total - 22 - 0xFFFF)
    tail = _range(source, tail_at, total - tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of a central directory")
    n, size, begin = struct.unpack("<HII", tail[at + 10 : at + 20])
    if n == 0xFFFF or size == LIMIT32 or begin == LIMIT32:
        locator = _range(source, tail_at + at - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        end64 = _range(source, struct.unpack("<Q", locator[8:16])[0], 56)
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end of a central directory")
        n, size, begin = struct.unpack("<QQQ", end64[32:56])
    data, at, out = _range(source, begin, size), 0, {}
    for _ in range(n):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("no central directory header")
        method, _, _, _, packed, plain, name_size, extra_size, note_size = struct.unpack("<HHHIIIHHH", data[at + 10 : at + 34])
        start = struct.unpack("<I", data[at + 42 : at + 46])[0]
        name = data[at + 46 : at + 46 + name_size].decode()
        extra = data[at + 46 + name_size : at + 46 + name_size + extra_size]
        while len(extra) >= 4:
            kind, length = struct.unpack("<HH", extra[:4])
            if kind == 1:  # only the fields that don't fit, in this order
                wide = list(struct.unpack(f"<{length // 8}Q", extra[4 : 4 + length // 8 * 8]))
                plain = wide.pop(0) if plain == LIMIT32 else plain
                packed = wide.pop(0) if packed == LIMIT32 else packed
                start = wide.pop(0) if start == LIMIT32 else start
            extra = extra[4 + length :]
        out[name] = (start, packed, method)
        at += 46 + name_size + extra_size + note_size
    return out


def stored_at(source, entry: tuple[int, int, int]) -> int:
    """Where the bytes of a stored member begin."""
    start, _, method = entry
    if method != 0:
        raise ValueError("the member is not stored")
    head = _range(source, start, 30)
    if head[:4] != LOCAL:
        raise ValueError("no local header")
    name_size, extra_size = struct.unpack("<HH", head[26:30])
    return start + 30 + name_size + extra_size


# --- WARC ------------------------------------------------------------------------------------


def _urn(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(urn: str) -> int | None:
    page = urn.strip("<>").rpartition(":")[2]
    return int(page) if page else None


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member with the record of a page. A revisit keeps the head of the response only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    raw = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(packed: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC head, HTTP head and payload of one gzip member."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in http.decode().split("\r\n")[1:])}, payload


# --- Spark -----------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest, refers_to, revisit.

    Payloads are not shuffled: what is joined to them is a row for each payload that recurs, broadcast if
    there are at most ``BROADCAST_ROWS`` of them (about 30 bytes each). Beyond that the rows of large
    payloads are joined by digest, a payload's rows in ``SALTS`` parts, so no payload meets in one task.
    """
    check_ids(pages, "page_id")
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("large", F.octet_length("html") >= min_revisit)
    again = rows.where("large").groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    again = cut(again.select("digest", "first"))
    if again.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(again.withColumn("large", F.lit(True))), ["digest", "large"], "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        parts = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        told = rows.where("large").withColumn("salt", salt).join(parts, ["digest", "salt"], "left").drop("salt")
        joined = told.unionByName(rows.where("not large"), allowMissingColumns=True)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", F.lower(F.hex("digest")).alias("digest"), F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages; a row (path, records) for each archive."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        state: dict = {}

        def close() -> pa.RecordBatch:
            z, sink, index = state["zip"], state["sink"], state["index"]
            z.finish()
            for name, body in ((INDEX, "".join(index).encode()), (PACKAGE, json.dumps({"profile": "data-package", "resources": [{"path": MEMBER}, {"path": INDEX}]}).encode())):
                z.begin(name)
                z.write(body)
                z.finish()
            z.close()
            sink.close()
            out = pa.RecordBatch.from_arrays([pa.array([state["path"]]), pa.array([len(index)], pa.int64())], names=["path", "records"])
            state.clear()
            return out

        for batch in batches:
            for page, url, html, digest, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not state:
                    store.create_dir(root, recursive=True)
                    path = f"{root}/{uuid.uuid4().hex}.wacz"
                    sink = store.open_output_stream(path)
                    state |= {"path": path, "sink": sink, "zip": StoredZip(sink), "index": []}
                    state["zip"].begin(MEMBER)
                packed = record(page, url, html.encode(), digest, refers_to, revisit)
                state["index"].append(json.dumps({"page": page, "offset": state["zip"].size, "length": len(packed)}) + "\n")
                state["zip"].write(packed)
                if state["zip"].size >= archive_bytes:
                    yield close()
        if state:
            yield close()

    return cut(with_revisits(pages, min_revisit).mapInArrow(job, "path string, records long"))


def index_of(archives: DataFrame, folder: str) -> DataFrame:
    """(path, offset, length) of each record, from the archives' directories and indexes."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_file(path) as source:
                    entries = central_directory(source)
                    begin = stored_at(source, entries[MEMBER])
                    lines = [json.loads(x) for x in _range(source, stored_at(source, entries[INDEX]), entries[INDEX][1]).decode().splitlines()]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), pa.array([begin + x["offset"] for x in lines], pa.int64()), pa.array([x["length"] for x in lines], pa.int64())], names=["path", "offset", "length"])

    return archives.select("path").mapInArrow(job, "path string, offset long, length long")


READ_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload_matches boolean"


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Range-read the records of an index. Digests of responses are checked against their payloads."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        path, source = None, None
        for batch in batches:
            rows = []
            for at, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != path:
                    if source is not None:
                        source.close()
                    path, source = at, store.open_input_file(at)
                fields, http, payload = parse_record(_range(source, offset, length))
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                revisit = fields["warc-type"] == "revisit"
                ok = None if revisit else hashlib.sha1(payload).hexdigest() == digest and len(payload) == int(http["content-length"])
                rows.append((_page(fields["warc-record-id"]), int(http["content-length"]), digest, fields["warc-type"], _page(fields["warc-refers-to"]) if revisit else None, fields["warc-target-uri"], ok))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in READ_DDL.split(", ")])
        if source is not None:
            source.close()

    return index.mapInArrow(job, READ_DDL)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages and read every record back: at most one archive for each task, as far as there are slots."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    archives = write_archives(pages, folder)
    # A number given here is kept: rows of paths are too small for adaptive execution to keep them apart.
    tasks = min(max(archives.count(), 1), MAX_TASKS)
    return read_records(index_of(archives.select("path").repartition(tasks), folder), folder)


def verified(records: DataFrame) -> DataFrame:
    """``records``, where a response whose payload isn't the one that its header tells is an error."""
    wrong = F.raise_error(F.concat(F.lit("the payload of record "), F.col("page_id").cast("string"), F.lit(" does not match its digest")))
    return records.withColumn("payload_digest", F.when(F.coalesce("payload_matches", F.lit(True)), F.col("payload_digest")).otherwise(wrong.cast("string")))
