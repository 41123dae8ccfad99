"""WARC records in ZIP packages: written as stored members with an index, read back by ranges.

A package holds archive/data.warc.gz and indexes/index.cdx, both stored, not deflated; in the archive each record is a gzip member
of its own, as WARC files have it. The reader takes the end-of-central-directory record (and its ZIP64 form), the central
directory and a member's local header, each by a range read, then the index, then single records inside the stored archive.
Nothing is extracted. Archives of plain records (archive/*.warc) are read too.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _kept, ship, shared_dir, stored

#: Bytes of records in a package, beyond which the next one begins.
PACKAGE_BYTES = 32 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Level of the records' compression.
LEVEL = 4
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload string"
SALTS = 32


def record(page_id: int | None, url: str, digest: str, kind: str, refers_to: int | None, n_bytes: int, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    refers = f"WARC-Refers-To: <urn:page:{refers_to}>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n" if kind == "revisit" else ""
    clean = "".join(c for c in url if c not in "\r\n")
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\nWARC-Target-URI: {clean}\r\nWARC-Payload-Digest: sha1:{digest}\r\n{refers}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(http) + len(payload)}\r\n\r\n"
    return head.encode() + http + payload + b"\r\n\r\n"


def package(records: list[tuple[int | None, bytes]]) -> bytes:
    """A ZIP of the records, in order, and their index: page_id, offset, length (as stored) and archive a line."""
    at, lines, members = 0, [], []
    for page_id, plain in records:
        r = gzip.compress(plain, LEVEL, mtime=0)
        members.append(r)
        lines.append(f"{'' if page_id is None else page_id} {at} {len(r)} {ARCHIVE.removeprefix('archive/')}\n")
        at += len(r)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(ARCHIVE, b"".join(members))
        z.writestr(INDEX, "".join(lines))
    return out.getvalue()


def read_range(f, at: int, n: int) -> bytes:  # noqa: ANN001
    f.seek(at)
    got = f.read(n)
    if len(got) != n:
        raise ValueError(f"{n} bytes at {at} asked for, {len(got)} there")
    return got


def directory(f, size: int) -> dict[str, tuple[int, int, int]]:  # noqa: ANN001
    """name -> (method, stored size, offset of the local header), from the central directory or its ZIP64 form."""
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = read_range(f, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    entries, length, start = struct.unpack("<10xHII2x", tail[end : end + 22])
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (at,) = struct.unpack("<8xQ4x", tail[end - 20 : end])
        z = read_range(f, at, 56)
        if z[:4] != b"PK\x06\x06":
            raise ValueError("broken ZIP64 end of central directory")
        entries, length, start = struct.unpack("<32xQQQ", z)
    data, at, found = read_range(f, start, length), 0, {}
    for _ in range(entries):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, full, n_name, n_extra, n_note, offset = struct.unpack("<10xH8xIIHHH8xI", data[at : at + 46])
        name = data[at + 46 : at + 46 + n_name].decode("utf-8")
        extra, e = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack("<HH", extra[e : e + 4])
            if kind == 1:  # ZIP64: only the fields that overflowed, in this order
                wide = list(struct.unpack(f"<{n // 8}Q", extra[e + 4 : e + 4 + n // 8 * 8]))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
            e += 4 + n
        found[name] = (method, packed, offset)
        at += 46 + n_name + n_extra + n_note
    return found


def member_at(f, entry: tuple[int, int, int]) -> int:  # noqa: ANN001
    """Where a stored member's bytes begin."""
    method, _, offset = entry
    if method != 0:
        raise ValueError("only stored members can be read by ranges")
    head = read_range(f, offset, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    return offset + 30 + sum(struct.unpack("<26xHH", head))


def read_record(data: bytes) -> dict:
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    n_bytes = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
    number = lambda x: int(x[len("<urn:page:") : -1]) if len(x) > len("<urn:page:>") else None
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response":
        if len(payload) != n_bytes or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": n_bytes, "payload_digest": digest,
        "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "payload": payload.decode() if kind == "response" else None,
    }


def index_entry(line: str) -> tuple[str, int, int]:
    """(archive, offset, length) of an index line: this module's own, or CDXJ (key, time, JSON)."""
    if "{" in line:
        fields = json.loads(line[line.index("{") :])
        return fields["filename"], int(fields["offset"]), int(fields["length"])
    _, at, n, archive = line.split(" ")
    return archive, int(at), int(n)


def records_of(f, size: int) -> Iterator[dict]:  # noqa: ANN001
    """The records of all archives of a package that its indexes list, in their order."""
    names = directory(f, size)
    archives = {name.removeprefix("archive/"): member_at(f, e) for name, e in names.items() if name.startswith("archive/") and name != "archive/"}
    for name, entry in names.items():
        if not name.startswith("indexes/") or name == "indexes/" or entry[1] == 0:
            continue
        data = read_range(f, member_at(f, entry), entry[1])
        for line in (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode().splitlines():
            if line and not line.startswith("!meta"):
                archive, at, n = index_entry(line)
                yield read_record(read_range(f, archives[archive] + at, n))


def decide(pages: DataFrame, least_bytes: int, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, sha1, n_bytes, refers_to (null: a response).

    Of the pages with equal payloads of least_bytes or more, the one with the largest id is the response. Rows that repeat its id
    are responses too, as are rows without an id. The join by payload carries ids only, its hot keys salted; the pages
    themselves move once, by page_id.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("n_bytes", F.octet_length("html").cast("long"))
    slim = rows.filter(F.col("n_bytes") >= least_bytes).filter("page_id is not null").select("page_id", "sha1")
    keepers = slim.groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("other")).filter("keeper <> other").drop("other")
    keepers = keepers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    revisits = slim.distinct().withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(keepers.hint("merge"), ["sha1", "salt"]).filter("page_id <> keeper")
    revisits = revisits.select("page_id", "sha1", F.col("keeper").alias("refers_to"))
    return rows.join(revisits, ["page_id", "sha1"], "left")


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes the packages into folder (a URI that pyarrow can open) and returns path, bytes, records of each.

    A task that runs twice writes other names; only packages in the returned table count.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        pending: list[tuple[int | None, bytes]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            data, path = package(pending), f"{base}/{uuid.uuid4().hex}.wacz"
            with files.open_output_stream(path) as out:
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(data)], pa.int64()), pa.array([len(pending)], pa.int64())], ["path", "bytes", "records"])

        files.create_dir(base, recursive=True)
        for batch in batches:
            for r in batch.to_pylist():
                kind = "response" if r["refers_to"] is None else "revisit"
                made = record(r["page_id"], r["url"], base64.b32encode(bytes.fromhex(r["sha1"])).decode(), kind, r["refers_to"], r["n_bytes"], r["html"].encode() if kind == "response" else b"")
                pending.append((r["page_id"], made))
                held += len(made)
                if held >= PACKAGE_BYTES:
                    yield flush()
                    pending, held = [], 0
        if pending:
            yield flush()

    slim = decide(pages, least_bytes).select("page_id", "url", "sha1", "n_bytes", "refers_to", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"))
    return stored(slim.mapInArrow(run, "path string, bytes bigint, records bigint"))


def read(packages: DataFrame, folder: str) -> DataFrame:
    """Every record of the packages (path, bytes), by range reads: RECORDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[dict] = []
                with files.open_input_file(path) as f:
                    for r in records_of(f, size):
                        rows.append(r)
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    spread = packages.select("path", "bytes").repartition(max(1, min(packages.count(), 4096)))
    return spread.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages written into the shared folder as packages and read back: a row a page, repeated rows included.

    Null html: an empty payload; null url: an empty one; null ids are responses. Payloads of any length are whole: one record
    is held in memory at a time, and a package of about PACKAGE_BYTES. Only the three named columns are read. An empty table
    gives no rows.
    """
    folder = f"{shared_dir(pages.sparkSession)}/graphloom-{uuid.uuid4().hex}"
    _kept.append((pages.sparkSession, folder))
    return read(write(pages, folder, least_bytes), folder)
