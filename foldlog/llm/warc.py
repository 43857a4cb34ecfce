"""WARC records in ZIP-packaged web archives: written by tasks, found through ZIP directories and indexes, read by range."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table, written

INDEX, RECORDS = "indexes/index.cdxj", "archive/data.warc.gz"
_CRLF = b"\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(page_id, url: str | None, payload: bytes, sha: str, refers_to) -> bytes:
    """One WARC record, gzipped on its own. A revisit has no payload, but the length and digest of the whole one."""
    revisit = refers_to is not None
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>",
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Page-ID": "" if page_id is None else str(page_id),
        "WARC-Payload-Digest": f"sha1:{sha}",
        "WARC-Payload-Length": str(len(payload)),
    }
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Page": str(refers_to)}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (0 if revisit else len(payload))
    block = http + (b"" if revisit else payload)
    head["Content-Type"], head["Content-Length"] = "application/http; msgtype=response", str(len(block))
    raw = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + _CRLF + block + _CRLF * 2
    packed = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packed.compress(raw) + packed.flush()


def parse_record(packed: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one gzipped record."""
    raw = zlib.decompress(packed, 31)
    at = raw.index(_CRLF * 2)
    lines = raw[:at].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = raw[at + 4 : at + 4 + int(head["content-length"])]
    return head, block[block.index(_CRLF * 2) + 4 :]


def zip_members(f, size: int) -> dict[str, tuple[int, int, int]]:
    """name: (offset of its data, stored length, method) from the central directory, ZIP64 where the archive has it.

    f has seek and read. Only the end of the file, the directory and each member's local header are read.
    """
    tail = min(size, 65_557 + 20)
    f.seek(size - tail)
    end = f.read(tail)
    at = end.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", end[at + 10 : at + 20])
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        spot = end[at - 20 : at]
        if spot[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        f.seek(struct.unpack("<Q", spot[8:16])[0])
        wide = f.read(56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", wide[32:56])
    f.seek(start)
    directory, out, p = f.read(length), {}, 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", directory[p + 8 : p + 12])
        packed, full, n_name, n_extra, n_note = struct.unpack("<IIHHH", directory[p + 20 : p + 34])
        offset = struct.unpack("<I", directory[p + 42 : p + 46])[0]
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            kind, n = struct.unpack("<HH", extra[q : q + 4])
            if kind == 1:  # the wide values follow in this order, for those that don't fit
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[q + 4 : q + 4 + n // 8 * 8]))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            q += 4 + n
        f.seek(offset)
        local = f.read(30)
        n_name2, n_extra2 = struct.unpack("<HH", local[26:30])
        out[name] = (offset + 30 + n_name2 + n_extra2, packed, method)
        p += 46 + n_name + n_extra + n_note
    return out


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """One archive per partition of records (page_id, url, payload, sha1 in hex, refers_to); returns archive and n_records.

    Records go to the archive as they come; only the index, a line per record, is held. A task writes under a name of
    its own, so a second attempt can't mix with a first; only archives in the returned, written table count.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in it if b.num_rows), None)
        if first is None:
            return
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        name = f"{base}/{uuid.uuid4().hex}.wacz"
        lines, at = [], 0
        with fs.open_output_stream(name) as out, zipfile.ZipFile(_Counted(out), "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            with z.open(RECORDS, "w", force_zip64=True) as member:
                for batch in _chain(first, it):
                    for row in batch.to_pylist():
                        packed = record(row["page_id"], row["url"], row["payload"], base64.b32encode(bytes.fromhex(row["sha1"])).decode(), row["refers_to"])
                        member.write(packed)
                        lines.append(json.dumps({"page": row["page_id"], "offset": at, "length": len(packed)}))
                        at += len(packed)
            z.writestr(INDEX, "\n".join(lines))
            z.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": RECORDS}, {"path": INDEX}]}))
        yield pa.RecordBatch.from_pydict({"archive": [name.rsplit("/", 1)[1]], "n_records": pa.array([len(lines)], pa.int64())})

    return written(records.mapInArrow(run, "archive string, n_records long"), "archives")


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


class _Counted(io.RawIOBase):
    """A stream that can't seek back, but knows its place: what ZipFile needs to write to an object store."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        pass


def list_records(archives: DataFrame, folder: str) -> DataFrame:
    """archive, at and length (of each record's bytes in the archive) from directories and indexes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        for batch in it:
            for name in batch.column("archive").to_pylist():
                info = fs.get_file_info(f"{base}/{name}")
                with fs.open_input_file(f"{base}/{name}") as f:
                    members = zip_members(f, info.size)
                    (start, _, method), (i_start, i_length, i_method) = members[RECORDS], members[INDEX]
                    if method or i_method:
                        raise ValueError("members must be stored")
                    f.seek(i_start)
                    lines = [json.loads(x) for x in f.read(i_length).decode().splitlines()]
                for k in range(0, len(lines), 10_000):
                    part = lines[k : k + 10_000]
                    yield pa.RecordBatch.from_pydict({"archive": [name] * len(part), "at": pa.array([start + x["offset"] for x in part], pa.int64()), "length": pa.array([x["length"] for x in part], pa.int64())})

    return archives.select("archive").mapInArrow(run, "archive string, at long, length long")


def read_records(spots: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records at spots (archive, at, length): page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    Each is one range read; nothing is extracted. A response whose payload doesn't have the length and digest of its
    header raises. With payloads false the payload is checked, but not returned (null). Revisits have a null payload.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        opened, f = None, None
        for batch in it:
            rows, held = [], 0
            for name, at, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "at", "length")), strict=True):
                if name != opened:
                    opened, f = name, fs.open_input_file(f"{base}/{name}")
                f.seek(at)
                head, payload = parse_record(f.read(length))
                n, sha, revisit = int(head["warc-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"] == "revisit"
                if not revisit and (len(payload) != n or digest(payload) != sha):
                    raise ValueError(f"{name}: payload at {at} doesn't match its header")
                page, refers = head["warc-page-id"], head.get("warc-refers-to-page")
                rows.append((int(page) if page else None, head["warc-target-uri"], head["warc-type"], n, sha, int(refers) if refers else None, payload if payloads and not revisit else None))
                held += len(payload) if payloads else 0
                if held > 1 << 24:
                    yield _rows(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _rows(rows, schema)

    return spots.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, sha1 and refers_to of each page.

    Of pages with equal payloads of at least least_bytes bytes, that with the largest page_id is the response. Only
    payloads that occur twice are joined, on their digest, one row each; a hot one is split by the adaptive skew join.
    Null html: an empty payload. Pages without id never are a response for others, nor revisits.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("sha1", F.sha1("payload"))
    again = rows.where((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("sha1").agg(
        F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = rows.join(again, "sha1", "left")
    return out.select("page_id", "url", "payload", "sha1", F.when(F.col("page_id") < F.col("response"), F.col("response")).alias("refers_to"))


def pack_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) to archives in folder; returns the table of archives."""
    return write_archives(with_revisits(pages), folder)


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "wacz")
    archives = pack_pages(table(spark, sf_dir, "pages"), folder)
    spots = list_records(archives, folder)
    return read_records(spots, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), r AS (SELECT html, max(page_id) AS response FROM p GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, %s AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < response THEN response END AS refers_to
FROM p JOIN r USING (html)
""" % (
    "(SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(('0b' || substr(bits, 5 * i + 1, 5))::INTEGER AS INTEGER), 1), '' ORDER BY i)"
    " FROM range(32) t(i), (SELECT string_agg(lpad(bin(('0x' || substr(sha1(p.html), 2 * j + 1, 2))::INTEGER), 8, '0'), '' ORDER BY j) AS bits FROM range(20) u(j)))"
)
