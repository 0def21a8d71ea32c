"""Operator 6: WARC records in ZIP-packaged archives.

Each task writes archives: a ZIP file with the stored (not compressed) members

    archive/data.warc.gz    a gzip member for each record, so each can be read by itself
    indexes/index.jsonl     a line for each record: page_id, offset, length
    datapackage.json        the members' names and the number of records

The reader finds the end record, the ZIP64 end record and the central directory by range reads from
the file's end, then the stored members' places, and reads index and records in ranges, never the
whole archive. Records of equal payloads are one response and revisits of it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm.shared import open_fs, partitions, put_file, shared_folder, written

DATA, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.jsonl", "datapackage.json"
MANIFEST = "archive string, n_records long, n_bytes long"
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, is_revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has no payload, only the length and digest of the one it stands for."""
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n"))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if is_revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if is_revisit else payload)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    body = rest[: int(fields["content-length"])]
    if len(body) != int(fields["content-length"]) or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut off")
    return fields, body.partition(b"\r\n\r\n")[2]


def gz(raw: bytes, level: int = 4) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def zip_chunks(members: list[tuple[str, list[bytes]]], zip64: bool | None = None) -> Iterator[bytes]:
    """A ZIP file of stored members. ZIP64 fields are written where sizes or offsets need them, or always if ``zip64``."""
    at, central = 0, []
    for name, chunks in members:
        crc, size = 0, 0
        for c in chunks:
            crc, size = zlib.crc32(c, crc), size + len(c)
        big = zip64 or max(size, at) >= 0xFFFFFFFF
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        shown = 0xFFFFFFFF if big else size
        local = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if big else 20, 0x800, 0, 0, 33, crc, shown, shown, len(name), len(extra)) + name.encode() + extra
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
        central.append(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if big else 20, 0x800, 0, 0, 33, crc, shown, shown, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if big else at) + name.encode() + extra)
        yield local
        yield from chunks
        at += len(local) + size
    directory = b"".join(central)
    big = zip64 or at + len(directory) >= 0xFFFFFFFF
    yield directory
    if big:
        yield struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, len(central), len(central), len(directory), at)
        yield struct.pack("<IIQI", 0x07064B50, 0, at + len(directory), 1)
    yield struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, len(central), len(central), 0xFFFFFFFF if big else len(directory), 0xFFFFFFFF if big else at, 0)


def zip_members(read: Callable[[int, int], bytes], size: int) -> dict[str, tuple[int, int]]:
    """Name -> (place of the data, length) of the stored members. ``read(at, n)`` reads a range of the file of ``size`` bytes."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    k = tail.rfind(b"PK\x05\x06")
    if k < 0:
        raise ValueError("no end record: not a ZIP file")
    _, _, _, _, n, length, at, _ = struct.unpack_from("<IHHHHIIH", tail, k)
    if 0xFFFFFFFF in (length, at) or n == 0xFFFF:
        signature, _, place, _ = struct.unpack("<IIQI", read(tail_at + k - 20, 20))
        if signature != 0x07064B50:
            raise ValueError("no ZIP64 locator")
        signature, *_, n, length, at = struct.unpack("<IQHHIIQQQQ", read(place, 56))
        if signature != 0x06064B50:
            raise ValueError("no ZIP64 end record")
    directory, p, out = read(at, length), 0, {}
    for _ in range(n):
        signature, _, _, _, method, _, _, _, packed, plain, n_name, n_extra, n_comment, _, _, _, local = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, p)
        if signature != 0x02014B50:
            raise ValueError("the central directory is damaged")
        name = directory[p + 46 : p + 46 + n_name].decode()
        extra, e = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n_field = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # only the fields that did not fit, in this order
                f = e + 4
                if plain == 0xFFFFFFFF:
                    (plain,), f = struct.unpack_from("<Q", extra, f), f + 8
                if packed == 0xFFFFFFFF:
                    (packed,), f = struct.unpack_from("<Q", extra, f), f + 8
                if local == 0xFFFFFFFF:
                    (local,) = struct.unpack_from("<Q", extra, f)
            e += 4 + n_field
        if method == 0:
            n_local_name, n_local_extra = struct.unpack("<HH", read(local + 26, 4))
            out[name] = (local + 30 + n_local_name + n_local_extra, packed)
        p += 46 + n_name + n_extra + n_comment
    return out


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); returns the manifest: archive (URI), n_records, n_bytes.

    Of records with equal payloads of at least ``min_bytes``, the one with the smallest page_id is the
    response and the others revisit it. Null html is an empty payload; a null page_id takes part like a
    greatest id; rows with the smallest page_id repeated are all responses; other columns are left out."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    # Only ids and digests take part in finding revisits; payloads are dealt once, by page_id and digest.
    ids = rows.where(F.length("payload") >= min_bytes).select("page_id", "sha1")
    first = ids.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = ids.join(first, "sha1").where("page_id IS DISTINCT FROM refers_to").select(F.col("page_id").alias("again"), F.col("sha1").alias("again_sha1"), "refers_to").distinct()
    # By id and digest: rows that share an id (or have none) may have different payloads.
    same = F.col("page_id").eqNullSafe(F.col("again")) & (F.col("sha1") == F.col("again_sha1"))
    some = rows.join(revisits, same, "left").select("page_id", "url", "payload", "sha1", "refers_to", F.col("again_sha1").isNotNull().alias("is_revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        data: list[bytes] = []
        lines: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal data, lines, size, place
            uri = f"{folder}/part-{part:06d}-{place:06d}.wacz"
            about = json.dumps({"records": len(data), "data": DATA, "index": INDEX}).encode()
            n = put_file(uri, zip_chunks([(DATA, data), (INDEX, [b"".join(lines)]), (ABOUT, [about])]))
            row = pa.RecordBatch.from_pydict({"archive": [uri], "n_records": [len(data)], "n_bytes": [n]})
            data, lines, size, place = [], [], 0, place + 1
            return row

        for batch in batches:
            for row in batch.to_pylist():
                data.append(gz(record(row["page_id"], row["url"], row["payload"], digest32(row["sha1"]), row["refers_to"], row["is_revisit"])))
                lines.append(json.dumps({"page_id": row["page_id"], "offset": size, "length": len(data[-1])}).encode() + b"\n")
                size += len(data[-1])
                if size >= archive_bytes:
                    yield flush()
        if data:
            yield flush()

    return written(some.mapInArrow(run, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, range_bytes: int = 4 << 20) -> DataFrame:
    """All records of the manifest's archives: page_id, url, record_type, refers_to, payload_bytes and
    payload_digest (of the full payload), payload (null for revisits). A response whose payload does not
    have its digest is an error."""

    def page_of(urn: str | None):
        value = urn[len("<urn:page:") : -1] if urn else "None"
        return None if value == "None" else int(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, path = open_fs(uri)
                with files.open_input_file(path) as f:

                    def read(at: int, n: int) -> bytes:
                        f.seek(at)
                        return f.read(n)

                    members = zip_members(read, f.size())
                    index = [json.loads(x) for x in read(*members[INDEX]).splitlines()]
                    place, _ = members[DATA]
                    k = 0
                    while k < len(index):
                        end, begin = k, index[k]["offset"]
                        while end < len(index) and (end == k or index[end]["offset"] + index[end]["length"] - begin <= range_bytes):
                            end += 1
                        raw = read(place + begin, index[end - 1]["offset"] + index[end - 1]["length"] - begin)
                        rows = []
                        for entry in index[k:end]:
                            at = entry["offset"] - begin
                            fields, payload = parse_record(zlib.decompress(raw[at : at + entry["length"]], 31))
                            digest = fields["warc-payload-digest"].removeprefix("sha1:")
                            revisit = fields["warc-type"] == "revisit"
                            if not revisit and digest32(hashlib.sha1(payload).digest()) != digest:
                                raise ValueError(f"{uri}: the payload of {fields['warc-record-id']} does not have its digest")
                            url = fields.get("warc-target-uri")
                            rows.append({"page_id": page_of(fields["warc-record-id"]), "url": url and _unescaped(url), "record_type": fields["warc-type"], "refers_to": page_of(fields.get("warc-refers-to")), "payload_bytes": int(fields["x-payload-length"]), "payload_digest": digest, "payload": None if revisit else payload})
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        k = end

    return manifest.select("archive").repartition(partitions(manifest.sparkSession)).mapInArrow(run, READ)


def _unescaped(url: str) -> str:
    out, k = [], 0
    while k < len(url):
        if url[k] == "\\" and k + 1 < len(url):
            out.append({"n": "\n", "r": "\r"}.get(url[k + 1], url[k + 1]))
            k += 1
        else:
            out.append(url[k])
        k += 1
    return "".join(out)
