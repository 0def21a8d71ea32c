"""Operator 10: length-delimited binary records of token ids.

Documents are dealt into ranges of their id, each range is sorted, and each task writes shards:

    shard:  a record is  length (u64) | masked crc32c of the length (u32) | data | masked crc32c of the data (u32)
    data:   flags (u8: 1 = has an id) | doc_id (i64) | width of an id (u8) | the ids, little-endian
    index:  beside each shard, one i64 offset for each record, and the shard's length at the end

so a reader can take any record of any shard by one seek. A shard appears under its final name only
when it is whole; a task that runs twice writes the same bytes under the same name.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomcast.llm.shared import open_fs, partitions, put_file, shared_folder, text_of, written

MANIFEST = "shard string, place long, part long, n_records long, n_ids long, n_bytes long, first_id long"
HEADER = "<BqB"
HEADER_SIZE = struct.calcsize(HEADER)


def _crc_table() -> np.ndarray:
    """Slicing tables of CRC-32C (reflected polynomial 0x82F63B78, a fixed value)."""
    first = np.arange(256, dtype="u4")
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ np.uint32(0x82F63B78), first >> 1).astype("u4")
    return first


CRC_TABLE = _crc_table()


def _zeros_operator(n_bytes: int) -> np.ndarray:
    """The images of the 32 unit states after ``n_bytes`` zero bytes."""
    state = np.uint32(1) << np.arange(32, dtype="u4")
    out = np.eye(32, dtype=bool)
    one = state.copy()
    one = (one >> 8) ^ CRC_TABLE[one & 255]

    def compose(f: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Images of f after g."""
        bits = (g[:, None] >> np.arange(32, dtype="u4")) & 1
        return np.bitwise_xor.reduce(np.where(bits.astype(bool), f[None, :], np.uint32(0)), axis=1).astype("u4")

    out = state
    while n_bytes:
        if n_bytes & 1:
            out = compose(one, out)
        one = compose(one, one)
        n_bytes >>= 1
    return out


LANE = 64


def _lookup(op: np.ndarray) -> np.ndarray:
    """An operator as four tables, one for each byte of the state."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return np.stack([np.bitwise_xor.reduce(np.where(bits.astype(bool), op[None, 8 * k : 8 * k + 8], np.uint32(0)), axis=1) for k in range(4)]).astype("u4")


#: The operators of LANE, 2 LANE, 4 LANE, ... zero bytes.
LANE_TABLES = [_lookup(_zeros_operator(LANE << k)) for k in range(34)]


#: The states after two zero bytes, for the low 16 bits of the state before.
CRC_PAIR = (CRC_TABLE[:, None] >> np.uint32(8) ^ CRC_TABLE[(CRC_TABLE[:, None] ^ np.arange(256, dtype="u4")[None]) & 255]).T.ravel().astype("u4")


def crc32c_lengths(lengths: np.ndarray) -> np.ndarray:
    """The CRC-32C of each 64-bit number's eight bytes, little-endian."""
    state = np.full(len(lengths), 0xFFFFFFFF, "u4")
    for pair in lengths.astype("<u8").view("<u2").reshape(-1, 4).T:
        state = (state >> np.uint32(16)) ^ CRC_PAIR[(state ^ pair) & np.uint32(0xFFFF)]
    return state ^ np.uint32(0xFFFFFFFF)


def crc32c_many(data: list[bytes]) -> np.ndarray:
    """The CRC-32C of each byte string. All are cut into lanes of LANE bytes that run side by side in
    numpy, two bytes a step; each lane's state is then moved over the lanes behind it, and a string's
    lanes are summed. Zero bytes in front of a string change nothing once its usual initial state is
    moved into its first four bytes; strings under four bytes go byte by byte."""
    out = np.zeros(len(data), "u4")
    for k, d in enumerate(data):
        if len(d) < 4:
            crc = 0xFFFFFFFF
            for b in d:
                crc = (crc >> 8) ^ int(CRC_TABLE[(crc ^ b) & 255])
            out[k] = crc ^ 0xFFFFFFFF
    long = [k for k, d in enumerate(data) if len(d) >= 4]
    if not long:
        return out
    sizes = np.array([len(data[k]) for k in long])
    lanes_of = -(-sizes // LANE)
    first = np.cumsum(lanes_of) - lanes_of
    fronts = (lanes_of * LANE - sizes).tolist()
    work = bytearray(b"".join([x for k, n in zip(long, fronts, strict=True) for x in (bytes(n), data[k])]))
    lanes = np.frombuffer(work, "u1")
    heads = (first + lanes_of) * LANE - sizes
    for k in range(4):
        lanes[heads + k] ^= 255
    pairs = np.ascontiguousarray(lanes.view("<u2").reshape(-1, LANE // 2).T)
    state = np.zeros(pairs.shape[1], "u4")
    for pair in pairs:
        state = (state >> np.uint32(16)) ^ CRC_PAIR[(state ^ pair) & np.uint32(0xFFFF)]
    behind = np.repeat(first + lanes_of, lanes_of) - 1 - np.arange(len(state))
    for level in range(int(behind.max()).bit_length()):
        at = np.flatnonzero((behind >> level) & 1)
        s, t = state[at], LANE_TABLES[level]
        state[at] = t[0][s & 255] ^ t[1][(s >> 8) & 255] ^ t[2][(s >> 16) & 255] ^ t[3][s >> 24]
    out[long] = np.bitwise_xor.reduceat(state, first) ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    """The usual mask of checksums that are stored beside the data they cover."""
    crc = np.asarray(crc, "u4")
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def framed(data: list[bytes]) -> list[bytes]:
    """Each byte string as a record."""
    lengths = np.array([len(d) for d in data], "<u8")
    sums = masked(crc32c_lengths(lengths)).tolist(), masked(crc32c_many(data)).tolist()
    front, back = struct.Struct("<QI").pack, struct.Struct("<I").pack
    return [b"".join((front(n, a), d, back(b))) for n, d, a, b in zip(lengths.tolist(), data, *sums, strict=True)]


def unframed(raw: bytes) -> list[bytes]:
    """The data of the records that follow each other in ``raw``; ValueError if a checksum is wrong or a record is cut off."""
    lengths, data, sums, at = [], [], [], 0
    front, back = struct.Struct("<QI"), struct.Struct("<I")
    while at < len(raw):
        n, a = front.unpack_from(raw, at) if at + 12 <= len(raw) else (0, 0)
        if at + 16 + n > len(raw):
            raise ValueError(f"the record at {at} is cut off")
        lengths.append(n)
        data.append(raw[at + 12 : at + 12 + n])
        sums.append((a, *back.unpack_from(raw, at + 12 + n)))
        at += 16 + n
    stored = np.array(sums, "u4").reshape(-1, 2)
    if (masked(crc32c_lengths(np.array(lengths, "<u8"))) != stored[:, 0]).any() or (masked(crc32c_many(data)) != stored[:, 1]).any():
        raise ValueError("a record's checksum is wrong")
    return data


def _in_parts(batch: pa.RecordBatch, rows: int = 2048, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of up to ``rows`` rows and about ``size`` bytes of text."""
    ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy())
    at = 0
    while at < len(batch):
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, size + (ends[at - 1] if at else 0)))))
        yield batch.slice(at, end - at)
        at = end


def write_records(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, shard_bytes: int = 64 << 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write all documents' ids, each with ``end_id`` at its end, in ascending order of id; returns the
    manifest, one row for each shard: shard (URI), place (of the shard in the order), part, n_records,
    n_ids, n_bytes, first_id (ids in all shards before it).

    Null or empty texts have the end id alone; null ids come first; of rows with equal ids the order
    is that of the texts' hashes; other columns are left out; an empty table gives no shard."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "records")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomcast.llm.tokenizers_lib import library_encoder

        encoder = library_encoder(tokenizer)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        shard: list[bytes] = []
        offsets, n_ids, place = [0], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, offsets, n_ids, place
            uri = f"{folder}/part-{part:06d}-{place:06d}.rec"
            put_file(f"{uri}.idx", [np.array(offsets, "<i8").tobytes()])
            put_file(uri, shard)
            row = pa.RecordBatch.from_pydict({"shard": [uri], "place": [place], "part": [part], "n_records": [len(shard)], "n_ids": [n_ids], "n_bytes": [offsets[-1]], "first_id": [0]})
            shard, offsets, n_ids, place = [], [0], 0, place + 1
            return row

        for batch in batches:
            for some in _in_parts(batch):
                ids = [np.frombuffer(i + end, "<u4") for i in encoder.encode(some["text"].to_pylist())]
                data = [struct.pack(HEADER, doc is not None, doc or 0, width) + a.astype(f"<u{width}").tobytes() for doc, a in zip(some["doc_id"].to_pylist(), ids, strict=True)]
                for record, a in zip(framed(data), ids, strict=True):
                    shard.append(record)
                    offsets.append(offsets[-1] + len(record))
                    n_ids += len(a)
                    if offsets[-1] >= shard_bytes:
                        yield flush()
        if shard:
            yield flush()

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    manifest = written(rows.select("doc_id", "text").mapInArrow(run, MANIFEST), "records-manifest")
    # One row for each shard of up to shard_bytes: a running sum over them is small whatever the table.
    before = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_records(manifest: DataFrame, records_at_once: int = 2000) -> DataFrame:
    """doc_id, start (ids of all records before it), ids (little-endian unsigned 32-bit) of every record
    in the manifest's shards, read by the index in ranges of ``records_at_once``, checksums verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, path = open_fs(row["shard"])
                with files.open_input_file(f"{path}.idx") as f:
                    offsets = np.frombuffer(f.read(), "<i8")
                start = row["first_id"]
                with files.open_input_file(path) as f:
                    for k in range(0, len(offsets) - 1, records_at_once):
                        end = min(k + records_at_once, len(offsets) - 1)
                        f.seek(int(offsets[k]))
                        docs, starts, found = [], [], []
                        for data in unframed(f.read(int(offsets[end] - offsets[k]))):
                            doc, ids = _parsed(data)
                            docs.append(doc)
                            starts.append(start)
                            found.append(ids.astype("<u4").tobytes())
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "start", "ids"])

    spark = manifest.sparkSession
    return manifest.select("shard", "first_id").repartition(partitions(spark)).mapInArrow(run, "doc_id long, start long, ids binary")


def read_shuffled(manifest: DataFrame, seed: int = 0, records_at_once: int = 64) -> DataFrame:
    """shard, record (its number there), doc_id, ids of every record, in an order that ``seed`` alone decides
    within a shard: each record is sought by its offset in the index, and its checksums are verified. Shards
    are dealt out by a hash with the seed. An empty manifest gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch["shard"].to_pylist():
                files, path = open_fs(uri)
                with files.open_input_file(f"{path}.idx") as f:
                    offsets = np.frombuffer(f.read(), "<i8")
                order = np.random.default_rng((seed, *path.rpartition("/")[2].encode())).permutation(len(offsets) - 1)
                with files.open_input_file(path) as f:
                    for k in range(0, len(order), records_at_once):
                        raw = []
                        for record in order[k : k + records_at_once].tolist():
                            f.seek(int(offsets[record]))
                            raw.append(f.read(int(offsets[record + 1] - offsets[record])))
                        found = [_parsed(data) for data in unframed(b"".join(raw))]
                        some = order[k : k + records_at_once]
                        yield pa.RecordBatch.from_arrays([pa.array([uri] * len(some)), pa.array(some, pa.int64()), pa.array([d for d, _ in found], pa.int64()), pa.array([i.astype("<u4").tobytes() for _, i in found], pa.binary())], names=["shard", "record", "doc_id", "ids"])

    dealt = manifest.select("shard").repartition(partitions(manifest.sparkSession), F.xxhash64("shard", F.lit(seed)))
    return dealt.mapInArrow(run, "shard string, record long, doc_id long, ids binary")


def _parsed(data: bytes) -> tuple[int | None, np.ndarray]:
    """The id and the token ids of a record's data."""
    has, doc, width = struct.unpack_from(HEADER, data)
    return doc if has else None, np.frombuffer(data, f"<u{width}", offset=HEADER_SIZE)
