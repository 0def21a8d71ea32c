"""Operator 5: removal of repeated passages by Rabin-Karp window hashes.

1. The documents are written as numbered files (units) in the shared folder. Every later pass reads
   them unit by unit and in order, so positions mean the same in each pass, whatever happened to
   executors between.
2. Every window of ``window`` words is hashed (Rabin-Karp over hashes of its words, modulo 2^64, then
   mixed). A chunk of some documents sends each distinct hash once, dealt by the hash's leading bits.
3. For each part of the hash range, hashes that came from two chunks or more are repeated; the
   answer to a chunk is a bit for each hash it sent. Hashes that a chunk has twice it knows itself.
4. Each unit's answers, one small file, are read with the unit; words that repeated windows cover
   merge into maximal intervals and are removed.

Hashes of a very frequent window are sent once for each chunk, so no part has more than one copy a
chunk. Two different windows are taken for one with a chance of about 2^-64 a pair.
"""

from __future__ import annotations

import functools
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from loomcast.llm.graph import group_bounds, in_groups
from loomcast.llm.shared import giving_back, open_fs, partitions, put_file, shared_folder, written

CHUNK_WORDS = 500_000
BYTES_AT_ONCE = 1 << 21
WORD_BASE = np.uint64(0x9E3779B97F4A7C15)
WINDOW_BASE = np.uint64(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
ANSWER = "<III"


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers (the finalizer of SplitMix64; fixed multipliers)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the word base and of its inverse modulo 2^64; some 32 MB, which tasks drop at their end."""
    inverse = np.uint64(pow(int(WORD_BASE), -1, 1 << 64))
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b)], dtype="u8") for b in (WORD_BASE, inverse))


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word of ``raw`` (bytes between ASCII white space), in order."""
    out = []
    at = 0
    while at < len(raw):
        end = min(at + BYTES_AT_ONCE, len(raw))
        if end < len(raw):  # cut at white space, if there is any
            gaps = np.flatnonzero(SPACE[np.frombuffer(raw, "u1", end - at, at)])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                after = np.flatnonzero(SPACE[np.frombuffer(raw, "u1", offset=end)])
                end = end + int(after[0]) if len(after) else len(raw)
        b = np.frombuffer(raw, "u1", end - at, at)
        edges = np.diff(np.r_[True, SPACE[b], True].astype("i1"))
        starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        up, down = powers(1 << max(21, (len(b)).bit_length()))
        sums = np.r_[np.uint64(0), np.cumsum((b.astype("u8") + np.uint64(1)) * up[: len(b)], dtype="u8")]
        h = (sums[ends] - sums[starts]) * down[starts]
        out.append(mix(h ^ mix((ends - starts).astype("u8"))))
        at = end
    return np.concatenate(out) if out else np.zeros(0, "u8")


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """The hash of each ``window`` consecutive words: sums of twice as many words until the window is full."""
    if len(words) < window:
        return np.zeros(0, "u8")
    n = len(words) - window + 1
    run, size, base = words, 1, WINDOW_BASE  # base is WINDOW_BASE ** size
    total, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if window & size:
                part = run[done : done + n]
                total = part if total is None else total * base + part
                done += size
            if size * 2 > window:
                return mix(total)
            run = run[:-size] * base + run[size:]
            size, base = size * 2, base * base


class Chunk:
    """Window hashes of some documents: ``unique`` (sorted), and for each window its place there."""

    def __init__(self, words: list[np.ndarray], window: int, buckets: int):
        found = [window_hashes(w, window) for w in words]
        self.sizes = [len(f) for f in found]
        self.unique, self.place, counts = np.unique(np.concatenate(found) if found else np.zeros(0, "u8"), return_inverse=True, return_counts=True)
        self.repeated = counts > 1
        shift = 64 - (buckets.bit_length() - 1)
        self.bounds = np.searchsorted(self.unique, np.arange(buckets, dtype="u8") << np.uint64(shift)) if buckets > 1 else np.zeros(1, "i8")
        self.bounds = np.r_[self.bounds, len(self.unique)]


def squeezed(h: np.ndarray) -> bytes:
    """Sorted hashes as the first one and 6-byte differences; in full where a difference is too large."""
    d = np.diff(h)
    if len(d) and d.max() >= 1 << 48:
        return b"\0" + h.tobytes()
    return b"\1" + h[:1].tobytes() + d.astype("<u8").view("u1").reshape(-1, 8)[:, :6].tobytes()


def unsqueezed(raw: bytes) -> np.ndarray:
    if raw[0] == 0:
        return np.frombuffer(raw, "<u8", offset=1)
    d = np.zeros(((len(raw) - 9) // 6, 8), "u1")
    d[:, :6] = np.frombuffer(raw, "u1", offset=9).reshape(-1, 6)
    return np.cumsum(np.r_[np.frombuffer(raw, "<u8", 1, 1), d.view("<u8").ravel()], dtype="u8")


def unit_chunks(uri: str, columns: list[str] | None, text: str) -> Iterator[tuple[list[pa.RecordBatch], list[bytes], list[np.ndarray]]]:
    """(batches, texts, word hashes) of the unit, chunk by chunk. Depends on the unit's bytes alone."""
    files, path = open_fs(uri)
    with files.open_input_file(path) as f:
        batches, texts, words, n = [], [], [], 0
        for batch in pq.ParquetFile(f).iter_batches(batch_size=256, columns=columns):
            for raw in batch[text].to_pylist():
                texts.append((raw or "").encode())
                words.append(word_hashes(texts[-1]))
                n += len(words[-1])
            batches.append(batch)
            if n >= CHUNK_WORDS:
                yield batches, texts, words
                batches, texts, words, n = [], [], [], 0
        if batches:
            yield batches, texts, words


def units_of(spark: SparkSession, folder: str) -> DataFrame:
    """unit (a number), uri of the files that Spark wrote in ``folder``."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select("path")
    named = rows.select(F.regexp_extract("path", r"[^/]+$", 0).alias("file"))
    # The part's number is the task's; a task that writes several files numbers them after a c.
    unit = F.regexp_extract("file", r"^part-(\d+)-", 1).cast("long") * 100_000 + F.regexp_extract("file", r"c(\d+)\.", 1).cast("long")
    return named.select(unit.alias("unit"), F.concat(F.lit(folder.rstrip("/") + "/"), "file").alias("uri")).repartition(partitions(spark), "unit")


def remove_repeats(docs: DataFrame, window: int = 35, text_column: str = "text", buckets: int | None = None) -> DataFrame:
    """``docs`` with n_words, n_removed, removed (array of [start, end) word intervals) and kept (kept words
    joined by one space).

    A word is removed if a window of ``window`` words that covers it also starts anywhere else, in the
    same document or another one. Null texts have no words; texts of fewer words than the window lose
    none; of repeated rows all copies lose the window. Other columns stay, columns named like the new
    ones are replaced. ``buckets``, a power of two, is the number of parts of the hash range: by default
    16 for each shuffle partition, 1024 at least."""
    spark = docs.sparkSession
    new = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("removed", ArrayType(ArrayType(LongType()))), StructField("kept", StringType())]
    taken = {f.name for f in new}
    kept_columns = [c for c in docs.columns if c.lower() not in taken]
    plain = docs.select(F.col(text_column).alias("given"), *[F.col(f"`{c}`") for c in kept_columns]).toDF("given", *[f"c{k}" for k in range(len(kept_columns))])
    at = kept_columns.index(text_column) if text_column in kept_columns else None
    if at is not None:  # the text is written once
        plain = plain.drop("given")
    text = "given" if at is None else f"c{at}"
    if buckets is None:
        buckets = 1 << max(10, (16 * partitions(spark) - 1).bit_length())
    folder = shared_folder(spark, "units")
    plain.write.option("compression", "snappy").parquet(folder)
    answers_folder = shared_folder(spark, "answers")
    units = units_of(spark, folder) if spark.read.schema(plain.schema).parquet(folder).limit(1).count() else spark.createDataFrame([], "unit long, uri string")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, uri in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for number, (_, _, words) in enumerate(unit_chunks(uri, [text], text)):
                    chunk = Chunk(words, window, buckets)
                    some = np.flatnonzero(np.diff(chunk.bounds))
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(np.full(len(some), unit), pa.int64()), pa.array(np.full(len(some), number), pa.int64()), pa.array([squeezed(chunk.unique[a:b]) for a, b in zip(chunk.bounds[some], chunk.bounds[some + 1], strict=True)], pa.binary())], names=["bucket", "unit", "chunk", "hashes"])
        powers.cache_clear()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_groups(batches, 1):
            bounds = group_bounds(table, 1)
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b - a < 2:
                    continue
                group = table.slice(a, b - a)
                sent = [unsqueezed(x) for x in group["hashes"].to_pylist()]
                every = np.concatenate(sent)
                order = np.argsort(every, kind="stable")
                equal = every[order[1:]] == every[order[:-1]]
                repeated = np.zeros(len(every), bool)
                repeated[order[1:][equal]] = True
                repeated[order[:-1][equal]] = True
                ends = np.cumsum([len(s) for s in sent])
                parts = np.split(repeated, ends[:-1])
                some = [k for k, p in enumerate(parts) if p.any()]
                if some:
                    g = group.select(["unit", "chunk", "bucket"]).take(some)
                    yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in g.columns), pa.array([np.packbits(parts[k]).tobytes() for k in some], pa.binary())], names=["unit", "chunk", "bucket", "bits"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_groups(batches, 1):
            bounds = group_bounds(table, 1)
            for a, b in zip(bounds, bounds[1:], strict=False):
                group = table.slice(a, b - a)
                unit = group["unit"][0].as_py()
                rows = zip(*(group[c].to_pylist() for c in ("chunk", "bucket", "bits")), strict=True)
                put_file(f"{answers_folder}/{unit}", (struct.pack(ANSWER, c, k, len(bits)) + bits for c, k, bits in rows))
                yield pa.RecordBatch.from_pydict({"unit": [unit]})

    n = partitions(spark)
    hashes = units.mapInArrow(giving_back(send), "bucket long, unit long, chunk long, hashes binary")
    answers = hashes.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(giving_back(compare), "unit long, chunk long, bucket long, bits binary")
    answered = written(answers.repartition(n, "unit").sortWithinPartitions("unit", "chunk").mapInArrow(store, "unit long"), "answered")

    fields = [*plain.schema.fields, *new]
    arrow = to_arrow_schema(StructType(fields))
    names = [f.name for f in plain.schema.fields]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, unit in zip(*(batch[c].to_pylist() for c in ("uri", "answer")), strict=True):
                bits: dict[int, list[tuple[int, bytes]]] = {}
                if unit is not None:
                    files, path = open_fs(f"{answers_folder}/{unit}")
                    with files.open_input_file(path) as f:
                        raw, p = f.read(), 0
                    while p < len(raw):
                        c, k, size = struct.unpack_from(ANSWER, raw, p)
                        p += struct.calcsize(ANSWER)
                        bits.setdefault(c, []).append((k, raw[p : p + size]))
                        p += size
                for number, (parts, texts, words) in enumerate(unit_chunks(uri, names, text)):
                    chunk = Chunk(words, window, buckets)
                    for k, b in bits.get(number, ()):
                        some = chunk.repeated[chunk.bounds[k] : chunk.bounds[k + 1]]
                        some |= np.unpackbits(np.frombuffer(b, "u1"), count=len(some)).astype(bool)
                    rows, at = [], 0
                    repeated = chunk.repeated[chunk.place]
                    for raw, w, size in zip(texts, words, chunk.sizes, strict=True):
                        starts = np.flatnonzero(repeated[at : at + size])
                        at += size
                        rows.append(_kept(raw, len(w), starts, window))
                    done = 0
                    for part in parts:
                        some = rows[done : done + len(part)]
                        done += len(part)
                        columns = [*part.columns, *(pa.array(c, arrow.field(len(names) + k).type) for k, c in enumerate(zip(*some, strict=True)))]
                        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        powers.cache_clear()

    with_answers = units.join(answered.select(F.col("unit").alias("answer")), F.col("unit") == F.col("answer"), "left").select("uri", "answer").repartition(n, "uri")
    out = with_answers.mapInArrow(giving_back(remove), StructType(fields))
    if at is None:
        out = out.drop("given")
    return out.toDF(*kept_columns, *[f.name for f in new])


def _kept(raw: bytes, n_words: int, starts: np.ndarray, window: int) -> tuple[int, int, list[list[int]], str]:
    """n_words, n_removed, maximal intervals and kept words of a document whose windows at ``starts`` are repeated."""
    words = raw.split()
    if not len(starts):
        return n_words, 0, [], b" ".join(words).decode()
    gaps = np.flatnonzero(np.diff(starts) > window)
    first, last = starts[np.r_[0, gaps + 1]], starts[np.r_[gaps, len(starts) - 1]] + window
    keep = np.ones(n_words, bool)
    for a, b in zip(first, last, strict=True):
        keep[a:b] = False
    return n_words, int(n_words - keep.sum()), np.stack((first, last), 1).tolist(), b" ".join(itertools.compress(words, keep)).decode()
