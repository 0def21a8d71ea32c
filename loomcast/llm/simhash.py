"""Operator 7: SimHash near-duplicates by tiled exact comparison.

Fingerprints are majorities of the bits of the shingles' XXH64 hashes. Equal fingerprints are one
row. All others are compared exactly, in tiles, by numpy exclusive-or and bit counts; blocks of a
tile are in order of their population counts, and pairs of blocks (and of tiles) whose counts differ
by more than the radius are skipped.

Which tiles meet: two fingerprints within radius r agree in at least one of r + 1 parts of their
bits, so for short radii each fingerprint is in a group for each part and its value, and groups are
tiles (``near_fingerprints``). No pair is lost by that. Groups over TILE rows are cut into tiles of
one population count each, and the pairs of tiles are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm.graph import BLOCK, TILE, TileReader, components, forest, group_bounds, in_groups, small_and_tiled, tile_pairs, with_classes
from loomcast.llm.shared import append_column, partitions, text_of, written

SEED = 42


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of hashes (the finalizer of SplitMix64; fixed multipliers)."""
    h = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str, width: int, at_once: int = 100_000) -> Iterator[np.ndarray]:
    """XXH64 hashes of the shingles of ``width`` words, repeats included; fewer words are one shingle, no word gives none."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not words:
        return
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        yield np.array([digest(b" ".join(words), SEED)], "u8")
        return
    for at in range(0, len(words) - width + 1, at_once):
        some = words[at : at + at_once + width - 1]
        line = b" ".join(some)
        ends = np.cumsum([len(w) + 1 for w in some])
        starts = np.r_[0, ends[:-1]][: len(some) - width + 1].tolist()
        yield np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), "u8", len(starts))


def fingerprint(text: str, width: int = 3, parts: int = 1) -> tuple[np.ndarray, int]:
    """``parts`` 64-bit words (the first is the majority of the hashes themselves, the others of further
    hashes), and the number of shingles. A bit is 1 if set in over half of the hashes."""
    counts, n = np.zeros((parts, 64), "i8"), 0
    for h in shingle_hashes(text, width):
        n += len(h)
        for k in range(parts):
            words = mixed(h, k) if k else h
            counts[k] += np.unpackbits(words.astype(">u8").view("u1")).reshape(-1, 64).sum(0, dtype="i8")
    return np.packbits(2 * counts > n, axis=1).view(">u8").ravel().astype("u8"), n


def fingerprints(docs: DataFrame, width: int = 3, text_column: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` with ``out``, the 64-bit fingerprint as a signed long. Null texts and texts without a word have 0."""
    return append_column(docs, text_of(text_column), lambda texts: pa.array(np.array([fingerprint(t, width)[0][0] for t in texts], "u8").view("i8")), out, "long")


def near_in_block(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j) of the rows of ``a`` and ``b`` (rows x words) within the radius. Further words are
    only looked at where the first one is near enough to be likely."""
    bits = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    i, j = np.nonzero(bits <= radius)
    if a.shape[1] > 1 and len(i):
        near = np.bitwise_count(a[i] ^ b[j]).sum(1, dtype="i8") <= radius
        i, j = i[near], j[near]
    return i, j


def near_pairs(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of near rows, block by block; with ``b`` None, pairs within ``a`` once each."""
    order = [np.argsort(np.bitwise_count(x).sum(1), kind="stable") for x in ((a, a) if b is None else (a, b))]
    left, right = a[order[0]], (a if b is None else b)[order[1]]
    pops = [np.bitwise_count(x).sum(1, dtype="i8") for x in (left, right)]
    for x in range(0, len(left), BLOCK):
        for y in range(x if b is None else 0, len(right), BLOCK):
            if pops[1][y] - pops[0][min(x + BLOCK, len(left)) - 1] > radius:
                break
            if pops[0][x] - pops[1][min(y + BLOCK, len(right)) - 1] > radius:
                continue
            i, j = near_in_block(left[x : x + BLOCK], right[y : y + BLOCK], radius)
            if b is None and x == y:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield order[0][i + x], order[1][j + y]


def tile_forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the near pairs of two tiles join, at most one for each row: indexes into both, one after the other."""
    n = len(a) + (0 if b is None else len(b))
    label = np.arange(n)
    for i, j in near_pairs(a, b, radius):
        if b is not None:
            j = j + len(a)
        if (label[i] != label[j]).any():
            label = forest(n, np.r_[np.arange(n), i], np.r_[label, j])
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def _edges(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(nodes[i], pa.int64()), pa.array(nodes[j], pa.int64())], names=["a", "b"])


def near_fingerprints(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a long, b long) that connect all distinct fingerprints of ``fps`` (fp long) within ``radius`` bits."""
    parts = radius + 1
    bounds = [64 * k // parts for k in range(parts + 1)]
    values = [F.shiftrightunsigned(F.shiftleft("fp", 64 - hi), 64 - hi + lo) for lo, hi in zip(bounds, bounds[1:], strict=False)]
    rows = fps.select("fp", F.posexplode(F.array(*values)).alias("part", "value")).withColumn("pop", F.bit_count("fp").cast("long"))
    small, cut = small_and_tiled(rows, ["part", "value"], TILE, "fp")

    def in_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_groups(batches, 2):
            fp = table["fp"].to_numpy()
            unsigned, pop = fp.view("u8"), table["pop"].to_numpy()
            bounds = group_bounds(table, 2)
            sizes = np.diff(bounds)
            # Groups of up to 32 rows all at once, each row against the next, the next but one, ...
            group = np.repeat(np.arange(len(sizes)), sizes)
            few = np.flatnonzero((sizes <= 32)[group])
            for step in range(1, min(32, sizes.max())):
                i = few[few + step < len(fp)]
                i = i[(group[i] == group[i + step]) & (pop[i + step] - pop[i] <= radius)]  # rows of a group are in order of pop
                i = i[np.bitwise_count(unsigned[i] ^ unsigned[i + step]) <= radius]
                if len(i):
                    yield _edges(fp, i, i + step)
            for k in np.flatnonzero(sizes > 32):
                some = slice(bounds[k], bounds[k + 1])
                i, j = tile_forest(unsigned[some, None], None, radius)
                if len(i):
                    yield _edges(fp[some], i, j)

    def in_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = TileReader()
        for batch in batches:
            for left, right in zip(batch["left"].to_pylist(), batch["right"].to_pylist(), strict=True):
                a, b = (read(uri)["fp"].to_numpy() for uri in (left, right))
                i, j = tile_forest(a.view("u8")[:, None], None if left == right else b.view("u8")[:, None], radius)
                if len(i):
                    yield _edges(np.r_[a, b], i, j)

    # Popcounts within the radius only: a tile holds one population count.
    far = tile_pairs(cut, ["part", "value"], ["fp"], near=("pop", radius)).mapInArrow(in_tiles, "a long, b long")
    small = small.sortWithinPartitions("part", "value", "pop")
    return small.select("part", "value", "fp", "pop").mapInArrow(in_small, "a long, b long").union(far)


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links lead to) of every row of ``docs``.

    Documents link if their fingerprints differ in at most ``radius`` bits; null and wordless texts have
    fingerprint 0 and link like others. Null ids are never a component's id unless it has no other."""
    rows = written(fingerprints(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), width).drop("text"), "fingerprints")
    reps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = components(near_fingerprints(reps.select("fp"), radius))
    joined = roots.join(reps, F.col("node") == F.col("fp")).select("node", "root", "rep")
    least = joined.groupBy(F.col("root").alias("r")).agg(F.min("rep").alias("least"))
    linked = joined.join(least, F.col("root") == F.col("r")).select("node", "least")
    classes = reps.join(linked, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("least", "rep").alias("component_id"), "n")
    return with_classes(rows, written(classes, "fingerprint-classes"), ["fp"]).select("doc_id", "fp", "component_id")
