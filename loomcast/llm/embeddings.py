"""Operator 2: embedding near-duplicates by cross-polytope hashing.

A vector is rotated by random signs and fast Hadamard transforms, three times over; the hash is the
largest coordinate and its sign. A table's bucket is the hashes of ``hashes`` rotations; probes are
the buckets where one of them is the second largest coordinate instead. Vectors are in the buckets of
all their probes, and those that meet in a bucket are compared in double precision. A pair that meets
in several buckets counts in the first of those that both are in, so links are counted once; only
counts and a forest of the links leave a bucket, never its pairs. Equal vectors are one class.
Buckets over TILE rows are cut into tiles, whose pairs are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm.graph import BLOCK, TILE, TileReader, components, forest, group_bounds, in_groups, small_and_tiled, tile_pairs, with_classes
from loomcast.llm.shared import written

FOUND = "node long, other long, weight long"


def hadamard(v: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = v.shape
    step = 1
    while step < d:
        v = v.reshape(n, -1, 2, step)
        v = np.concatenate((v[:, :, :1] + v[:, :, 1:], v[:, :, :1] - v[:, :, 1:]), axis=2)
        step *= 2
    return v.reshape(n, d) / np.sqrt(d)


def codes(v: np.ndarray, tables: int, hashes: int, seed: int) -> np.ndarray:
    """rows x tables x (1 + hashes): each table's own bucket and its probes."""
    n, d = v.shape
    size = 1 << max(d - 1, 0).bit_length()
    v = np.pad(v, ((0, 0), (0, size - d)))
    out = np.zeros((n, tables, 1 + hashes), "i8")
    for t in range(tables):
        choices = []
        for h in range(hashes):
            signs = np.random.default_rng((seed, t, h)).choice((-1.0, 1.0), (3, size))
            r = v
            for s in signs:
                r = hadamard(r * s)
            top = np.argsort(-np.abs(r), axis=1, kind="stable")[:, : min(2, size)]
            choices.append(2 * top + (np.take_along_axis(r, top, 1) > 0))
        for probe in range(1 + hashes):
            for h, c in enumerate(choices):
                out[:, t, probe] = out[:, t, probe] * 2 * size + c[:, -1 if probe == h + 1 else 0]
    return out


def links_of(va, vb, ca, cb, wa, wb, t: int, code: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes (i, j) of linked rows whose first common bucket is ``code`` of table ``t``, block by block."""
    same = vb is None
    if same:
        vb, cb = va, ca
    for x in range(0, len(va), BLOCK):
        for y in range(x if same else 0, len(vb), BLOCK):
            i, j = np.nonzero(va[x : x + BLOCK] @ vb[y : y + BLOCK].T >= threshold)
            if same and x == y:
                i, j = i[i < j], j[i < j]
            i, j = i + x, j + y
            for earlier in range(t + 1):
                if not len(i):
                    break
                p, q = ca[i, earlier], cb[j, earlier]
                meet = p[:, :, None] == q[:, None, :]
                if earlier == t:
                    meet &= p[:, :, None] < code
                first = ~meet.any((1, 2))
                i, j = i[first], j[first]
            if len(i):
                yield i, j


def near_vectors(classes: DataFrame, threshold: float, tables: int, hashes: int, seed: int) -> DataFrame:
    """For classes (node long, label string, dim int, vec binary of doubles, n long): rows (node, null, weight), whose sum is
    the number of vectors in linked classes, and rows (node, other, null), links that connect what links connect."""
    width = 1 + hashes

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 1024):
                part = batch.slice(k, 1024)
                label, dim, node, n, raw = (part[c].to_pylist() for c in ("label", "dim", "node", "n", "vec"))
                for d in sorted(set(dim)):
                    at = [x for x, y in enumerate(dim) if y == d]
                    v = np.frombuffer(b"".join(raw[x] for x in at)).reshape(-1, d)
                    c = codes(v / np.linalg.norm(v, axis=1, keepdims=True), tables, hashes, seed)
                    short = v.astype("f4")
                    exact = (short == v).all(1)  # single precision where it holds the same numbers
                    rows = [(label[x], d, t, int(c[k, t, p]), node[x], n[x], (short[k] if exact[k] else v[k]).tobytes(), c[k].tobytes()) for k, x in enumerate(at) for t in range(tables) for p in range(width)]
                    yield pa.RecordBatch.from_arrays([pa.array(y, t) for y, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["label", "dim", "t", "code", "node", "n", "vec", "codes"])

    keys = ["label", "dim", "t", "code"]
    rows = written(classes.mapInArrow(hashed, "label string, dim int, t int, code long, node long, n long, vec binary, codes binary"), "buckets")
    small, cut = small_and_tiled(rows, keys, TILE, "node")

    def arrays(node, n, vec, c, d: int):
        v = np.stack([np.frombuffer(x, "f4" if len(x) == 4 * d else "f8") for x in vec]).astype("f8")
        return np.array(node), np.array(n), v / np.linalg.norm(v, axis=1, keepdims=True), np.frombuffer(b"".join(c), "i8").reshape(-1, tables, width)

    def found(a, b, t: int, code: int) -> pa.RecordBatch | None:
        node = a[0] if b is None else np.r_[a[0], b[0]]
        weight, label = np.zeros(len(node), "i8"), np.arange(len(node))
        n = a[1] if b is None else np.r_[a[1], b[1]]
        for i, j in links_of(a[2], b and b[2], a[3], b and b[3], a[1], b and b[1], t, code, threshold):
            j = j if b is None else j + len(a[0])
            np.add.at(weight, i, n[j])
            np.add.at(weight, j, n[i])
            label = forest(len(node), np.r_[np.arange(len(node)), i], np.r_[label, j])
        some, moved = np.flatnonzero(weight), np.flatnonzero(label != np.arange(len(node)))
        if not len(some):
            return None
        nothing = [None] * len(some), [None] * len(moved)
        return pa.RecordBatch.from_arrays([pa.array(np.r_[node[some], node[moved]]), pa.array([*nothing[0], *node[label[moved]].tolist()], pa.int64()), pa.array([*weight[some].tolist(), *nothing[1]], pa.int64())], names=["node", "other", "weight"])

    def in_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_groups(batches, 4):
            bounds = group_bounds(table, 4)
            for k in np.flatnonzero(np.diff(bounds) > 1):
                group = table.slice(bounds[k], bounds[k + 1] - bounds[k])
                columns = [group[c].to_pylist() for c in ("node", "n", "vec", "codes")]
                if (out := found(arrays(*columns, group["dim"][0].as_py()), None, group["t"][0].as_py(), group["code"][0].as_py())) is not None:
                    yield out

    def in_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = TileReader()
        for batch in batches:
            for left, right in zip(batch["left"].to_pylist(), batch["right"].to_pylist(), strict=True):
                sides = []
                for tile in [read(uri) for uri in ((left,) if left == right else (left, right))]:
                    sides.append(arrays(*(tile[x].to_pylist() for x in ("node", "n", "vec", "codes")), tile["dim"][0].as_py()))
                    t, code = tile["t"][0].as_py(), tile["code"][0].as_py()
                if (out := found(sides[0], sides[1] if len(sides) > 1 else None, t, code)) is not None:
                    yield out

    tiles = tile_pairs(cut, keys, ["node", "n", "vec", "codes", "dim", "t", "code"]).mapInArrow(in_tiles, FOUND)
    return small.mapInArrow(in_small, FOUND).union(tiles)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tables: int = 5, hashes: int = 2, seed: int = 1, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``.

    Rows with equal labels link if their cosine is at least ``threshold``. Rows whose label is null, or
    whose vector is null, empty, zero or holds null or non-finite numbers, link with nothing. Vectors of
    different lengths never link. Of rows with the same id each has its own links; a component's id is its
    smallest id, and a row with a null id is kept if the component has no other. Vectors of any finite size
    link; an empty table gives no rows; other columns, whatever their names, take no part."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, keys, dims = [], [], []
            for x in batch["vec"].to_pylist():
                v = np.array([np.nan if y is None else y for y in x], "f8") + 0.0 if x else None
                good = v is not None and np.isfinite(v).all() and v.any()
                if good and not 1e-100 < np.abs(v).max() < 1e100:  # its squares could over- or underflow
                    v = np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) + 0.0
                raw.append(v.tobytes() if good else None)
                keys.append(hashlib.sha256(raw[-1]).digest() if good else None)
                dims.append(len(v) if good else None)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(dims, pa.int32()), pa.array(raw, pa.binary()), pa.array(keys, pa.binary())], names=["vec_id", "label", "dim", "vec", "key"])

    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("string").alias("label"), F.col(vector_column).cast("array<double>").alias("vec"))
    rows = rows.mapInArrow(checked, "vec_id long, label string, dim int, vec binary, key binary").withColumn("uid", F.monotonically_increasing_id())
    rows = written(rows.withColumn("key", F.when(F.col("label").isNotNull(), F.col("key"))), "vectors")
    classes = rows.where("key IS NOT NULL").groupBy("label", "key").agg(F.min("uid").alias("node"), F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    classes = written(classes, "vector-classes")
    found = written(near_vectors(classes, threshold, tables, hashes, seed), "links")
    weights = found.where("weight IS NOT NULL").groupBy("node").agg(F.sum("weight").alias("weight"))
    roots = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "member")
    of_class = classes.select("label", "key", "node", "rep", "n").join(weights, "node", "left").join(roots, F.col("node") == F.col("member"), "left")
    of_class = of_class.withColumn("root", F.coalesce("root", "node"))
    least = of_class.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(least, "root").select("label", "key", "n", (F.col("n") - 1 + F.coalesce("weight", F.lit(0))).alias("links"), "component_id")
    mine = rows.select("vec_id", "label", "key")
    out = with_classes(mine.where("key IS NOT NULL"), written(of_class, "classes-of-vectors"), ["label", "key"]).select("vec_id", "links", "component_id")
    alone = mine.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component_id"))
    component = F.col("component_id")
    return out.union(alone).select("vec_id", F.col("links").cast("long").alias("n_links"), component, F.col("vec_id").eqNullSafe(component).alias("kept"))
