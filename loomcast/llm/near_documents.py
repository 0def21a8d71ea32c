"""Near-duplicate documents by wide SimHash fingerprints: operator 7 for similarities of shingle sets.

64 bits tell a Jaccard similarity of 0.8 from lower ones poorly, so fingerprints here have 512 bits of
the set of 5-word shingles. Tiled exact comparison finds pairs within ``radius`` bits; at 0.8 the
distance is 78 +- 8 bits, of unrelated texts 256 +- 11. Tiles hold documents of similar set sizes, and
tiles whose sizes cannot have the similarity never meet. The first comparison tells who has a near
pair at all; the shingle sets of these alone are stored, and the second one verifies their near pairs
by Jaccard similarity. Only a spanning forest of the verified pairs leaves a pair of tiles: a near
pair that fails never stands in for one that does not, and a group of n copies makes about n links.
Sets of up to SMALL shingles and what is similar to them are found without fingerprints, by shared shingles.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm.graph import TileReader, components, forest, group_bounds, in_groups, small_and_tiled, stored_tiles, tile_pairs
from loomcast.llm.lines import numbered
from loomcast.llm.shared import append_column, discard, giving_back, open_fs, partitions, put_file, shared_folder, text_of, written
from loomcast.llm.simhash import mixed, near_pairs, shingle_hashes

PARTS = 8
TILE = 8192
#: Sets of up to this many shingles, whose fingerprints tell little, are compared by shared shingles.
SMALL = 32
#: Small sets of a group that one task compares.
SET_TILE = 1024


def shingle_set(text: str, width: int) -> np.ndarray:
    found = list(shingle_hashes(text, width))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, "u8")


def wide_fingerprint(text: str, width: int, parts: int = PARTS, largest: int = 0) -> tuple[bytes, int, np.ndarray | None]:
    """512 bits of the text's shingle set, the set's size, and sets of up to ``largest`` themselves. No word: zero bits, size 0."""
    h = shingle_set(text, width)
    out = []
    for k in range(parts):
        counts = np.zeros(64, "i8")
        for at in range(0, len(h), 1 << 17):
            some = h[at : at + (1 << 17)]
            counts += np.unpackbits((mixed(some, k) if k else some).astype(">u8").view("u1")).reshape(-1, 64).sum(0, dtype="i8")
        out.append(np.packbits(2 * counts > len(h)).tobytes())
    return b"".join(out), len(h), h.view("i8") if len(h) <= largest else None


def spanning(n: int, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) make a minimum spanning forest (Boruvka's steps; ties go to the earlier pair)."""
    rank = np.empty(len(i), "i8")
    rank[np.argsort(distance, kind="stable")] = np.arange(len(i))
    of_rank = np.argsort(rank)
    label, chosen, live = np.arange(n), [], np.arange(len(i))
    while True:
        a, b = label[i[live]], label[j[live]]
        live, a, b = live[a != b], a[a != b], b[a != b]
        if not len(live):
            return np.concatenate(chosen) if chosen else live
        best = np.full(n, len(i))
        np.minimum.at(best, a, rank[live])
        np.minimum.at(best, b, rank[live])
        pick = of_rank[np.unique(best[best < len(i)])]
        chosen.append(pick)
        label = forest(n, np.r_[np.arange(n), i[pick]], np.r_[label, j[pick]])


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets of hashes, each sorted or at least without repeats, have the Jaccard similarity."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def verified_links(n: int, i: np.ndarray, j: np.ndarray, distance: np.ndarray, label: np.ndarray, check: Callable[[int, int], bool]) -> tuple[list[int], np.ndarray]:
    """Which of the pairs (i, j) pass ``check`` and join what all that pass join, and the labels after it.

    A spanning forest of the pairs between unjoined labels is checked; those that fail are dropped, those
    that pass join, and so on until no pair is left. Where forests fail, growing numbers of the nearest
    other pairs are checked with them."""
    passed: list[int] = []
    open_pairs, more = np.arange(len(i)), 0
    while True:
        open_pairs = open_pairs[label[i[open_pairs]] != label[j[open_pairs]]]
        if not len(open_pairs):
            return passed, label
        tried = spanning(n, label[i[open_pairs]], label[j[open_pairs]], distance[open_pairs])
        if more:
            tried = np.union1d(tried, np.argsort(distance[open_pairs], kind="stable")[:more])
        good = [k for k in open_pairs[tried].tolist() if check(i[k], j[k])]
        passed += good
        label = forest(n, np.r_[np.arange(n), i[good]], np.r_[label, j[good]])
        open_pairs = np.delete(open_pairs, tried)
        more = 2 * more or 512


def _links(left: dict, right: dict | None, radius: int, check: Callable[[int, int], bool] | None = None, first_radius: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of two tiles (or one): nodes a and b. With ``check``, of the near pairs that pass
    it, or else of all. The first 64 bits are looked at first; at a similarity of 0.8 they differ in 10 +- 3."""
    a = left["fp"]
    b = None if right is None else right["fp"]
    node = left["node"] if right is None else np.r_[left["node"], right["node"]]
    kept = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8")
    label = np.arange(len(node))
    for i, j in near_pairs(a[:, :1], None if b is None else b[:, :1], first_radius):
        distance = np.bitwise_count(a[i] ^ (a if b is None else b)[j]).sum(1, dtype="i8")
        near = distance <= radius
        if not near.any():
            continue
        i, j, distance = i[near], j[near] + (0 if b is None else len(a)), distance[near]
        if check:
            some, label = verified_links(len(node), i, j, distance, label, check)
            kept = tuple(np.r_[x, y[some]] for x, y in zip(kept, (i, j, distance), strict=True))
        else:
            merged = [np.r_[x, y] for x, y in zip(kept, (i, j, distance), strict=True)]
            some = spanning(len(node), *merged)
            kept = tuple(x[some] for x in merged)
    return node[kept[0]], node[kept[1]]


class StoredSets:
    """Shingle sets read from the files that ``_store_sets`` wrote, the last ones kept in memory."""

    def __init__(self, most_bytes: int = 64 << 20):
        self.most, self.size, self.kept, self.files = most_bytes, 0, {}, {}

    def get(self, uri: str, at: int, n: int) -> np.ndarray:
        found = self.kept.pop((uri, at), None)
        if found is None:
            if uri not in self.files:
                files, path = open_fs(uri)
                self.files[uri] = files.open_input_file(path)
            self.files[uri].seek(at)
            found = np.frombuffer(self.files[uri].read(8 * n), "<u8")
            self.size += found.nbytes
        self.kept[uri, at] = found
        while self.size > self.most and len(self.kept) > 2:
            self.size -= self.kept.pop(next(iter(self.kept))).nbytes
        return found


def _store_sets(rows: DataFrame, width: int, file_bytes: int = 32 << 20) -> tuple[DataFrame, str]:
    """node, uri, at, n: where in the shared folder the shingle set of each of ``rows`` (node, t) is; and the folder."""
    folder = shared_folder(rows.sparkSession, "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            uri = f"{folder}/{uuid.uuid4().hex}"  # a task that runs again writes files of its own
            put_file(uri, (raw for _, raw in found))
            sizes = np.array([len(raw) for _, raw in found], "i8")
            out = pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([uri] * len(found)), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes // 8)], names=["node", "uri", "at", "n"])
            found.clear()
            return out

        for batch in batches:
            for node, text in zip(batch["node"].to_pylist(), batch["t"], strict=True):
                found.append((node, shingle_set(text.as_py(), width).astype("<u8").tobytes()))
                size += len(found[-1][1])
                if size >= file_bytes:
                    yield flush()
                    size = 0
        if found:
            yield flush()

    return written(rows.select("node", "t").mapInArrow(giving_back(run), "node long, uri string, at long, n long"), "places-of-sets"), folder


def _tile_links(reps: DataFrame, radius: int, similarity: float | None = None) -> DataFrame:
    """Links a, b of ``reps`` (node, fp, band), tile by tile. With ``similarity``, only links whose sets (at uri, at, n) have it."""
    # A band is a range of sizes by the factor 1 / similarity: similar sets are in one or in neighbours.
    columns = ["node", "fp"] + (["uri", "at", "n"] if similarity else [])
    bands = reps.groupBy("band").agg(F.ceil(F.count("*") / TILE).alias("cuts"))
    cut = reps.join(bands, "band").withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")))
    tiles, folder = stored_tiles(cut, ["band", "cut"], columns)
    left = tiles.select(F.col("band").alias("i"), F.col("cut").alias("ic"), F.col("uri").alias("left"))
    beside = [tiles.select((F.col("band") - k).alias("i"), F.col("band").alias("j"), F.col("cut").alias("jc"), F.col("uri").alias("right")) for k in (0, 1)]
    pairs = left.join(beside[0].union(beside[1]), "i").where("i < j or i = j and ic <= jc")
    pairs = pairs.select((F.col("i") == F.col("j")).__and__(F.col("ic") == F.col("jc")).alias("same"), "left", "right").repartition(4 * partitions(reps.sparkSession))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored, read = StoredSets(), TileReader()
        for batch in batches:
            for k in range(len(batch)):
                sides, places = [], []
                for c in ("left",) if batch["same"][k].as_py() else ("left", "right"):
                    tile = read(batch[c][k].as_py())
                    sides.append({"node": tile["node"].to_numpy(), "fp": np.frombuffer(b"".join(tile["fp"].to_pylist()), ">u8").astype("u8").reshape(-1, PARTS)})
                    if similarity:
                        places += zip(*[tile[c].to_pylist() for c in ("uri", "at", "n")], strict=True)

                def check(i: int, j: int, places=places) -> bool:
                    return similar(stored.get(*places[i]), stored.get(*places[j]), similarity)

                a, b = _links(sides[0], sides[1] if len(sides) > 1 else None, radius, check if similarity else None)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    links = written(pairs.mapInArrow(giving_back(compare), "a long, b long").distinct(), "links")
    discard(reps.sparkSession, tiles, folder)
    return links


def similar_in_group(flat: np.ndarray, sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the similar ones of some sets join: indexes of the sets, whose hashes ``flat`` has one after the other."""
    n = len(sizes)
    ids = np.unique(flat, return_inverse=True)[1]
    order = np.argsort(ids, kind="stable")
    members = np.repeat(np.arange(n), sizes)[order]
    starts = np.searchsorted(ids[order], np.arange(len(ids) + 1))
    bounds = np.r_[0, np.cumsum(sizes)]
    label = np.arange(n)
    for k in range(1, n):
        common = np.bincount(np.concatenate([members[starts[t] : starts[t + 1]] for t in ids[bounds[k] : bounds[k + 1]]]), minlength=n)[:k]
        near = np.flatnonzero(common >= similarity * (sizes[k] + sizes[:k] - common) - 1e-9)
        if (label[near] != label[k]).any():
            label = forest(n, np.r_[np.arange(n), np.full(len(near), k)], np.r_[label, near])
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def _small_links(reps: DataFrame, similarity: float) -> DataFrame:
    """Links a, b that connect all similar ones of ``reps`` (node, size, small: the set). Similar sets share one of
    the first |s| - ceil(similarity |s|) + 1 hashes of their order, so sets meet by these."""
    n = F.col("size").cast("int")
    tokens = written(reps.select("node", F.explode(F.slice("small", 1, n - F.ceil(n * similarity - 1e-9).cast("int") + 1)).alias("token")), "tokens")
    shared = tokens.groupBy("token").count().where("count > 1").select("token")
    rows = written(tokens.join(shared, "token", "left_semi").join(reps.select("node", "small"), "node"), "shared-tokens")
    some, cut = small_and_tiled(rows, ["token"], SET_TILE, "node")

    def links(node: np.ndarray, sets: list) -> pa.RecordBatch:
        a, b = similar_in_group(np.concatenate(sets), np.array([len(x) for x in sets]), similarity)
        return pa.RecordBatch.from_arrays([pa.array(node[a], pa.int64()), pa.array(node[b], pa.int64())], names=["a", "b"])

    def in_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_groups(batches, 1):
            node, sets, bounds = table["node"].to_numpy(), table["small"].to_numpy(), group_bounds(table, 1)
            for x, y in zip(bounds, bounds[1:], strict=False):
                if y - x > 1:
                    yield links(node[x:y], list(sets[x:y]))

    def in_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = TileReader()
        for batch in batches:
            for left, right in zip(batch["left"].to_pylist(), batch["right"].to_pylist(), strict=True):
                sides = [read(uri) for uri in ((left,) if left == right else (left, right))]
                yield links(np.concatenate([x["node"].to_numpy() for x in sides]), [np.asarray(v) for x in sides for v in x["small"].to_pylist()])

    near = some.select("token", "node", "small").mapInArrow(in_small, "a long, b long").union(tile_pairs(cut, ["token"], ["node", "small"]).mapInArrow(in_tiles, "a long, b long"))
    links_of_all = written(near.distinct(), "small-links")
    discard(reps.sparkSession, tokens, rows)
    return links_of_all


def distinct_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 112, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, the one with the smallest doc_id.

    Documents link if their shingle sets' Jaccard similarity is at least ``similarity`` and, where both sets
    have over SMALL shingles, their fingerprints are within ``radius``; equal sets always link, so all null and wordless texts are one group. Null
    ids come last; of rows with equal ids one stays. All columns stay, whatever their names;
    an empty table stays empty."""
    spark = docs.sparkSession
    names, inner = docs.columns, [f"c{k}" for k in range(len(docs.columns))]
    id_column, text_column = inner[names.index(id_column)], inner[names.index(text_column)]
    rows = numbered(docs.toDF(*inner), id_column).withColumnRenamed("loom_row", "_row")
    kind = pa.struct([("fp", pa.binary()), ("size", pa.int64()), ("small", pa.list_(pa.int64()))])
    largest = int(SMALL / similarity + 1e-9)  # what a small set can be similar to

    def run(texts: list[str]) -> pa.Array:
        return pa.array([dict(zip(("fp", "size", "small"), wide_fingerprint(t, width, largest=largest), strict=True)) for t in texts], kind)

    fps = append_column(rows.select(F.col("_row").alias("row"), F.coalesce(F.col(id_column).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), text_of(text_column).alias("t")), F.col("t"), run, "f", "struct<fp: binary, size: long, small: array<long>>")
    fps = written(fps.select("row", "doc", "f.fp", "f.size", "f.small"), "wide-fingerprints")
    reps = written(fps.groupBy("fp", "size").agg(F.min("row").alias("node"), F.first("small").alias("small")).withColumn("band", F.when(F.col("size") == 0, -1).otherwise(F.floor(F.log(F.col("size").cast("double")) / math.log(1 / similarity) + 1e-9))), "sets")

    # Whoever has a near pair is in a link of the first comparison; the second one is of these alone, and looks into their sets.
    small = _small_links(reps.where(f"size between 1 and {largest}"), similarity)
    sized = reps.drop("small").where(F.col("size") > SMALL)
    near = _tile_links(sized, radius)
    linked = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    some = rows.select(F.col("_row").alias("node"), text_of(text_column).alias("t")).join(linked, "node", "left_semi")
    places, folder = _store_sets(some, width)
    verified = _tile_links(sized.join(places, "node"), radius, similarity)
    discard(spark, near, places, folder)
    roots = components(verified.union(small)).withColumnRenamed("node", "member")
    group = reps.join(roots, F.col("node") == F.col("member"), "left").select(F.col("fp").alias("gfp"), F.col("size").alias("gsize"), F.coalesce("root", "node").alias("group"))
    members = fps.join(group, (F.col("fp") == F.col("gfp")) & (F.col("size") == F.col("gsize")))
    stays = written(members.groupBy("group").agg(F.min(F.struct("doc", "row")).alias("first")).select(F.col("first.row").alias("_row")), "staying-documents")
    discard(spark, verified, small, fps, reps)
    return rows.join(stays, "_row", "left_semi").drop("_row").toDF(*names)
