"""Connected components, and what tiled comparisons share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomcast.llm.shared import discard, open_fs, partitions, put_file, shared_folder, written

#: Rows of a group that one task compares; larger groups are cut into tiles of about this size.
TILE = 2048
#: Rows of a tile that are compared at a time.
BLOCK = 512


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that links lead to) for all nodes of ``edges`` (a long, b long).

    Alternates large-star and small-star steps: every node hands its larger neighbours, then its
    smaller ones, to the smallest node it knows, until nothing changes. Each step is an aggregation
    and a join; only sums of the edges reach the driver."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, F.col("a") == F.col("u")).select("a", "b", "m")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        old, now = now, written(small.distinct(), "edges")
        discard(now.sparkSession, old, collect=False)
        state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    # At the fixpoint every edge is (node, root).
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that links (i, j) join each of n indexes to."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        while (up := label[label] != label).any():
            label[up] = label[label[up]]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


def in_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups (rows equal in the first ``keys`` columns) from batches sorted by them."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        last = len(table) - 1
        while last and all(table[k][last].equals(table[k][last - 1]) for k in range(keys)):
            last -= 1
        if last:
            yield table.slice(0, last)
        rest = table.slice(last)
    if rest is not None and len(rest):
        yield rest


def group_bounds(table: pa.Table, keys: int) -> np.ndarray:
    """Where groups begin, and the number of rows."""
    change = np.zeros(len(table) - 1, bool)
    for k in range(keys):
        values = table[k].to_numpy()
        change |= values[1:] != values[:-1]
    return np.r_[0, np.flatnonzero(change) + 1, len(table)]


def small_and_tiled(rows: DataFrame, keys: list[str], tile: int, salt: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` of groups of up to ``tile`` rows, sorted by ``keys`` in partitions of whole groups; and rows
    of larger groups with ``cut``, a number of about ``tile`` rows of the group that ``salt``'s hash deals out."""
    spark = rows.sparkSession
    large = rows.groupBy(*keys).agg(F.count("*").alias("size")).where(F.col("size") > tile)
    small = rows.join(large, keys, "left_anti").repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    cut = rows.join(large, keys).withColumn("cut", F.pmod(F.xxhash64(salt, F.lit(1)), F.ceil(F.col("size") / tile))).drop("size")
    return small, cut


def with_classes(rows: DataFrame, classes: DataFrame, keys: list[str], hot_share: int = 1000) -> DataFrame:
    """``rows`` with the columns of their class: ``classes`` has a row for each value of ``keys`` and ``n``, its number
    of rows. Classes of over 1 / ``hot_share`` of all rows, of which there are fewer than ``hot_share``, are
    broadcast, so no task gets all rows of one; the others meet by shuffle. Rows without a class go."""
    limit = rows.count() / hot_share
    hot, cold = classes.where(F.col("n") > limit).drop("n"), classes.where(F.col("n") <= limit).drop("n")
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(others.join(cold, keys))


def stored_tiles(cut: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame, str]:
    """``keys`` and uri of each tile (rows of ``cut`` with equal keys), whose ``columns`` are an Arrow file in
    the shared folder; and that folder. So pairs of tiles are pairs of names, however large the tiles are."""
    folder = shared_folder(cut.sparkSession, "tiles")
    tiles = cut.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("rows"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uris = []
            for k in range(len(batch)):
                rows = pa.RecordBatch.from_struct_array(batch["rows"][k].values)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_batch(rows)
                uris.append(f"{folder}/{uuid.uuid4().hex}")  # a task that runs again writes files of its own
                put_file(uris[-1], [sink.getvalue().to_pybytes()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(uris, pa.string())], names=[*batch.schema.names[:-1], "uri"])

    schema = StructType([*tiles.schema.fields[:-1], StructField("uri", StringType())])
    return written(tiles.mapInArrow(store, schema), "tile-names"), folder


class TileReader:
    """Reads stored tiles; the last few stay in memory."""

    def __init__(self, most: int = 4):
        self.most, self.kept = most, {}

    def __call__(self, uri: str) -> pa.Table:
        if (found := self.kept.pop(uri, None)) is None:
            files, path = open_fs(uri)
            with files.open_input_stream(path) as f:
                found = pa.ipc.open_stream(f).read_all()
        self.kept[uri] = found
        while len(self.kept) > self.most:
            del self.kept[next(iter(self.kept))]
        return found


def tile_pairs(cut: DataFrame, keys: list[str], columns: list[str], near: tuple[str, int] | None = None) -> DataFrame:
    """Pairs of tiles of the same group, each once and with itself: ``left`` and ``right``, names of stored
    tiles with ``columns``. With ``near`` = (column, distance) a tile has one value of that column, and
    pairs of tiles that are further apart are skipped. Only names are joined; tasks read the tiles."""
    by = [near[0]] if near else []
    tiles, _ = stored_tiles(cut, [*keys, *by, "cut"], columns)
    tiles = tiles.withColumn("tile", F.struct(*by, "cut"))
    left = tiles.select(*keys, F.col("tile").alias("i"), F.col("uri").alias("left"))
    right = tiles.select(*keys, F.col("tile").alias("j"), F.col("uri").alias("right"))
    pairs = left.join(right, keys).where("i <= j")
    if near:
        pairs = pairs.where(F.abs(F.col(f"i.{near[0]}") - F.col(f"j.{near[0]}")) <= near[1])
    return pairs.select("left", "right").repartition(partitions(cut.sparkSession))
