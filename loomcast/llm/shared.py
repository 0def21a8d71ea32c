"""The folder that the driver and all executors share, and small helpers of all operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The URI in ``spark.checkpoint.dir``; a temporary folder of our own only where that is unset and all runs in
    one process. On a cluster it must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomcast-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root if "://" in root else f"file://{os.path.abspath(root.removeprefix('file:'))}"


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name under the shared folder; writers create it."""
    FOLDERS.append(f"{shared_root(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}")
    return FOLDERS[-1]


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: lineage ends here, and a
    lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_folder(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.loom_folder = path
    return out


def written_in_parts(parts: Iterable[DataFrame], what: str) -> DataFrame:
    """``written`` of all ``parts`` together, one after the other: shuffle files of a part go before the next one's are
    made, so the disk holds those of one."""
    out = None
    for part in parts:
        if out is None:
            out = written(part, what)
        else:
            part.write.mode("append").parquet(out.loom_folder)
        discard(part.sparkSession)
    again = out.sparkSession.read.schema(out.schema).parquet(out.loom_folder)  # files are listed when it is made
    again.loom_folder = out.loom_folder
    return again


#: Folders that this process has named and not discarded, in order.
FOLDERS: list[str] = []


def discard(spark: SparkSession, *tables: DataFrame | str, collect: bool = True) -> None:
    """Delete tables that ``written`` made (or folders) and that nothing reads any more, and, with ``collect``, let
    Spark free the shuffle files of jobs that are over."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t.loom_folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if str(t if isinstance(t, str) else t.loom_folder) in FOLDERS:
            FOLDERS.remove(t if isinstance(t, str) else t.loom_folder)
    if collect:
        gc.collect()
        spark._jvm.System.gc()


def give_back() -> None:
    """Hand the memory that a task has freed back to the system: workers outlive their tasks, and other stages'
    workers need it. Arrow's allocator keeps what batches had, the C library what Python had; where the latter has no
    such call, its part stays."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, then ``give_back`` when nothing of it is left, its last batch included."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return over


def open_fs(uri: str):
    """(file system, path) of a URI: local, HDFS, S3 or whatever pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, chunks) -> int:
    """Write ``chunks`` under a temporary name and rename, so that a task that dies or runs twice
    leaves either nothing or a whole file. Returns the bytes written."""
    files, path = open_fs(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    part, n = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with files.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            n += len(chunk)
    files.move(part, path)
    return n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def each(array: Column, element: str, function) -> Column:
    """``F.transform`` of an array of ``element`` ("string", "integer", "long") without nulls, in compiled code.

    Spark interprets the lambdas of its functions on arrays, at some 0.2 microseconds an element; the loop that it
    compiles for the fields of its datasets has no public name. Where a version or a remote session does not have that
    either, ``F.transform`` gives the same values."""
    spark = SparkSession.getActiveSession()
    try:
        columns = getattr(spark._jvm, "org.apache.spark.sql.classic.ExpressionUtils")
        objects = spark._jvm.org.apache.spark.sql.catalyst.expressions.objects
        kind = spark._jvm.org.apache.spark.sql.types.DataType.fromJson(f'"{element}"')
        item = objects.LambdaVariable("item", kind, False, uuid.uuid4().int >> 66)  # an id of its own, of 62 bits
        loop = getattr(getattr(objects, "MapObjects$"), "MODULE$")
        made = columns.expression(function(Column(columns.column(item)))._jc)
        return Column(columns.column(loop.apply(item, made, columns.expression(array._jc), spark._jvm.scala.Option.empty())))
    except (AttributeError, TypeError, Py4JError):
        return F.transform(array, function)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def with_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` without columns whose names clash with (or differ only by case from) the new ones, plus these."""
    new = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new], *[v.alias(k) for k, v in columns.items()])


def append_column(df: DataFrame, given: Column, run, name: str, kind: str, step: int = 256) -> DataFrame:
    """``df`` with a column ``name``, which ``run`` makes from lists of ``given``'s values, ``step`` rows
    at a time. A column of that name is replaced; others may have any names, repeated ones too."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    kept = [(k, c) for k, c in enumerate(df.columns) if c.lower() != name.lower()]
    rows = df.select("*", given.alias("given")).toDF(*[f"c{k}" for k in range(len(df.columns))], "given")
    rows = rows.select(*[f"c{k}" for k, _ in kept], "given")
    made = StructField(name, _parse_datatype_string(kind))
    schema = StructType([*rows.schema.fields[:-1], StructField("made", made.dataType)])

    def over(batches):
        for batch in batches:
            for k in range(0, len(batch), step):
                part = batch.slice(k, step)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], run(part.columns[-1].to_pylist())], names=[*part.schema.names[:-1], "made"])

    return rows.mapInArrow(giving_back(over), schema).toDF(*[c for _, c in kept], name)
