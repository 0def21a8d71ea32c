"""Tables on disk: work items in, the attempt log out, resume between."""

from __future__ import annotations

import asyncio
import itertools

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from loomcast.functions.threads import in_thread
from loomcast.schema import ATTEMPTS, FINAL


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_items(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Work items from any file format that Spark reads; a schema avoids a pass to infer one."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    """The log, empty if there is none yet."""
    schema = _parse_datatype_string(ATTEMPTS)
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        # A relation that is known to be empty, so that joins with it shuffle nothing.
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in schema) + " LIMIT 0")


def append_attempts(attempts: DataFrame, path: str) -> None:
    attempts.write.mode("append").parquet(path)


def remaining(items: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Items without a final attempt in the log."""
    done = read_attempts(spark, path).where(F.col("state").isin(*FINAL)).select("item_id").distinct()
    return items.join(done, "item_id", "left_anti")


def write_results(results: DataFrame, path: str, partition_by: list[str] | None = None, kind: str = "parquet", mode: str = "overwrite") -> None:
    results.write.mode(mode).partitionBy(*(partition_by or [])).format(kind).save(path)


def post_process(results: DataFrame, handle, timeout: float | None = 30.0, at_once: int = 16) -> None:
    """Call ``handle(row)`` for each result, successes and failures: an async function, or a sync one in a thread,
    ``at_once`` at a time, each given up after ``timeout`` seconds. Its exceptions are ignored. Results
    should be written first; a task that runs twice handles its rows twice."""

    def over(rows) -> None:
        async def one(row) -> None:
            try:
                call = handle(row) if asyncio.iscoroutinefunction(handle) else in_thread(handle, row)
                await asyncio.wait_for(call, timeout)
            except Exception:  # noqa: S110  a failing hook never fails an item
                pass

        async def all_of(some: list) -> None:
            await asyncio.gather(*map(one, some))

        for some in itertools.batched(rows, at_once):
            asyncio.run(all_of(list(some)))

    results.foreachPartition(over)
