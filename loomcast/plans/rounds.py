"""Durable rounds: each round is one attempt of every item that is still open.

The log on disk is the truth. A round calls, appends and decides what is open from the log, in DataFrame
operations; the driver only counts, and sleeps the cooldown between rounds, which is therefore global.
A run that was cut off goes on where the log ends.
"""

from __future__ import annotations

import itertools
import time
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.config import EngineConfig, RetryConfig
from loomcast.functions.classify import is_validation
from loomcast.operators.infer import infer
from loomcast.operators.strategies import Strategy
from loomcast.schema import FINAL
from loomcast.sources.log import append_attempts, read_attempts


class OneAttempt(Strategy):
    """A strategy in one round: the attempt's number comes from the log, by way of the item's context."""

    def __init__(self, inner: Strategy, attempt: int = 1):
        self.inner, self.attempt = inner, attempt

    def for_item(self, item_id: str, generation: int) -> OneAttempt:
        # Rounds hand ids over as id, generation and attempt; earlier validation failures come with the item.
        own, generation, attempt = item_id.rsplit("\x1f", 2)
        return OneAttempt(self.inner.for_item(own, int(generation)), int(attempt))

    def resume(self, validation_failures: int) -> None:
        self.inner.resume(validation_failures)

    def described(self, attempt: int) -> dict:
        return self.inner.described(self.attempt)

    async def prepare(self) -> None:
        await self.inner.prepare()

    async def cleanup(self) -> None:
        await self.inner.cleanup()

    async def execute(self, prompt: str, attempt: int, timeout: float):
        return await self.inner.execute(prompt, self.attempt, timeout)

    async def on_error(self, error: Exception, attempt: int) -> None:
        await self.inner.on_error(error, self.attempt)


def open_items(items: DataFrame, log: DataFrame, max_attempts: int, max_generations: int | None) -> DataFrame:
    """Items without a final attempt, with the generation and attempt that come next."""
    failed = F.count_if(is_validation(F.col("error_type"), F.col("error_message"), F.col("error.error_category")) & F.col("error_type").isNotNull())
    last = log.groupBy("item_id").agg(F.max_by(F.struct("state", "generation", "attempt"), F.struct("generation", "attempt")).alias("last"), failed.cast("int").alias("n_failed"))
    both = items.join(last, "item_id", "left").where(F.col("last").isNull() | ~F.col("last.state").isin(*FINAL))
    limited = F.col("last.state") == "rate_limited"
    return both.withColumn("generation", F.coalesce(F.col("last.generation") + limited.cast("int"), F.lit(1))).withColumn("attempt", F.when(F.col("last").isNull() | limited, 1).otherwise(F.col("last.attempt") + 1)).withColumn("failures", F.coalesce("n_failed", F.lit(0))).drop("last", "n_failed")


def _delete(spark, *folders: str) -> None:
    for f in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run_rounds(items: DataFrame, path: str, strategies: dict[str, Strategy], config: EngineConfig = EngineConfig(), max_rounds: int | None = None) -> DataFrame:
    """The attempt log at ``path`` once no item is open. Items that are open after ``max_rounds`` are an error; what
    was called for stays in the log, so another run goes on from there."""
    spark = items.sparkSession
    once = replace(config, retry=replace(config.retry, max_attempts=1) if config.retry.max_attempts > 1 else RetryConfig(max_attempts=1), max_generations=None)
    single = {k: OneAttempt(s) for k, s in strategies.items()}
    consecutive = 0
    left_over: list[str] = []
    rest = items
    try:
        for number in itertools.count(1):
            todo = open_items(rest, read_attempts(spark, path), config.retry.max_attempts, config.max_generations)
            if number > 1:
                # What is open is written, and the next round chooses from that: an item's text is moved once for each attempt.
                left_over.append(f"{path.rstrip('/')}-open-{uuid.uuid4().hex}")
                todo.write.parquet(left_over[-1])
                todo = spark.read.schema(todo.schema).parquet(left_over[-1])
                rest = todo.select(*[F.col(f"`{c}`") for c in items.columns])
                if len(left_over) > 1:
                    _delete(spark, left_over.pop(0))
                left = todo.agg(F.count("*").alias("n"), F.count_if(F.col("attempt") == 1).alias("limited"), F.min(F.when(F.col("attempt") > 1, F.col("attempt"))).alias("next")).first()
                if not left["n"]:
                    break
                if max_rounds is not None and number > max_rounds:
                    raise RuntimeError(f"{left['n']} items are open after {max_rounds} rounds")
                limit = config.rate_limit
                consecutive = consecutive + 1 if left["limited"] else 0
                pause = min(limit.cooldown_seconds * limit.backoff_multiplier ** (consecutive - 1), limit.max_cooldown) if consecutive else config.retry.wait(left["next"] - 1)
                time.sleep(pause * config.time_scale)
            tagged = todo.withColumn("item_id", F.concat_ws("\x1f", "item_id", F.col("generation").cast("string"), F.col("attempt").cast("string")))
            # One attempt each: a rate limit ends it, too.
            found = infer(tagged, single, replace(once, max_generations=1, rate_limit=replace(once.rate_limit, cooldown_seconds=0.0)))
            parts = F.split("item_id", "\x1f")
            n = F.size(parts)
            found = found.withColumn("generation", F.element_at(parts, -2).cast("int")).withColumn("attempt", F.element_at(parts, -1).cast("int")).withColumn("item_id", F.array_join(F.slice(parts, 1, n - 2), "\x1f"))
            limited = F.col("error.is_rate_limit")
            capped = F.lit(False) if config.max_generations is None else F.col("generation") >= config.max_generations
            state = F.when(F.col("state") == "success", "success").when(limited & ~capped, "rate_limited").when(limited, "exhausted").when(F.col("error.is_retryable") & (F.col("attempt") < config.retry.max_attempts), "retry").when(F.col("error.is_retryable"), "exhausted").otherwise("failed_final")
            append_attempts(found.withColumn("state", state), path)
    finally:
        _delete(spark, *left_over)
    return read_attempts(spark, path)
