"""Results, statistics, events and reports: queries on the attempt log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcast.functions.schedule import configured_cooldown, slow_start_delay
from loomcast.schema import FINAL

TOKEN_KINDS = ("input_tokens", "output_tokens", "total_tokens", "cached_input_tokens")


def _tokens(name: str) -> Column:
    return F.coalesce(F.col(f"tokens.{name}"), F.lit(0))


def results(attempts: DataFrame) -> DataFrame:
    """One row for each item with a final attempt: item_id, success, output, error, token_usage, failed_attempt_tokens, attempts,
    generations. A successful item's and a non-retryable failure's usage is that of the last attempt; an
    exhausted one's is the sum over its last generation (cached tokens are not summed). failed_attempt_tokens
    holds what the failed attempts cost together."""
    order = F.struct("generation", "attempt")
    last = F.max_by(F.struct("state", "output", "error_type", "error_message", "tokens", "generation", "context"), order)
    by_generation = attempts.groupBy("item_id", "generation").agg(
        last.alias("last"), F.count("*").alias("n"), *[F.sum(_tokens(k)).alias(k) for k in TOKEN_KINDS[:3]],
        F.sum(F.when(~F.col("state").isin("success", "recovered"), _tokens("total_tokens")).otherwise(0)).alias("failed"),
    )
    top = F.max_by(F.struct("last", *TOKEN_KINDS[:3]), "generation")
    items = by_generation.groupBy("item_id").agg(top.alias("top"), F.sum("n").alias("attempts"), F.sum("failed").alias("failed_attempt_tokens"), F.max("generation").alias("generations"))
    state, final = F.col("top.last.state"), F.col("top.last")
    text = F.concat(final["error_type"], F.lit(": "), F.when(state == "exhausted", F.substring(final["error_message"], 1, 200)).otherwise(F.substring(final["error_message"], 1, 500)))
    summed = F.struct(*[F.col(f"top.{k}").alias(k) for k in TOKEN_KINDS[:3]], F.lit(0).cast("bigint").alias("cached_input_tokens"))
    return items.where(state.isin(*FINAL)).select(
        "item_id", state.isin("success", "recovered").alias("success"), final["output"].alias("output"), text.alias("error"),
        F.when(state == "exhausted", summed).otherwise(final["tokens"]).alias("token_usage"), F.col("failed_attempt_tokens").cast("bigint"), F.col("attempts").cast("bigint"), "generations", final["context"].alias("context"),
    )


def summary(found: DataFrame) -> DataFrame:
    """One row, zeros for no results: total_items, succeeded, failed, and tokens over all results."""
    kinds = {"total_input_tokens": "input_tokens", "total_output_tokens": "output_tokens", "total_tokens": "total_tokens", "cached_input_tokens": "cached_input_tokens"}
    return found.agg(F.count("*").alias("total_items"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), *[F.coalesce(F.sum(F.coalesce(F.col(f"token_usage.{k}"), F.lit(0))), F.lit(0)).cast("bigint").alias(a) for a, k in kinds.items()])


def error_counts(found: DataFrame) -> DataFrame:
    """Failures by the error text before its first colon."""
    return found.where("not success and error is not null").groupBy(F.substring_index("error", ":", 1).alias("error_type")).agg(F.count("*").alias("n"))


def events(attempts: DataFrame) -> DataFrame:
    """Rows (event, item_id, attempt, generation, ts, duration, error_type) as observers get them: an item starts with each
    attempt; only non-retryable failures are ITEM_FAILED."""
    kinds = F.array(
        F.lit("ITEM_STARTED"),
        F.when(F.col("state") == "success", "ITEM_COMPLETED").when(F.col("state") == "failed_final", "ITEM_FAILED").when(F.col("state") == "rate_limited", "RATE_LIMIT_HIT"),
    )
    rows = attempts.select(F.explode(F.array_compact(kinds)).alias("event"), "item_id", "attempt", "generation", "partition_id", "started_at", "duration", "error_type", "tokens")
    return rows.withColumn("ts", F.timestamp_seconds(F.col("started_at") + F.when(F.col("event") == "ITEM_STARTED", 0.0).otherwise(F.col("duration"))))


def run_events(attempts: DataFrame) -> DataFrame:
    """Rows (event, partition_id, ts, duration, consecutive) of what is not about one item: cooldowns, workers
    (a partition's first and last attempt) and the batch (those of all). An empty log has none."""
    end = F.col("started_at") + F.col("duration")
    no_int, no_double = F.lit(None).cast("int"), F.lit(None).cast("double")

    def two(rows: DataFrame, first: str, last: str, partition, duration, consecutive) -> DataFrame:
        both = F.array(F.struct(F.lit(first).alias("event"), F.col("begin").alias("at")), F.struct(F.lit(last).alias("event"), F.col("end").alias("at")))
        return rows.select(F.explode(both).alias("e"), partition.alias("partition_id"), duration.alias("duration"), consecutive.alias("consecutive")).select("e.event", "partition_id", F.timestamp_seconds("e.at").alias("ts"), "duration", "consecutive")

    pauses = attempts.where("cooldown is not null").select(end.alias("begin"), (end + F.col("cooldown")).alias("end"), "partition_id", "cooldown", "consecutive")
    spans = [F.min("started_at").alias("begin"), F.max(end).alias("end")]
    workers, batch = attempts.groupBy("partition_id").agg(*spans), attempts.agg(*spans).where("begin is not null")
    return (
        two(pauses, "COOLDOWN_STARTED", "COOLDOWN_ENDED", F.col("partition_id"), F.col("cooldown"), F.col("consecutive"))
        .union(two(workers, "WORKER_STARTED", "WORKER_STOPPED", F.col("partition_id"), F.col("end") - F.col("begin"), no_int))
        .union(two(batch, "BATCH_STARTED", "BATCH_COMPLETED", no_int, F.col("end") - F.col("begin"), no_int))
        .select("event", "partition_id", "ts", F.coalesce("duration", no_double).alias("duration"), "consecutive")
    )


def all_events(attempts: DataFrame) -> DataFrame:
    """``events`` and ``run_events``."""
    return events(attempts).unionByName(run_events(attempts), allowMissingColumns=True)


def since(log: DataFrame, ts) -> DataFrame:
    """The events after ``ts``: metrics of these start from zero, as after a reset."""
    return log.where(F.col("ts") > F.lit(ts))


def metrics_dict(one: DataFrame, errors: DataFrame | None = None) -> dict:
    """The one row of ``metrics`` as a dict, with ``error_counts`` if they are given (a row for each type)."""
    out = one.first().asDict()
    return out if errors is None else out | {"error_counts": {r["error_type"]: r["n"] for r in errors.collect()}}


def metrics(log: DataFrame) -> DataFrame:
    """One row over events: what an observer that counts events has."""

    def n(event: str) -> Column:
        return F.count_if(F.col("event") == event)

    done = n("ITEM_COMPLETED") + n("ITEM_FAILED")
    spent = F.coalesce(F.avg(F.when(F.col("event") == "ITEM_COMPLETED", F.col("duration"))), F.lit(0.0))
    return log.agg(
        done.alias("items_processed"), n("ITEM_COMPLETED").alias("items_succeeded"), n("ITEM_FAILED").alias("items_failed"), n("RATE_LIMIT_HIT").alias("rate_limits_hit"),
        F.coalesce(F.sum(F.when(F.col("event") == "COOLDOWN_ENDED", F.col("duration"))), F.lit(0.0)).alias("total_cooldown_time"),
        n("ITEM_COMPLETED").alias("processing_times_count"), spent.alias("avg_processing_time"), F.coalesce(F.try_divide(n("ITEM_COMPLETED"), done), F.lit(0.0)).alias("success_rate"),
    )


#: Names, kinds and help texts of the exported metrics (fixed texts).
EXPORTED = (
    ("items_processed", "counter", "Total items processed"),
    ("items_succeeded", "counter", "Total items succeeded"),
    ("items_failed", "counter", "Total items failed"),
    ("rate_limits_hit", "counter", "Total rate limits encountered"),
    ("avg_processing_time", "gauge", "Average processing time in seconds"),
    ("success_rate", "gauge", "Success rate (0.0 to 1.0)"),
    ("total_cooldown_time", "gauge", "Total time spent in rate limit cooldown (seconds)"),
)


def metrics_json(one: DataFrame) -> DataFrame:
    return one.select(F.to_json(F.struct(*one.columns)).alias("json"))


def label_value(text: Column) -> Column:
    """A label's value as the text format wants it: backslashes, quotes and newlines escaped."""
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def metric_rows(one: DataFrame, errors: DataFrame, prefix: str = "loomcast") -> DataFrame:
    """name, kind, help, label, value: what the Prometheus text is made of."""
    plain = F.array(*[F.struct(F.lit(f"{prefix}_{n}").alias("name"), F.lit(k).alias("kind"), F.lit(h).alias("help"), F.lit("").alias("label"), F.col(n).cast("double").alias("value")) for n, k, h in EXPORTED])
    by_type = errors.select(F.lit(f"{prefix}_errors_total").alias("name"), F.lit("counter").alias("kind"), F.lit("Total errors by type").alias("help"), F.concat(F.lit('{error_type="'), label_value(F.col("error_type")), F.lit('"}')).alias("label"), F.col("n").cast("double").alias("value"))
    return one.select(F.inline(plain)).union(by_type)


def prometheus(rows: DataFrame) -> DataFrame:
    """One row: the text format, one block for each metric."""
    line = F.concat("name", "label", F.lit(" "), F.when(F.col("value") == F.floor("value"), F.col("value").cast("bigint").cast("string")).otherwise(F.col("value").cast("string")))
    blocks = rows.groupBy("name", "kind", "help").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    text = F.concat(F.lit("# HELP "), "name", F.lit(" "), "help", F.lit("\n# TYPE "), "name", F.lit(" "), "kind", F.lit("\n"), "lines", F.lit("\n"))
    return blocks.agg(F.array_join(F.array_sort(F.collect_list(text)), "\n").alias("text"))


def _range_of(order: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` are at most ``order``, by halves; nulls come after all."""

    def within(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(order < F.lit(bounds[mid]), within(lo, mid)).otherwise(within(mid + 1, hi))

    return F.when(order.isNull(), len(bounds) + 1).otherwise(within(0, len(bounds)))


def progress_points(rows: DataFrame, order: str, interval: int = 10) -> DataFrame:
    """item_id, completed, total at each ``interval``-th row by the number ``order``, nulls last, and among equal ones
    by item_id. Running numbers are made from counts of ranges of ``order``, so no task holds all rows. The
    ranges' bounds are fixed once: Spark's own ranges are sampled anew, with other bounds, each time they are made."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("item_id", order)
    found = rows.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else None
    dealt = rows.withColumn("part", _range_of(F.col(order), sorted(set(found or ()))))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    total = rows.agg(F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col(order).asc_nulls_last(), "item_id"))
    numbered = dealt.withColumn("place", place).join(F.broadcast(before), "part").withColumn("completed", F.col("place") + F.col("before"))
    return numbered.where(F.col("completed") % interval == 0).join(F.broadcast(total)).select("item_id", "completed", "total")


def consecutive_limits(log: DataFrame, limited: Column, key: str, order: str) -> DataFrame:
    """Rate limits of each ``key`` with ``consecutive``, their number since its last success, and the cooldown that follows."""
    w = Window.partitionBy(key).orderBy(order)
    island = F.sum(F.when(limited, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = log.withColumn("island", island).where(limited)
    n = F.row_number().over(Window.partitionBy(key, "island").orderBy(order))
    return runs.withColumn("consecutive", n).withColumn("cooldown", configured_cooldown(F.col("consecutive"))).drop("island")


def slow_start(log: DataFrame, limited: Column, key: str, order: str) -> DataFrame:
    """Items of each ``key`` after a rate limit, with ``since_resume`` and the delay of slow start."""
    w = Window.partitionBy(key).orderBy(order)
    resumes = F.sum(limited.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = log.withColumn("resumes", resumes).where(~limited & (F.col("resumes") > 0))
    since = F.row_number().over(Window.partitionBy(key, "resumes").orderBy(order)) - 1
    return after.withColumn("since_resume", since).withColumn("delay", slow_start_delay(F.col("since_resume"))).drop("resumes")


def validation_failures_before(attempts: DataFrame, is_validation: Column) -> DataFrame:
    """``attempts`` with ``earlier_validation_failures`` of the item."""
    w = Window.partitionBy("item_id").orderBy("generation", "attempt").rowsBetween(Window.unboundedPreceding, -1)
    return attempts.withColumn("earlier_validation_failures", F.coalesce(F.sum(is_validation.cast("int")).over(w), F.lit(0)))


def cost(input_price: float = 1e-5, output_price: float = 3e-5) -> Column:
    return F.col("token_usage.input_tokens") * input_price + F.col("token_usage.output_tokens") * output_price
