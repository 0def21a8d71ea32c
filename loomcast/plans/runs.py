"""Registered queries of what a run itself does: events, limits, escalation, detailed errors, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.config import EngineConfig, RetryConfig
from loomcast.functions import classify
from loomcast.functions.details import validation_errors
from loomcast.operators import stats
from loomcast.operators.infer import infer
from loomcast.operators.infer import run as run_infer
from loomcast.operators.limits import FixedDelay, RateLimitStrategy
from loomcast.operators.strategies import LadderStrategy, SimulatedEndpoint
from loomcast.plans.catalogue import LADDER, SIM, SIMULATED, SMART, TEMPERATURES, _log_path, attempt_table, docs, query
from loomcast.plans.plan import InferencePlan, Middleware
from loomcast.sources.log import read_attempts, read_table

SERIAL = EngineConfig(max_workers=1, time_scale=0.0, enable_detailed_logging=True)


class LadderedEndpoint(LadderStrategy):
    """The simulated endpoint, called by way of a ladder."""

    def __init__(self, smart: bool, inner: SimulatedEndpoint | None = None):
        super().__init__(list(zip(LADDER, TEMPERATURES, strict=True)), None, smart)
        self.inner = inner or SimulatedEndpoint()

    def for_item(self, item_id: str, generation: int) -> LadderedEndpoint:
        return LadderedEndpoint(self.smart, self.inner.for_item(item_id, generation))

    async def execute(self, prompt: str, attempt: int, timeout: float):
        return await self.inner.execute(prompt, attempt, timeout)


class FailingLimits(RateLimitStrategy):
    def cooldown(self, consecutive: int) -> float:
        raise RuntimeError("no cooldown today")


class ProviderEndpoint(SimulatedEndpoint):
    """The simulated endpoint with a provider's error types."""

    class ClientError(Exception): ...

    class ServerError(Exception): ...

    class UnexpectedModelBehavior(Exception): ...  # noqa: N818

    async def execute(self, prompt: str, attempt: int, timeout: float):
        b = self.bucket(attempt)
        if b < 5:
            raise self.ClientError("quota is used up")
        if b < 10:
            raise self.ClientError("400 INVALID_ARGUMENT")
        if b < 15:
            raise self.ServerError("500 INTERNAL")
        if b < 20:
            raise self.ServerError("DEADLINE exceeded")
        if b < 30:
            raise self.UnexpectedModelBehavior("too many retries")
        return "fine", {}


def serial_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of all documents with one worker a partition, a fixed cooldown and detailed errors; called once."""
    path = _log_path(id(spark), sf_dir) + "-serial"
    run_infer(docs(spark, sf_dir).withColumnRenamed("doc_id", "seq"), path, SIMULATED, SERIAL, limits=FixedDelay(2.0, 0.0))
    return read_attempts(spark, path)


def _laddered(spark: SparkSession, sf_dir: str, smart: bool) -> DataFrame:
    log = infer(docs(spark, sf_dir).drop("doc_id"), {"ladder": LadderedEndpoint(smart)}, EngineConfig(max_workers=32, time_scale=0.0))
    return log.select("item_id", "generation", "attempt", "model", "temperature")


@query(SIM + "SELECT item_id, generation, attempt, ['small', 'medium', 'large'][least(attempt, 3)] AS model, ([0.0, 0.25, 0.5][least(attempt, 3)])::DOUBLE AS temperature FROM attempts")
def operator_ladder_blind(spark, sf_dir):
    """Model and temperature in the log of a run whose strategy climbs with each attempt."""
    return _laddered(spark, sf_dir, smart=False)


@query(SIM + f"SELECT item_id, generation, attempt, ['small', 'medium', 'large'][least({SMART} + 1, 3)] AS model, ([0.0, 0.25, 0.5][least({SMART} + 1, 3)])::DOUBLE AS temperature FROM attempts")
def operator_ladder_smart(spark, sf_dir):
    """The same where only validation failures climb, those of earlier generations too."""
    return _laddered(spark, sf_dir, smart=True)


@query(
    SIM
    + """SELECT item_id, generation, attempt, 0::INTEGER AS depth, 'ValidationError' AS error_type,
    'reply -> ' || (('0x' || substring(md5(item_id || ':' || generation || ':' || attempt), 1, 8))::BIGINT % 100) AS path,
    'missing' AS type, 'field required' AS msg, substring(prompt, 1, 100) AS input, 'Mock response to: ' AS raw
    FROM attempts WHERE category = 'validation_error'"""
)
def validation_error_details(spark, sf_dir):
    """A row for each field that a validation error names."""
    return validation_errors(serial_table(spark, sf_dir))


@query(
    SIM
    + """, n AS (SELECT count(*) FILTER (WHERE category = 'rate_limit') AS n FROM attempts)
    SELECT event, n, 2.0::DOUBLE * n AS seconds FROM n, (VALUES ('COOLDOWN_STARTED'), ('COOLDOWN_ENDED')) e(event)"""
)
def cooldown_events(spark, sf_dir):
    """With one worker a partition, every rate limit begins a pause, and each ends."""
    found = stats.run_events(serial_table(spark, sf_dir)).where("event like 'COOLDOWN%'")
    return found.groupBy("event").agg(F.count("*").alias("n"), F.sum("duration").alias("seconds"))


@query(SIM + "SELECT 2.0::DOUBLE * count(*) FILTER (WHERE category = 'rate_limit') AS total_cooldown_time, count(*) FILTER (WHERE category = 'rate_limit') AS rate_limits_hit FROM attempts")
def cooldown_metrics(spark, sf_dir):
    return stats.metrics(stats.all_events(serial_table(spark, sf_dir))).select("total_cooldown_time", "rate_limits_hit")


@query("SELECT event, 1::BIGINT AS n, true AS spans FROM (VALUES ('BATCH_STARTED'), ('BATCH_COMPLETED')) e(event)")
def batch_events(spark, sf_dir):
    """One start and one end of the batch, between which all attempts lie."""
    log = attempt_table(spark, sf_dir)
    found = stats.run_events(log)
    batch = found.where("event like 'BATCH%'")
    ends = found.where("event like 'WORKER%'").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    spans = F.when(F.col("event") == "BATCH_STARTED", F.col("ts") <= F.col("first")).otherwise(F.col("ts") >= F.col("last"))
    return batch.join(F.broadcast(ends)).groupBy("event").agg(F.count("*").alias("n"), F.every(spans).alias("spans"))


@query("SELECT 2::BIGINT AS events_of_each, true AS started_and_stopped")
def worker_events(spark, sf_dir):
    """Every partition that called has one start and one stop."""
    found = stats.run_events(attempt_table(spark, sf_dir)).where("event like 'WORKER%'").groupBy("partition_id").agg(F.count("*").alias("n"), F.countDistinct("event").alias("kinds"))
    return found.agg(F.max("n").alias("events_of_each"), F.every((F.col("n") == 2) & (F.col("kinds") == 2)).alias("started_and_stopped"))


@query(SIM + "SELECT count(*) AS finished, 0.0::DOUBLE AS cooldown FROM results")
def failing_limit_strategy(spark, sf_dir):
    """A rate-limit strategy that raises means pauses of no length; all items end."""
    log = infer(docs(spark, sf_dir).drop("doc_id"), SIMULATED, EngineConfig(max_workers=32, retry=RetryConfig(initial_wait=1e-3, max_wait=1e-3)), limits=FailingLimits())
    return log.agg(F.count_if(F.col("state").isin("success", "failed_final", "exhausted")).alias("finished"), F.coalesce(F.sum("cooldown"), F.lit(0.0)).alias("cooldown"))


_B = "('0x' || substring(md5('doc_' || doc_id || ':1:1'), 1, 8))::BIGINT % 100"


@query(
    f"""SELECT category, count(*) AS n FROM (SELECT CASE WHEN b < 5 THEN 'rate_limit' WHEN b < 10 THEN 'client_error' WHEN b < 15 THEN 'server_error'
    WHEN b < 20 THEN 'server_timeout' WHEN b < 30 THEN 'validation_error' ELSE 'none' END AS category FROM (SELECT {_B} AS b FROM documents)) GROUP BY 1"""
)
def provider_classifier(spark, sf_dir):
    """The first attempts of a run that is classified by the provider cascade."""
    log = infer(docs(spark, sf_dir).drop("doc_id"), {"p": ProviderEndpoint()}, EngineConfig(max_workers=32, time_scale=0.0), classifier=classify.classify_provider)
    first = log.where("generation = 1 and attempt = 1")
    return first.groupBy(F.coalesce("error.error_category", F.lit("none")).alias("category")).agg(F.count("*").alias("n"))


@query(
    SIM
    + """, m AS (SELECT count(*) FILTER (WHERE state = 'success') AS s, count(*) FILTER (WHERE state = 'failed_final') AS f, count(*) FILTER (WHERE state = 'rate_limited') AS r FROM attempts)
    SELECT unnest(['items_processed', 'items_succeeded', 'items_failed', 'rate_limits_hit']) AS name, unnest([s + f, s, f, r]) AS value FROM m
    UNION ALL SELECT 'error ' || split_part(error, ':', 1), count(*) FROM results WHERE NOT success GROUP BY 1"""
)
def metrics_dict(spark, sf_dir):
    """The dict export of the metrics, a row for each entry."""
    log = attempt_table(spark, sf_dir)
    found = stats.metrics_dict(stats.metrics(stats.events(log)), stats.error_counts(stats.results(log)))
    rows = [(k, int(found[k])) for k in ("items_processed", "items_succeeded", "items_failed", "rate_limits_hit")]
    return spark.createDataFrame(rows + [(f"error {k}", n) for k, n in found["error_counts"].items()], "name string, value long")


@query("SELECT 0::BIGINT AS items_processed, 0.0::DOUBLE AS total_cooldown_time")
def metrics_reset(spark, sf_dir):
    """Metrics of what came after the last event: all zero."""
    log = stats.all_events(serial_table(spark, sf_dir))
    last = log.agg(F.max("ts")).first()[0]
    return stats.metrics(stats.since(log, last)).select("items_processed", "total_cooldown_time")


@query(r"""SELECT k, replace(replace(replace(v, '\', '\\'), '"', '\"'), chr(10), '\n') AS label FROM (VALUES (1, 'plain'), (2, 'a"b'), (3, 'c\d'), (4, 'e' || chr(10) || 'f'), (5, '\"')) t(k, v)""")
def metric_labels(spark, sf_dir):
    rows = spark.createDataFrame([(1, "plain"), (2, 'a"b'), (3, "c\\d"), (4, "e\nf"), (5, '\\"')], "k int, v string")
    return rows.select("k", stats.label_value(F.col("v")).alias("label"))


class Loud(Middleware):
    """A word before prompts, no texts from crawls, a mark on outputs, an answer for timeouts."""

    def before(self, items):
        return items.withColumn("prompt", F.concat(F.lit("LOUD "), "prompt"))

    def skip(self):
        return F.col("source") == "crawl"

    def after(self, results):
        return results.withColumn("output", F.concat("output", F.lit("!")))

    def on_error(self):
        return F.when(F.col("error").startswith("FrameworkTimeoutError"), "late")


class Broken(Middleware):
    """Hooks that fail change nothing."""

    def before(self, items):
        return items.withColumn("prompt", F.col("no_such_column"))

    def after(self, results):
        return results.select("output")


@query(
    SIM
    + """SELECT r.item_id, source <> 'crawl' AND (success OR error LIKE 'FrameworkTimeoutError%') AS success,
    CASE WHEN source = 'crawl' THEN NULL WHEN success THEN 'Mock response to: ' || substring('LOUD ' || text, 1, 50) || '!' WHEN error LIKE 'FrameworkTimeoutError%' THEN 'late!' END AS output
    FROM results r JOIN (SELECT 'doc_' || doc_id AS item_id, text, source FROM documents) USING (item_id)"""
)
def middleware(spark, sf_dir):
    """One middleware with all hooks, between two whose hooks fail."""
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        plan = InferencePlan(docs(spark, sf_dir, "source").drop("doc_id"), SIMULATED, EngineConfig(max_workers=32, time_scale=0.0)).use(Broken()).use(Loud()).use(Middleware())
        return plan.run(_log_path(id(spark), sf_dir) + "-middleware").select("item_id", "success", "output")


_COPIES = "SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS model FROM documents"


@query(
    f"""SELECT 'doc_' || doc_id AS item_id, 'Mock response to: ' || substring(text, 1, 50) AS output, 'context ' || doc_id AS context, model,
    (SELECT count(*) FROM (SELECT DISTINCT text, model FROM ({_COPIES}))) AS calls FROM ({_COPIES})"""
)
def prompt_dedupe_by_call(spark, sf_dir):
    """Prompts are called once for each model, and every item keeps its own context."""
    path = _log_path(id(spark), sf_dir) + "-dedupe"
    items = docs(spark, sf_dir).withColumn("model", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b")).withColumn("context", F.concat(F.lit("context "), "doc_id"))
    plan = InferencePlan(items.drop("doc_id"), {"sim": SimulatedEndpoint(failures=False)}, EngineConfig(max_workers=32, time_scale=0.0)).dedupe_prompts()
    found = plan.run(path)
    calls = read_attempts(spark, path).where("state = 'success'").agg(F.count("*").alias("calls"))
    return found.join(items.select("item_id", "model"), "item_id").join(F.broadcast(calls)).select("item_id", "output", "context", "model", "calls")


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars, grouping_id(lang, source)::BIGINT AS grouping FROM documents GROUP BY CUBE (lang, source)")
def batch_cube(spark, sf_dir):
    cubed = read_table(spark, sf_dir, "documents").cube("lang", "source")
    return cubed.agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id("lang", "source").alias("grouping"))


@query("SELECT event_type, true AS close FROM events GROUP BY 1")
def approximate_users(spark, sf_dir):
    """Approximate distinct counts, within 15 % of the exact ones (their standard error is 5 %)."""
    users = read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.05).alias("about"), F.countDistinct("user_id").alias("exact"))
    return users.select("event_type", (F.abs(F.col("about") - F.col("exact")) <= 0.15 * F.col("exact")).alias("close"))
