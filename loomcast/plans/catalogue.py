"""The registered queries of the engine's own operators, each with the SQL that states the same."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.config import EngineConfig, RetryConfig
from loomcast.functions import classify, schedule
from loomcast.operators import items as I
from loomcast.operators import stats
from loomcast.operators.infer import infer
from loomcast.operators.infer import run as run_infer
from loomcast.operators.strategies import SimulatedEndpoint
from loomcast.plans.plan import InferencePlan, dry_run_output, skipped_results, word_count
from loomcast.plans.rounds import run_rounds
from loomcast.sources.log import read_table, remaining

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CONFIG = EngineConfig(max_workers=32, time_scale=0.0)
SIMULATED = {"sim": SimulatedEndpoint()}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def docs(spark: SparkSession, sf_dir: str, *context: str) -> DataFrame:
    """Documents as work items."""
    rows = read_table(spark, sf_dir, "documents")
    return I.work_items(rows, F.concat(F.lit("doc_"), F.col("doc_id").cast("string")), F.col("text"), "doc_id", *context)


@functools.cache
def _log_path(session: int, sf_dir: str) -> str:
    import tempfile
    import uuid

    spark = SparkSession.active()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomcast-log-")
    return f"{root.rstrip('/')}/attempts-{uuid.uuid4().hex}"


def attempt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of all documents against the simulated endpoint: called once for a session and directory, then read."""
    from loomcast.sources.log import read_attempts

    path = _log_path(id(spark), sf_dir)
    items = docs(spark, sf_dir).withColumnRenamed("doc_id", "seq")
    if not remaining(items, spark, path).isEmpty():
        run_infer(items, path, SIMULATED, CONFIG)
    return read_attempts(spark, path)


SIM = """
WITH RECURSIVE a AS (
    SELECT 'doc_' || doc_id AS item_id, coalesce(text, '') AS prompt, 1 AS generation, 1 AS attempt,
        ('0x' || substring(md5('doc_' || doc_id || ':1:1'), 1, 8))::BIGINT % 100 AS b
    FROM documents
    UNION ALL
    SELECT item_id, prompt, g, t, ('0x' || substring(md5(item_id || ':' || g || ':' || t), 1, 8))::BIGINT % 100
    FROM (SELECT item_id, prompt, CASE WHEN b < 5 THEN generation + 1 ELSE generation END AS g, CASE WHEN b < 5 THEN 1 ELSE attempt + 1 END AS t
          FROM a WHERE b < 5 OR (b < 40 AND attempt < 3))
), attempts AS (
    SELECT item_id, prompt, generation, attempt,
        CASE WHEN b < 5 THEN 'rate_limited' WHEN b < 40 AND attempt < 3 THEN 'retry' WHEN b < 40 THEN 'exhausted' WHEN b < 45 THEN 'failed_final' ELSE 'success' END AS state,
        CASE WHEN b < 5 THEN 'RuntimeError' WHEN b < 15 THEN 'FrameworkTimeoutError' WHEN b < 25 THEN 'ConnectionError' WHEN b < 40 THEN 'ValidationError' WHEN b < 45 THEN 'ValueError' END AS error_type,
        CASE WHEN b < 5 THEN '429 RESOURCE_EXHAUSTED: simulated' WHEN b < 15 THEN 'simulated time limit' WHEN b < 25 THEN 'simulated connection reset' WHEN b < 40 THEN 'simulated result validation failure' WHEN b < 45 THEN 'simulated logic error' END AS error_message,
        CASE WHEN b < 5 THEN 'rate_limit' WHEN b < 15 THEN 'framework_timeout' WHEN b < 25 THEN 'connection_error' WHEN b < 40 THEN 'validation_error' WHEN b < 45 THEN 'logic_error' END AS category,
        CASE WHEN b >= 45 THEN 'Mock response to: ' || substring(prompt, 1, 50) END AS output,
        CASE WHEN b >= 45 THEN len(regexp_extract_all(prompt, '\\S+')) ELSE 0 END AS input_tokens,
        CASE WHEN b >= 45 THEN 50 ELSE 0 END AS output_tokens
    FROM a
), results AS (
    SELECT item_id, state = 'success' AS success, output, error_type || ': ' || error_message AS error, input_tokens, output_tokens, generation,
        count(*) OVER (PARTITION BY item_id) AS n FROM attempts
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY generation DESC, attempt DESC) = 1
)
"""


@query("SELECT 'doc_' || doc_id AS item_id, 'Summarise this ' || lang || ' text from ' || source || ': ' || text AS prompt, lang, source FROM documents")
def work_items(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents")
    return I.work_items(rows, F.concat(F.lit("doc_"), F.col("doc_id").cast("string")), I.template("Summarise this %s text from %s: %s", "lang", "source", "text"), "lang", "source")


BAD_ID = "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN NULL WHEN 3 THEN 'a/b:' || doc_id ELSE 'x' || doc_id END"


@query(f"SELECT length(regexp_replace(coalesce(i, ''), '\\s', '', 'g')) > 0 AS valid, count(*) AS n FROM (SELECT {BAD_ID} AS i FROM documents) GROUP BY 1")
def item_id_validation(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").select(F.expr(BAD_ID).alias("i"))
    return rows.groupBy(I.id_is_valid(F.col("i")).alias("valid")).agg(F.count("*").alias("n"))


@query("SELECT conv_id::VARCHAR AS item_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1")
def duplicate_item_ids(spark, sf_dir):
    return I.duplicate_ids(read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("item_id")))


@query("SELECT 'doc_' || doc_id AS item_id, '[DRY-RUN] Mock output for prompt: ' || substring(text, 1, 50) || '...' AS output, 100::BIGINT AS input_tokens, 50::BIGINT AS output_tokens FROM documents")
def dry_run_text(spark, sf_dir):
    return docs(spark, sf_dir).select("item_id", dry_run_output(F.col("prompt")).alias("output"), F.lit(100).cast("bigint").alias("input_tokens"), F.lit(50).cast("bigint").alias("output_tokens"))


@query("SELECT sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS input_tokens, (count(*) * 50)::BIGINT AS output_tokens, (sum(len(regexp_extract_all(text, '\\S+'))) + count(*) * 50)::BIGINT AS total_tokens FROM documents")
def dry_run_tokens(spark, sf_dir):
    n = word_count(F.col("prompt"))
    return docs(spark, sf_dir).agg(F.sum(n).alias("input_tokens"), (F.count("*") * 50).alias("output_tokens"), (F.sum(n) + F.count("*") * 50).alias("total_tokens"))


@query("SELECT count(*) AS total_items, count(*) AS succeeded, 0::BIGINT AS failed, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS total_input_tokens, (count(*) * 50)::BIGINT AS total_output_tokens, (sum(len(regexp_extract_all(text, '\\S+'))) + count(*) * 50)::BIGINT AS total_tokens, 0::BIGINT AS cached_input_tokens FROM documents")
def infer_basic(spark, sf_dir):
    """The flagship: every document through the operator, one pass, and the summary of its results."""
    return stats.summary(stats.results(infer(docs(spark, sf_dir), {"sim": SimulatedEndpoint(failures=False)}, CONFIG)))


@query(SIM + "SELECT item_id, success, output, error, input_tokens::BIGINT AS input_tokens, output_tokens::BIGINT AS output_tokens, n AS attempts, generation AS generations FROM results")
def infer_results(spark, sf_dir):
    found = stats.results(attempt_table(spark, sf_dir))
    return found.select("item_id", "success", "output", "error", "token_usage.input_tokens", "token_usage.output_tokens", "attempts", "generations")


@query(SIM + "SELECT item_id, generation, attempt, state, error_type, error_message, category FROM attempts")
def attempt_log(spark, sf_dir):
    return attempt_table(spark, sf_dir).select("item_id", "generation", "attempt", "state", "error_type", "error_message", F.col("error.error_category").alias("category"))


@query("SELECT 'doc_' || doc_id AS item_id, '<outer><inner>Mock response to: ' || substring('[2][1]' || text, 1, 50) || '</inner></outer>' AS output FROM documents")
def before_rewrite(spark, sf_dir):
    plan = InferencePlan(docs(spark, sf_dir), {"sim": SimulatedEndpoint(failures=False)}, CONFIG)
    for k in (1, 2):
        plan = plan.before(lambda d, k=k: d.withColumn("prompt", F.concat(F.lit(f"[{k}]"), "prompt")))
    for tag in ("outer", "inner"):
        plan = plan.after(lambda d, tag=tag: d.withColumn("output", F.concat(F.lit(f"<{tag}>"), "output", F.lit(f"</{tag}>"))))
    return plan.finish(stats.results(plan.attempts())).select("item_id", "output")


@query(SIM + """SELECT r.item_id, CASE WHEN toxic THEN false ELSE success END AS success, CASE WHEN toxic THEN 'Skipped by middleware' ELSE error END AS error
FROM results r JOIN (SELECT 'doc_' || doc_id AS item_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM documents) USING (item_id)""")
def skip_filter(spark, sf_dir):
    toxic = read_table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("bad_id")).distinct()
    marked = docs(spark, sf_dir).join(toxic, F.col("doc_id") == F.col("bad_id"), "left").withColumn("toxic", F.col("bad_id").isNotNull()).drop("bad_id")
    plan = InferencePlan(marked, SIMULATED, CONFIG).skip(F.col("toxic"))
    found = stats.results(plan.attempts()).unionByName(skipped_results(plan.prepared()[1]))
    return plan.finish(found).select("item_id", "success", "error")


@query(SIM + "SELECT item_id, success OR error LIKE 'ValueError%' OR error LIKE 'ConnectionError%' AS success, CASE WHEN success THEN output WHEN error LIKE 'ValueError%' THEN 'fallback for ' || item_id WHEN error LIKE 'ConnectionError%' THEN 'offline' END AS output, CASE WHEN NOT success AND error NOT LIKE 'ValueError%' AND error NOT LIKE 'ConnectionError%' THEN error END AS error FROM results")
def on_error_recover(spark, sf_dir):
    plan = InferencePlan(docs(spark, sf_dir), SIMULATED, CONFIG)
    plan = plan.on_error(F.when(F.col("error").startswith("ValueError"), F.concat(F.lit("fallback for "), "item_id"))).on_error(F.when(F.col("error").startswith("ConnectionError"), "offline"))
    return plan.finish(stats.results(attempt_table(spark, sf_dir))).select("item_id", "success", "output", "error")


#: Error types, their ancestors and messages that try the cascades' order.
CASES = [
    ("TimeoutError", "TimeoutError,OSError,Exception", "Operation timed out"),
    ("Exception", "Exception", "429 RESOURCE_EXHAUSTED: quota exceeded"),
    ("ConnectionError", "ConnectionError,OSError,Exception", "refused"),
    ("ValueError", "ValueError,Exception", "bad value"),
    ("Exception", "Exception", "504 Gateway Timeout"),
    ("Exception", "Exception", "Some random error"),
    ("FrameworkTimeoutError", "FrameworkTimeoutError,TimeoutError,OSError,Exception", "exceeded after 429.0s"),
    ("ValidationError", "ValidationError,ValueError,Exception", "1 validation error"),
    ("ValidationError", "ValidationError,ValueError,Exception", "Rate Limit in field"),
    ("KeyError", "KeyError,LookupError,Exception", "'x'"),
    ("ZeroDivisionError", "ZeroDivisionError,ArithmeticError,Exception", "division by zero"),
    ("ClientError", "ClientError,APIError,Exception", "400 INVALID_ARGUMENT"),
    ("ClientError", "ClientError,APIError,Exception", "quota is used up"),
    ("ServerError", "ServerError,APIError,Exception", "500 INTERNAL"),
    ("ServerError", "ServerError,APIError,Exception", "DEADLINE exceeded"),
    ("UnexpectedModelBehavior", "UnexpectedModelBehavior,Exception", "Exceeded maximum retries for result validation"),
    ("RuntimeError", "RuntimeError,Exception", "lost Connection to host"),
    ("RuntimeError", "RuntimeError,Exception", None),
    ("IndexError", "IndexError,LookupError,Exception", "request timeout"),
]
CASE_ROWS = "(VALUES " + ", ".join(f"({k}, '{t}', '{m}', " + (("'" + x.replace("'", "''") + "'") if x is not None else "NULL") + ")" for k, (t, m, x) in enumerate(CASES)) + ") c(case_no, error_type, mro, message)"
_MRO = "list_has_any(string_split(mro, ','), [{}])"
_LIMIT = "(m LIKE '%429%' OR m LIKE '%resource\\_exhausted%' ESCAPE '\\' OR m LIKE '%quota%' OR m LIKE '%rate limit%')"
_LATE = "(m LIKE '%timeout%' OR m LIKE '%504%' OR m LIKE '%deadline%')"
_LOGIC = _MRO.format(", ".join(f"'{n}'" for n in classify.LOGIC_TYPES))
DEFAULT_SQL = f"""CASE WHEN {_MRO.format("'FrameworkTimeoutError'")} THEN 'framework_timeout' WHEN {_LIMIT} THEN 'rate_limit' WHEN {_MRO.format("'TimeoutError'")} OR m LIKE '%timeout%' THEN 'api_timeout'
WHEN {_MRO.format("'ConnectionError'")} OR m LIKE '%connection%' THEN 'connection_error' WHEN {_MRO.format("'ValidationError'")} THEN 'validation_error' WHEN {_LOGIC} THEN 'logic_error' ELSE 'unknown' END"""
PROVIDER_SQL = f"""CASE WHEN {_MRO.format("'FrameworkTimeoutError'")} THEN 'framework_timeout' WHEN {_MRO.format("'ClientError'")} THEN CASE WHEN {_LIMIT} THEN 'rate_limit' ELSE 'client_error' END
WHEN {_MRO.format("'ServerError'")} THEN CASE WHEN {_LATE} THEN 'server_timeout' ELSE 'server_error' END WHEN {_MRO.format("'UnexpectedModelBehavior'")} THEN 'validation_error'
WHEN {_LIMIT} THEN 'rate_limit' WHEN {_LATE} THEN 'timeout' WHEN {_MRO.format("'ValidationError'")} THEN 'validation_error' WHEN {_LOGIC} THEN 'logic_error' ELSE 'unknown' END"""


def _cases(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(k, t, m.split(","), x) for k, (t, m, x) in enumerate(CASES)], "case_no int, error_type string, mro array<string>, message string")
    return rows.withColumn("no_wait", classify.is_validation(F.col("error_type"), F.col("message"), F.lit(None).cast("string")))


def _flags(category: str) -> str:
    return f"{category} NOT IN ('rate_limit', 'logic_error', 'server_error') AS is_retryable, {category} = 'rate_limit' AS is_rate_limit, {category} IN ('framework_timeout', 'api_timeout', 'timeout', 'server_timeout') AS is_timeout, {category} AS error_category, CASE WHEN {category} = 'rate_limit' THEN 300.0::DOUBLE END AS suggested_wait"


@query(f"SELECT case_no, {_flags('category')} FROM (SELECT *, {DEFAULT_SQL} AS category FROM (SELECT *, lower(coalesce(message, '')) AS m FROM {CASE_ROWS}))")
def classify_default(spark, sf_dir):
    return _cases(spark).select("case_no", classify.error_struct(classify.default_category(F.col("mro"), F.col("message"))).alias("e")).select("case_no", "e.*")


@query(f"SELECT case_no, {_flags('category')} FROM (SELECT *, {PROVIDER_SQL} AS category FROM (SELECT *, lower(coalesce(message, '')) AS m FROM {CASE_ROWS}))")
def classify_provider(spark, sf_dir):
    return _cases(spark).select("case_no", classify.error_struct(classify.provider_category(F.col("mro"), F.col("message"))).alias("e")).select("case_no", "e.*")


@query(f"SELECT category, count(*) AS n FROM (SELECT {DEFAULT_SQL} AS category FROM (SELECT 'Exception' AS mro, lower(text) AS m FROM documents)) GROUP BY 1")
def classify_documents(spark, sf_dir):
    category = classify.default_category(F.array(F.lit("Exception")), F.col("text"))
    return read_table(spark, sf_dir, "documents").groupBy(category.alias("category")).agg(F.count("*").alias("n"))


@query("SELECT attempt::INTEGER AS attempt, round(least(1.0 * power(2.0, attempt - 1), 60.0), 6)::DOUBLE AS wait FROM range(1, 11) t(attempt)")
def retry_schedule(spark, sf_dir):
    return spark.range(1, 11).select(F.col("id").cast("int").alias("attempt")).withColumn("wait", F.round(schedule.retry_wait(F.col("attempt"), RetryConfig(jitter=False)), 6))


@query(SIM + "SELECT item_id, round(sum(CASE WHEN state <> 'retry' OR category = 'validation_error' THEN 0 ELSE least(power(2.0, attempt - 1), 60.0) END), 6)::DOUBLE AS waited FROM attempts GROUP BY 1")
def retry_wait_per_item(spark, sf_dir):
    no_wait = classify.is_validation(F.col("error_type"), F.col("error_message"), F.col("error.error_category"))
    wait = F.when(F.col("state") == "retry", schedule.retry_wait(F.col("attempt"), RetryConfig(jitter=False), no_wait)).otherwise(0.0)
    return attempt_table(spark, sf_dir).groupBy("item_id").agg(F.round(F.sum(wait), 6).alias("waited"))


@query("SELECT n::INTEGER AS consecutive, round(least(300.0 * power(1.5, n - 1), 600.0), 6)::DOUBLE AS configured, round(least(60.0 * power(2.0, n - 1), 600.0), 6)::DOUBLE AS exponential, 300.0::DOUBLE AS fixed FROM range(1, 9) t(n)")
def cooldown_schedule(spark, sf_dir):
    n = F.col("consecutive")
    return spark.range(1, 9).select(F.col("id").cast("int").alias("consecutive")).select(n, F.round(schedule.configured_cooldown(n), 6).alias("configured"), F.round(schedule.exponential_cooldown(n), 6).alias("exponential"), schedule.fixed_cooldown().alias("fixed"))


@query("SELECT i::INTEGER AS since_resume, round(CASE WHEN i < 50 THEN greatest(0.1, 2.0 - (2.0 - 0.1) * i / 50) ELSE 0 END, 6)::DOUBLE AS delay FROM range(0, 61) t(i)")
def slow_start_schedule(spark, sf_dir):
    return spark.range(0, 61).select(F.col("id").cast("int").alias("since_resume")).withColumn("delay", F.round(schedule.slow_start_delay(F.col("since_resume")), 6))


@query("""SELECT event_id, consecutive, round(least(300.0 * power(1.5, consecutive - 1), 600.0), 6)::DOUBLE AS cooldown FROM (
SELECT event_id, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id)::INTEGER AS consecutive FROM (
SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events) WHERE event_type = 'error')""")
def consecutive_limits(spark, sf_dir):
    found = stats.consecutive_limits(read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), F.col("event_type") == "error", "user_id", "event_id")
    return found.select("event_id", "consecutive", F.round("cooldown", 6).alias("cooldown"))


@query("""SELECT event_id, since_resume, round(CASE WHEN since_resume < 50 THEN greatest(0.1, 2.0 - 1.9 * since_resume / 50) ELSE 0 END, 6)::DOUBLE AS delay FROM (
SELECT event_id, (row_number() OVER (PARTITION BY user_id, r ORDER BY event_id) - 1)::INTEGER AS since_resume FROM (
SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE event_type <> 'error' AND r > 0)""")
def slow_start_assignment(spark, sf_dir):
    found = stats.slow_start(read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), F.col("event_type") == "error", "user_id", "event_id")
    return found.select("event_id", "since_resume", F.round("delay", 6).alias("delay"))


SUMMARY = "count(*) AS total_items, count(*) FILTER (WHERE success) AS succeeded, count(*) FILTER (WHERE NOT success) AS failed, coalesce(sum(input_tokens), 0)::BIGINT AS total_input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS total_output_tokens, coalesce(sum(input_tokens + output_tokens), 0)::BIGINT AS total_tokens, 0::BIGINT AS cached_input_tokens"


@query(SIM + f"SELECT {SUMMARY} FROM results")
def batch_summary(spark, sf_dir):
    return stats.summary(stats.results(attempt_table(spark, sf_dir)))


@query(SIM + f"SELECT {SUMMARY} FROM results WHERE false")
def batch_summary_empty(spark, sf_dir):
    return stats.summary(stats.results(attempt_table(spark, sf_dir).where("false")))


@query(SIM + "SELECT split_part(error, ':', 1) AS error_type, count(*) AS n FROM results WHERE NOT success GROUP BY 1")
def error_counts(spark, sf_dir):
    return stats.error_counts(stats.results(attempt_table(spark, sf_dir)))


@query(SIM + "SELECT item_id, count(*) AS attempts, sum(CASE WHEN state = 'success' THEN input_tokens + output_tokens ELSE 0 END)::BIGINT AS success_tokens, sum(CASE WHEN state <> 'success' THEN input_tokens + output_tokens ELSE 0 END)::BIGINT AS failed_attempt_tokens FROM attempts GROUP BY 1 HAVING count(*) FILTER (WHERE state <> 'retry' AND state <> 'rate_limited') > 0")
def token_accounting(spark, sf_dir):
    found = stats.results(attempt_table(spark, sf_dir))
    return found.select("item_id", "attempts", F.col("token_usage.total_tokens").alias("success_tokens"), "failed_attempt_tokens")


@query(SIM + "SELECT count(*) FILTER (WHERE state IN ('success', 'failed_final')) AS items_processed, count(*) FILTER (WHERE state = 'success') AS items_succeeded, count(*) FILTER (WHERE state = 'failed_final') AS items_failed, count(*) FILTER (WHERE state = 'rate_limited') AS rate_limits_hit, count(*) AS started, round(coalesce(count(*) FILTER (WHERE state = 'success') / count(*) FILTER (WHERE state IN ('success', 'failed_final')), 0), 6) AS success_rate, (SELECT count(*) FROM results WHERE NOT success) AS failed_results FROM attempts")
def metrics_events(spark, sf_dir):
    """What observers count, and beside it the failures among results, of which observers miss the exhausted ones."""
    log = attempt_table(spark, sf_dir)
    events = stats.events(log)
    failed = stats.results(log).agg(F.count_if(~F.col("success")).alias("failed_results"))
    started = events.agg(F.count_if(F.col("event") == "ITEM_STARTED").alias("started"))
    one = stats.metrics(events).withColumn("success_rate", F.round("success_rate", 6))
    return one.join(F.broadcast(started)).join(F.broadcast(failed)).select("items_processed", "items_succeeded", "items_failed", "rate_limits_hit", "started", "success_rate", "failed_results")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_value, round(quantile_cont(value, 0.5), 6) AS median_value, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def metrics_by_event_type(spark, sf_dir):
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"), F.round(F.percentile("value", 0.5), 6).alias("median_value"), F.countDistinct("user_id").alias("users"))


def _table_metrics(spark, sf_dir) -> DataFrame:
    """Metrics of the events table read as an event stream: purchases complete, errors fail, signups are limits, views are cooldowns."""
    names = {"purchase": "ITEM_COMPLETED", "error": "ITEM_FAILED", "signup": "RATE_LIMIT_HIT", "view": "COOLDOWN_ENDED"}
    event = functools.reduce(lambda c, k: c.when(F.col("event_type") == k, names[k]), names, F.when(F.lit(False), ""))
    return stats.metrics(read_table(spark, sf_dir, "events").select(event.alias("event"), F.col("value").alias("duration")))


@query()
def metrics_json(spark, sf_dir):
    return stats.metrics_json(_table_metrics(spark, sf_dir))


@query("""WITH m AS (SELECT count(*) FILTER (WHERE event_type IN ('purchase', 'error'))::DOUBLE AS p, count(*) FILTER (WHERE event_type = 'purchase')::DOUBLE AS s, count(*) FILTER (WHERE event_type = 'error')::DOUBLE AS f,
count(*) FILTER (WHERE event_type = 'signup')::DOUBLE AS r, coalesce(avg(value) FILTER (WHERE event_type = 'purchase'), 0) AS a, coalesce(sum(value) FILTER (WHERE event_type = 'view'), 0) AS c FROM events)
SELECT 'loomcast_items_processed' AS name, 'counter' AS kind, '' AS label, round(p, 4) AS value FROM m UNION ALL SELECT 'loomcast_items_succeeded', 'counter', '', round(s, 4) FROM m UNION ALL SELECT 'loomcast_items_failed', 'counter', '', round(f, 4) FROM m
UNION ALL SELECT 'loomcast_rate_limits_hit', 'counter', '', round(r, 4) FROM m UNION ALL SELECT 'loomcast_avg_processing_time', 'gauge', '', round(a, 4) FROM m UNION ALL SELECT 'loomcast_success_rate', 'gauge', '', round(coalesce(s / p, 0), 4) FROM m
UNION ALL SELECT 'loomcast_total_cooldown_time', 'gauge', '', round(c, 4) FROM m UNION ALL SELECT 'loomcast_errors_total', 'counter', '{error_type="' || event_type || '"}', count(*)::DOUBLE FROM events WHERE event_type = 'error' GROUP BY event_type""")
def metrics_prometheus(spark, sf_dir):
    errors = read_table(spark, sf_dir, "events").where("event_type = 'error'").groupBy(F.col("event_type").alias("error_type")).agg(F.count("*").alias("n"))
    return stats.metric_rows(_table_metrics(spark, sf_dir), errors).select("name", "kind", "label", F.round("value", 4).alias("value"))


@query()
def metrics_prometheus_text(spark, sf_dir):
    errors = read_table(spark, sf_dir, "events").where("event_type = 'error'").groupBy(F.col("event_type").alias("error_type")).agg(F.count("*").alias("n"))
    return stats.prometheus(stats.metric_rows(_table_metrics(spark, sf_dir), errors))


@query("SELECT item_id, completed, total FROM (SELECT 'doc_' || doc_id AS item_id, row_number() OVER (ORDER BY doc_id) AS completed, count(*) OVER () AS total FROM documents) WHERE completed % 10 = 0")
def progress_points(spark, sf_dir):
    return stats.progress_points(docs(spark, sf_dir), "doc_id", 10)


@query("SELECT count(*) AS processed, round(count(*) / nullif(epoch(max(ts)) - epoch(min(ts)), 0), 6) AS per_second FROM events")
def throughput(spark, sf_dir):
    span = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    return read_table(spark, sf_dir, "events").agg(F.count("*").alias("processed"), F.round(F.try_divide(F.count("*"), span / 1e6), 6).alias("per_second"))


TEMPERATURES = [0.0, 0.25, 0.5]
LADDER = ["small", "medium", "large"]
PRICES = {"small": 1.0, "medium": 2.0, "large": 10.0}


@query(SIM + "SELECT item_id, generation, attempt, ([0.0, 0.25, 0.5][least(attempt, 3)])::DOUBLE AS temperature FROM attempts")
def temperature_ladder(spark, sf_dir):
    return attempt_table(spark, sf_dir).select("item_id", "generation", "attempt", schedule.step(TEMPERATURES, F.col("attempt")).alias("temperature"))


@query(SIM + "SELECT item_id, generation, attempt, ['small', 'medium', 'large'][least(attempt, 3)] AS model, [0.0, 0.25, 0.5][least(attempt, 3)]::DOUBLE AS temperature FROM attempts")
def model_ladder_blind(spark, sf_dir):
    return attempt_table(spark, sf_dir).select("item_id", "generation", "attempt", schedule.step(LADDER, F.col("attempt")).alias("model"), schedule.step(TEMPERATURES, F.col("attempt")).alias("temperature"))


SMART = "coalesce(sum(CASE WHEN category = 'validation_error' THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY generation, attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER"


def _smart(spark, sf_dir) -> DataFrame:
    found = stats.validation_failures_before(attempt_table(spark, sf_dir), F.coalesce(F.col("error.error_category") == "validation_error", F.lit(False)))
    return found.withColumn("model", schedule.step(LADDER, F.col("earlier_validation_failures") + 1))


@query(SIM + f"SELECT item_id, generation, attempt, ['small', 'medium', 'large'][least({SMART} + 1, 3)] AS model FROM attempts")
def model_ladder_smart(spark, sf_dir):
    return _smart(spark, sf_dir).select("item_id", "generation", "attempt", "model")


@query(SIM + f""", laddered AS (SELECT ['small', 'medium', 'large'][least({SMART} + 1, 3)] AS model FROM attempts)
SELECT model, count(*) AS calls, sum(p)::DOUBLE AS units, round(100 * (1 - sum(p) / (count(*) * 10.0)), 4)::DOUBLE AS saved_percent FROM laddered JOIN (VALUES ('small', 1.0), ('medium', 2.0), ('large', 10.0)) v(model, p) USING (model) GROUP BY 1""")
def escalation_cost(spark, sf_dir):
    prices = spark.createDataFrame(list(PRICES.items()), "model string, p double")
    found = _smart(spark, sf_dir).join(F.broadcast(prices), "model").groupBy("model")
    return found.agg(F.count("*").alias("calls"), F.sum("p").alias("units"), F.round(100 * (1 - F.sum("p") / (F.count("*") * PRICES["large"])), 4).alias("saved_percent"))


@query(SIM + "SELECT round(sum(input_tokens * 1e-5 + output_tokens * 3e-5), 6)::DOUBLE AS dollars FROM results")
def token_cost(spark, sf_dir):
    return stats.results(attempt_table(spark, sf_dir)).agg(F.round(F.sum(stats.cost()), 6).alias("dollars"))


def _parsed(spark, sf_dir) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    # Every third reply is cut off, as a model's may be.
    raw = F.when(F.col("event_id") % 3 == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
    return rows.withColumn("raw", raw).withColumn("k", F.from_json("raw", "k INT, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})["k"])


_K = "CASE WHEN event_id % 3 <> 0 THEN (props->>'$.k')::INTEGER END"


@query(f"SELECT event_id, {_K} AS k, CASE WHEN {_K} IS NULL THEN 'missing' WHEN {_K} <= 0 OR {_K} >= 50 THEN 'range' ELSE 'ok' END AS verdict FROM events")
def structured_validation(spark, sf_dir):
    k = F.col("k")
    return _parsed(spark, sf_dir).select("event_id", "k", F.when(k.isNull(), "missing").when((k <= 0) | (k >= 50), "range").otherwise("ok").alias("verdict"))


@query(f"SELECT event_id, 'Fix these fields: ' || CASE WHEN {_K} IS NULL THEN 'k (field required)' ELSE 'k (must be between 1 and 49, got ' || {_K} || ')' END || '. Keep these: event_type=' || event_type AS prompt FROM events WHERE {_K} IS NULL OR {_K} <= 0 OR {_K} >= 50")
def smart_retry_prompt(spark, sf_dir):
    k = F.col("k")
    fault = F.when(k.isNull(), "k (field required)").otherwise(F.concat(F.lit("k (must be between 1 and 49, got "), k.cast("string"), F.lit(")")))
    return _parsed(spark, sf_dir).where(k.isNull() | (k <= 0) | (k >= 50)).select("event_id", F.concat(F.lit("Fix these fields: "), fault, F.lit(". Keep these: event_type="), "event_type").alias("prompt"))


@query("SELECT CASE WHEN lang = 'en' THEN 'fast' WHEN length(text) > 2000 THEN 'long' ELSE 'careful' END AS strategy, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def strategy_routing(spark, sf_dir):
    routed = I.route(docs(spark, sf_dir, "lang", "n_chars"), [(F.col("lang") == "en", "fast"), (F.length("prompt") > 2000, "long")], "careful")
    return routed.groupBy("strategy").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT 'doc_' || doc_id AS item_id, 'Mock response to: ' || substring(text, 1, 50) AS output, (SELECT count(DISTINCT text) FROM documents) AS calls FROM documents")
def prompt_dedupe(spark, sf_dir):
    plan = InferencePlan(docs(spark, sf_dir), {"sim": SimulatedEndpoint(failures=False)}, CONFIG).dedupe_prompts()
    call, _ = plan.prepared()
    log = plan.attempts().where("state = 'success'").select("prompt", "output")
    calls = call.select("prompt").distinct().agg(F.count("*").alias("calls"))
    return call.join(log, "prompt").join(F.broadcast(calls)).select("item_id", "output", "calls")


@query(SIM + "SELECT item_id FROM results WHERE NOT success")
def resume_anti_join(spark, sf_dir):
    done = stats.results(attempt_table(spark, sf_dir)).where("success").select("item_id")
    return docs(spark, sf_dir).join(done, "item_id", "left_anti").select("item_id")


@query("SELECT doc_id, k::INTEGER AS chunk_no, substring(text, k * 100 + 1, 100) AS chunk FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 100)::BIGINT)) AS k FROM documents)")
def chunk_documents(spark, sf_dir):
    return I.chunks(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "chunk_no", "chunk")


@query("""SELECT query_id, vec_id, score, rank FROM (SELECT q.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id)::INTEGER AS rank FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 2""")
def rag_topk(spark, sf_dir):
    base = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = base.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return I.nearest(queries, base, 2)


@query("SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn, text) FILTER (WHERE role = 'system'), '') AS system_prompt, coalesce(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role || ': ' || text) FILTER (WHERE role <> 'system'), '') AS prompt FROM conversations GROUP BY 1")
def conversation_prompts(spark, sf_dir):
    return I.conversation_prompts(read_table(spark, sf_dir, "conversations"))


@query(SIM + ", joined AS (SELECT d.lang, d.source, r.success, r.input_tokens FROM results r JOIN documents d ON r.item_id = 'doc_' || d.doc_id) SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE success) AS succeeded, sum(input_tokens)::BIGINT AS input_tokens FROM joined GROUP BY ROLLUP (lang, source)")
def batch_rollup(spark, sf_dir):
    context = docs(spark, sf_dir, "lang", "source").drop("prompt", "doc_id")
    joined = stats.results(attempt_table(spark, sf_dir)).select("item_id", "success", "token_usage.input_tokens").join(context, "item_id")
    return joined.rollup("lang", "source").agg(F.count("*").alias("n"), F.count_if("success").alias("succeeded"), F.sum("input_tokens").alias("input_tokens"))


@query("SELECT 'doc_' || doc_id AS item_id, lang, source, n_chars, 'safe' AS rating FROM documents")
def context_passthrough(spark, sf_dir):
    context = F.to_json(F.struct("lang", "source", "n_chars", F.create_map(F.lit("harm"), F.lit("safe")).alias("ratings")))
    items = docs(spark, sf_dir, "lang", "source", "n_chars").withColumn("context", context)
    found = stats.results(infer(items, {"sim": SimulatedEndpoint(failures=False)}, CONFIG))
    back = F.from_json("context", "lang string, source string, n_chars bigint, ratings map<string, string>").alias("c")
    return found.select("item_id", back).select("item_id", "c.lang", "c.source", "c.n_chars", F.col("c.ratings")["harm"].alias("rating"))


@query("SELECT 0::BIGINT AS differing")
def rounds_mode_equals_inline(spark, sf_dir):
    columns = ["item_id", "generation", "attempt", "state", "error_type", "output"]
    inline = attempt_table(spark, sf_dir).select(*columns)
    rounds = run_rounds(docs(spark, sf_dir).drop("doc_id"), _log_path(id(spark), sf_dir) + "-rounds", SIMULATED, EngineConfig(max_workers=32, time_scale=0.0)).select(*columns)
    # Each row counts as often as one log has it more than the other: exceptAll both ways, with one shuffle.
    both = inline.withColumn("n", F.lit(1)).union(rounds.withColumn("n", F.lit(-1))).groupBy(*columns).agg(F.abs(F.sum("n")).alias("n"))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("differing"))


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_events(spark, sf_dir):
    w = F.window(F.col("ts"), "1 hour")["start"]
    return read_table(spark, sf_dir, "events").groupBy("event_type", w.alias("hour")).agg(F.count("*").alias("n"))


@query("SELECT error_type, pos::BIGINT AS attempt_no, count(*) AS n FROM (" + "SELECT * FROM (" + SIM + "SELECT error_type, attempt AS pos FROM attempts WHERE error_type IS NOT NULL)) GROUP BY 1, 2")
def validation_error_log(spark, sf_dir):
    """Failures by error type and attempt; ``validation_error_details`` has the fields."""
    return attempt_table(spark, sf_dir).where("error_type is not null").groupBy("error_type", F.col("attempt").cast("bigint").alias("attempt_no")).agg(F.count("*").alias("n"))


