"""The inference operator, plan, rounds and statistics against the simulated endpoint and small strategies."""

import asyncio
import sys
import warnings

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomcast.config import EngineConfig, RateLimitConfig, RetryConfig
from loomcast.functions import classify
from loomcast.operators import stats
from loomcast.operators.infer import infer
from loomcast.operators.infer import run as run_infer
from loomcast.operators.strategies import FunctionStrategy, SimulatedEndpoint, Strategy, ValidationError
from loomcast.plans import catalogue
from loomcast.plans.plan import InferencePlan
from loomcast.schema import SKIPPED

# Workers cannot import this file, so its classes travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAST = EngineConfig(max_workers=4, time_scale=0.0, retry=RetryConfig(jitter=False))
SMALL = "/root/testdata/sf0.001"


def items(spark, prompts):
    return spark.createDataFrame([(f"i/{k}:@#", p) for k, p in enumerate(prompts)], "item_id string, prompt string")


class ByPrompt(Strategy):
    """Fails as the prompt says."""

    async def execute(self, prompt, attempt, timeout):
        if prompt == "slow":
            await asyncio.sleep(5)
        if prompt == "logic":
            raise ValueError("no")
        if prompt == "always":
            raise RuntimeError("broken")
        if prompt == "once" and attempt == 1:
            raise ValidationError("shape")
        return prompt.upper(), {"input_tokens": 1, "output_tokens": 2, "total_tokens": 3}


def test_states_and_one_result_per_item(spark):
    config = EngineConfig(max_workers=3, timeout_per_item=1.0, time_scale=0.0)
    df = infer(items(spark, ["a", "logic", "always", "once", "ünïcode 中", None]), {"s": ByPrompt()}, config)
    found = {r.item_id[2]: r for r in stats.results(df).collect()}
    assert len(found) == 6
    assert [found[str(k)].success for k in range(6)] == [True, False, False, True, True, True]
    assert [found[str(k)].attempts for k in range(5)] == [1, 1, 3, 2, 1]
    assert found["1"].error == "ValueError: no" and found["2"].error == "RuntimeError: broken"


def test_attempt_timeout(spark):
    config = EngineConfig(timeout_per_item=0.05, time_scale=0.0, retry=RetryConfig(max_attempts=2))
    rows = infer(items(spark, ["slow"]), {"s": ByPrompt()}, config).collect()
    assert [(r.state, r.error_type, r.error.error_category) for r in rows] == [("retry", "FrameworkTimeoutError", "framework_timeout"), ("exhausted", "FrameworkTimeoutError", "framework_timeout")]


def test_partitioning_does_not_matter(spark):
    base = catalogue.docs(spark, SMALL).drop("doc_id")
    found = [sorted(map(tuple, infer(base.repartition(n), catalogue.SIMULATED, FAST).select("item_id", "generation", "attempt", "state").collect())) for n in (1, 7)]
    assert found[0] == found[1]


def test_generations_can_be_capped(spark):
    def always(prompt, attempt, timeout):
        raise RuntimeError("429")

    config = EngineConfig(time_scale=0.0, max_generations=3)
    rows = infer(items(spark, ["x"]), {"s": FunctionStrategy(always)}, config).collect()
    assert [r.state for r in rows] == ["rate_limited", "rate_limited", "exhausted"]


def test_resume_calls_only_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "log")
    first = items(spark, ["a", "b"])
    assert run_infer(first, path, {"s": ByPrompt()}, FAST).count() == 2
    assert run_infer(items(spark, ["a", "b", "c"]), path, {"s": ByPrompt()}, FAST).count() == 3


def test_plan_puts_skips_below_the_operator(spark, tmp_path):
    plan = InferencePlan(items(spark, ["a", "skip me", "logic"]), {"s": ByPrompt()}, FAST).skip(F.col("prompt").contains("skip"))
    plan = plan.on_error(F.when(F.col("error").startswith("ValueError"), "rescued"))
    text = plan.attempts()._jdf.queryExecution().executedPlan().toString()
    assert text.index("MapInArrow") < text.index("Contains") if "Contains" in text else "Filter" in text[text.index("MapInArrow") :] or "LocalTableScan" in text
    found = {r.item_id[2]: r for r in plan.run(str(tmp_path / "log")).collect()}
    assert found["1"].error == SKIPPED and not found["1"].success
    assert found["2"].success and found["2"].output == "rescued"


def test_hooks_that_fail_change_nothing(spark):
    class Bad(ByPrompt):
        async def on_error(self, error, attempt):
            raise KeyError("hook")

        async def cleanup(self):
            raise KeyError("hook")

    assert stats.results(infer(items(spark, ["once"]), {"s": Bad()}, FAST)).first().success


def test_prepare_failure_fails_the_item(spark):
    class Bad(ByPrompt):
        async def prepare(self):
            raise ValueError("no key")

    assert infer(items(spark, ["a"]), {"s": Bad()}, FAST).first().state == "failed_final"


def test_python_and_column_cascades_agree(spark):
    errors = [TimeoutError("x"), RuntimeError("429"), ConnectionError("x"), ValueError("x"), RuntimeError("504 Gateway Timeout"), RuntimeError("x"), classify.FrameworkTimeoutError("429.0"), KeyError("a"), ValidationError("x")]
    rows = spark.createDataFrame([(k, classify.mro_of(e), str(e)) for k, e in enumerate(errors)], "k int, mro array<string>, m string")
    found = {r.k: r.c for r in rows.select("k", classify.default_category(F.col("mro"), F.col("m")).alias("c")).collect()}
    assert [found[k] for k in range(len(errors))] == [classify.classify(e) for e in errors]


@pytest.mark.parametrize("make", [lambda: EngineConfig(max_workers=0), lambda: EngineConfig(timeout_per_item=0), lambda: RetryConfig(max_attempts=0), lambda: RetryConfig(initial_wait=0), lambda: RetryConfig(initial_wait=2, max_wait=1), lambda: RetryConfig(exponential_base=0.5), lambda: RateLimitConfig(cooldown_seconds=-1), lambda: RateLimitConfig(backoff_multiplier=0.5), lambda: RateLimitConfig(slow_start_initial_delay=0.01), lambda: EngineConfig(progress_interval=0), lambda: EngineConfig(max_queue_size=-1), lambda: EngineConfig(max_requests_per_minute=0)])
def test_wrong_settings(make):
    with pytest.raises(ValueError):
        make()


def test_unwise_settings_warn():
    for more in ({"max_queue_size": 1}, {"timeout_per_item": 0.5}, {"max_requests_per_minute": 60}):
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            EngineConfig(**more)
        assert seen


def test_waits():
    assert sum(RetryConfig().wait(k) for k in range(1, 9)) == 183.0


def test_stream(spark, tmp_path):
    from loomcast.sources.log import read_attempts
    from loomcast.streaming.stream import infer_stream

    items(spark, ["a", "b", "once"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("item_id string, prompt string").parquet(str(tmp_path / "in"))
    infer_stream(stream, str(tmp_path / "log"), str(tmp_path / "check"), {"s": ByPrompt()}, FAST).awaitTermination(60)
    assert read_attempts(spark, str(tmp_path / "log")).count() == 4


def test_simulated_endpoint_is_what_sql_says():
    assert SimulatedEndpoint().for_item("doc_0", 1).bucket(1) == int(__import__("hashlib").md5(b"doc_0:1:1").hexdigest()[:8], 16) % 100


def test_progress_points_number_rows_by_ranges_that_stay(spark):
    """The counts before a range are those of the ranges that rows are numbered in, made twice or not."""
    key = "spark.sql.exchange.reuse"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        rows = spark.range(30000).select(((F.col("id") * 7919) % 30011).alias("n")).withColumn("item_id", F.concat(F.lit("i"), "n")).repartition(3)
        rows = rows.union(spark.createDataFrame([(None, "none"), (5, "i5b")], "n long, item_id string"))
        found = {(r.completed, r.item_id, r.total) for r in stats.progress_points(rows, "n", 7).collect()}
        order = sorted(((r.n is None, r.n or 0, r.item_id) for r in rows.collect()))
    finally:
        spark.conf.set(key, was)
    assert found == {(k, o[2], 30002) for k, o in enumerate(order, 1) if k % 7 == 0}


def test_nearest_compares_tiles_and_equals_all_pairs(spark, monkeypatch):
    """Small tiles; copies, zero and null vectors, other lengths and nulls in them: what a join of rows gives."""
    import random

    from pyspark.sql import Window

    from loomcast.operators import items as I

    rng = random.Random(3)
    rows = [(k, [float(rng.randint(-2, 2)) for _ in range(4)]) for k in range(300)]
    rows += [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(300, 400)]
    rows += [(400, [0.0] * 4), (401, None), (402, [1.0, None, 2.0, 3.0]), (403, [1.0, 2.0]), (410, [2.0, 4.1]), (405, []), (None, [1.0] * 4), (406, [float("nan")] + [1.0] * 3)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = base.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    monkeypatch.setattr(I, "TILE", 64)
    found = I.nearest(queries, base, 3)
    assert "zip_with" not in found._jdf.queryExecution().toString() and "MapInArrow" in found._jdf.queryExecution().toString()
    scored = base.join(queries, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(I.cosine("query", "embedding"), 6).alias("score")).where("score is not null")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    said = scored.withColumn("rank", rank).where("rank <= 3")
    assert sorted(map(str, found.collect())) == sorted(map(str, said.collect()))
    assert found.schema == said.schema or found.dtypes == said.dtypes


def test_a_log_that_is_not_there_moves_no_items(spark, tmp_path):
    """Nothing is joined with a log that does not exist yet, so the items' texts are not shuffled."""
    from loomcast.sources.log import read_attempts, remaining

    given = items(spark, ["a", "b"])
    assert read_attempts(spark, str(tmp_path / "none")).schema.simpleString() == spark.createDataFrame([], catalogue.attempt_table(spark, SMALL).schema).schema.simpleString()
    plan = remaining(given, spark, str(tmp_path / "none"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
