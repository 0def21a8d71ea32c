"""What a run does besides calling: observers, limits, escalation, chunks of the log, strategies around a client."""

import asyncio
import json
import os
import sys
import time
from types import SimpleNamespace

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomcast.config import EngineConfig, RateLimitConfig, RetryConfig
from loomcast.functions import classify
from loomcast.functions.details import error_detail, validation_errors
from loomcast.operators import stats
from loomcast.operators.infer import infer
from loomcast.operators.infer import run as run_infer
from loomcast.operators.items import validated
from loomcast.operators.limits import ExponentialBackoff, FixedDelay
from loomcast.operators.observers import Observer
from loomcast.operators.strategies import AgentStrategy, CachedContextStrategy, FunctionStrategy, LadderStrategy, MockStrategy, RotatingStrategy, Strategy, StructuredStrategy, ValidationError, faults_prompt
from loomcast.plans.rounds import run_rounds
from loomcast.sources.log import post_process, read_items, write_results

cloudpickle.register_pickle_by_value(sys.modules[__name__])
FAST = EngineConfig(max_workers=4, time_scale=0.0, retry=RetryConfig(jitter=False))


def items(spark, n, parts=1):
    return spark.range(0, n, 1, parts).select(F.concat(F.lit("i"), "id").alias("item_id"), F.concat(F.lit("p"), "id").alias("prompt"))


def note(path, line):
    with open(path, "a") as f:
        f.write(f"{line}\n")


class FileObserver(Observer):
    def __init__(self, path):
        self.path = path

    async def on_event(self, event, data):
        note(self.path, json.dumps([event, data.get("item_id")]))


class Rude(Observer):
    async def on_event(self, event, data):
        raise RuntimeError("no")


def test_observers_and_progress(spark, tmp_path):
    seen, reports = str(tmp_path / "events"), str(tmp_path / "progress")

    def progress(done, item_id):
        note(reports, done)
        if done == 3:
            time.sleep(30)  # given up, and held against nobody

    config = EngineConfig(max_workers=2, time_scale=0.0, progress_interval=3, progress_callback_timeout=0.05)
    began = time.time()
    log = infer(items(spark, 10), {"s": MockStrategy(rate_limit_on=1)}, config, observers=[Rude(), FileObserver(seen)], progress=progress)
    assert stats.results(log).where("success").count() == 10 and time.time() - began < 25
    events = [json.loads(x)[0] for x in open(seen)]
    assert events[0] == "BATCH_STARTED" and events[-1] == "BATCH_COMPLETED"
    assert {e: events.count(e) for e in set(events)} == {"BATCH_STARTED": 1, "BATCH_COMPLETED": 1, "WORKER_STARTED": 2, "WORKER_STOPPED": 2, "ITEM_STARTED": 20, "ITEM_COMPLETED": 10, "RATE_LIMIT_HIT": 10, "COOLDOWN_STARTED": events.count("COOLDOWN_ENDED"), "COOLDOWN_ENDED": events.count("COOLDOWN_STARTED")}
    assert [int(x) for x in open(reports)] == [3, 6, 9]


class Mortal(Strategy):
    """Kills its worker once, in the middle."""

    def __init__(self, calls, flag):
        self.calls, self.flag = calls, flag

    async def execute(self, prompt, attempt, timeout):
        note(self.calls, prompt)
        if prompt == "p30" and not os.path.exists(self.flag):
            open(self.flag, "w").close()
            await asyncio.sleep(0.3)  # earlier chunks are written meanwhile
            os._exit(1)
        return "ok", {}


def test_finished_chunks_outlive_a_worker(spark, tmp_path):
    calls, flag, path = str(tmp_path / "calls"), str(tmp_path / "flag"), str(tmp_path / "log")
    config = EngineConfig(max_workers=2, time_scale=0.0, max_queue_size=2)
    strategies = {"s": Mortal(calls, flag)}
    with pytest.raises(Exception):  # noqa: B017  a lost worker fails a local job
        run_infer(items(spark, 60), path, strategies, config, rows_at_once=5)
    before = len(open(calls).readlines())
    log = run_infer(items(spark, 60), path, strategies, config, rows_at_once=5)
    made = [x.strip() for x in open(calls)]
    assert log.count() == 60 and stats.results(log).where("success").count() == 60
    assert set(made) == {f"p{k}" for k in range(60)} and len(made) < 60 + 12 and before > 25
    assert run_infer(items(spark, 60), path, strategies, config).count() == 60 and len(open(calls).readlines()) == len(made)


def test_a_slow_writer_does_not_time_calls_out(spark):
    config = EngineConfig(max_workers=4, timeout_per_item=0.5, time_scale=0.0, retry=RetryConfig(max_attempts=1))
    log = infer(items(spark, 24), {"s": MockStrategy(latency=0.1)}, config, rows_at_once=1)

    def slowly(batches):
        for b in batches:
            time.sleep(0.3)
            yield b

    assert [r.state for r in log.mapInArrow(slowly, log.schema).collect()] == ["success"] * 24


def test_stopping_early(spark):
    began = time.time()
    assert len(infer(items(spark, 2000), {"s": MockStrategy(latency=0.05)}, FAST, rows_at_once=1).limit(3).collect()) == 3
    assert time.time() - began < 20


def test_request_rate(spark):
    config = EngineConfig(max_workers=10, max_requests_per_minute=1200.0)
    rows = infer(items(spark, 12), {"s": MockStrategy()}, config, tasks=1).collect()
    starts = sorted(r.started_at for r in rows)
    assert 11 * 0.05 * 0.9 <= starts[-1] - starts[0] <= 3


def test_one_pause_at_a_time(spark):
    config = EngineConfig(max_workers=8, rate_limit=RateLimitConfig(cooldown_seconds=0.4, slow_start_items=0))
    rows = infer(items(spark, 8), {"s": MockStrategy(rate_limit_on=1, latency=0.01)}, config).collect()
    pauses = [r for r in rows if r.cooldown is not None]
    assert len(pauses) == 1 and len([r for r in rows if r.state == "rate_limited"]) == 8
    end = pauses[0].started_at + pauses[0].duration + 0.4
    assert all(r.started_at >= end - 0.05 for r in rows if r.generation == 2)


def test_limit_strategies():
    b = ExponentialBackoff(RateLimitConfig())
    assert [b.cooldown(k) for k in (1, 2, 3, 4)] == [300, 450, 600, 600] and b.delay(0) == 2.0 and b.delay(50) is None
    assert round(sum(b.delay(k) for k in range(50)), 2) == 53.45
    f = FixedDelay(7.0, 0.5)
    assert {f.cooldown(k) for k in (1, 9)} == {7.0} and f.delay(10_000) == 0.5


def test_categories_that_are_none(spark):
    def strange(error):
        return "no such category"

    def broken(error):
        raise KeyError("classifier")

    for classifier in (strange, broken):
        rows = infer(items(spark, 2), {"s": MockStrategy(failure_rate=1.0)}, FAST, classifier=classifier).collect()
        assert {r.error.error_category for r in rows} == {"unknown"} and len(rows) == 6


def test_usage_of_errors():
    cause = RuntimeError()
    cause.result = SimpleNamespace(usage=lambda: SimpleNamespace(request_tokens=3, response_tokens=4))
    first = ValueError()
    first.__cause__ = cause
    second, third = ValueError(), ValueError()
    second.usage = {"input_tokens": 1, "output_tokens": 2, "total_tokens": 9}
    third.__dict__["_failed_token_usage"] = {"input_tokens": 5}
    found = [tuple(classify.usage_of(e).values()) for e in (first, second, third, ValueError())]
    assert found == [(3, 4, 7), (1, 2, 9), (5, 0, 5), (0, 0, 0)]


class Climbing(LadderStrategy):
    """Limits the first call of each item, then gives no valid output below the last rung."""

    def for_item(self, item_id, generation):
        own = Climbing(self.ladder, None, self.smart)
        own.generation = generation
        return own

    async def execute(self, prompt, attempt, timeout):
        model, _ = self.rung(attempt)
        if self.generation == 1 and attempt == 2:
            raise RuntimeError("429")
        if model != "large":
            raise ValidationError("shape")
        return model, {}


@pytest.mark.parametrize("rounds", [False, True])
def test_escalation_goes_on_after_a_rate_limit(spark, tmp_path, rounds):
    ladder = Climbing([("small", 0.0), ("medium", 0.5), ("large", 1.0)], None, smart=True)
    log = run_rounds(items(spark, 3), str(tmp_path / "log"), {"s": ladder}, FAST) if rounds else infer(items(spark, 3), {"s": ladder}, FAST)
    rows = sorted((r.item_id, r.generation, r.attempt, r.model, r.temperature, r.state) for r in log.collect())
    one = [(1, 1, "small", 0.0, "retry"), (1, 2, "medium", 0.5, "rate_limited"), (2, 1, "medium", 0.5, "retry"), (2, 2, "large", 1.0, "success")]
    assert rows == [(f"i{k}", *x) for k in range(3) for x in one]


def test_open_rounds_are_an_error(spark, tmp_path):
    with pytest.raises(RuntimeError, match="open after 1 rounds"):
        run_rounds(items(spark, 2), str(tmp_path / "log"), {"s": MockStrategy(failure_rate=1.0)}, FAST, max_rounds=1)


class Cache:
    def __init__(self, path):
        self.path = path

    async def create(self, ttl):
        note(self.path, "create")
        return "handle"

    async def renew(self, handle, ttl):
        note(self.path, "renew")

    async def delete(self, handle):
        note(self.path, "delete")

    async def call(self, handle, prompt):
        assert handle == "handle"
        await asyncio.sleep(0.01)
        return prompt, {"cached_input_tokens": 7}


@pytest.mark.parametrize("lifecycle", ["partition", "item"])
def test_cached_context(spark, tmp_path, lifecycle):
    path = str(tmp_path / "cache")
    config = EngineConfig(max_workers=4, time_scale=0.0, lifecycle=lifecycle)
    found = stats.results(infer(items(spark, 12), {"s": CachedContextStrategy(Cache(path), ttl=0.06, refresh_below=0.5)}, config)).collect()
    assert len(found) == 12 and all(r.success and r.token_usage.cached_input_tokens == 7 for r in found)
    lines = [x.strip() for x in open(path)]
    assert lines[0] == "create" and lines[-1] == "delete" and lines.count("create") == lines.count("delete") >= 1
    assert lifecycle == "item" or lines.count("create") == 1


class Agent:
    async def run(self, prompt):
        return SimpleNamespace(output={"said": prompt}, usage=lambda: SimpleNamespace(request_tokens=2, response_tokens=None, total_tokens=2))


def test_agent_and_dry_run(spark):
    row = infer(items(spark, 1), {"a": AgentStrategy(Agent())}, FAST).first()
    assert json.loads(row.output) == {"said": "p0"} and tuple(row.tokens) == (2, 0, 2, 0)
    dry = infer(items(spark, 3), {"m": MockStrategy(failure_rate=1.0)}, EngineConfig(dry_run=True, max_requests_per_minute=600.0, max_workers=1)).collect()
    assert {(r.state, r.tokens.total_tokens) for r in dry} == {("success", 150)} and dry[0].output.startswith("[DRY-RUN]")


def test_mock_switches(spark):
    states = lambda s, **c: sorted(r.state for r in infer(items(spark, 2), {"s": s}, FAST).collect())
    assert states(MockStrategy(timeout_on=1)) == ["retry", "retry", "success", "success"]
    assert states(MockStrategy(rate_limit_on=2)) == ["success", "success"]
    assert states(MockStrategy(failure_rate=1.0)) == ["exhausted"] * 2 + ["retry"] * 4
    half = [r.state for r in infer(items(spark, 200), {"s": MockStrategy(failure_rate=0.5)}, EngineConfig(retry=RetryConfig(max_attempts=1))).collect()]
    assert 60 < half.count("exhausted") < 140


def test_rotation(spark):
    keys = [FunctionStrategy(lambda p, a, t, k=k: (k, {})) for k in "abc"]
    found = {r.output for r in infer(items(spark, 60), {"s": RotatingStrategy(keys)}, FAST).collect()}
    assert found == {"a", "b", "c"}


def parse(output):
    value = json.loads(output)
    if value is not None and "age" not in value:
        raise ValidationError("1 fault", [{"loc": ("person", "age"), "type": "missing", "msg": "Field required", "input": value}], output)
    return value


def test_structured_output(spark):
    def answer(prompt, attempt, timeout):
        if prompt.startswith("p1"):
            return "null", {"input_tokens": 4, "output_tokens": 1, "total_tokens": 5}
        return json.dumps({"name": "x"} | ({"age": 3} if "person -> age (Field required)" in prompt else {})), {"input_tokens": 4, "output_tokens": 1, "total_tokens": 5}

    strategy = StructuredStrategy(FunctionStrategy(answer), parse, faults_prompt)
    config = EngineConfig(time_scale=0.0, enable_detailed_logging=True)
    log = infer(items(spark, 2), {"s": strategy}, config)
    rows = sorted((r.item_id, r.attempt, r.state, r.error_type, r.tokens.total_tokens) for r in log.collect())
    assert rows == [("i0", 1, "retry", "ValidationError", 5), ("i0", 2, "success", None, 5), ("i1", 1, "failed_final", "ValueError", 5)]
    detail = validation_errors(log).collect()
    assert [(d.item_id, d.path, d.type, d.msg, d.raw) for d in detail] == [("i0", "person -> age", "missing", "Field required", '{"name": "x"}')]


def test_error_detail():
    first = None
    for k in range(15):
        e = ValueError(f"level {k}")
        e.__cause__ = first
        first = e
    found = json.loads(error_detail(first))
    assert [d["depth"] for d in found] == list(range(10)) and found[0]["message"] == "level 14"
    long = json.loads(error_detail(ValidationError("m", [{"loc": (1,), "input": "x" * 500}], "r" * 5000)))[0]
    assert (len(long["fields"][0]["input"]), len(long["raw"]), long["fields"][0]["path"]) == (100, 1000, "1")


def test_post_process_and_sinks(spark, tmp_path):
    seen, out = str(tmp_path / "seen"), str(tmp_path / "out")
    found = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "item_id string, success boolean").coalesce(1)

    def sync(row):
        note(seen, row.item_id)
        raise RuntimeError("ignored")

    async def late(row):
        note(seen, row.item_id + "!")
        await asyncio.sleep(60)

    began = time.time()
    post_process(found, sync)
    post_process(found, late, timeout=0.1)
    assert sorted(x.strip() for x in open(seen)) == ["a", "a!", "b", "b!", "c", "c!"] and time.time() - began < 30
    write_results(found, out, ["success"], "json")
    write_results(found, out, ["success"], "json", mode="append")
    back = read_items(spark, out, "json", "item_id string, success boolean")
    assert back.count() == 6 and back.where("success").count() == 4


def test_blank_ids_fail(spark):
    good = spark.createDataFrame([("a", "p")], "item_id string, prompt string")
    assert validated(good).count() == 1 and validated(good).collect()[0].item_id == "a"
    with pytest.raises(Exception, match="must not be blank"):
        validated(spark.createDataFrame([("  ", "p")], "item_id string, prompt string")).collect()
