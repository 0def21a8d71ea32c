"""The one expensive operator: items in, a log of attempts out.

Each partition runs an event loop in a thread of its own, so neither a slow reader nor a slow writer
holds up calls that are in flight. ``max_workers`` coroutines take items from the partition's rows as
they come, so a slow item holds up nobody. An item's attempts are classified and retried in place; a
rate limit puts the item at the tail and pauses pickup for the partition. Every attempt is a row;
results, statistics and events are queries on that log.

Calls cost money, so callers write the log once (``run``) and derive everything from the written table.
``run`` writes it in chunks as attempts end: a task that is run again, after its executor was lost, calls
only for items that no finished chunk holds.
"""

from __future__ import annotations

import asyncio
import json
import queue
import threading
import time
import uuid
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from loomcast.config import EngineConfig
from loomcast.functions.classify import CATEGORIES, RATE_LIMIT_WAIT, FrameworkTimeoutError, classify, retry_needs_no_wait, safely, usage_of
from loomcast.functions.details import error_detail
from loomcast.operators.limits import ExponentialBackoff, RateLimitStrategy
from loomcast.operators.observers import Notifier, Observer
from loomcast.operators.strategies import Strategy
from loomcast.schema import ATTEMPTS, FINAL

Classifier = Callable[[BaseException], str]
#: Seconds that a partition which is stopped early gives its calls to end, and its strategies to clean up.
CANCEL_TIMEOUT = 5.0
#: Rows of a batch that are turned into items at a time where ``max_queue_size`` sets no bound.
READ_AHEAD = 512
LOGGED = ("item_id", "prompt", "seq", "generation", "strategy", "model", "temperature", "context")


class PartitionRun:
    """The state machine of one partition. ``rows`` gives items as dicts, lists at a time, and may block;
    ``hand_over`` gets lists of log rows and may block."""

    def __init__(self, rows: Iterator[list[dict]], strategies: dict[str, Strategy], config: EngineConfig, classifier: Classifier, share: int, limits: RateLimitStrategy, notifier: Notifier, hand_over: Callable[[list[dict]], None], rows_at_once: int, part: int):
        self.source, self.strategies, self.config, self.classifier, self.limits, self.notifier = rows, strategies, config, classifier, limits, notifier
        self.hand_over, self.rows_at_once, self.part = hand_over, rows_at_once, part
        self.items: deque[dict] = deque()
        self.again: deque[dict] = deque()
        self.rows: list[dict] = []
        self.threads = ThreadPoolExecutor(2)
        self.reading, self.writing, self.preparing = asyncio.Lock(), asyncio.Lock(), asyncio.Lock()
        self.over = False
        self.open = asyncio.Event()
        self.open.set()
        self.consecutive = 0
        self.since_resume: int | None = None  # None: no slow start
        self.working = 0
        self.spacing = 60.0 * share / config.max_requests_per_minute if config.max_requests_per_minute else 0.0
        self.next_call = 0.0
        self.prepared: set[str] = set()

    async def sleep(self, seconds: float) -> None:
        if seconds * self.config.time_scale > 0:
            await asyncio.sleep(seconds * self.config.time_scale)

    async def beside(self, f, *args):
        """``f`` in a thread: the loop goes on."""
        return await asyncio.get_running_loop().run_in_executor(self.threads, f, *args)

    async def take(self) -> dict | None:
        if not self.items and not self.over:
            async with self.reading:
                while not self.items and not self.over:
                    some = await self.beside(next, self.source, None)
                    self.over = some is None
                    self.items.extend(some or ())
        if self.items:
            return {"generation": 1, "failures": 0} | self.items.popleft()
        return self.again.popleft() if self.again else None

    async def flush(self, least: int = 1) -> None:
        async with self.writing:
            if len(self.rows) >= least:
                done, self.rows = self.rows, []
                await self.beside(self.hand_over, done)

    async def worker(self, number: int) -> None:
        await self.notifier.event("WORKER_STARTED", partition_id=self.part, worker_id=number)
        while True:
            await self.open.wait()
            item = await self.take()
            if item is None:
                if not self.working and not self.again:
                    break
                await asyncio.sleep(0.001)  # another worker may put its item back
                continue
            self.working += 1
            try:
                await self.slow_start()
                await self.process(item, number)
            finally:
                self.working -= 1
            if len(self.rows) >= self.rows_at_once:
                await self.flush(self.rows_at_once)
        await self.notifier.event("WORKER_STOPPED", partition_id=self.part, worker_id=number)

    async def slow_start(self) -> None:
        if (n := self.since_resume) is None:
            return
        try:
            delay = self.limits.delay(n)
        except Exception:  # a failing strategy delays nothing
            delay = None
        self.since_resume = None if delay is None else n + 1
        if delay:
            await self.sleep(delay)

    def log(self, item: dict, attempt: int, state: str, started: float, wait: float, output=None, tokens=None, error: BaseException | None = None, category: str | None = None, **more) -> None:
        flags = dict(zip(("is_retryable", "is_rate_limit", "is_timeout"), CATEGORIES[category], strict=True)) if category else None
        row = {k: item.get(k) for k in LOGGED}
        row |= {"attempt": attempt, "state": state, "started_at": started, "duration": time.time() - started, "wait_before": wait, "partition_id": self.part}
        row["output"] = output if output is None or isinstance(output, str) else json.dumps(output, default=lambda o: getattr(o, "__dict__", str(o)))
        row["tokens"] = {k: int((tokens or {}).get(k) or 0) for k in ("input_tokens", "output_tokens", "total_tokens", "cached_input_tokens")}
        if error is not None:
            row |= {"error_type": type(error).__name__, "error_message": str(error), "error": flags and flags | {"error_category": category, "suggested_wait": RATE_LIMIT_WAIT if category == "rate_limit" else None}}
            if self.config.enable_detailed_logging:
                row["error_detail"] = error_detail(error)
        self.rows.append(row | more)

    async def ready(self, strategy: Strategy, name: str) -> None:
        if self.config.lifecycle == "item":
            await strategy.prepare()
            return
        async with self.preparing:
            if name not in self.prepared:
                await self.strategies[name].prepare()
                self.prepared.add(name)

    async def process(self, item: dict, number: int) -> None:
        config, name, notify = self.config, item["strategy"], self.notifier.event
        started = time.time()
        about = {"item_id": item["item_id"], "partition_id": self.part, "worker_id": number}
        try:
            strategy = self.strategies[name].for_item(item["item_id"], item["generation"])
            strategy.resume(item["failures"])
            if not config.dry_run:
                await self.ready(strategy, name)
        except Exception as e:  # no attempt can be made; the item fails
            self.log(item, 1, "failed_final", started, 0.0, error=e, category=safely(self.classifier, e))
            self.notifier.item_done(item["item_id"])
            await notify("ITEM_FAILED", **about, error_type=type(e).__name__)
            return
        try:
            state = await self.attempts(item, strategy, about)
        finally:
            if config.lifecycle == "item" and not config.dry_run:
                try:
                    await strategy.cleanup()
                except Exception:  # noqa: S110
                    pass
        if state in FINAL:
            self.notifier.item_done(item["item_id"])

    async def attempts(self, item: dict, strategy: Strategy, about: dict) -> str:
        """Make attempts until one ends the item or its generation; the state of the last."""
        config, notify, wait = self.config, self.notifier.event, 0.0
        for attempt in range(1, config.retry.max_attempts + 1):
            await self.sleep(wait)
            if self.spacing and not config.dry_run:  # the partition's share of the request rate
                now = time.monotonic()
                self.next_call = max(self.next_call, now) + self.spacing * config.time_scale
                await asyncio.sleep(self.next_call - self.spacing * config.time_scale - now)
            started = time.time()
            made = item | strategy.described(attempt)
            await notify("ITEM_STARTED", **about, attempt=attempt)
            try:
                if config.dry_run:
                    output, tokens = await strategy.dry_run(item["prompt"])
                else:
                    try:
                        output, tokens = await asyncio.wait_for(strategy.execute(item["prompt"], attempt, config.timeout_per_item), config.timeout_per_item)
                    except FrameworkTimeoutError:
                        raise
                    except TimeoutError as e:
                        raise FrameworkTimeoutError(f"attempt exceeded its timeout of {config.timeout_per_item:g} s") from e
            except Exception as e:
                try:
                    await strategy.on_error(e, attempt)
                except Exception:  # noqa: S110  a failing hook changes nothing
                    pass
                category = safely(self.classifier, e)
                retryable, limited, _ = CATEGORIES[category]
                no_wait = retry_needs_no_wait(e, category)
                item["failures"] += no_wait
                used = usage_of(e)
                if limited:
                    most = config.max_generations
                    last = most is not None and item["generation"] >= most
                    state = "exhausted" if last else "rate_limited"
                    pause = self.pause()
                    self.log(made, attempt, state, started, wait, tokens=used, error=e, category=category, cooldown=pause, consecutive=self.consecutive)
                    if not last:
                        self.again.append(item | {"generation": item["generation"] + 1})
                    await notify("RATE_LIMIT_HIT", **about, attempt=attempt)
                    if pause is not None:
                        await self.cool_down(pause)
                    return state
                state = "failed_final" if not retryable else "exhausted" if attempt == config.retry.max_attempts else "retry"
                self.log(made, attempt, state, started, wait, tokens=used, error=e, category=category)
                if state != "retry":
                    if state == "failed_final":
                        await notify("ITEM_FAILED", **about, attempt=attempt, error_type=type(e).__name__)
                    return state
                wait = 0.0 if no_wait else config.retry.wait(attempt)
                if config.retry.jitter:  # between half of the wait and all of it, the same in every process
                    wait *= 0.5 + 0.5 * (zlib.crc32(f"{item['item_id']}:{attempt}".encode()) % 1000) / 1000
            else:
                self.log(made, attempt, "success", started, wait, output=output, tokens=tokens)
                self.consecutive = 0
                await notify("ITEM_COMPLETED", **about, attempt=attempt, duration=time.time() - started, tokens=tokens)
                return "success"
        raise AssertionError("the last attempt always returns")

    def pause(self) -> float | None:
        """Begin a pause of this many seconds; None if there is one: who hits the limit during a pause only goes back in line."""
        if not self.open.is_set():
            return None
        self.open.clear()
        self.consecutive += 1
        try:
            return max(0.0, float(self.limits.cooldown(self.consecutive)))
        except Exception:  # a failing strategy means no pause
            return 0.0

    async def cool_down(self, seconds: float) -> None:
        await self.notifier.event("COOLDOWN_STARTED", partition_id=self.part, duration=seconds, consecutive=self.consecutive)
        try:
            await self.sleep(seconds)
        finally:
            self.since_resume = 0
            self.open.set()
        await self.notifier.event("COOLDOWN_ENDED", partition_id=self.part, duration=seconds)

    async def run(self) -> None:
        await self.notifier.event("BATCH_STARTED", partition_id=self.part)
        try:
            await asyncio.gather(*(self.worker(k) for k in range(self.config.max_workers)))
            await self.flush()
        finally:
            for name in self.prepared:
                try:
                    await asyncio.wait_for(self.strategies[name].cleanup(), CANCEL_TIMEOUT)
                except Exception:  # noqa: S110
                    pass
            await self.notifier.finish()
            self.threads.shutdown(wait=False)
        await self.notifier.event("BATCH_COMPLETED", partition_id=self.part, items=self.notifier.done)


def _in_thread(start: Callable[[Callable[[list[dict]], None]], PartitionRun]) -> Iterator[list[dict]]:
    """Run a partition's loop in a thread and give its log rows as they come. Whoever stops reading stops the
    calls: they are cancelled, and have CANCEL_TIMEOUT to end."""
    rows: queue.Queue = queue.Queue(maxsize=4)
    stopped = threading.Event()
    box: dict = {}

    def put(x) -> None:
        while not stopped.is_set():
            try:
                return rows.put(x, timeout=0.1)
            except queue.Full:
                continue

    async def main() -> None:
        box["loop"], box["task"] = asyncio.get_running_loop(), asyncio.current_task()
        await start(put).run()

    def body() -> None:
        try:
            asyncio.run(main())
            put(None)
        except BaseException as e:  # handed to the reader
            put(e)

    thread = threading.Thread(target=body, daemon=True)
    thread.start()
    try:
        while (some := rows.get()) is not None:
            if isinstance(some, BaseException):
                raise some
            yield some
    finally:
        stopped.set()
        if thread.is_alive() and "loop" in box:
            try:
                box["loop"].call_soon_threadsafe(box["task"].cancel)
            except RuntimeError:  # it has just ended
                pass
        thread.join(CANCEL_TIMEOUT)


class _Calls:
    """What a task needs to call for its partition; travels with the task."""

    def __init__(self, strategies, config, classifier, share, limits, observers, progress, rows_at_once):
        self.strategies, self.config, self.classifier, self.share = strategies, config, classifier, share
        self.limits, self.observers, self.progress, self.rows_at_once = limits, observers, progress, rows_at_once

    def over(self, batches: Iterator[pa.RecordBatch], part: int, done: set[str] = frozenset()) -> Iterator[list[dict]]:
        step = self.config.max_queue_size or READ_AHEAD

        def source() -> Iterator[list[dict]]:
            for batch in batches:
                for k in range(0, len(batch), step):
                    yield [r for r in batch.slice(k, step).to_pylist() if r["item_id"] not in done]

        def start(put) -> PartitionRun:
            c = self.config
            notifier = Notifier(self.observers, self.progress, c.progress_interval, c.progress_callback_timeout)
            return PartitionRun(source(), self.strategies, c, self.classifier, self.share, self.limits, notifier, put, self.rows_at_once, part)

        return _in_thread(start)


def _prepared(items: DataFrame, strategies: dict[str, Strategy], config: EngineConfig, classifier: Classifier, tasks: int | None, rows_at_once: int, limits: RateLimitStrategy | None, observers: list[Observer], progress) -> tuple[DataFrame, _Calls]:
    share = tasks or items.sparkSession.sparkContext.defaultParallelism
    optional = {"seq": "bigint", "model": "string", "temperature": "double", "context": "string", "strategy": "string", "failures": "int"}
    columns = [F.col("item_id").cast("string"), F.coalesce(F.col("prompt"), F.lit("")).alias("prompt")]
    default = {"strategy": next(iter(strategies)), "failures": 0}
    columns += [(F.col(c).cast(t) if c in items.columns else F.lit(default.get(c)).cast(t)).alias(c) for c, t in optional.items()]
    rows = items.select(*columns)
    if tasks:  # calls in flight are tasks times max_workers, whatever the scan's partitions
        rows = rows.repartition(tasks)
    return rows, _Calls(strategies, config, classifier, share, limits or ExponentialBackoff(config.rate_limit), list(observers), progress, rows_at_once)


def infer(
    items: DataFrame, strategies: dict[str, Strategy], config: EngineConfig = EngineConfig(), classifier: Classifier = classify, tasks: int | None = None, rows_at_once: int = 512,
    limits: RateLimitStrategy | None = None, observers: list[Observer] = (), progress: Callable | None = None,
) -> DataFrame:
    """The attempt log of ``items`` (item_id, prompt, strategy; seq, model, temperature and context if there).

    Rows are evaluated again with every action on the result: write it once (see ``run``). With ``tasks``,
    items are dealt to so many tasks, whose number the request rate is shared out over. Output rows come
    as soon as ``rows_at_once`` attempts are done. ``limits`` replaces the configured cooldowns, and
    ``observers`` and ``progress`` are told of what happens, in the workers."""
    rows, calls = _prepared(items, strategies, config, classifier, tasks, rows_at_once, limits, observers, progress)
    schema = _parse_datatype_string(ATTEMPTS)
    arrow = to_arrow_schema(schema)

    def run_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in calls.over(batches, TaskContext.get().partitionId()):
            yield pa.RecordBatch.from_pylist(done, arrow)

    return rows.mapInArrow(run_partition, schema)


def _write_chunks(rows: DataFrame, calls: _Calls, path: str, arrow: pa.Schema) -> int:
    """Call for ``rows`` and write a Parquet file for each chunk of the log, whole or not at all; the number of
    attempts. A task that is run again finds the chunks of its earlier run and leaves out their items."""
    run_id = uuid.uuid4().hex

    def run_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        part = TaskContext.get().partitionId()
        files, folder = fs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        prefix = f"part-{part:05d}-{run_id}-"
        found = [f.path for f in files.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith(prefix)] if TaskContext.get().attemptNumber() else []
        done: set[str] = set()
        for f in found:
            known = pq.read_table(f, columns=["item_id", "state"], filesystem=files)
            done.update(i for i, s in zip(known["item_id"].to_pylist(), known["state"].to_pylist(), strict=True) if s in FINAL)
        n = 0
        for log in calls.over(batches, part, done):
            name = f"{prefix}{uuid.uuid4().hex}.parquet"
            part_file = f"{folder}/_{name}.tmp"  # names that begin with _ are no part of a table
            pq.write_table(pa.Table.from_pylist(log, arrow), part_file, filesystem=files)
            files.move(part_file, f"{folder}/{name}")
            n += len(log)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return rows.mapInArrow(run_partition, "n long").agg(F.sum("n")).first()[0] or 0


def run(items: DataFrame, path: str, strategies: dict[str, Strategy], config: EngineConfig = EngineConfig(), **more) -> DataFrame:
    """The log of ``items`` at ``path``, called for once. Items that ``path`` already holds a final attempt of are
    not called again; neither are those that a lost executor's task had written before it was lost. A path
    that pyarrow knows no file system for is written by Spark, when each task is over."""
    from loomcast.sources.log import append_attempts, read_attempts, remaining

    from pyarrow import fs

    spark = items.sparkSession
    todo = remaining(items, spark, path)
    arguments = {"classifier": classify, "tasks": None, "rows_at_once": 512, "limits": None, "observers": (), "progress": None} | more
    try:
        fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        append_attempts(infer(todo, strategies, config, **arguments), path)
    else:
        rows, calls = _prepared(todo, strategies, config, **arguments)
        _write_chunks(rows, calls, path if "://" in path else f"file://{path}", to_arrow_schema(_parse_datatype_string(ATTEMPTS)))
    return read_attempts(spark, path)
