"""What is called for an item. A strategy lives in a Python worker; it must be picklable or made by a factory."""

from __future__ import annotations

import asyncio
import copy
import hashlib
import re
from typing import Any

from loomcast.functions.classify import FrameworkTimeoutError, classify, retry_needs_no_wait
from loomcast.functions.threads import in_thread
from loomcast.schema import DRY_RUN_PREFIX, MOCK_PREFIX

Tokens = dict[str, int]
WORD = re.compile(r"\S+", re.ASCII)


class Strategy:
    """``execute`` is awaited for each attempt; the other methods are optional."""

    async def prepare(self) -> None:
        """Once for each partition or item before its attempts."""

    async def execute(self, prompt: str, attempt: int, timeout: float) -> tuple[Any, Tokens]:
        raise NotImplementedError

    async def on_error(self, error: Exception, attempt: int) -> None:
        """After each failed attempt, before it is decided what follows; exceptions are ignored."""

    async def cleanup(self) -> None:
        """After the attempts, if prepare() succeeded; exceptions are ignored."""

    async def dry_run(self, prompt: str) -> tuple[Any, Tokens]:
        return f"{DRY_RUN_PREFIX}{prompt[:50]}...", {"input_tokens": 100, "output_tokens": 50, "total_tokens": 150}

    def for_item(self, item_id: str, generation: int) -> Strategy:
        """The strategy that handles an item; override where state belongs to an item."""
        return self


    def resume(self, validation_failures: int) -> None:
        """Before an item's first attempt of a generation: the validation failures of its earlier ones."""

    def described(self, attempt: int) -> dict[str, Any]:
        """``model`` and ``temperature`` of an attempt that is about to be made, for the log; empty: the item's own."""
        return {}


class ValidationError(Exception):
    """A structured output that does not have the form asked for. ``errors`` are its faults (loc, type, msg, input),
    ``raw`` is the response."""

    def __init__(self, message: str = "", errors: list[dict] | None = None, raw: str | None = None):
        super().__init__(message)
        self.errors, self.raw = errors or [], raw


class SimulatedEndpoint(Strategy):
    """A deterministic endpoint: the outcome of an attempt follows from a hash of item, generation and
    attempt, so SQL can state it too."""

    def __init__(self, latency: float = 0.0, failures: bool = True):
        self.latency, self.failures, self.key = latency, failures, ("", 0)

    def for_item(self, item_id: str, generation: int) -> SimulatedEndpoint:
        own = type(self)(self.latency, self.failures)
        own.key = (item_id, generation)
        return own

    def bucket(self, attempt: int) -> int:
        return int(hashlib.md5(f"{self.key[0]}:{self.key[1]}:{attempt}".encode()).hexdigest()[:8], 16) % 100

    async def execute(self, prompt: str, attempt: int, timeout: float) -> tuple[str, Tokens]:
        if self.latency:
            await asyncio.sleep(self.latency)
        b = self.bucket(attempt) if self.failures else 99
        if b < 5:
            raise RuntimeError("429 RESOURCE_EXHAUSTED: simulated")
        if b < 15:
            raise FrameworkTimeoutError("simulated time limit")
        if b < 25:
            raise ConnectionError("simulated connection reset")
        if b < 40:
            raise ValidationError("simulated result validation failure", [{"loc": ("reply", b), "type": "missing", "msg": "field required", "input": prompt}], MOCK_PREFIX)
        if b < 45:
            raise ValueError("simulated logic error")
        n = len(WORD.findall(prompt))
        return MOCK_PREFIX + prompt[:50], {"input_tokens": n, "output_tokens": 50, "total_tokens": n + 50}


class FunctionStrategy(Strategy):
    """Any client: ``call(prompt, attempt, timeout) -> (output, tokens)``, an async function, or a sync one, which runs in a thread."""

    def __init__(self, call, prepare=None, cleanup=None):
        self.call, self._prepare, self._cleanup = call, prepare, cleanup

    async def prepare(self) -> None:
        if self._prepare:
            await self._run(self._prepare)

    async def cleanup(self) -> None:
        if self._cleanup:
            await self._run(self._cleanup)

    async def execute(self, prompt: str, attempt: int, timeout: float) -> tuple[Any, Tokens]:
        return await self._run(self.call, prompt, attempt, timeout)

    @staticmethod
    async def _run(f, *args):
        return await f(*args) if asyncio.iscoroutinefunction(f) else await in_thread(f, *args)


class AgentStrategy(Strategy):
    """An agent with ``run(prompt)`` whose result has ``output`` and ``usage()``."""

    def __init__(self, agent):
        self.agent = agent

    async def execute(self, prompt: str, attempt: int, timeout: float) -> tuple[Any, Tokens]:
        result = await self.agent.run(prompt)
        u = result.usage()
        return result.output, {"input_tokens": u.request_tokens or 0, "output_tokens": u.response_tokens or 0, "total_tokens": u.total_tokens or 0}

    async def dry_run(self, prompt: str) -> tuple[Any, Tokens]:
        n = len(WORD.findall(prompt))
        return None, {"input_tokens": n, "output_tokens": 50, "total_tokens": n + 50}


class MockStrategy(Strategy):
    """A stand-in with switches: an answer by ``respond(prompt)``, ``latency``, a share of failing calls
    (``failure_rate``) and, by the attempt, rate limits (``rate_limit_on``) and timeouts (``timeout_on``).
    What fails follows from a hash of prompt and attempt, so it is the same in every partitioning."""

    def __init__(self, respond=None, latency: float = 0.0, failure_rate: float = 0.0, rate_limit_on: int | None = None, timeout_on: int | None = None):
        self.respond, self.latency, self.failure_rate, self.rate_limit_on, self.timeout_on = respond, latency, failure_rate, rate_limit_on, timeout_on
        self.generation = 1

    def for_item(self, item_id: str, generation: int) -> MockStrategy:
        own = copy.copy(self)
        own.generation = generation
        return own

    async def execute(self, prompt: str, attempt: int, timeout: float) -> tuple[Any, Tokens]:
        if self.latency:
            await asyncio.sleep(self.latency)
        if attempt == self.rate_limit_on and self.generation == 1:
            raise RuntimeError("429 RESOURCE_EXHAUSTED")
        if attempt == self.timeout_on:
            raise TimeoutError("Operation timed out")
        if int(hashlib.md5(f"{prompt}:{attempt}".encode()).hexdigest()[:8], 16) < self.failure_rate * (1 << 32):
            raise RuntimeError("simulated failure")
        return self.respond(prompt) if self.respond else MOCK_PREFIX + prompt[:50], {"input_tokens": 100, "output_tokens": 50, "total_tokens": 150}


class RotatingStrategy(Strategy):
    """One of several strategies (say, one for each key) for each item, by a hash of its id; attempts go on to the next."""

    def __init__(self, strategies: list[Strategy], first: int = 0, own: list[Strategy] | None = None):
        self.strategies, self.first = own or strategies, first

    def for_item(self, item_id: str, generation: int) -> RotatingStrategy:
        first = int(hashlib.md5(item_id.encode()).hexdigest()[:8], 16)
        return RotatingStrategy(self.strategies, first, [s.for_item(item_id, generation) for s in self.strategies])

    async def prepare(self) -> None:
        for s in self.strategies:
            await s.prepare()

    async def cleanup(self) -> None:
        for s in self.strategies:
            await s.cleanup()

    def _of(self, attempt: int) -> Strategy:
        return self.strategies[(self.first + attempt - 1) % len(self.strategies)]

    async def execute(self, prompt: str, attempt: int, timeout: float) -> tuple[Any, Tokens]:
        return await self._of(attempt).execute(prompt, attempt, timeout)

    async def on_error(self, error: Exception, attempt: int) -> None:
        await self._of(attempt).on_error(error, attempt)


class StructuredStrategy(Strategy):
    """Structured output: ``parse(output)`` gives the value or raises ValidationError; None is a ValueError, which
    is not retried. With ``ask_again(prompt, error)``, the prompt of an attempt after a validation error."""

    def __init__(self, inner: Strategy, parse, ask_again=None):
        self.inner, self.parse, self.ask_again, self.failed = inner, parse, ask_again, None

    def for_item(self, item_id: str, generation: int) -> StructuredStrategy:
        return StructuredStrategy(self.inner.for_item(item_id, generation), self.parse, self.ask_again)

    async def prepare(self) -> None:
        await self.inner.prepare()

    async def cleanup(self) -> None:
        await self.inner.cleanup()

    def resume(self, validation_failures: int) -> None:
        self.inner.resume(validation_failures)

    def described(self, attempt: int) -> dict[str, Any]:
        return self.inner.described(attempt)

    async def on_error(self, error: Exception, attempt: int) -> None:
        self.failed = error if isinstance(error, ValidationError) else self.failed
        await self.inner.on_error(error, attempt)

    async def execute(self, prompt: str, attempt: int, timeout: float) -> tuple[Any, Tokens]:
        if self.failed is not None and self.ask_again:
            prompt = self.ask_again(prompt, self.failed)
        output, tokens = await self.inner.execute(prompt, attempt, timeout)
        try:
            value = self.parse(output)
            if value is None:
                raise ValueError("the response holds no structured output")
        except Exception as e:
            e.__dict__.setdefault("_failed_token_usage", tokens)  # the call has been paid for
            raise
        return value, tokens


def faults_prompt(prompt: str, error: ValidationError) -> str:
    """A prompt that keeps what is right and names the faults of the last response."""
    faults = "; ".join(f"{' -> '.join(map(str, f.get('loc', ())))} ({f.get('msg')})" for f in error.errors)
    return f"{prompt}\n\nFix these fields: {faults or error}.\nYour last response, whose other fields stay: {error.raw or ''}"


class CachedContextStrategy(Strategy):
    """A remote context cache, made once by prepare(), renewed when little of its time is left, deleted by
    cleanup(). ``client`` has async create(ttl), renew(handle, ttl), delete(handle) and call(handle, prompt)."""

    def __init__(self, client, ttl: float = 3600.0, refresh_below: float = 0.1, clock=None):
        import time

        self.client, self.ttl, self.refresh_below, self.clock, self.handle, self.made = client, ttl, refresh_below, clock or time.monotonic, None, 0.0
        self.users, self.lock = 0, None

    def _guard(self) -> asyncio.Lock:
        if self.lock is None:  # made in the worker: locks are not pickled
            self.lock = asyncio.Lock()
        return self.lock

    async def prepare(self) -> None:
        """The first user makes the cache; others share it."""
        async with self._guard():
            if not self.users:
                self.handle, self.made = await self.client.create(self.ttl), self.clock()
            self.users += 1

    async def execute(self, prompt: str, attempt: int, timeout: float) -> tuple[Any, Tokens]:
        async with self._guard():
            if self.ttl - (self.clock() - self.made) < self.ttl * self.refresh_below:
                await self.client.renew(self.handle, self.ttl)
                self.made = self.clock()
        return await self.client.call(self.handle, prompt)

    async def cleanup(self) -> None:
        """The last user deletes it."""
        async with self._guard():
            self.users -= 1
            if self.users <= 0 and self.handle is not None:
                handle, self.handle, self.users = self.handle, None, 0
                await self.client.delete(handle)


class LadderStrategy(Strategy):
    """Escalation: step k of ``ladder`` (model and temperature) for the k-th attempt or, if ``smart``, after k - 1
    validation failures of the item. ``call(prompt, model, temperature) -> (output, tokens)`` is async."""

    def __init__(self, ladder: list[tuple[str, float]], call, smart: bool = False):
        self.ladder, self.call, self.smart, self.failures = ladder, call, smart, 0

    def for_item(self, item_id: str, generation: int) -> LadderStrategy:
        return LadderStrategy(self.ladder, self.call, self.smart)

    def resume(self, validation_failures: int) -> None:
        self.failures = validation_failures

    def rung(self, attempt: int) -> tuple[str, float]:
        return self.ladder[min(self.failures if self.smart else attempt - 1, len(self.ladder) - 1)]

    def described(self, attempt: int) -> dict[str, Any]:
        return dict(zip(("model", "temperature"), self.rung(attempt), strict=True))

    async def execute(self, prompt: str, attempt: int, timeout: float) -> tuple[Any, Tokens]:
        return await self.call(prompt, *self.rung(attempt))

    async def on_error(self, error: Exception, attempt: int) -> None:
        self.failures += retry_needs_no_wait(error, classify(error))
