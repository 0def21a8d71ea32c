"""Push interfaces of a run: observers of events and a progress callback, both in the worker that calls.

An observer that fails, or takes longer than its time, is ignored. The same events, for all partitions,
are in the log: ``stats.events``."""

from __future__ import annotations

import asyncio
from collections.abc import Callable

from loomcast.functions.threads import in_thread

OBSERVER_TIMEOUT = 5.0


class Observer:
    """``on_event`` is awaited for each event, one observer after the other, in the order they were given."""

    async def on_event(self, event: str, data: dict) -> None:
        """``event`` is BATCH_, WORKER_ (STARTED, STOPPED or COMPLETED), ITEM_ (STARTED, COMPLETED, FAILED), RATE_LIMIT_HIT
        or COOLDOWN_ (STARTED, ENDED); ``data`` has what it is about."""


class Notifier:
    def __init__(self, observers: list[Observer], progress: Callable | None, interval: int, progress_timeout: float | None):
        self.observers, self.progress, self.interval, self.progress_timeout = observers, progress, interval, progress_timeout
        self.done = 0
        self.reports: set[asyncio.Task] = set()
        self.last: asyncio.Task | None = None

    async def event(self, event: str, **data) -> None:
        for o in self.observers:
            try:
                await asyncio.wait_for(o.on_event(event, data), OBSERVER_TIMEOUT)
            except Exception:  # noqa: S110  observers change nothing
                pass

    def item_done(self, item_id: str) -> None:
        """Every ``interval`` items ``progress(items done by this partition, item_id)`` is called beside the work: an
        async function as a task, another one in a thread, given up after its time. A call begins when the one
        before it has ended or is given up, so counts come in order."""
        self.done += 1
        if self.progress and self.done % self.interval == 0:
            self.last = task = asyncio.ensure_future(self._report(self.done, item_id, self.last))
            self.reports.add(task)
            task.add_done_callback(self.reports.discard)

    async def _report(self, done: int, item_id: str, before: asyncio.Task | None) -> None:
        f = self.progress
        if before:
            await asyncio.wait([before])
        try:
            call = f(done, item_id) if asyncio.iscoroutinefunction(f) else in_thread(f, done, item_id)
            await asyncio.wait_for(call, self.progress_timeout)
        except Exception:  # noqa: S110
            pass

    async def finish(self) -> None:
        """Waits for the reports that are still open, for each up to its time."""
        if self.reports:
            await asyncio.wait(self.reports)
