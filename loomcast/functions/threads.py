"""Calls of blocking functions beside an event loop."""

from __future__ import annotations

import asyncio
import threading


async def in_thread(f, *args):
    """``f(*args)`` in a thread that nothing waits for once it is given up: a call that hangs holds up neither
    the loop nor its end."""
    loop = asyncio.get_running_loop()
    future = loop.create_future()

    def settle(set_to, value) -> None:
        if not future.done():
            set_to(value)

    def body() -> None:
        try:
            outcome = future.set_result, f(*args)
        except BaseException as e:  # the caller's to handle
            outcome = future.set_exception, e
        try:
            loop.call_soon_threadsafe(settle, *outcome)
        except RuntimeError:  # the loop is over
            pass

    threading.Thread(target=body, daemon=True).start()
    return await future
