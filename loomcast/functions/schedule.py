"""Waits, cooldowns and slow start as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomcast.config import RateLimitConfig, RetryConfig


def retry_wait(attempt: Column, retry: RetryConfig = RetryConfig(), no_wait: Column | None = None, seed: int | None = None) -> Column:
    """Wait after a failed attempt; 0 where ``no_wait``. With jitter (``seed`` given) between half of it and all of it."""
    wait = F.least(F.lit(retry.initial_wait) * F.pow(F.lit(retry.exponential_base), attempt - 1), F.lit(retry.max_wait))
    if retry.jitter and seed is not None:
        wait = wait * (0.5 + 0.5 * F.rand(seed))
    return wait if no_wait is None else F.when(no_wait, F.lit(0.0)).otherwise(wait)


def exponential_cooldown(consecutive: Column, initial: float = 60.0, most: float = 600.0, multiplier: float = 2.0) -> Column:
    return F.least(F.lit(initial) * F.pow(F.lit(multiplier), consecutive - 1), F.lit(most))


def configured_cooldown(consecutive: Column, limit: RateLimitConfig = RateLimitConfig()) -> Column:
    return exponential_cooldown(consecutive, limit.cooldown_seconds, limit.max_cooldown, limit.backoff_multiplier)


def fixed_cooldown(cooldown: float = 300.0) -> Column:
    return F.lit(float(cooldown))


def slow_start_delay(since_resume: Column, limit: RateLimitConfig = RateLimitConfig()) -> Column:
    """Delay before the item that has ``since_resume`` items before it since the last cooldown; 0 once slow start is over."""
    first, last = limit.slow_start_initial_delay, limit.slow_start_final_delay
    if not limit.slow_start_items:
        return F.lit(0.0)
    return F.when(since_resume < limit.slow_start_items, F.greatest(F.lit(last), first - (first - last) * since_resume / limit.slow_start_items)).otherwise(F.lit(0.0))


def step(values: list, attempt: Column) -> Column:
    """The ladder's value for an attempt (1, 2, ...); later attempts keep the last one."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.least(attempt, F.lit(len(values))).cast("int"))
