"""Frozen configuration with validation. Values that merely look unwise give warnings, wrong ones a ValueError."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class RetryConfig:
    max_attempts: int = 3
    initial_wait: float = 1.0
    max_wait: float = 60.0
    exponential_base: float = 2.0
    jitter: bool = True

    def __post_init__(self) -> None:
        _require(self.max_attempts >= 1, "max_attempts must be at least 1")
        _require(self.initial_wait > 0, "initial_wait must be positive")
        _require(self.max_wait >= self.initial_wait, "max_wait must not be below initial_wait")
        _require(self.exponential_base >= 1, "exponential_base must be at least 1")

    def wait(self, attempt: int) -> float:
        """The wait after failed attempt number ``attempt``, without jitter."""
        return min(self.initial_wait * self.exponential_base ** (attempt - 1), self.max_wait)


@dataclass(frozen=True)
class RateLimitConfig:
    cooldown_seconds: float = 300.0
    slow_start_items: int = 50
    slow_start_initial_delay: float = 2.0
    slow_start_final_delay: float = 0.1
    backoff_multiplier: float = 1.5
    max_cooldown: float = 600.0

    def __post_init__(self) -> None:
        _require(self.cooldown_seconds >= 0, "cooldown_seconds must not be negative")
        _require(self.slow_start_items >= 0, "slow_start_items must not be negative")
        _require(self.slow_start_initial_delay >= self.slow_start_final_delay, "slow_start_initial_delay must not be below slow_start_final_delay")
        _require(self.backoff_multiplier >= 1, "backoff_multiplier must be at least 1")


@dataclass(frozen=True)
class EngineConfig:
    max_workers: int = 5
    timeout_per_item: float = 120.0
    retry: RetryConfig = field(default_factory=RetryConfig)
    rate_limit: RateLimitConfig = field(default_factory=RateLimitConfig)
    max_requests_per_minute: float | None = None
    progress_interval: int = 10
    progress_callback_timeout: float | None = 5.0
    enable_detailed_logging: bool = False
    max_queue_size: int = 0
    dry_run: bool = False
    #: How often an item may be taken up again after a rate limit; None: as often as it takes.
    max_generations: int | None = None
    #: prepare() and cleanup() of a strategy once for each "partition" or "item".
    lifecycle: str = "partition"
    #: Waits are multiplied by this; 0 in tests.
    time_scale: float = 1.0

    def __post_init__(self) -> None:
        _require(self.max_workers >= 1, "max_workers must be at least 1")
        _require(self.timeout_per_item > 0, "timeout_per_item must be positive")
        _require(self.progress_interval >= 1, "progress_interval must be at least 1")
        _require(self.progress_callback_timeout is None or self.progress_callback_timeout > 0, "progress_callback_timeout must be positive or None")
        _require(self.max_queue_size >= 0, "max_queue_size must not be negative")
        _require(self.max_requests_per_minute is None or self.max_requests_per_minute > 0, "max_requests_per_minute must be positive or None")
        _require(self.lifecycle in ("item", "partition"), "lifecycle must be 'item' or 'partition'")
        if 0 < self.max_queue_size < self.max_workers:
            warnings.warn("max_queue_size is below max_workers: some workers will idle", stacklevel=2)
        if self.timeout_per_item < self.retry.initial_wait:
            warnings.warn("timeout_per_item is below the first retry wait", stacklevel=2)
        longest = sum(self.retry.wait(k) for k in range(1, self.retry.max_attempts))
        if self.timeout_per_item < longest / 2:
            warnings.warn("timeout_per_item is below half of the retry waits together", stacklevel=2)
        if self.max_requests_per_minute is not None and self.max_requests_per_minute / 60 < self.max_workers:
            warnings.warn("max_requests_per_minute allows less than one request a second for each worker", stacklevel=2)
