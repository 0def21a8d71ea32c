"""Rate-limit strategies: how long a partition pauses, and how slowly it goes on."""

from __future__ import annotations

from loomcast.config import RateLimitConfig


class RateLimitStrategy:
    """Both methods may raise: a failing strategy means no pause and no delay."""

    def cooldown(self, consecutive: int) -> float:
        """Seconds to pause after the ``consecutive``-th rate limit since the last success."""
        raise NotImplementedError

    def delay(self, since_resume: int) -> float | None:
        """Seconds to wait before the item that has ``since_resume`` items before it since the pause; None ends the slow start."""
        return None


class ExponentialBackoff(RateLimitStrategy):
    """Growing pauses, then a slow start; the formulas that ``functions.schedule`` states as columns."""

    def __init__(self, limit: RateLimitConfig = RateLimitConfig()):
        self.limit = limit

    def cooldown(self, consecutive: int) -> float:
        c = self.limit
        return min(c.cooldown_seconds * c.backoff_multiplier ** (consecutive - 1), c.max_cooldown)

    def delay(self, since_resume: int) -> float | None:
        c = self.limit
        if since_resume >= c.slow_start_items:
            return None
        first, last = c.slow_start_initial_delay, c.slow_start_final_delay
        return max(last, first - (first - last) * since_resume / c.slow_start_items)


class FixedDelay(RateLimitStrategy):
    """The same pause each time, and the same delay before every item from then on."""

    def __init__(self, cooldown: float = 300.0, delay: float = 1.0):
        self.pause, self.each = cooldown, delay

    def cooldown(self, consecutive: int) -> float:
        return self.pause

    def delay(self, since_resume: int) -> float | None:
        return self.each
