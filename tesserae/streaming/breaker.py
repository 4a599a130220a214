"""Circuit breaker for calls of external models."""

from __future__ import annotations

import time
from collections.abc import Callable


class Open(RuntimeError):
    """Calls are refused for now."""


class Breaker:
    """Opens after ``threshold`` failures in a row; after ``reset`` seconds one probe may close it."""

    def __init__(self, threshold: int = 3, reset: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.threshold, self.reset, self.clock = threshold, reset, clock
        self.failures, self.since, self.probing = 0, None, False

    @property
    def state(self) -> str:
        if self.since is None:
            return "closed"
        return "half-open" if self.clock() - self.since >= self.reset else "open"

    def call(self, f: Callable, *args, **kwargs):
        if self.state == "open" or (self.state == "half-open" and self.probing):
            raise Open
        self.probing = self.state == "half-open"
        try:
            out = f(*args, **kwargs)
        except Exception:
            self.failures += 1
            if self.probing or self.failures >= self.threshold:
                self.since = self.clock()
            raise
        finally:
            self.probing = False
        self.failures, self.since = 0, None
        return out
