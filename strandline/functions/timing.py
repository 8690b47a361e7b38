"""Wall and processor time of a step."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

UNITS = {"s": 1.0, "ms": 1e3, "us": 1e6, "ns": 1e9}


def timed(f: Callable, *args, unit: str = "s", **options) -> tuple[float, float, object]:
    """(processor time, wall time, result) of a call. Processor time is that of
    this process: where Spark does the work, its tasks' is in Spark's metrics."""
    if unit not in UNITS:
        raise ValueError(f"no unit {unit}")
    cpu, wall = time.process_time(), time.perf_counter()
    result = f(*args, **options)
    return (time.process_time() - cpu) * UNITS[unit], (time.perf_counter() - wall) * UNITS[unit], result


class Spent(dict):
    """Seconds by the name of a step."""

    @contextmanager
    def on(self, step: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self[step] = self.get(step, 0.0) + time.perf_counter() - began
