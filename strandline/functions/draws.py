"""Seeded draws that any engine with 64-bit integers computes alike."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Multipliers of the three keys, modulus, and the mixing step.
KEYS = (7919, 104729, 1299709)
MODULUS = 2147483647
STEP = (48271, 12345)


def draw_sql(seed: str | int, step: str | int, key: str | int) -> str:
    """An expression for a draw from 0 to MODULUS - 1, in Spark's or DuckDB's SQL."""
    big = lambda x: f"cast({x} as bigint)"
    x = f"(({big(seed)} * {KEYS[0]} + {big(step)} * {KEYS[1]} + {big(key)} * {KEYS[2]}) % {MODULUS})"
    for _ in range(2):
        x = f"(({x} * {x} + {STEP[0]} * {x} + {STEP[1]}) % {MODULUS})"
    return x


def draw(seed: str | int, step: str | int, key: str | int) -> Column:
    return F.expr(draw_sql(seed, step, key))


def draw_np(seed, step, key):
    """The same draws for integers or integer arrays."""
    x = (np.int64(seed) * KEYS[0] + np.asarray(step, np.int64) * KEYS[1] + np.asarray(key, np.int64) * KEYS[2]) % MODULUS
    for _ in range(2):
        x = (x * x + STEP[0] * x + STEP[1]) % MODULUS
    return x
