"""Counter-based randomness: u(seed, op, id, pos).

A draw depends only on (seed, operation, row id, position), never on partitioning,
task order or retries, so a perturbation is reproducible under any plan and can be
recomputed by plain SQL.

Recipe (P = 2^31 - 1):
  row key   k = int(first 8 hex digits of md5("seed|op|id"), 16) mod P
  position  x = (k + (pos + 1) * 48271) mod P
  mix twice x = (x^5 mod P + 69621) mod P     (x -> x^5 permutes Z_P since gcd(5, P-1) = 1)
  event     x < floor(level * P)

Every product stays below 2^62, so bigint arithmetic never overflows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

P = 2147483647
STEP = 48271
SHIFT = 69621


# ---- Spark column expressions -------------------------------------------------

def row_key(seed, op, id_col) -> Column:
    """k = md5('seed|op|id')[0:8] as hex, mod P (bigint)."""
    seed_c = seed if isinstance(seed, Column) else F.lit(str(seed))
    op_c = op if isinstance(op, Column) else F.lit(op)
    id_c = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.md5(F.concat_ws("|", seed_c.cast("string"), op_c.cast("string"), id_c.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % F.lit(P)


def _pow5(x: Column) -> Column:
    x2 = (x * x) % P
    x4 = (x2 * x2) % P
    return (x4 * x) % P


def draw(k: Column, pos) -> Column:
    """Integer draw in [0, P) for row key k at position pos (bigint)."""
    pos_c = pos if isinstance(pos, Column) else F.lit(pos)
    x = (k + (pos_c.cast("bigint") + 1) * STEP) % P
    x = (_pow5(x) + SHIFT) % P
    x = (_pow5(x) + SHIFT) % P
    return x


def threshold(level) -> Column:
    lv = level if isinstance(level, Column) else F.lit(float(level))
    return F.floor(lv.cast("double") * F.lit(float(P))).cast("bigint")


def uniform(k: Column, pos) -> Column:
    """Draw scaled to [0, 1) as a double (for orderings and weights)."""
    return draw(k, pos).cast("double") / F.lit(float(P))


# ---- Python / numpy side (inside Arrow UDF kernels) ----------------------------

def py_row_key(seed, op: str, row_id) -> int:
    parts = [str(p) for p in (seed, op, row_id) if p is not None]
    digest = hashlib.md5("|".join(parts).encode("utf-8")).hexdigest()
    return int(digest[:8], 16) % P


def py_threshold(level: float) -> int:
    return int(math.floor(float(level) * float(P)))


def _np_pow5(x: np.ndarray) -> np.ndarray:
    x2 = (x * x) % P
    x4 = (x2 * x2) % P
    return (x4 * x) % P


def np_draws(k: int, n: int) -> np.ndarray:
    """Draws for positions 0..n-1 of one row (int64)."""
    return np_draws_at(k, np.arange(n, dtype=np.int64))


def np_draws_at(k: int, pos: np.ndarray) -> np.ndarray:
    """Draws for the given positions of one row (int64)."""
    x = (np.int64(k) + (pos + 1) * STEP) % P
    x = (_np_pow5(x) + SHIFT) % P
    x = (_np_pow5(x) + SHIFT) % P
    return x
