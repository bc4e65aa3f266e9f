"""Column functions that the operators share. Missing is NULL throughout; ingest turns NaN and infinities into it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

# State names in tie-break order, and the six internal states with their names.
STATES = ("Stable", "Movement", "LossShort", "LossLong", "Unstable")
EXPANDED = ("Stable", "Movement", "LossShort", "LossLong", "UnstableImpulse", "UnstableBurst")
FINITE_STATES = (0, 1, 4, 5)
SHORT_GAP_SECONDS = 0.5
SEVERITY = {"low": 1.0, "medium": 1.7, "high": 2.5}

KEY = ("series",)
IDX = "sample_idx"


def ordered(key: Sequence[str] = KEY, idx: str = IDX) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(idx)


def whole(key: Sequence[str] = KEY) -> WindowSpec:
    return Window.partitionBy(*key)


def finite(c: Column) -> Column:
    """A number or NULL: NaN and infinities become NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def has_pair(x: str = "x", y: str = "y") -> Column:
    return F.col(x).isNotNull() & F.col(y).isNotNull()


def round_half_even(c: Column) -> Column:
    return F.bround(c).cast("int")


def gap_limit(fs: Column, seconds: float = SHORT_GAP_SECONDS) -> Column:
    """Longest short gap in samples, one at least."""
    return F.greatest(F.lit(1), round_half_even(fs * F.lit(float(seconds))))


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def clip(c: Column, low: float, high: float) -> Column:
    """NULL stays NULL."""
    return F.when(c < low, F.lit(float(low))).when(c > high, F.lit(float(high))).otherwise(c)


def argmax_first(scores: Column) -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def normalize_id(c: Column) -> Column:
    """Trimmed; a whole number that ends in .0 is written as an integer; what is no number stays."""
    t = F.trim(c)
    number = F.regexp_replace(t, r"\.0$", "").try_cast("long")
    return F.when(t.rlike(r"^[+-]?[0-9]{1,18}\.0$"), number.cast("string")).otherwise(t)


PRIME = 2147483647


def draw(series: Column, idx: Column, seed: Column | int, stream: int) -> Column:
    """A uniform draw in (0, 1) from integers alone, the same in any engine: two rounds modulo a prime, one of them not linear."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    h = (F.pmod(series.cast("long"), F.lit(1000003)) * 1103515 + idx.cast("long") * 12345 + seed.cast("long") * 265443 + stream * 97531 + 12345) % PRIME
    # A round names h twice: written out, the rounds of a few draws make a method too long for the JVM to compile.
    h = F.aggregate(F.array(F.lit(0), F.lit(1)), h, lambda h, _: (h * (h % 65521 + 1) + 48271) % PRIME)
    return (h.cast("double") + 0.5) / PRIME


def draw_values(series: np.ndarray, idx: np.ndarray, seed: int, stream: int) -> np.ndarray:
    """The same draw for arrays of whole numbers, none of them negative."""
    h = (series.astype(np.int64) % 1000003 * 1103515 + idx.astype(np.int64) * 12345 + seed * 265443 + stream * 97531 + 12345) % PRIME
    for _ in range(2):
        h = (h * (h % 65521 + 1) + 48271) % PRIME
    return (h + 0.5) / PRIME


def draw_sql(series: str, idx: str, seed: str, stream: int) -> str:
    """The same draw as SQL text."""
    h = f"((({series}) % 1000003) * 1103515 + ({idx}) * 12345 + CAST(({seed}) AS BIGINT) * 265443 + {stream * 97531} + 12345) % {PRIME}"
    for _ in range(2):
        h = f"(({h}) * (({h}) % 65521 + 1) + 48271) % {PRIME}"
    return f"((CAST(({h}) AS DOUBLE) + 0.5) / {PRIME})"


def normal(series: Column, idx: Column, seed: Column | int, stream: int) -> Column:
    u, v = draw(series, idx, seed, stream), draw(series, idx, seed, stream + 1)
    return F.sqrt(-2 * F.log(u)) * F.cos(v * 6.283185307179586)


def normal_sql(series: str, idx: str, seed: str, stream: int) -> str:
    return f"(sqrt(-2 * ln({draw_sql(series, idx, seed, stream)})) * cos({draw_sql(series, idx, seed, stream + 1)} * 6.283185307179586))"
