"""Repair actions for states, and baseline cleaners."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import IDX, KEY, clip, has_pair, ordered
from .diagnostics import with_run_length
from .longseries import nearest, own_rows, run_lengths, with_halo
from .states import public_state


def interpolated(v: str, key: Sequence[str] = KEY, idx: str = IDX, carried: bool = False) -> Column:
    """Linear by position between the nearest values on either side; the ends take the nearest value. Both sides are
    running frames, the later one in descending order, so a series costs one pass each way. With `carried` the series are
    slices, entered with what nearest() gives."""
    back = ordered(key, idx).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*key).orderBy(F.col(idx).desc()).rowsBetween(Window.unboundedPreceding, 0)
    place = F.when(F.col(v).isNotNull(), F.col(idx))
    pv, pi = F.last(v, True).over(back), F.last(place, True).over(back)
    nv, ni = F.last(v, True).over(ahead), F.last(place, True).over(ahead)
    if carried:
        pv, pi, nv, ni = (F.coalesce(c, F.col(f"_{side}_{v}")[part]) for c, side, part in ((pv, "prev", "v"), (pi, "prev", "place"), (nv, "next", "v"), (ni, "next", "place")))
    between = pv + (nv - pv) * (F.col(idx) - pi) / (ni - pi)
    return F.when(F.col(v).isNotNull(), F.col(v)).when(pv.isNull(), nv).when(nv.isNull(), pv).otherwise(between)


def mended(v: str, state: str = "state", key: Sequence[str] = KEY, idx: str = IDX, stable_smoothing: bool = False, carried: bool = False) -> Column:
    """One coordinate after what the state asks for: short losses are interpolated from the raw neighbours, long losses are
    blanked, unstable samples take the centred median of 7, stable ones stay (or take the mean of 5), movement stays."""
    w, s = ordered(key, idx), public_state(F.col(state))
    out = F.when(s == "LossShort", interpolated(v, key, idx, carried)).when(s == "LossLong", None)
    out = out.when(s == "Unstable", F.percentile(v, F.lit(0.5)).over(w.rowsBetween(-3, 3)))
    if stable_smoothing:
        out = out.when(s == "Stable", F.avg(v).over(w.rowsBetween(-2, 2)))
    return out.otherwise(F.col(v))


def repair(df: DataFrame, state: str = "state", key: Sequence[str] = KEY, idx: str = IDX, stable_smoothing: bool = False, slice_rows: int | None = None) -> DataFrame:
    """Overwrite x and y by mended(). With `slice_rows` in slices of so many rows, over many tasks."""
    if slice_rows:
        df = with_halo(nearest(df, ("x", "y"), slice_rows, key, idx).drop("_slice"), 3, slice_rows, idx)
        made = df.withColumns({v: mended(v, state, (*key, "_slice"), idx, stable_smoothing, True) for v in ("x", "y")})
        return own_rows(made).drop(*CARRIED)
    return df.withColumns({v: mended(v, state, key, idx, stable_smoothing) for v in ("x", "y")})


def oracle_policy(df: DataFrame, key: Sequence[str] = KEY, idx: str = IDX) -> DataFrame:
    return repair(df.withColumn("pred_regime", F.col("true_regime")), "pred_regime", key, idx)


#: What nearest() adds for x and y.
CARRIED = tuple(f"_{side}_{v}" for side in ("prev", "next") for v in ("x", "y"))


def global_interpolate(df: DataFrame, key: Sequence[str] = KEY, idx: str = IDX, slice_rows: int | None = None) -> DataFrame:
    if slice_rows:
        df = nearest(df, ("x", "y"), slice_rows, key, idx)
        return df.withColumns({v: interpolated(v, (*key, "_slice"), idx, True) for v in ("x", "y")}).drop("_slice", *CARRIED)
    return df.withColumns({v: interpolated(v, key, idx) for v in ("x", "y")})


def short_gap_only(df: DataFrame, max_gap: int | Column = 25, key: Sequence[str] = KEY, idx: str = IDX, slice_rows: int | None = None) -> DataFrame:
    """Fill gaps of at most max_gap samples and leave longer ones wholly open."""
    if not isinstance(max_gap, Column) and max_gap < 1:
        raise ValueError("max_gap must be at least 1")
    df = df.withColumn("_gap", ~has_pair())
    if slice_rows:
        df = nearest(run_lengths(df, "_gap", "_run", slice_rows, key, idx), ("x", "y"), slice_rows, key, idx)
        key = (*key, "_slice")
    else:
        df = with_run_length(df, "_gap", "_run", key, idx)
    short = F.col("_gap") & (F.col("_run") <= max_gap)
    made = df.withColumns({v: F.when(short, interpolated(v, key, idx, bool(slice_rows))).otherwise(F.col(v)) for v in ("x", "y")})
    return made.drop("_gap", "_run", *(("_slice", *CARRIED) if slice_rows else ()))


def global_smooth(df: DataFrame, key: Sequence[str] = KEY, idx: str = IDX) -> DataFrame:
    near = ordered(key, idx).rowsBetween(-3, 3)
    return df.withColumns({v: F.avg(v).over(near) for v in ("x", "y")})


def interp_smooth(df: DataFrame, key: Sequence[str] = KEY, idx: str = IDX) -> DataFrame:
    return global_smooth(global_interpolate(df, key, idx), key, idx)


def robust_clip(df: DataFrame, width: float, height: float) -> DataFrame:
    return df.withColumns({"x": clip(F.col("x"), 0, width), "y": clip(F.col("y"), 0, height)})


def cleaners(width: float, height: float, key: Sequence[str] = KEY, idx: str = IDX, max_gap: int | Column = 25) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Baseline cleaners by name; each maps a degraded table to a cleaned one."""
    return {
        "raw_degraded": lambda df: df,
        "global_interpolate": lambda df: global_interpolate(df, key, idx),
        "short_gap_only": lambda df: short_gap_only(df, max_gap, key, idx),
        "global_smooth": lambda df: global_smooth(df, key, idx),
        "interp_smooth": lambda df: interp_smooth(df, key, idx),
        "robust_clip": lambda df: robust_clip(df, width, height),
    }
