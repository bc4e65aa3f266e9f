"""Six diagnostics per sample. All windows share one partitioning, so one exchange serves them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import IDX, KEY, distance, has_pair, ordered
from .longseries import own_rows, run_lengths, with_halo


def with_run_length(df: DataFrame, flag: str, out: str, key: Sequence[str] = KEY, idx: str = IDX) -> DataFrame:
    """Add `out`: on each row of a run of true flags the run's length, else 0."""
    w = ordered(key, idx)
    df = df.withColumn("_island", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*key, flag).orderBy(idx)))
    size = F.count(F.lit(1)).over(Window.partitionBy(*key, flag, "_island"))
    return df.withColumn(out, F.when(F.col(flag).cast("boolean"), size).otherwise(0).cast("int")).drop("_island")


def diagnose(df: DataFrame, width: float, height: float, key: Sequence[str] = KEY, idx: str = IDX, time: str = "time_s", slice_rows: int | None = None) -> DataFrame:
    """Add m_t (missing), r_t (length of the missing run), p_t (outside the screen), c_t (velocity), alpha_t (change of
    velocity per time) and u_t (distance to the centred running median of 7). With `slice_rows` series are cut into slices of
    so many rows, over many tasks; idx must then count rows from 0."""
    df = df.withColumn("m_t", (~has_pair()).cast("int"))
    if slice_rows:
        df = with_halo(run_lengths(df, "m_t", "r_t", slice_rows, key, idx), 3, slice_rows, idx)
        return own_rows(framed(df, width, height, (*key, "_slice"), idx, time))
    return framed(with_run_length(df, "m_t", "r_t", key, idx), width, height, key, idx, time)


def framed(df: DataFrame, width: float, height: float, key: Sequence[str], idx: str, time: str) -> DataFrame:
    """Add what diagnose() takes from frames that reach at most three rows."""
    w = ordered(key, idx)
    x, y = F.col("x"), F.col("y")
    outside = (x < 0) | (x > width) | (y < 0) | (y > height)
    df = df.withColumn("p_t", F.when(has_pair() & outside, 1).otherwise(0))
    usable = (F.col("m_t") == 0) & (F.col("p_t") == 0)
    step = F.col(time) - F.lag(time).over(w)
    df = df.withColumn("_dt", F.when(step > 0, step)).withColumn("_ok", usable)
    move = distance(x - F.lag("x").over(w), y - F.lag("y").over(w))
    df = df.withColumn("c_t", F.when(F.col("_ok") & F.lag("_ok").over(w), move / F.col("_dt")))
    df = df.withColumn("alpha_t", F.when(F.col("_ok"), F.abs(F.col("c_t") - F.lag("c_t").over(w)) / F.col("_dt")))
    near = w.rowsBetween(-3, 3)

    def middle(c: str) -> F.Column:
        return F.when(F.count(c).over(near) >= 3, F.percentile(c, F.lit(0.5)).over(near))

    df = df.withColumn("u_t", F.when(F.col("_ok"), distance(x - middle("x"), y - middle("y"))))
    return df.drop("_dt", "_ok")
