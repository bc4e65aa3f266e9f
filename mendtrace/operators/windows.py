"""Cadence, clean windows, coordinate bounds, splits and case specifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import SEVERITY, has_pair
from .quantiles import exact_quantiles

RECORDING = ("source_file", "participant_id", "segment_id")
CORRUPTIONS = ("short_gap", "long_gap", "jitter", "spike", "mixed")


def time_steps(df: DataFrame, key: Sequence[str], time: str = "time_s") -> DataFrame:
    """Positive differences between neighbouring times of each recording."""
    w = Window.partitionBy(*key).orderBy(time)
    return df.withColumn("dt", F.col(time) - F.lag(time).over(w)).where("dt > 0")


def sampling_rate(df: DataFrame, key: Sequence[str] = RECORDING, by: Sequence[str] | None = None, time: str = "time_s") -> DataFrame:
    """1 / median step, by `by` (default: per recording; (): over all), with the column hz."""
    if by is not None and not set(key) <= set(by):
        return exact_quantiles(time_steps(df, key, time), ("dt",), (0.5,), by).select(*by, (1 / F.col("quantiles")[0]).alias("hz"))
    by = key if by is None else by
    return time_steps(df, key, time).groupBy(*by).agg((1 / F.median("dt")).alias("hz"))


def rate_or(df: DataFrame, fallback: Column, key: Sequence[str] = RECORDING, time: str = "time_s") -> DataFrame:
    """One row per recording: its rate, or the fallback where it has no positive step."""
    every = df.select(*key).distinct()
    return every.join(sampling_rate(df, key, time=time), list(key), "left").withColumn("hz", F.coalesce("hz", fallback))


def rate_report(df: DataFrame, time: str = "time_s") -> DataFrame:
    return sampling_rate(df, time=time).groupBy("source_file").agg(F.median("hz").alias("median_hz"), F.min("hz").alias("min_recording_hz"), F.max("hz").alias("max_recording_hz"), F.count("*").alias("n_recordings"), F.count_distinct("participant_id").alias("n_participants"))


def first_exact_window(df: DataFrame, seconds: float = 8.0, max_dt_factor: float = 3.0, key: Sequence[str] = RECORDING, time: str = "time_s", order: str | None = None) -> DataFrame:
    """The first run of each recording that spans `seconds`, up to the first sample that ends them.

    Times that come again keep their first row. A run breaks at a row without both coordinates and at a step that is not
    positive or above max_dt_factor times the recording's median step.
    """
    order = order or time
    again = Window.partitionBy(*key, time).orderBy(order)
    df = df.withColumn("_n", F.row_number().over(again)).where("_n = 1").drop("_n")
    w, all_ = Window.partitionBy(*key).orderBy(time), Window.partitionBy(*key)
    df = df.withColumn("_dt", F.col(time) - F.lag(time).over(w)).withColumn("_ok", has_pair())
    df = df.withColumn("_mid", F.percentile(F.when(F.col("_dt") > 0, F.col("_dt")), F.lit(0.5)).over(all_))
    broken = ~F.col("_ok") | F.lag(~F.col("_ok")).over(w) | F.col("_dt").isNull() | (F.col("_dt") <= 0) | (F.col("_dt") > max_dt_factor * F.col("_mid"))
    df = df.withColumn("_run", F.sum(F.coalesce(broken, F.lit(True)).cast("int")).over(w)).where("_ok")
    run = Window.partitionBy(*key, "_run")
    df = df.withColumn("_t0", F.min(time).over(run)).withColumn("_t1", F.max(time).over(run))
    df = df.withColumn("_end", F.min(F.when(F.col(time) >= F.col("_t0") + seconds, F.col(time))).over(run))
    df = df.where((F.col("_t1") - F.col("_t0") >= seconds) & F.col("_end").isNotNull())
    df = df.withColumn("_first", F.min("_run").over(all_)).where((F.col("_run") == F.col("_first")) & (F.col(time) <= F.col("_end")))
    return df.drop("_dt", "_ok", "_mid", "_run", "_t0", "_t1", "_end", "_first")


def hashed(*cols: Column) -> Column:
    """A place in a portable shuffle: the leading 60 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("long")


def numbered(df: DataFrame, order: Sequence[str], out: str, among: DataFrame, slices: int = 128) -> DataFrame:
    """Number rows from 0 in the order of text columns, NULL first. Slices of the first column, between a few values of
    `among` drawn by hash, are numbered alone, after the number of rows in all slices before."""
    first = F.coalesce(F.col(order[0]), F.lit(""))
    drawn = among.select(first.alias("b")).distinct().orderBy(hashed(F.col("b")), "b").limit(slices - 1)
    bounds = F.array(*(F.lit(r["b"]) for r in drawn.collect())).cast("array<string>")
    df = df.withColumn("_slice", F.size(F.filter(bounds, lambda b: b <= first)))
    sizes = df.groupBy("_slice").agg(F.count("*").alias("_n"))  # one row for each slice
    before = sizes.select(F.col("_slice"), (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_slice")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    return df.join(F.broadcast(before), "_slice").withColumn(out, (F.col("_before") + inside - 1).cast("int")).drop("_slice", "_before")


def extract_segments(df: DataFrame, seconds: float = 8.0, per_participant: int = 1, seed: int = 42, max_dt_factor: float = 3.0) -> DataFrame:
    """First exact windows, at most so many per participant (drawn by a hash), with case_segment and case_index."""
    got = first_exact_window(df, seconds, max_dt_factor)
    name = F.concat_ws("__", F.coalesce(F.col("participant_id"), F.lit("None")), F.coalesce(F.col("source_file"), F.lit("None")), F.coalesce(F.col("segment_id"), F.lit("None")))
    got = got.withColumn("_key", name)
    keys = got.select("participant_id", "_key").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("participant_id").orderBy(hashed(F.lit(str(seed)), F.col("_key")), "_key"))).where(F.col("_r") <= per_participant)
    keys = numbered(keys, ("participant_id", "_key"), "case_index", df).select("_key", "case_index")
    got = got.join(keys, "_key")
    return got.withColumn("case_segment", F.concat_ws("__", "dataset", F.coalesce(F.col("participant_id"), F.lit("None")), F.concat(F.lit("seg"), F.col("case_index")))).drop("_key")


def coordinate_bounds(df: DataFrame, q: float = 0.999, step: float = 100.0, by: Sequence[str] = ()) -> DataFrame:
    """Width and height: the quantile rounded up to a multiple of step, one step at least; exact, never approximate."""
    got = exact_quantiles(df, ("x", "y"), (q,), by).withColumn("v", F.col("quantiles")[0])
    up = lambda v: F.greatest(F.lit(step), F.ceil(F.max(F.when(F.col("name") == v, F.col("v"))) / step) * step).cast("double")
    return got.groupBy(*by).agg(up("x").alias("width"), up("y").alias("height"))


def prefix(df: DataFrame, seconds: float, key: Sequence[str], time: str = "time_s") -> DataFrame:
    return df.withColumn("_t0", F.min(time).over(Window.partitionBy(*key))).where(F.col(time) <= F.col("_t0") + seconds).drop("_t0")


def split_units(units: DataFrame, fraction: float = 0.3, seed: int = 20260728, stratum: str = "dataset", unit: str = "participant_id", names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Each unit with its side: per stratum, max(1, half-even rounded share) units, one less than all at most, by a hash."""
    w = Window.partitionBy(stratum)
    held = F.least(F.greatest(F.lit(1), F.bround(F.lit(fraction) * F.col("_n")).cast("int")), F.col("_n") - 1)
    units = units.select(stratum, unit).distinct().withColumn("_n", F.count("*").over(w).cast("int"))
    units = units.withColumn("_r", F.row_number().over(w.orderBy(hashed(F.lit(str(seed)), F.col(stratum), F.col(unit)), unit)))
    return units.withColumn("split", F.when(F.col("_r") <= held, names[1]).otherwise(names[0])).drop("_n", "_r")


def case_specs(segments: DataFrame, seeds: Sequence[int], severities: Sequence[str] = tuple(SEVERITY), corruptions: Sequence[str] = CORRUPTIONS, cap: int | None = None, seed: int = 0) -> DataFrame:
    """segments (dataset, case_segment) times seeds, severities and corruptions, capped per dataset by a hash before any
    sample is made. The short lists are exploded, so nothing is cross joined."""
    rows = segments
    for name, values in (("seed", seeds), ("severity", severities), ("corruption", corruptions)):
        rows = rows.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    if cap is not None:
        order = hashed(F.lit(str(seed)), *(F.col(c).cast("string") for c in ("case_segment", "seed", "severity", "corruption")))
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("dataset").orderBy(order, "case_segment", "seed", "severity", "corruption"))).where(F.col("_r") <= cap).drop("_r")
    return rows


def extraction_summary(df: DataFrame, by: Sequence[str] = ("dataset",), time: str = "time_s") -> DataFrame:
    spans = df.groupBy(*by, "source_file", "participant_id", "case_segment").agg((F.max(time) - F.min(time)).alias("span"))
    return spans.groupBy(*by).agg(F.count_distinct("source_file").alias("files"), F.count_distinct("participant_id").alias("participants"), F.count_distinct("case_segment").alias("segments"), F.median("span").alias("median_duration_s"))


