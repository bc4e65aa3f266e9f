"""Scores, grouped means, timing tables, weight ranks and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.core import draw, draw_values
from ..sources.staging import staged
from .longseries import running_totals
from .metrics import METRICS
from .quantiles import exact_quantiles

#: Of these less is better.
LOWER_IS_BETTER = ("mae", "rmse", "long_hallucination")

# Fixed values: (long and short, movement, stable, unstable) weights of each weighting.
WEIGHTINGS = {
    "equal": (0.4, 0.2, 0.2, 0.2),
    "safety_heavy": (0.55, 0.15, 0.10, 0.20),
    "repair_heavy": (0.20, 0.15, 0.10, 0.55),
    "no_stable": (0.5, 0.25, 0.0, 0.25),
    "finite_only": (0.0, 1 / 3, 1 / 3, 1 / 3),
}


def parts() -> list[Column]:
    return [1 - F.col("long_hallucination"), F.col("short_recovery"), F.col("movement_preservation"), F.col("stable_preservation"), F.col("unstable_repair_score")]


def score_available(df: DataFrame, out: str = "Q_local") -> DataFrame:
    """Mean of the components that are there."""
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts()), F.lit(0.0))
    n = sum((p.isNotNull().cast("int") for p in parts()), F.lit(0))
    return df.withColumn(out, F.when(n > 0, total / n))


def score_strict(df: DataFrame, out: str = "local_action_score") -> DataFrame:
    """Mean of all five components; NULL if one is absent."""
    a, b, c, d, e = parts()
    return df.withColumn(out, (a + b + c + d + e) / 5)


def means(df: DataFrame, by: Sequence[str], columns: Sequence[str] = METRICS) -> DataFrame:
    return df.groupBy(*by).agg(*(F.avg(c).alias(c) for c in columns))


def participant_means(sequences: DataFrame) -> DataFrame:
    return score_available(means(sequences, ("dataset", "participant_id", "method")))


def dataset_and_macro(participants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Means by dataset and method over participants, then their unweighted mean over datasets."""
    columns = (*METRICS, "Q_local")
    by_dataset = means(participants, ("dataset", "method"), columns)
    return by_dataset, means(by_dataset, ("method",), columns)


# The groupings of one pass: their columns besides the method.
GROUPINGS = {"pooled": (), "by_corruption": ("corruption",), "by_severity": ("severity",), "by_dataset": ("dataset",), "by_participant": ("dataset", "participant_id"), "by_dataset_corruption": ("dataset", "corruption")}
SIDES = ("dataset", "participant_id", "corruption", "severity")


def all_groupings(sequences: DataFrame) -> DataFrame:
    """(grouping, SIDES, method, METRICS, Q_local, Q_sequences): the means of all GROUPINGS from one pass over the sequences,
    then `dataset_agg`, means over participants, and `macro`, their means over datasets, from these rows.

    Columns that a grouping does not have are NULL, told apart from NULL values by the grouping's name. Q_local is the score
    of the means (for the last two the mean of scores), Q_sequences the mean of the sequences' scores. No sequences: no rows.
    """
    cols = [F.col(c) for c in (*SIDES, "method")]
    sets = [[*(F.col(c) for c in by), F.col("method")] for by in GROUPINGS.values()]
    gone = [F.grouping(c).cast("int") for c in SIDES]
    name = F.lit(None).cast("string")
    for n, by in GROUPINGS.items():
        here = reduce(lambda a, b: a & b, (g == int(c not in by) for g, c in zip(gone, SIDES, strict=True)))
        name = F.when(here, n).otherwise(name)
    scored = score_available(sequences, "Q_sequences")
    first = scored.groupingSets(sets, *cols).agg(name.alias("grouping"), *(F.avg(c).alias(c) for c in (*METRICS, "Q_sequences")))
    first = staged(score_available(first), "groupings")
    names = ("grouping", *SIDES, "method", *METRICS, "Q_local", "Q_sequences")

    def over(df: DataFrame, n: str, by: Sequence[str]) -> DataFrame:
        absent = {c: F.lit(None).cast("string") for c in SIDES if c not in by}
        return means(df, (*by, "method"), (*METRICS, "Q_local", "Q_sequences")).withColumns({"grouping": F.lit(n), **absent}).select(*names)

    by_dataset = over(first.where("grouping = 'by_participant'"), "dataset_agg", ("dataset",))
    return first.select(*names).union(by_dataset).union(over(by_dataset, "macro", ()))


def f1_summary(f1: DataFrame, by: Sequence[str] = ("method", "regime")) -> DataFrame:
    return f1.groupBy(*by).agg(F.avg("f1").alias("mean_f1"), F.stddev_samp("f1").alias("std_f1"), F.count("f1").alias("n"), F.sum("support").alias("support"))


def with_median(stats: DataFrame, rows: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """stats (a row for each group) with the exact median of the rows' values; no group is held in one buffer."""
    m = exact_quantiles(rows, [value], (0.5,), by).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("quantiles")[0].alias(out))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.lit(True))
    return stats.join(m, same, "left").drop(*(f"_{c}" for c in by))


def timing_summary(t: DataFrame, by: Sequence[str] = ("dataset", "duration_setting_s", "method"), ms: str = "milliseconds") -> DataFrame:
    stats = t.groupBy(*by).agg(F.count(ms).alias("n"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"))
    return with_median(stats, t, by, ms, "median_ms").select(*by, "n", "median_ms", "min_ms", "max_ms")


def paired_difference(t: DataFrame, a: str, b: str, pair: Sequence[str], by: Sequence[str], ms: str = "milliseconds") -> DataFrame:
    """Median over pairs of b - a; only complete pairs count."""
    both = t.groupBy(*by, *(c for c in pair if c not in by)).agg(F.max(F.when(F.col("method") == a, F.col(ms))).alias("_a"), F.max(F.when(F.col("method") == b, F.col(ms))).alias("_b"))
    both = both.where("_a is not null and _b is not null").withColumn("_d", F.col("_b") - F.col("_a"))
    return with_median(both.groupBy(*by).agg(F.count("*").alias("pairs")), both, by, "_d", "median_difference").select(*by, "median_difference", "pairs")


def weight_ranks(scores: DataFrame, by: Sequence[str] = ("evaluation",)) -> DataFrame:
    """Scores and ranks of methods under each weighting; long and short losses share the first weight evenly."""
    rows = scores.withColumn("w", F.explode(F.array(*(F.struct(F.lit(n).alias("weighting"), *(F.lit(float(x)).alias(f"w{i}") for i, x in enumerate(ws))) for n, ws in WEIGHTINGS.items()))))
    a, b, c, d, e = parts()
    score = (a + b) / 2 * F.col("w.w0") + c * F.col("w.w1") + d * F.col("w.w2") + e * F.col("w.w3")
    rows = rows.select(*by, "method", "w.weighting", score.alias("score"))
    return rows.withColumn("rank", F.rank().over(Window.partitionBy(*by, "weighting").orderBy(F.desc("score"))).cast("int"))


#: Units of a stratum that one task resamples at a time.
BLOCK_UNITS = 4096


def resampled_means(values: DataFrame, columns: Sequence[str], replicates: int, seed: int, by: Sequence[str] = (), strata: str = "dataset", unit: str = "participant_id", block: int = BLOCK_UNITS) -> DataFrame:
    """(by, replicate, columns): means over strata of the means over as many units as a stratum has, drawn with replacement.

    values has rows of (strata, unit, by, columns); a unit drawn n times counts n times with all its rows. Draws are integer
    arithmetic, so any engine repeats them. Units are numbered in each stratum and cut into blocks. In strata of several blocks
    each slot first draws a block; tasks only send how many slots of a replicate each block got. A block then draws its slots'
    units, as a matrix of counts of replicates by units, and multiplies it with the units' values: what is shuffled are the
    sums of each block and replicate, never a row for each replicate and unit.

    NULL and NaN values take no part in means; rows without stratum or unit are left out; no rows give no rows.
    """
    values = staged(values.where(F.col(strata).isNotNull() & F.col(unit).isNotNull()).select(strata, unit, *by, *(F.col(c).cast("double").alias(c) for c in columns)), "resampled")
    units = values.select(strata, unit).distinct().withColumn("_one", F.lit(1))
    units = staged(running_totals(units, [strata], [unit], "_one").drop("_one"), "units")
    slots = units.where(F.col("_total") > block).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    first = F.floor(draw(F.col("replicate"), F.col("_before"), F.lit(seed), 8) * F.col("_total"))
    got = slots.groupBy(strata, F.floor(first / block).alias("_block"), "replicate").agg(F.count("*").alias("_slots"))
    rows = values.join(units.withColumn("_block", F.floor(F.col("_before") / block)), [strata, unit])
    sums = [f"_{k}{i}" for k in "sn" for i in range(len(columns))]

    def resample(rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=[strata, *by, "replicate", *sums])
        start, total = int(rows["_block"].iat[0]) * block, int(rows["_total"].iat[0])
        size = min(block, total - start)
        n_slots = np.full(replicates, 0 if total > block else total)
        n_slots[got["replicate"].to_numpy(int)] = got["_slots"].to_numpy(int)
        place = rows["_before"].to_numpy(int) - start
        x = rows[list(columns)].to_numpy(float)
        there = ~np.isnan(x)
        both = np.hstack([np.where(there, x, 0.0), there])
        groups = list(rows.groupby(list(by), dropna=False, sort=False).indices.items()) if by else [((), np.arange(len(rows)))]
        out, step = [], max(1, (1 << 20) // size)
        for r in range(0, replicates, step):
            some = np.arange(r, min(r + step, replicates))
            of = np.repeat(np.arange(len(some)), n_slots[some])
            slot = np.arange(len(of)) - np.repeat(np.cumsum(n_slots[some]) - n_slots[some], n_slots[some])
            pick = np.floor(draw_values(some[of], start + slot, seed, 7) * size).astype(np.int64)
            drawn = np.bincount(of * size + pick, minlength=len(some) * size).reshape(len(some), size).astype(float)
            for name, at in groups:
                part = pd.DataFrame(drawn[:, place[at]] @ both[at], columns=sums)
                part.insert(0, "replicate", some)
                for k, c in enumerate(by):
                    part.insert(k, c, rows[c].iat[at[0]])
                out.append(part)
        done = pd.concat(out, ignore_index=True)
        done.insert(0, strata, rows[strata].iat[0])
        return done

    kept = [rows.schema[c] for c in (strata, *by)]
    schema = StructType([*kept, StructField("replicate", IntegerType()), *(StructField(c, DoubleType()) for c in sums)])
    blocks = rows.groupBy(strata, "_block").cogroup(got.groupBy(strata, "_block")).applyInPandas(resample, schema)
    total = blocks.groupBy(strata, *by, "replicate").agg(*(F.sum(c).alias(c) for c in sums))
    means_of = [F.when(F.col(f"_n{i}") > 0, F.col(f"_s{i}") / F.col(f"_n{i}")).alias(c) for i, c in enumerate(columns)]
    return means(total.select(strata, *by, "replicate", *means_of), (*by, "replicate"), columns)


def limits(drawn: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The middle 95 % of the replicates; a group holds one value for each replicate."""
    long = drawn.unpivot([*by, "replicate"], list(metrics), "metric", "value")
    return long.groupBy(*by, "metric").agg(F.percentile("value", F.lit(0.025)).alias("ci_low"), F.percentile("value", F.lit(0.975)).alias("ci_high"))


def paired_bootstrap(participants: DataFrame, a: str, b: str, replicates: int = 2000, seed: int = 20260728, metrics: Sequence[str] = ("Q_local", "mae", "rmse"), block: int = BLOCK_UNITS) -> DataFrame:
    """Observed difference a - b (mean over datasets of the mean over participants) and its 95 % interval."""
    key = ("dataset", "participant_id")
    wide = participants.groupBy(*key).agg(*(F.max(F.when(F.col("method") == m, F.col(c))).alias(f"{c}_{s}") for c in metrics for m, s in ((a, "a"), (b, "b"))))
    wide = staged(wide.select(*key, *((F.col(f"{c}_a") - F.col(f"{c}_b")).alias(c) for c in metrics)), "differences")
    seen = means(wide, ("dataset",), metrics).agg(*(F.avg(c).alias(c) for c in metrics)).unpivot([], list(metrics), "metric", "difference")
    found = limits(resampled_means(wide, metrics, replicates, seed, block=block), metrics)
    return seen.join(found, "metric").withColumn("favorable_direction", F.when(F.col("metric").isin(*LOWER_IS_BETTER), "negative").otherwise("positive"))


def hierarchical_bootstrap(participants: DataFrame, metrics: Sequence[str], replicates: int = 2000, seed: int = 20260728, block: int = BLOCK_UNITS) -> DataFrame:
    """For each method and metric the mean over datasets of participants' means, with a 95 % interval."""
    rows = staged(participants.select("dataset", "participant_id", "method", *metrics), "participants")
    seen = means(means(rows, ("method", "dataset"), metrics), ("method",), metrics).unpivot(["method"], list(metrics), "metric", "mean")
    return seen.join(limits(resampled_means(rows, metrics, replicates, seed, ("method",), block=block), metrics, ("method",)), ["method", "metric"])
