"""Quality metrics of cleaned sequences: one lag projection, then one aggregate per sequence and method."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import IDX, KEY, STATES, clip, distance, ordered

METRICS = ("mae", "rmse", "retention", "long_hallucination", "short_recovery", "movement_preservation", "stable_preservation", "unstable_repair_gain", "unstable_repair_score", "plausibility_score")


def evaluate(df: DataFrame, width: float, height: float, key: Sequence[str] = KEY, idx: str = IDX) -> DataFrame:
    """One row of METRICS per key. df holds x_clean, y_clean, x_degraded, y_degraded, true_regime and the output x, y."""
    w = ordered(key, idx)

    def pair(x: str, y: str) -> Column:
        return F.col(x).isNotNull() & F.col(y).isNotNull()

    df = df.withColumns({"_ref": pair("x_clean", "y_clean"), "_out": pair("x", "y"), "_deg": pair("x_degraded", "y_degraded")})
    both = F.col("_ref") & F.col("_out")
    off = distance(F.col("x") - F.col("x_clean"), F.col("y") - F.col("y_clean"))
    was = distance(F.col("x_degraded") - F.col("x_clean"), F.col("y_degraded") - F.col("y_clean"))
    step = lambda x, y: distance(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    regime = F.col("true_regime")
    df = df.withColumns({"_d": F.when(both, off), "_e": was, "_so": step("x", "y"), "_sc": step("x_clean", "y_clean"), "_pair": both & F.coalesce(F.lag("_ref").over(w) & F.lag("_out").over(w), F.lit(False))})
    moving = (regime == "Movement") & F.col("_pair")
    same = F.col("_out") & (F.abs(F.col("x") - F.col("x_clean")) <= 1e-9) & (F.abs(F.col("y") - F.col("y_clean")) <= 1e-9)
    bad = (regime == "Unstable") & F.col("_ref") & F.col("_deg")
    inside = (F.col("x") >= 0) & (F.col("x") <= width) & (F.col("y") >= 0) & (F.col("y") <= height)
    share = lambda when, what: F.avg(F.when(when, F.coalesce(what, F.lit(False)).cast("double")))
    got = df.groupBy(*key).agg(
        F.avg("_d").alias("mae"),
        F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmse"),
        F.avg(F.col("_out").cast("double")).alias("retention"),
        share(regime == "LossLong", F.col("_out")).alias("long_hallucination"),
        share(regime == "LossShort", F.col("_out")).alias("short_recovery"),
        F.avg(F.when(moving, F.col("_so"))).alias("_mo"),
        F.avg(F.when(moving, F.col("_sc"))).alias("_mc"),
        share((regime == "Stable") & F.col("_ref"), same).alias("stable_preservation"),
        F.avg(F.when(bad, F.when(F.col("_out"), off).otherwise(F.col("_e")))).alias("_eo"),
        F.avg(F.when(bad, F.col("_e"))).alias("_ei"),
        share(F.col("_out"), inside).alias("plausibility_score"),
    )
    gain = F.when(F.col("_ei") > 1e-12, 1 - F.col("_eo") / F.col("_ei"))
    moved = F.when(F.col("_mc") > 0, clip(1 - F.abs(F.col("_mo") / F.col("_mc") - 1), 0, 1))
    got = got.withColumns({"movement_preservation": moved, "unstable_repair_gain": gain, "unstable_repair_score": clip(gain, 0, 1)})
    return got.select(*key, *METRICS)


def regime_f1(df: DataFrame, key: Sequence[str] = KEY, true: str = "true_regime", pred: str = "pred_regime") -> DataFrame:
    """(key, regime, f1, support) for each of STATES: f1 is NULL where the reference has no such row."""
    one = F.explode(F.array(*(F.lit(s) for s in STATES))).alias("regime")
    rows = df.select(*key, true, pred, one)
    t, p = F.col(true) == F.col("regime"), F.col(pred) == F.col("regime")
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    got = rows.groupBy(*key, "regime").agg(count(t & p).alias("_tp"), count(t).alias("support"), count(p).alias("_pp"))
    return got.select(*key, "regime", F.when(F.col("support") > 0, 2.0 * F.col("_tp") / (F.col("support") + F.col("_pp"))).alias("f1"), "support")
