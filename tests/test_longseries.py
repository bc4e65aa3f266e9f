"""Series in slices against whole series: frames, runs, neighbours, ranks and quantiles."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendtrace.operators import corrupt, diagnostics, hybrid, longseries, quantiles, repair, states
from mendtrace.sources import staging

KEYS = (0, 1, None, 3, 4)


def signals(spark, seed, n=150):
    """Series with gaps of all lengths (one empty of values, one without gaps), ties, values off the screen, odd times."""
    r = np.random.default_rng(seed)
    rows = []
    for s in KEYS:
        size = 1 if s == 4 else n
        gone = np.repeat(r.random(size) < 0.4, r.integers(1, 30, size))[:size]
        gone = np.ones(size, bool) if s == 1 else np.zeros(size, bool) if s == 3 else gone
        t = np.cumsum(r.integers(0, 3, size)) / 10
        rows += [(s, i, "kept", float(t[i]), None if gone[i] else float(r.integers(-3, 30)), None if gone[i] or i % 41 == 7 else float(r.integers(0, 12))) for i in range(size)]
    return spark.createDataFrame(rows, "series long, sample_idx long, note string, time_s double, x double, y double").repartition(5).cache()


def same(got, want, cols):
    key = lambda r: (r["series"] is None, r["series"] or 0, r["sample_idx"])
    a, b = (sorted(d.select("series", "sample_idx", *cols).collect(), key=key) for d in (got, want))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(u == v or (isinstance(u, float) and v is not None and abs(u - v) < 1e-9) for u, v in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_diagnostics_repair_and_features_in_slices(spark, rows):
    df = signals(spark, rows)
    want = diagnostics.diagnose(df, 25, 10).cache()
    got = diagnostics.diagnose(df, 25, 10, slice_rows=rows)
    assert got.columns == want.columns
    same(got, want, ["note", "m_t", "r_t", "p_t", "c_t", "alpha_t", "u_t"])
    a, b = (states.pointwise(states.potentials(want, F.lit(4.0), range_rows=r)).cache() for r in (None, 5))
    same(b, a, ["limit", "v_thr", "j_thr", "a_thr", "state"])
    for smooth in (False, True):
        same(repair.repair(a, stable_smoothing=smooth, slice_rows=rows), repair.repair(a, stable_smoothing=smooth), ["x", "y", "note"])
    same(repair.global_interpolate(df, slice_rows=rows), repair.global_interpolate(df), ["x", "y"])
    same(repair.short_gap_only(df, 3, slice_rows=rows), repair.short_gap_only(df, 3), ["x", "y"])
    same(corrupt.mark_movement(df, slice_rows=rows, range_rows=5), corrupt.mark_movement(df), ["true_regime"])
    hz = want.withColumn("hz", F.when(F.col("series") == 0, 80.0).otherwise(100.0))
    same(hybrid.features(hz, slice_rows=rows, range_rows=5), hybrid.features(hz), hybrid.FEATURES)


def test_empty_tables_in_slices(spark):
    df = signals(spark, 1).limit(0)
    d = diagnostics.diagnose(df, 25, 10, slice_rows=5)
    assert d.count() == 0 and repair.global_interpolate(df, slice_rows=5).count() == 0
    assert states.thresholds(d, range_rows=5).count() == 0 and longseries.number_rows(df.drop("sample_idx"), ["time_s"]).count() == 0


def test_rows_are_numbered_over_ranges(spark):
    df = signals(spark, 2)
    got = longseries.number_rows(df, ["time_s", "sample_idx"], "place", rows=20)
    assert got.where("place <> sample_idx").count() == 0 and got.count() == df.count()


@pytest.mark.parametrize("bound", [0, 3, 250_000])
def test_ranks_and_quantiles_beyond_the_broadcast_bound(spark, monkeypatch, bound):
    """Joins within the bound, with heavy groups apart, and with all groups but none of the heavy ones broadcast."""
    df = diagnostics.diagnose(signals(spark, 3), 25, 10).cache()
    monkeypatch.setattr(longseries, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(staging, "BROADCAST_ROWS", bound)
    ranks = {"c_t": "rc", "u_t": "ru"}
    want = df.withColumns({o: hybrid.average_rank(c) for c, o in ranks.items()})
    same(longseries.average_ranks(df, ranks, rows=7), want, ["rc", "ru"])
    same(states.thresholds(df, range_rows=7), states.thresholds(df), ["v_thr", "j_thr", "a_thr"])
    got = {r["name"]: r["quantiles"] for r in quantiles.exact_quantiles(df, ["x", "c_t"], (0.0, 0.3, 0.5, 1.0), rows=3).collect()}
    for c in ("x", "c_t"):
        v = np.array([r[0] for r in df.select(c).where(F.col(c).isNotNull()).collect()])
        assert np.allclose(got[c], np.quantile(v, [0.0, 0.3, 0.5, 1.0]))


def test_no_task_reads_a_whole_series(spark):
    """One series of 100,000 rows: no shuffle deals rows by the series alone, and no task sorts more than a few slices."""
    n, rows = 100_000, 5_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("series"), F.col("id").alias("sample_idx"), (F.col("id") / 250).alias("time_s"), F.when(F.col("id") % 97 > 2, F.rand(1) * 30).alias("x"), F.when(F.col("id") % 89 > 1, F.rand(2) * 12).alias("y"))
    df = staging.staged(df, "one")
    got = states.pointwise(states.potentials(diagnostics.diagnose(df, 25, 10, slice_rows=rows), F.lit(250.0), range_rows=rows))
    got = repair.repair(got, slice_rows=rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*), \d+\)", plan)
    assert dealt and all("_slice" in d for d in dealt), dealt
    want = repair.repair(states.pointwise(states.potentials(diagnostics.diagnose(df, 25, 10), F.lit(250.0))))
    other = want.select("sample_idx", *(F.col(c).alias(f"_{c}") for c in ("x", "y", "state")))
    wrong = "not (x <=> _x or abs(x - _x) < 1e-9) or not (y <=> _y or abs(y - _y) < 1e-9) or state <> _state"
    both = got.select("sample_idx", "x", "y", "state").join(other, "sample_idx")
    assert both.count() == n and both.where(wrong).count() == 0
