"""Sliced decoding against decoding in one pass."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mendtrace.operators import states


def runs(spark, seed, n=400, series=(0, 1, None, 3)):
    """Series with runs of many lengths, scores with many ties."""
    r = np.random.default_rng(seed)
    rows = []
    for s in series:
        there = np.repeat(r.random(n) < 0.7, r.integers(1, 30, n))[:n] if s != 3 else np.ones(n, bool)
        rows += [(s, i, "kept", bool(t), [float(x) for x in r.integers(0, 3, 3)] if t else None) for i, t in enumerate(there)]
    return spark.createDataFrame(rows, "series long, sample_idx long, note string, ok boolean, s array<double>").repartition(5)


@pytest.mark.parametrize("slice_rows", [1, 7, 50, 1000])
def test_slices_give_the_path_of_one_pass(spark, slice_rows):
    change = np.array([[1.25, -0.75, -0.75], [-0.75, 1.25, -0.5], [0.0, -0.75, 1.0]])
    w = Window.partitionBy("series").orderBy("sample_idx")
    begin = F.col("ok") & ~F.coalesce(F.lag("ok").over(w), F.lit(False))
    for start in (0.0, np.array([0.5, 0.0, 0.25])):
        df = runs(spark, slice_rows)
        want = states.decode_runs(df, "s", begin, F.col("ok"), change, start, "p")
        got = states.decode_runs(df, "s", begin, F.col("ok"), change, start, "p", slice_rows=slice_rows)
        assert got.columns == want.columns
        key = lambda r: (r["series"] is None, r["series"] or 0, r["sample_idx"])
        assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_slices_of_nothing_and_of_series_without_runs(spark):
    df = runs(spark, 1)
    change = np.eye(3)
    assert states.decode_runs(df.limit(0), "s", F.col("ok"), F.col("ok"), change, 0.0, "p", slice_rows=5).count() == 0
    none = df.withColumn("ok", F.lit(False))
    assert states.decode_runs(none, "s", F.col("ok"), F.col("ok"), change, 0.0, "p", slice_rows=5).where("p is null").count() == df.count()


def test_a_long_block_spans_many_tasks(spark):
    """One series of 100,000 rows: no slice has more rows than told, and the path is that of one pass."""
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("series"), F.col("id").alias("sample_idx"), F.array(*(F.floor(F.rand(k) * 3).cast("double") for k in range(3))).alias("s"))
    df = df.cache()
    begin = F.row_number().over(Window.partitionBy("series").orderBy("sample_idx")) == 1
    change = np.full((3, 3), -0.75) + 2 * np.eye(3)
    want = states.decode_runs(df, "s", begin, F.lit(True), change, 0.0, "p").select("sample_idx", "p")
    got = states.decode_runs(df, "s", begin, F.lit(True), change, 0.0, "p", slice_rows=2000).select("sample_idx", F.col("p").alias("q"))
    assert got.join(want, "sample_idx").where("p = q").count() == n


@pytest.mark.parametrize("slice_rows", [1, 7, 1000])
def test_em_round_in_slices(spark, slice_rows):
    from mendtrace.operators import generative as ge

    r = np.random.default_rng(4)
    sizes = {0: 300, 1: 1, 2: 2, None: 41, 5: 120}
    rows = [(s, i, [float(x) for x in r.normal(size=6)]) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "series long, sample_idx long, v array<double>").repartition(4)
    k = ge.K
    start, change = np.log(r.dirichlet(np.ones(k))), np.log(r.dirichlet(np.ones(k), k))
    mean, var = r.normal(size=(k, 6)), r.uniform(0.5, 2, (k, 6))
    want = sorted(ge.em_round(ge.dealt(df, "v").where("_many"), start, change, mean, var).collect(), key=lambda x: x["component"])
    got = sorted(ge.em_round_slices(ge.dealt_slices(df, "v", slice_rows), start, change, mean, var).collect(), key=lambda x: x["component"])
    for a, b in zip(got, want, strict=True):
        assert all(np.allclose(a[c], b[c], atol=1e-9) for c in want[0].asDict())


def test_kmeans_of_all_starts_at_once(spark):
    """The cheapest of all starts, as plain Lloyd rounds from the same centres give it."""
    from mendtrace.operators import generative as ge

    r = np.random.default_rng(6)
    places = r.normal(scale=6, size=(ge.K, 6))
    z = np.concatenate([places[i] + r.normal(size=(60, 6)) for i in range(ge.K)])
    df = spark.createDataFrame([([float(v) for v in x],) for x in z], "z array<double>").repartition(4).cache()
    centers, n, var = ge.kmeans(df, 12, 3)
    far = lambda c: ((z[:, None] - c) ** 2).sum(2)
    at = far(centers).argmin(1)
    assert np.array_equal(np.bincount(at, minlength=ge.K), n) and sorted(n) == [60] * ge.K
    assert all(np.allclose(z[at == k].mean(0), centers[k], atol=1e-6) and np.allclose(z[at == k].var(0), var[k], atol=1e-6) for k in range(ge.K))
    costs = [ge.assigned(df, c[None])[0][0] for c in (centers, centers + 0.5)]
    assert np.isclose(costs[0], far(centers).min(1).sum()) and costs[0] < costs[1]


def test_model_fitted_in_slices(spark):
    from mendtrace.operators import generative as ge

    r = np.random.default_rng(1)
    rows = [(s, i, 0, 0, float(abs(r.normal(i // 40 % 3 * 4, 1))), float(abs(r.normal())), float(abs(r.normal())), 0, "Stable") for s in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "series long, sample_idx long, m_t int, r_t int, c_t double, alpha_t double, u_t double, p_t int, true_regime string").cache()
    a, b = ge.fit(df, rounds=3, inits=4), ge.fit(df, rounds=3, inits=4, slice_rows=33)
    assert np.allclose(a.log_likelihood, b.log_likelihood) and np.allclose(a.mean, b.mean, atol=1e-6) and a.names == b.names
