"""Plans and passes that large tables need: one exchange for a series' windows, rows not multiplied by trials."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendtrace.functions.core import draw, draw_values
from mendtrace.operators import hybrid, metrics, repair
from mendtrace.sources import recordings
from tests.test_tuning import HEIGHT, HZ, WIDTH, cases  # noqa: F401


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_dealt_once(spark):
    """Windows over lineitem's series share the exchange that numbers its rows."""
    rows = spark.sql("select 1L as l_orderkey, 2L as l_partkey, 3L as l_suppkey, 4 as l_linenumber, 5.0d as l_quantity, 6.0d as l_extendedprice, timestamp'2020-01-01' as l_shipdate").union(spark.sql("select 1L, 2L, 3L, 5, 1.0d, 2.0d, timestamp'2019-01-01'"))
    df = recordings.lineitem_as_series(rows)
    from mendtrace.operators.diagnostics import diagnose

    assert len(re.findall(r"Exchange hashpartitioning", plan_of(diagnose(df, 9.0, 9.0)))) == 1
    assert [(r["series"], r["sample_idx"], r["x"], r["y"]) for r in df.orderBy("sample_idx").collect()] == [(3, 0, 2.0, 1.0), (3, 1, 6.0, 5.0)]


def test_a_draw_is_written_once(spark):
    """A draw's rounds don't double what they start from, and give what numpy gives."""
    df = spark.range(500).select(draw(F.col("id") * 7919, F.col("id") % 613, 42, 17).alias("u"))
    assert plan_of(df).count("7919") == 1
    ids = np.arange(500)
    assert np.array_equal([r["u"] for r in df.collect()], draw_values(ids * 7919, ids % 613, 42, 17))


@pytest.fixture(scope="module")
def models():
    eye = np.eye(4)
    return {c: hybrid.HybridModel(np.zeros(13), np.ones(13), (np.arange(52).reshape(4, 13) % 7 - 3) / k, np.arange(4) / 3, np.log(0.05 + 0.8 * np.roll(eye, k - 2, 1)), np.log([0.4, 0.3, 0.2, 0.1]), c) for k, c in ((2, 0.5), (3, 2.0))}


@pytest.mark.parametrize("rows", [1, 700, 400_000])
def test_scores_of_each_trial(cases, models, rows, monkeypatch):  # noqa: F811
    """Every series and trial as by predict(), repair() and evaluate(), however many trials are decoded at once."""
    monkeypatch.setattr(hybrid, "TRIAL_ROWS", rows)
    some = cases.where("series < 4").withColumn("x_clean", F.when(F.col("sample_idx") % 37 != 5, F.col("x_clean")))
    told = hybrid.trial_scores(some, F.lit(HZ), models, (0.0, 0.5), WIDTH, HEIGHT)
    assert not re.search(r"Generate|Expand", plan_of(told))
    got = {(r["series"], r["c"], r["strength"]): r for r in told.collect()}
    assert len(got) == 16
    for c, m in models.items():
        for s in (0.0, 0.5):
            done = hybrid.predict(m.emissions(some), F.lit(HZ), m.transition_log, m.start_log, s).withColumn("state", hybrid.state_name())
            for w in metrics.evaluate(repair.repair(done), WIDTH, HEIGHT).collect():
                for v in metrics.METRICS:
                    a, b = got[w["series"], c, s][v], w[v]
                    assert (a is None) == (b is None) and (a is None or np.isclose(a, b, rtol=1e-9, atol=1e-12)), (w["series"], c, s, v)


def test_regression_reaches_the_minimum(spark):
    """Few passes, each a job of its own; the slope at the end is nil."""
    r = np.random.default_rng(8)
    x, k, w = r.normal(size=(600, 3)), r.integers(0, 4, 600), r.uniform(0.2, 3, 600)
    k[:300] = np.digitize(x[:300, 0], [-0.7, 0.1, 0.8])
    rows = spark.createDataFrame([([1.0, *a.tolist()], int(b), float(c)) for a, b, c in zip(x, k, w, strict=True)], "z array<double>, k int, w double").repartition(3).cache()
    for c_value in (0.1, 10.0):
        got = hybrid.regression(rows, c_value)
        z = np.column_stack([np.ones(600), x])
        e = np.exp(z @ got.T)
        slope = c_value * (w[:, None] * (e / e.sum(1, keepdims=True) - np.eye(4)[k])).T @ z + got * (np.arange(4) > 0)
        assert np.abs(slope).max() < 1e-7 and abs(got[:, 0].sum()) < 1e-9


def test_features_are_computed_once(cases):  # noqa: F811
    got, want = hybrid.staged_features(cases, ("m_t",)), cases.select("series", "sample_idx", "m_t", *hybrid.FEATURES)
    assert "Window" not in plan_of(got) and sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("nil", [False, True])
def test_scaled_expectations(nil):
    """As in log space, on series of several lengths; a model with odds of nil is left to log space."""
    from mendtrace.operators import generative as ge

    r = np.random.default_rng(2)
    sizes = np.array([2, 40, 7, 300])
    begins, z = np.cumsum(sizes) - sizes, r.normal(size=(sizes.sum(), 6)) * 3
    mean, var, start = r.normal(size=(5, 6)), r.uniform(0.01, 2, (5, 6)), np.log(np.full(5, 0.2))
    change = np.log(np.full((5, 5), 0.02) + np.eye(5) * 0.9)
    if nil:
        change = np.where(np.eye(5) > 0, 0.0, -1e4)
    e = ge.emission_matrix(z, mean, var)
    want = ge.log_expectations(e, begins, sizes, start, change)
    assert (ge.scaled_expectations(e, begins, sizes, start, change) is None) == nil
    for a, b in zip(ge.expectations(z, begins, sizes, start, change, mean, var), want, strict=True):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9)


def test_series_go_in_step_together():
    import pyarrow as pa

    from mendtrace.operators import generative as ge

    tables = [pa.table({"i": list(range(n))}) for n in (4, 3, 9, 1, 1)]
    assert [t.num_rows for t in ge.gathered(iter(tables), 8)] == [7, 9, 2]


def test_examples_decode_once(spark):
    from mendtrace.plans import catalogue

    plan = plan_of(catalogue.examples(spark, "/root/testdata/sf0.001"))
    assert plan.count("MapInArrow") == 1 and plan.count("Scan parquet") == 1
