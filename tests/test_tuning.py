"""All trials at once against one run for each trial."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendtrace.operators import aggregate, corrupt, diagnostics, hybrid, metrics, repair

WIDTH, HEIGHT, HZ = 400.0, 300.0, 20.0
STRENGTHS = (0, 0.25, 1)


@pytest.fixture(scope="module")
def cases(spark):
    r = np.random.default_rng(5)
    rows = []
    for s in range(8):
        x, y = 200 + np.cumsum(r.normal(size=160)) + 60 * (np.arange(160) // 40 % 2), 150 + np.cumsum(r.normal(size=160))
        rows += [(s, "A" if s % 2 else "B", f"p{s // 3}", i, i / HZ, float(x[i]), float(y[i]), "mixed", ("low", "high")[s % 2], s) for i in range(160)]
    df = spark.createDataFrame(rows, "series long, dataset string, participant_id string, sample_idx long, time_s double, x double, y double, corruption string, severity string, seed int")
    df = diagnostics.diagnose(corrupt.inject(df), WIDTH, HEIGHT).withColumn("hz", F.lit(HZ))
    return hybrid.features(df, sizes=((3,), (5,))).repartition(3).cache()


def alone(cases, model, strength):
    """Q_local and mae of one trial, by predict()."""
    df = hybrid.predict(model.emissions(cases), F.lit(HZ), model.transition_log, model.start_log, strength)
    done = repair.repair(df.withColumn("state", hybrid.state_name()), "state")
    scores = metrics.evaluate(done, WIDTH, HEIGHT, ("series", "dataset", "participant_id")).withColumn("method", F.lit("trial"))
    got = aggregate.dataset_and_macro(aggregate.participant_means(scores))[1].first()
    return got["Q_local"], got["mae"]


def test_all_trials_at_once(spark, cases):
    """Fitted models: each trial's labels and scores, the chosen C and strength as by separate runs."""
    model, strength, table = hybrid.tune_at_once(cases, cases, F.lit(HZ), WIDTH, HEIGHT, (0.1, 10), STRENGTHS, cap=200)
    got = {(r["c"], r["strength"]): r for r in table.collect()}
    assert set(got) == {(c, float(s)) for c in (0.1, 10.0) for s in STRENGTHS} and sum(r["chosen"] for r in got.values()) == 1
    models = {c: hybrid.fit(cases, c, cap=200) for c in (0.1, 10.0)}
    for (c, s), r in got.items():
        q, mae = alone(cases, models[c], s)
        assert np.isclose(r["Q_local"], q, atol=1e-6) and np.isclose(r["mae"], mae, rtol=1e-6), (c, s)
    _, want, trials = hybrid.tune(cases, lambda m, s: (round(got[m.c_value, float(s)]["Q_local"], 9), round(got[m.c_value, float(s)]["mae"], 6)), (0.1, 10), STRENGTHS, cap=200)
    assert strength == want and got[model.c_value, strength]["chosen"]
    assert model.c_value == min((t for t in trials if t[0] == "C"), key=lambda t: (-t[2], t[3]))[1]


def test_labels_of_each_trial(cases):
    eye = np.eye(4)
    models = {c: hybrid.HybridModel(np.zeros(13), np.ones(13), (np.arange(52).reshape(4, 13) % 7 - 3) / k, np.arange(4) / 3, np.log(0.05 + 0.8 * np.roll(eye, k - 2, 1)), np.log([0.4, 0.3, 0.2, 0.1]), c) for k, c in ((2, 0.5), (3, 2.0))}
    got = hybrid.predict_grid(cases, F.lit(HZ), models, STRENGTHS)
    key = lambda r: (r["series"], r["sample_idx"])
    for c, m in models.items():
        for s in STRENGTHS:
            want = hybrid.predict(m.emissions(cases), F.lit(HZ), m.transition_log, m.start_log, s).select("series", "sample_idx", "label")
            a = got.where((F.col("c") == c) & (F.col("strength") == s)).select("series", "sample_idx", "label")
            assert sorted(a.collect(), key=key) == sorted(want.collect(), key=key), (c, s)


def test_no_cases(cases):
    m = hybrid.HybridModel(np.zeros(13), np.ones(13), np.zeros((4, 13)), np.zeros(4), np.zeros((4, 4)), np.zeros(4), 1.0)
    assert hybrid.tuning_table(cases.limit(0), F.lit(HZ), {1.0: m}, STRENGTHS, WIDTH, HEIGHT).count() == 0
