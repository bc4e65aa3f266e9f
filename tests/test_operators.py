"""Hand-made cases and differential tests against small pandas and numpy versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mendtrace.functions.core import normalize_id
from mendtrace.operators import corrupt, diagnostics, generative, hybrid, methods, metrics, quantiles, repair, states, windows
from mendtrace.sources import recordings, sinks

SCHEMA = "series long, sample_idx long, time_s double, x double, y double"


def series(spark, x, y=None, key=0, dt=0.25):
    y = x if y is None else y
    return spark.createDataFrame([(key, i, i * dt, a, b) for i, (a, b) in enumerate(zip(x, y, strict=True))], SCHEMA)


def rows(df, column):
    return [r[column] for r in df.orderBy("series", "sample_idx").collect()]


def gappy(seed, n=120, holes=0.3):
    r = np.random.default_rng(seed)
    x, y = r.normal(200, 90, n).round(1), r.normal(50, 30, n).round(1)
    return [None if h else float(v) for v, h in zip(x, r.random(n) < holes, strict=True)], [None if h else float(v) for v, h in zip(y, r.random(n) < holes / 2, strict=True)]


def test_run_length(spark):
    x = [1.0, None, None, None, 2.0, None]
    assert rows(diagnostics.diagnose(series(spark, x), 100, 100), "r_t") == [0, 3, 3, 3, 0, 1]


@pytest.mark.parametrize("seed", range(3))
def test_diagnostics_like_pandas(spark, seed):
    x, y = gappy(seed)
    got = diagnostics.diagnose(series(spark, x, y), 300, 100).orderBy("sample_idx").toPandas()
    a, b = pd.Series(x, dtype=float), pd.Series(y, dtype=float)
    ok = a.notna() & b.notna() & a.between(0, 300) & b.between(0, 100)
    c = (np.hypot(a.diff(), b.diff()) / 0.25).where(ok & ok.shift(fill_value=False))
    alpha = ((c - c.shift()).abs() / 0.25).where(ok)
    mid = [v.rolling(7, center=True, min_periods=3).median() for v in (a, b)]
    u = np.hypot(a - mid[0], b - mid[1]).where(ok)
    for name, want in (("c_t", c), ("alpha_t", alpha), ("u_t", u)):
        np.testing.assert_allclose(got[name].astype(float), want, atol=1e-9, err_msg=name)


@pytest.mark.parametrize("seed", range(3))
def test_interpolation_like_pandas(spark, seed):
    x, y = gappy(seed, 60)
    got = repair.global_interpolate(series(spark, x, y)).orderBy("sample_idx").toPandas()
    for name, v in (("x", x), ("y", y)):
        np.testing.assert_allclose(got[name].astype(float), pd.Series(v, dtype=float).interpolate("linear", limit_direction="both"), atol=1e-9)


def test_edge_series(spark):
    for x in ([], [None], [None] * 4, [1.0], [None, 1.0, None]):
        df = diagnostics.diagnose(series(spark, x), 100, 100)
        out = repair.repair(states.viterbi_d(states.potentials(df, F.lit(4.0))))
        assert out.count() == len(x)


def test_short_gap_only_never_fills_part_of_a_long_gap(spark):
    x = [0.0, None, None, 3.0, None, None, None, None, 8.0]
    assert rows(repair.short_gap_only(series(spark, x), 2), "x") == [0.0, 1.0, 2.0, 3.0, None, None, None, None, 8.0]
    with pytest.raises(ValueError):
        repair.short_gap_only(series(spark, x), 0)


def stub(df):
    logs = lambda p: F.array(*(F.lit(float(np.log(v))) for v in p))
    return df.withColumn("emissions", F.when(F.col("sample_idx") % 2 == 0, logs((0.55, 0.25, 0.15, 0.05))).otherwise(logs((0.20, 0.60, 0.15, 0.05))))


CHANGE = np.full((4, 4), np.log(0.05)) + np.eye(4) * (np.log(0.85) - np.log(0.05))


def predicted(spark, x, strength):
    df = stub(diagnostics.diagnose(series(spark, x), 100, 100))
    return rows(hybrid.predict(df, F.lit(4.0), CHANGE, np.log(np.full(4, 0.25)), strength), "label")


def test_hard_gap_rule(spark):
    got = predicted(spark, [1.0, None, None, 1.0, None, None, None, None, 1.0], 1.0)
    assert got[1:3] == [2, 2] and got[4:8] == [3] * 4


def test_strength_zero_is_pointwise(spark):
    assert predicted(spark, [1.0, 2.0, 3.0, 4.0], 0.0) == [0, 1, 0, 1]


def test_missing_rows_split_blocks(spark):
    got = predicted(spark, [1.0, 2.0, None, None, 1.0, 2.0], 1.0)
    assert got[2:4] == [2, 2] and {got[0], got[4]} <= {0, 1, 4, 5}


@pytest.mark.parametrize("seed", range(3))
def test_viterbi_fold_and_kernel_agree(spark, seed):
    x, y = gappy(seed, 80)
    df = states.potentials(diagnostics.diagnose(series(spark, x, y), 300, 100), F.lit(4.0))
    assert rows(states.viterbi_d(df), "state") == rows(states.viterbi_fold(df), "state")


def test_repair_gain(spark):
    got = {}
    for name, x in (("raw", [0.0, 11.0, 2.0]), ("clean", [0.0, 1.0, 2.0])):
        df = series(spark, x).withColumns({"x_clean": F.col("sample_idx").cast("double"), "y_clean": F.col("sample_idx").cast("double"), "x_degraded": F.element_at(F.array(F.lit(0.0), F.lit(11.0), F.lit(2.0)), F.col("sample_idx").cast("int") + 1)})
        df = df.withColumns({"y_degraded": F.col("x_degraded"), "true_regime": F.when(F.col("sample_idx") == 1, "Unstable").otherwise("Stable")})
        got[name] = metrics.evaluate(df, 100, 100).first()
    assert abs(got["raw"]["unstable_repair_gain"]) < 1e-12
    assert got["clean"]["unstable_repair_gain"] == 1 and got["clean"]["stable_preservation"] == 1


def test_average_rank_like_pandas(spark):
    x, _ = gappy(5)
    got = series(spark, x).withColumn("r", hybrid.average_rank("x")).orderBy("sample_idx").toPandas()
    want = pd.Series(x, dtype=float).rank(method="average", pct=True).fillna(0.5)
    np.testing.assert_allclose(got["r"], want, atol=1e-12)


def test_normalize_id(spark):
    df = spark.createDataFrame([("37.0", "37"), (" 007.0", "7"), ("ab.0", "ab.0"), ("1.5", "1.5"), (None, None)], "a string, b string")
    assert all(r["got"] == r["b"] for r in df.withColumn("got", normalize_id(F.col("a"))).collect())


def test_split_is_disjoint_and_leaves_one(spark):
    units = spark.createDataFrame([("A", str(i)) for i in range(10)] + [("B", "1"), ("B", "2")], "dataset string, participant_id string")
    got = windows.split_units(units).toPandas()
    assert (got[got.dataset == "A"].split == "test").sum() == 3 and (got[got.dataset == "B"].split == "test").sum() == 1


def test_synthetic_end_to_end(spark):
    samples, split = recordings.synthetic_traces(spark, (("ETDD70", 60.0, 3), ("Autism", 60.0, 3)))
    specs = windows.case_specs(samples.select("dataset", "case_segment").distinct(), (0,), ("medium",), ("mixed",)).drop("dataset")
    key = ("case_segment", "seed", "severity", "corruption")
    cases = corrupt.prepare(samples, specs, 1400, 1200).withColumn("series", F.xxhash64(*key)).cache()
    df = hybrid.features(cases.withColumn("hz", F.lit(60.0)))
    model = hybrid.fit(df)
    out = hybrid.predict(model.emissions(df), F.lit(60.0), model.transition_log, model.start_log)
    done = repair.repair(out.withColumn("pred_regime", hybrid.state_name()), "pred_regime")
    got = metrics.evaluate(done, 1400, 1200).toPandas()
    assert len(got) == 6 and (got.long_hallucination.dropna() == 0).all() and (got.mae < 50).all()
    f1 = metrics.regime_f1(done.withColumn("pred_regime", states.public_state(F.col("pred_regime"))))
    assert f1.count() == 30
    hmm = generative.fit(cases, rounds=4, inits=1)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(hmm.log_likelihood, hmm.log_likelihood[1:], strict=False))
    assert set(hmm.names) == {"Stable", "Movement", "LossShort", "LossLong", "Unstable"}
    assert hmm.predict(cases).count() == cases.count()


def test_raw_files(spark, tmp_path):
    (tmp_path / "1.csv").write_text("time,gaze_x_left,gaze_y_left,gaze_x_right,gaze_y_right,task\n1000000,1,2,3,4,t\n1004000,0,bad,5,0,t\n")
    (tmp_path / "2.csv").write_text("a,b\n1,2\n")
    df, warnings = recordings.load_dataset(spark, str(tmp_path), "ETDD70")
    got = df.orderBy("time_s").collect()
    assert len(warnings) == 1 and [(r.x, r.y, r.participant_id, r.segment_id) for r in got] == [(2.0, 3.0, "1", "t"), (5.0, None, "1", "t")]
    assert abs(got[1].time_s - 0.004) < 1e-12
    assert sinks.file_digests(spark, str(tmp_path), "*.csv").count() == 2
    assert "tabular" in sinks.latex(spark.createDataFrame([("a_b", 1.23456)], "m string, v double"))
    sinks.write_json(spark, {"n": 1}, str(tmp_path / "s.json"))
    assert (tmp_path / "s.json").read_text().startswith("{")


def test_shifted_generator_does_not_depend_on_partitions(spark):
    x = [float(v) for v in np.arange(200)]
    df = series(spark, x, dt=1 / 60).withColumns({"corruption": F.lit("mixed"), "severity": F.lit("low"), "seed": F.lit(3)})
    a, b = (corrupt.inject_shifted(d, 60.0).orderBy("sample_idx").toPandas() for d in (df, df.repartition(7)))
    pd.testing.assert_frame_equal(a, b)
    assert (a.true_regime == "LossLong").any()


def test_shifted_intervals_never_overlap(spark):
    df = spark.range(40).select(F.col("id").alias("series"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(399).cast("long"))).alias("sample_idx"))
    df = df.withColumns({"time_s": F.col("sample_idx") / 60.0, "x": F.col("sample_idx") * 1.0, "y": F.col("sample_idx") * 0.5, "corruption": F.lit("mixed"), "severity": F.lit("medium"), "seed": F.col("series")})
    got = corrupt.inject_shifted(df, 60.0).orderBy("series", "sample_idx").toPandas()
    for _, g in got.groupby("series"):
        lost = g.x.isna().to_numpy()
        runs = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(int)])) == 1)
        counts = g.true_regime.value_counts()
        assert 1 <= len(runs) <= 2 and counts["LossShort"] + counts["LossLong"] == lost.sum()
        assert 0.17 * 60 - 1 <= counts["LossShort"] <= 0.374 * 60 + 1 and 0.986 * 60 - 1 <= counts["LossLong"] <= 1.445 * 60 + 1
        assert (g.unstable_subtype == "impulse").sum() >= 1 and g.sample_idx[lost].between(32, 368).all()
        calm = ~lost & (g.unstable_subtype == "").to_numpy()
        assert (g.x[calm] == g.x_clean[calm]).all()


def slow_path(scores, change, start):
    best, back = scores[0] + start, []
    for s in scores[1:]:
        through = best[:, None] + change
        back.append(through.argmax(0))
        best = s + through[back[-1], np.arange(len(s))]
    path = [int(best.argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_viterbi_paths_in_step():
    r = np.random.default_rng(6)
    sizes = np.array([1, 7, 3, 1, 20, 7])
    scores, change = np.round(r.normal(size=(sizes.sum(), 4)), 1), np.round(r.normal(size=(4, 4)), 1)
    begins = np.cumsum(sizes) - sizes
    got = states.viterbi_paths(scores, begins, sizes, change, np.arange(4) * 0.1)
    assert got.tolist() == [p for b, n in zip(begins, sizes, strict=True) for p in slow_path(scores[b : b + n], change, np.arange(4) * 0.1)]
    assert states.viterbi_paths(np.zeros((0, 3)), np.zeros(0, int), np.zeros(0, int), np.zeros((3, 3))).tolist() == []


def test_decoding_does_not_depend_on_batches(spark):
    parts = [series(spark, *gappy(s, 90, 0.05 * s), key=s) for s in range(5)]
    df = parts[0]
    for p in parts[1:]:
        df = df.union(p)
    df = states.potentials(diagnostics.diagnose(df, 300, 100), F.lit(4.0))
    want = rows(states.viterbi_fold(df), "state")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("1", "7", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert rows(states.viterbi_d(df), "state") == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_methods_by_name(spark):
    x, y = gappy(4, 60)
    df = series(spark, x, y).withColumn("true_regime", F.when(F.col("x").isNull() | F.col("y").isNull(), "LossShort").otherwise("Stable"))
    names = methods.methods(F.lit(4.0), 400, 200)
    assert len(names) == 9
    for name in set(names) - {"gaussian_hmm"}:
        assert methods.run_method(name, df, F.lit(4.0), 400, 200).count() == 60
    for name in ("gaussian_hmm", "none"):
        with pytest.raises(ValueError):
            methods.run_method(name, df, F.lit(4.0), 400, 200)
    d = diagnostics.diagnose(df, 400, 200)
    assert rows(states.predict_regimes_simple(d, F.lit(4.0), jitter_quantile=0.1), "state") == rows(states.predict_regimes(d, F.lit(4.0)), "state")


def test_tuning_takes_the_best_of_each_grid(spark, monkeypatch):
    monkeypatch.setattr(hybrid, "fit", lambda df, c, **how: f"model {c}")
    quality = {("model 0.1", 0.0): (0.5, 3.0), ("model 1", 0.0): (0.7, 2.0), ("model 10", 0.0): (0.7, 1.0)}
    model, strength, trials = hybrid.tune(None, lambda m, s: quality.get((m, s), (0.7 + (s == 0.25) * 0.1, 1.0)))
    assert (model, strength) == ("model 10", 0.25) and len(trials) == 9


def test_sinks_and_reference_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "m string, v double")
    sinks.write_tables({"one": df}, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/one")).count() == 2
    for name in ("p", "q"):
        (tmp_path / name).mkdir()
    (tmp_path / "p/1.csv").write_text("a\n1\n")
    (tmp_path / "p/2.csv").write_text("a\n1\n")
    (tmp_path / "q/1.csv").write_text("a\n1\n")
    assert {r["dataset"]: r["files"] for r in sinks.csv_counts(spark, {"A": str(tmp_path / "p"), "B": str(tmp_path / "q")}).collect()} == {"A": 2, "B": 1}
    head, row = "dataset,source_file,participant_id,segment_id,time_s,x,y,case_segment,case_index", "ETDD70,f,1.0,s,0.0,1.0,2.0,c,0"
    for k, text in enumerate((head.replace(",x,", ",z,") + "\n" + row, head, f"{head}\n{row.replace('ETDD70', 'other')}", f"{head}\n{row.replace(',2.0,', ',NaN,')}")):
        (tmp_path / f"r{k}.csv").write_text(text + "\n")
        with pytest.raises(ValueError):
            recordings.read_reference(spark, str(tmp_path / f"r{k}.csv"))
    (tmp_path / "good.csv").write_text(f"{head}\n{row}\n")
    assert recordings.read_reference(spark, str(tmp_path / "good.csv")).first()["participant_id"] == "1"


@pytest.mark.parametrize("n", [1, 2, 5, 3000])
def test_exact_quantiles_like_numpy(spark, n):
    r = np.random.default_rng(n)
    frame = pd.DataFrame({"g": r.choice(["a", "b"], n), "v": r.normal(size=n).round(2), "w": r.integers(0, 3, n).astype(float)})
    df = spark.createDataFrame(frame).union(spark.createDataFrame([(None, 7.0, None), ("c", None, None)], "g string, v double, w double"))
    qs = (0.0, 0.25, 0.5, 0.999, 1.0)
    got = {(r["g"], r["name"]): r["quantiles"] for r in quantiles.exact_quantiles(df, ("v", "w"), qs, ("g",)).collect()}
    assert set(got) == {(g, c) for g in set(frame["g"]) for c in "vw"} | {(None, "v")} and got[None, "v"] == [7.0] * 5
    for g, part in frame.groupby("g"):
        for c in "vw":
            assert np.allclose(got[g, c], np.quantile(part[c], qs))
    whole = {r["name"]: r["quantiles"] for r in quantiles.exact_quantiles(df, ("v", "w"), qs).collect()}
    assert np.allclose(whole["v"], np.quantile([*frame["v"], 7.0], qs)) and np.allclose(whole["w"], np.quantile(frame["w"], qs))
    assert quantiles.exact_quantiles(df.where("false"), ("v",), qs).count() == 0


def test_exact_quantiles_in_narrow_brackets(spark, monkeypatch):
    values = np.random.default_rng(3).lognormal(size=20_000).round(3)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    monkeypatch.setattr(quantiles, "ACCURACY", 1000)  # a sketch that is not exact here
    got = quantiles.exact_quantiles(df, ("v",), (0.1, 0.5, 0.999)).first()["quantiles"]
    assert np.allclose(got, np.quantile(values, (0.1, 0.5, 0.999)))


@pytest.mark.parametrize("slices", [1, 2, 7, 500])
def test_numbering_by_slices(spark, slices):
    pairs = sorted({(f"p{i % 7}" if i % 5 else None, f"k{i}") for i in range(60)}, key=lambda p: (p[0] is not None, p[0] or "", p[1]))
    df = spark.createDataFrame(pairs[::-1], "p string, k string")
    got = windows.numbered(df, ("p", "k"), "n", df, slices).collect()
    assert sorted((r["n"], r["p"], r["k"]) for r in got if r["p"]) == [(i, *p) for i, p in enumerate(pairs) if p[0]]
    assert [r["k"] for r in sorted(got, key=lambda r: r["n"])] == [k for _, k in pairs]


def test_expectations_against_all_paths():
    from itertools import product

    r = np.random.default_rng(8)
    k, sizes = generative.K, np.array([3, 2, 4])
    begins = np.cumsum(sizes) - sizes
    z, mean, var = r.normal(size=(sizes.sum(), 6)), r.normal(size=(k, 6)), r.uniform(0.5, 2, (k, 6))
    start, change = np.log(r.dirichlet(np.ones(k))), np.log(r.dirichlet(np.ones(k), k))
    total, occupancy, pairs = generative.expectations(z, begins, sizes, start, change, mean, var)
    want_total, want_g, want_pairs = 0.0, np.zeros((len(z), k)), np.zeros((k, k))
    e = generative.emission_matrix(z, mean, var)
    for b, n in zip(begins, sizes, strict=True):
        paths = np.array(list(product(range(k), repeat=int(n))))
        logs = start[paths[:, 0]] + e[b + np.arange(n), paths].sum(1) + change[paths[:, :-1], paths[:, 1:]].sum(1)
        p = np.exp(logs - logs.max())
        want_total += logs.max() + np.log(p.sum())
        p /= p.sum()
        for i in range(n):
            np.add.at(want_g[b + i], paths[:, i], p)
            if i:
                np.add.at(want_pairs, (paths[:, i - 1], paths[:, i]), p)
    assert np.isclose(total, want_total) and np.allclose(occupancy, want_g) and np.allclose(pairs, want_pairs)


def test_models_by_dataset(spark):
    parts = [series(spark, *gappy(s, 60, 0.1), key=s).withColumn("dataset", F.lit("AB"[s % 2])) for s in range(4)]
    df = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(series(spark, [1.0], key=9).withColumn("dataset", F.lit("A")))
    df = diagnostics.diagnose(df, 400, 200).withColumn("true_regime", F.when(F.col("m_t") == 1, "LossShort").otherwise("Stable"))
    models = generative.fit_by(df, rounds=3, inits=1)
    assert set(models) == {"A", "B"}
    for name, m in models.items():
        assert sorted(m.names) == sorted(states.STATES) and np.all(np.diff(m.log_likelihood) >= -1e-6)
        assert m.predict(df.where(F.col("dataset") == name)).where("state is null").count() == 0
    with pytest.raises(ValueError):
        generative.fit(df.where("series = 9"), rounds=1, inits=1)
