"""The learned hybrid: 13 features, a class-balanced multinomial emission model, and decoding within finite blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import EXPANDED, FINITE_STATES, IDX, KEY, SHORT_GAP_SECONDS, STATES, argmax_first, gap_limit, ordered, whole
from ..sources.staging import shuffles_removed, staged
from .longseries import RANGE_ROWS, average_ranks, own_rows, with_halo
from .metrics import METRICS
from .repair import interpolated
from .states import decode_blocks, expanded_label, finite_blocks, viterbi_paths, whole_runs

FEATURES = ("log_c", "log_a", "log_u", "rank_c", "rank_a", "rank_u", "short_a", "short_u", "long_a", "long_u", "over_a", "over_u", "p")
#: The diagnostics that features are made of.
SCALES = {"c": "c_t", "a": "alpha_t", "u": "u_t"}
FLOOR = 1e-12


def average_rank(value: str, key: Sequence[str] = KEY) -> Column:
    """Share of the average rank among the series' values; 0.5 where there is none."""
    up = Window.partitionBy(*key).orderBy(F.col(value).asc_nulls_last())
    ranked = F.rank().over(up)
    same = F.count(value).over(up.rangeBetween(0, 0))  # the row's peers, in the same order
    return F.when(F.col(value).isNotNull(), (ranked + (same - 1) / 2) / F.count(value).over(whole(key))).otherwise(F.lit(0.5))


def centred(agg: Callable[[Column], Column], value: str, size: str, sizes: Sequence[int], key: Sequence[str], idx: str) -> Column:
    """agg over a centred frame whose size differs by row; an even size reaches one row further back. One window per size."""
    w = ordered(key, idx)
    out = F.lit(None).cast("double")
    for n in sizes:
        out = F.when(F.col(size) == n, agg(F.col(value)).over(w.rowsBetween(-(n // 2), n - 1 - n // 2))).otherwise(out)
    return out


def logs() -> dict[str, Column]:
    return {f"log_{k}": F.when(F.col(c).isNull(), 0.0).otherwise(F.log1p(F.greatest(F.col(c), F.lit(0.0)))) for k, c in SCALES.items()}


def derived() -> dict[str, Column]:
    return {**{f"over_{k}": F.col(f"rank_{k}") - F.col(f"short_{k}") for k in "au"}, "p": F.col("p_t").cast("double")}


def features(df: DataFrame, fs: str = "hz", key: Sequence[str] = KEY, idx: str = IDX, sizes: tuple[Sequence[int], Sequence[int]] | None = None, slice_rows: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add FEATURES. Frames need literal bounds, so the few distinct sizes are collected unless they are given. With
    `slice_rows` in slices of so many rows: ranks by ranges of values, frames over slices with their neighbours' rows."""
    absent = sorted({"c_t", "alpha_t", "u_t", "p_t"} - set(df.columns))
    if absent:
        raise ValueError(f"missing diagnostic columns: {absent}")
    df = df.withColumn("_ws", F.greatest(F.lit(3), F.bround(0.05 * F.col(fs)).cast("int"))).withColumn("_wl", F.greatest(F.lit(5), F.bround(0.15 * F.col(fs)).cast("int")))
    if sizes is None:
        got = df.agg(F.collect_set("_ws").alias("s"), F.collect_set("_wl").alias("l")).first()
        sizes = sorted(got["s"]), sorted(got["l"])
    names = SCALES
    df = df.withColumns(logs())
    if slice_rows:
        df = average_ranks(df, {c: f"rank_{k}" for k, c in names.items()}, key, idx, range_rows)
        df, key = with_halo(df, max(max(s, default=0) for s in sizes), slice_rows, idx), (*key, "_slice")
    else:
        df = df.withColumns({f"rank_{k}": average_rank(c, key) for k, c in names.items()})
    df = df.withColumns({f"short_{k}": centred(F.avg, f"rank_{k}", "_ws", sizes[0], key, idx) for k in "au"})
    df = df.withColumns({f"long_{k}": centred(F.max, f"rank_{k}", "_wl", sizes[1], key, idx) for k in "au"})
    df = df.withColumns(derived())
    df = df.drop("_ws", "_wl")
    return own_rows(df) if slice_rows else df


def staged_features(df: DataFrame, keep: Sequence[str] = (), key: Sequence[str] = KEY, idx: str = IDX) -> DataFrame:
    """df's key, idx, `keep` and FEATURES, its windows computed once; features that others give are made again when read."""
    told = [f"{side}_{k}" for side, ks in (("rank", "cau"), ("short", "au"), ("long", "au")) for k in ks]
    rows = staged(df.select(*key, idx, *keep, *SCALES.values(), "p_t", *told), "features")
    return rows.withColumns(logs() | derived()).select(*key, idx, *keep, *FEATURES)


def labels(df: DataFrame) -> DataFrame:
    return df.withColumn("label", expanded_label(F.col("true_regime"), F.col("unstable_subtype")))


def transition_counts(df: DataFrame, key: Sequence[str] = KEY, idx: str = IDX, pseudo: float = 0.5) -> DataFrame:
    """(left, right, n, log_p) over the finite states; pairs of neighbours within finite blocks, a pseudocount added."""
    df = finite_blocks(df, key, idx).where(F.col("block").isNotNull())
    pairs = df.withColumn("right", F.lead("label").over(Window.partitionBy(*key, "block").orderBy(idx))).where("right is not null")
    got = pairs.groupBy(F.col("label").alias("left"), "right").agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(1).select(F.explode(F.array(*(F.lit(s) for s in FINITE_STATES))).alias("left")).withColumn("right", F.explode(F.array(*(F.lit(s) for s in FINITE_STATES))))
    got = grid.join(got, ["left", "right"], "left").withColumn("n", F.coalesce(F.col("n"), F.lit(0)) + pseudo)
    return got.withColumn("log_p", F.log(F.greatest(F.col("n") / F.sum("n").over(Window.partitionBy("left")), F.lit(FLOOR))))


def start_counts(df: DataFrame, key: Sequence[str] = KEY, idx: str = IDX, pseudo: float = 0.5) -> DataFrame:
    """(state, n, log_p): the first label of each finite block."""
    df = finite_blocks(df, key, idx).where(F.col("block").isNotNull())
    first = df.groupBy(*key, "block").agg(F.min_by("label", idx).alias("state"))
    got = first.groupBy("state").agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(1).select(F.explode(F.array(*(F.lit(s) for s in FINITE_STATES))).alias("state"))
    got = grid.join(got, "state", "left").withColumn("n", F.coalesce(F.col("n"), F.lit(0)) + pseudo)
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # over four rows
    return got.withColumn("log_p", F.log(F.greatest(F.col("n") / total, F.lit(FLOOR))))


def balanced_sample(df: DataFrame, cap: int = 75_000, number: Column | None = None, seed: int = 20260728, idx: str = IDX) -> DataFrame:
    """At most `cap` rows of each label, those with the least portable draw. A cap is what this operator is for."""
    from ..functions.core import draw

    number = F.col(KEY[0]) if number is None else number
    df = df.withColumn("_u", draw(number, F.col(idx), seed, 31))
    # A histogram of draws tells how far the least `cap` reach, so that few more rows than these are sorted.
    bins = df.groupBy("label", F.floor(F.col("_u") * 4096).alias("_b")).agg(F.count("*").alias("_n"))
    so_far = F.sum("_n").over(Window.partitionBy("label").orderBy("_b"))
    last = bins.withColumn("_s", so_far - F.col("_n")).where(F.col("_s") < cap).groupBy(F.col("label").alias("_label")).agg(F.max("_b").alias("_last"))
    near = df.join(F.broadcast(last), F.col("label") == F.col("_label")).where(F.floor(F.col("_u") * 4096) <= F.col("_last"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("_u", number, idx))
    return near.withColumn("_r", place).where(F.col("_r") <= cap).drop("_r", "_u", "_label", "_last")


@dataclass
class HybridModel:
    """Standardised multinomial regression with log transition and start matrices over the finite states."""

    mean: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray  # states x features
    intercepts: np.ndarray
    transition_log: np.ndarray
    start_log: np.ndarray
    c_value: float

    def emissions(self, df: DataFrame, out: str = "emissions") -> DataFrame:
        """Add log-probabilities of the four finite states, as expressions on FEATURES."""
        z = [(F.col(f) - float(m)) / float(s) for f, m, s in zip(FEATURES, self.mean, self.scale, strict=True)]
        df = df.withColumn("_z", F.array(*z))
        scores = [sum((F.col("_z")[i] * float(w) for i, w in enumerate(ws)), F.lit(float(b))) for ws, b in zip(self.coefficients, self.intercepts, strict=True)]
        df = df.withColumn("_l", F.array(*scores))
        top = F.array_max("_l")
        norm = F.aggregate(F.transform("_l", lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v)
        return df.withColumn(out, F.transform("_l", lambda v: F.log(F.greatest(F.exp(v - top) / norm, F.lit(FLOOR))))).drop("_z", "_l")


def regression(rows: DataFrame, c_value: float, classes: int = len(FINITE_STATES), passes: int = 100, tol: float = 1e-9) -> np.ndarray:
    """Weights (classes x columns of z, of which the first is 1 and its weights, which sum to 0, cost nothing) that minimise half
    the squared weights plus c_value times the weighted multinomial losses of rows (z, k, w).

    Newton's method: each pass over the rows sends one row of sums a task (loss, gradient, second derivatives), and a dozen
    passes reach the minimum. A step that does not lower the objective is halved."""
    width = len(rows.select("z").first()[0])
    size = classes * width

    def sums(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + size + size * size)
            for b in batches:
                x = b["z"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                k, w = b["k"].to_numpy(), b["w"].to_numpy()
                logits = x @ at.T
                top = logits.max(1, keepdims=True)
                e = np.exp(logits - top)
                p = e / e.sum(1, keepdims=True)
                total[0] += w @ (np.log(e.sum(1)) + top[:, 0] - logits[np.arange(len(k)), k])
                total[1 : 1 + size] += ((w[:, None] * (p - np.eye(classes)[k])).T @ x).ravel()
                second = np.empty((classes, width, classes, width))
                for i in range(classes):
                    for j in range(classes):
                        second[i, :, j] = x.T @ (x * (w * p[:, i] * ((i == j) - p[:, j]))[:, None])
                total[1 + size :] += second.ravel()
            yield pa.record_batch({"s": pa.array([total.tolist()], pa.list_(pa.float64()))})

        got = np.sum([r["s"] for r in rows.mapInArrow(f, "s array<double>").collect()], 0)
        free = at.copy()
        free[:, 0] = 0
        loss = c_value * got[0] + 0.5 * (free**2).sum()
        slope = c_value * got[1 : 1 + size] + free.ravel()
        bend = c_value * got[1 + size :].reshape(size, size) + np.diag(np.tile(np.arange(width) > 0, classes).astype(float))
        first = np.arange(classes) * width
        bend[np.ix_(first, first)] += 1.0  # only bears on the intercepts' sum, which stays 0
        return loss, slope, bend

    at, scale = np.zeros((classes, width)), 1.0
    loss, slope, bend = sums(at)
    for _ in range(passes):
        step = scale * np.linalg.solve(bend, -slope).reshape(at.shape)
        new = sums(at + step)
        if new[0] > loss + 1e-12 * abs(loss):
            if scale < 1e-6:
                break
            scale /= 2
            continue
        at, (loss, slope, bend), full = at + step, new, scale == 1
        scale = min(1.0, scale * 2)
        if full and np.abs(step).max() < tol * max(1.0, np.abs(at).max()):
            break
    return at


def fit(df: DataFrame, c_value: float = 1.0, key: Sequence[str] = KEY, idx: str = IDX, cap: int = 75_000, seed: int = 20260728, number: Column | None = None) -> HybridModel:
    """Fit on labelled rows with FEATURES. The objective is half the squared weights plus C times the weighted losses, hence
    regParam = 1 / (C N); class weights are N / (K n_class)."""
    df = labels(df)
    rows = balanced_sample(df.where(F.col("m_t") == 0), cap, number, seed, idx).cache()
    try:
        counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
        if set(FINITE_STATES) - set(counts):
            raise ValueError(f"labels are missing: {sorted(set(FINITE_STATES) - set(counts))}")
        n = sum(counts.values())
        moments = rows.agg(*(F.avg(f).alias(f"m_{f}") for f in FEATURES), *(F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES)).first()
        mean = np.array([moments[f"m_{f}"] for f in FEATURES])
        scale = np.array([moments[f"s_{f}"] or 1.0 for f in FEATURES])
        weight, target = F.lit(None).cast("double"), F.lit(None).cast("double")
        for k, s in enumerate(FINITE_STATES):
            weight = F.when(F.col("label") == s, n / (len(FINITE_STATES) * counts[s])).otherwise(weight)
            target = F.when(F.col("label") == s, float(k)).otherwise(target)
        z = F.array(F.lit(1.0), *((F.col(f) - float(m)) / float(s) for f, m, s in zip(FEATURES, mean, scale, strict=True)))
        weights = regression(rows.select(z.alias("z"), target.cast("int").alias("k"), weight.alias("w")), c_value)
    finally:
        rows.unpersist()
    with shuffles_removed(df.sparkSession):
        t = {(r["left"], r["right"]): r["log_p"] for r in transition_counts(df, key, idx).collect()}
        s = {r["state"]: r["log_p"] for r in start_counts(df, key, idx).collect()}
    change = np.array([[t[a, b] for b in FINITE_STATES] for a in FINITE_STATES])
    return HybridModel(mean, scale, weights[:, 1:], weights[:, 0], change, np.array([s[a] for a in FINITE_STATES]), c_value)


def predict(df: DataFrame, fs: Column, transition_log: np.ndarray, start_log: np.ndarray, strength: float = 1.0, emissions: str = "emissions", out: str = "label", key: Sequence[str] = KEY, idx: str = IDX, seconds: float = SHORT_GAP_SECONDS, slice_rows: int | None = None) -> DataFrame:
    """Add the expanded state's number: missing rows by their run's length, finite rows by the largest emission (strength
    <= 0) or by Viterbi over each finite block with matrices times `strength`. `emissions` may come from any model."""
    lost = F.when(F.col("r_t") <= gap_limit(fs, seconds), 2).otherwise(3)
    if strength <= 0:
        df = df.withColumn("_p", argmax_first(F.col(emissions)))
    else:
        df = decode_blocks(df, emissions, strength * np.asarray(transition_log), strength * np.asarray(start_log), "_p", key, idx, slice_rows).drop("block")
    state = F.element_at(F.array(*(F.lit(s) for s in FINITE_STATES)), F.col("_p") + 1)
    return df.withColumn(out, F.when(F.col("m_t") == 1, lost).otherwise(state)).drop("_p")


def state_name(label: str = "label") -> Column:
    return F.element_at(F.array(*(F.lit(s) for s in EXPANDED)), F.col(label) + 1)


def tune(train: DataFrame, evaluate: Callable[[HybridModel, float], tuple[float, float]], c_grid: Sequence[float] = (0.1, 1, 10), strengths: Sequence[float] = (0, 0.1, 0.25, 0.5, 0.75, 1), **how) -> tuple[HybridModel, float, list[tuple]]:
    """C by (Q, -mae) at strength 0, then the strength with that model. evaluate(model, strength) gives (Q, mae) on
    development cases, whose emissions the caller may cache. Returns (model, strength, table of trials)."""
    trials, models = [], {}
    for c in c_grid:
        models[c] = fit(train, c, **how)
        q, mae = evaluate(models[c], 0.0)
        trials.append(("C", c, q, mae))
    best = min(trials, key=lambda t: (-t[2], t[3]))[1]
    for s in strengths:
        q, mae = evaluate(models[best], s)
        trials.append(("strength", s, q, mae))
    chosen = min((t for t in trials if t[0] == "strength"), key=lambda t: (-t[2], t[3]))[1]
    return models[best], chosen, trials


def predict_grid(df: DataFrame, fs: Column, models: dict[float, HybridModel], strengths: Sequence[float], key: Sequence[str] = KEY, idx: str = IDX, seconds: float = SHORT_GAP_SECONDS) -> DataFrame:
    """df's rows once for each trial (c, strength; numbered `trial`), with `label` as predict() gives it for that model and
    strength. All trials come from one scan and one stream of blocks: emissions of all models are columns of one pass, and
    each block is decoded with its trial's matrices."""
    for k, m in enumerate(models.values()):
        df = m.emissions(df, f"_e{k}")
    grid = [(k, c, s) for k, c in enumerate(models) for s in strengths]
    each = [F.struct(F.lit(float(c)).alias("c"), F.lit(float(s)).alias("strength"), F.lit(n).alias("trial"), F.col(f"_e{k}").alias("emissions")) for n, (k, c, s) in enumerate(grid)]
    df = df.withColumn("_t", F.explode(F.array(*each))).select(*(c for c in df.columns if not c.startswith("_e")), "_t.*")
    used = list(models.values())
    change = np.stack([s * np.asarray(used[k].transition_log) for k, _, s in grid])
    start = np.stack([s * np.asarray(used[k].start_log) for k, _, s in grid])
    df = decode_blocks(df, "emissions", change, start, "_p", (*key, "trial"), idx, which="trial").drop("block")
    place = F.when(F.col("m_t") == 0, F.when(F.col("strength") <= 0, argmax_first(F.col("emissions"))).otherwise(F.col("_p")))
    lost = F.when(F.col("r_t") <= gap_limit(fs, seconds), 2).otherwise(3)
    state = F.element_at(F.array(*(F.lit(s) for s in FINITE_STATES)), place + 1)
    return df.withColumn("label", F.when(F.col("m_t") == 1, lost).otherwise(state)).drop("_p", "emissions")


#: Rows times trials that are decoded and scored at once; a longer series takes its trials one by one.
TRIAL_ROWS = 400_000


def log_emissions(m: HybridModel, features: np.ndarray) -> np.ndarray:
    """HybridModel.emissions() of rows of FEATURES, summed in the same order."""
    logits = np.tile(np.asarray(m.intercepts, np.float64), (len(features), 1))
    for i in range(features.shape[1]):
        logits += ((features[:, i] - m.mean[i]) / m.scale[i])[:, None] * m.coefficients[:, i]
    e = np.exp(logits - logits.max(1, keepdims=True))
    return np.log(np.maximum(e / (e[:, :1] + e[:, 1:2] + e[:, 2:3] + e[:, 3:]), FLOOR))


def trial_scores(cases: DataFrame, fs: Column, models: dict[float, HybridModel], strengths: Sequence[float], width: float, height: float, key: Sequence[str] = KEY, idx: str = IDX, seconds: float = SHORT_GAP_SECONDS) -> DataFrame:
    """(key, dataset, participant_id, c, strength, METRICS): each series repaired by each trial's states and scored, as
    predict(), repair() and metrics.evaluate() do it, with rows sorted once and never multiplied by trials.

    What a state asks for (the interpolated value, the median) does not hang on the trial, so it is made once a row; whole
    series then stream through Python, which decodes all trials in step and sends a row for each series and trial. Dataset and
    participant are those of the series."""
    used, grid = list(models.values()), [(k, float(c), float(s)) for k, c in enumerate(models) for s in strengths]
    of = [c for c in ("dataset", "participant_id") if c not in key]
    near = ordered(key, idx).rowsBetween(-3, 3)
    values = {f"_{v}{n}": c for v in ("x", "y") for n, c in (("i", interpolated(v, key, idx)), ("7", F.percentile(v, F.lit(0.5)).over(near)))}
    regime = F.coalesce(sum((F.when(F.col("true_regime") == s, k).otherwise(0) for k, s in enumerate(STATES, 1)), F.lit(0)), F.lit(0))
    df = cases.withColumns({**values, "_begin": F.row_number().over(ordered(key, idx)) == 1})
    pairs = [("x", "y"), ("_xi", "_yi"), ("_x7", "_y7"), ("x_clean", "y_clean"), ("x_degraded", "y_degraded")]
    numbers = [F.col(c).cast("double").alias(c) for c in (*FEATURES, *(v for p in pairs for v in p))]
    df = df.select(*key, *of, F.col(idx), "_begin", F.lit(True).alias("_in"), F.coalesce(F.col("m_t") == 1, F.lit(False)).alias("_gone"), F.coalesce(F.col("r_t") <= gap_limit(fs, seconds), F.lit(False)).alias("_short"), regime.cast("int").alias("_regime"), *numbers)
    schema = T.StructType([*(df.schema[c] for c in (*key, *of)), *(T.StructField(c, T.DoubleType()) for c in ("c", "strength", *METRICS))])

    def labels_of(t: pa.Table, number: Callable, gone: np.ndarray, starts: np.ndarray, some: Sequence[tuple]) -> np.ndarray:
        """Expanded states, trials x rows."""
        out = np.where(t["_short"].to_numpy(), 2, 3) * np.ones((len(some), 1), np.int64)
        here = np.flatnonzero(~gone)
        if not len(here):
            return out
        first = np.ones(len(here), bool)
        first[1:] = (np.diff(here) > 1) | starts[here[1:]]
        begins = np.flatnonzero(first)
        sizes, n = np.diff(np.append(begins, len(here))), len(here)
        features = np.column_stack([number(f)[here] for f in FEATURES])
        logs = {k: log_emissions(used[k], features) for k in {k for k, _, _ in some}}
        for j, (k, _, s) in enumerate(some):
            if s <= 0:
                out[j, here] = np.take(FINITE_STATES, logs[k].argmax(1))
        walked = [(j, k, s) for j, (k, _, s) in enumerate(some) if s > 0]
        if walked:
            change, start = (np.repeat(np.stack([s * np.asarray(getattr(used[k], m), np.float64) for _, k, s in walked]), len(begins), 0) for m in ("transition_log", "start_log"))
            path = viterbi_paths(np.concatenate([logs[k] for _, k, _ in walked]), np.concatenate([begins + n * i for i in range(len(walked))]), np.tile(sizes, len(walked)), change, start)
            for i, (j, _, _) in enumerate(walked):
                out[j, here] = np.take(FINITE_STATES, path[n * i : n * (i + 1)])
        return out

    def scored(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        number = lambda c: t[c].cast(pa.float64()).to_numpy(zero_copy_only=False)
        starts = t["_begin"].to_numpy()
        at = np.flatnonzero(starts)
        told = {tuple(p): tuple(number(c) for c in p) for p in pairs}  # NULL is NaN
        regime, gone = t["_regime"].to_numpy(), t["_gone"].to_numpy()
        (xc, yc), (xd, yd) = told[pairs[3]], told[pairs[4]]
        ref = ~(np.isnan(xc) | np.isnan(yc))
        total = lambda v: np.add.reduceat(np.where(np.isnan(v), 0.0, v) if v.dtype == np.float64 else v.astype(np.int64), at)

        def mean(v: np.ndarray, where: np.ndarray) -> np.ndarray:
            n = total(where)
            return np.where(n > 0, total(np.where(where, v, 0.0)) / np.maximum(n, 1), np.nan)

        def step(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.append(np.nan, np.sqrt(np.diff(x) ** 2 + np.diff(y) ** 2))

        was, clean_step = np.sqrt((xd - xc) ** 2 + (yd - yc) ** 2), step(xc, yc)
        bad = (regime == 5) & ref & ~np.isnan(xd) & ~np.isnan(yd)
        every = max(1, TRIAL_ROWS // t.num_rows)
        for a in range(0, len(grid), every):
            some = grid[a : a + every]
            for (_, c, s), label in zip(some, labels_of(t, number, gone, starts, some), strict=True):
                x, y = (np.where(label == 2, told[pairs[1]][i], np.where(label == 3, np.nan, np.where(label >= 4, told[pairs[2]][i], told[pairs[0]][i]))) for i in (0, 1))
                out = ~(np.isnan(x) | np.isnan(y))
                both, off = ref & out, np.sqrt((x - xc) ** 2 + (y - yc) ** 2)
                moving = both & (regime == 2) & ~starts & np.append(False, both[:-1])
                same = out & (np.abs(x - xc) <= 1e-9) & (np.abs(y - yc) <= 1e-9)
                ei, eo = mean(was, bad), mean(np.where(out, off, was), bad)
                mo, mc = mean(step(x, y), moving), mean(clean_step, moving)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ei > 1e-12, 1 - eo / ei, np.nan)
                    moved = np.where(mc > 0, np.clip(1 - np.abs(mo / mc - 1), 0, 1), np.nan)
                inside = (x >= 0) & (x <= width) & (y >= 0) & (y <= height)
                got = {
                    "mae": mean(off, both), "rmse": np.sqrt(mean(off * off, both)), "retention": mean(out, np.ones(len(x), bool)),
                    "long_hallucination": mean(out, regime == 4), "short_recovery": mean(out, regime == 3), "movement_preservation": moved,
                    "stable_preservation": mean(same, (regime == 1) & ref), "unstable_repair_gain": gain, "unstable_repair_score": np.clip(gain, 0, 1), "plausibility_score": mean(inside, out),
                }
                cols = [t[k].take(pa.array(at)).combine_chunks() for k in (*key, *of)]
                cols += [pa.array(np.full(len(at), v)) for v in (c, s)] + [pa.array(got[m], mask=np.isnan(got[m])) for m in METRICS]
                yield from pa.Table.from_arrays(cols, [*key, *of, "c", "strength", *METRICS]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches):
            yield from scored(t)

    return df.sortWithinPartitions(*key, idx).mapInArrow(run, schema)


def tuning_table(cases: DataFrame, fs: Column, models: dict[float, HybridModel], strengths: Sequence[float], width: float, height: float, key: Sequence[str] = KEY, idx: str = IDX) -> DataFrame:
    """(c, strength, Q_local, mae, rmse, chosen) for each trial: development cases (prepared, with FEATURES, dataset and
    participant_id) repaired by each trial's states and scored as mean over datasets of participants' means.

    C is chosen at strength 0 (always tried) by the largest Q_local, then the least mae, then the least C; the strength in the
    same way among that C's trials. Scores alike to nine digits (mae: six) tie. No cases: no rows."""
    from .aggregate import dataset_and_macro, participant_means

    scores = trial_scores(cases, fs, models, sorted({0.0, *map(float, strengths)}), width, height, key, idx).withColumn("method", F.struct("c", "strength"))
    table = dataset_and_macro(participant_means(scores))[1].select("method.*", "Q_local", "mae", "rmse")
    table = staged(table, "trials")
    better = [F.round("Q_local", 9).desc_nulls_last(), F.round("mae", 6).asc_nulls_last()]
    best = table.where("strength = 0").orderBy(*better, "c").limit(1).select(F.col("c").alias("_c"))
    pick = table.join(F.broadcast(best), F.col("c") == F.col("_c")).orderBy(*better, "strength").limit(1).select(F.col("_c"), F.col("strength").alias("_s"))
    return table.join(F.broadcast(pick), (F.col("c") == F.col("_c")) & (F.col("strength") == F.col("_s")), "left").withColumn("chosen", F.col("_c").isNotNull()).drop("_c", "_s")


def tune_at_once(train: DataFrame, cases: DataFrame, fs: Column, width: float, height: float, c_grid: Sequence[float] = (0.1, 1, 10), strengths: Sequence[float] = (0, 0.1, 0.25, 0.5, 0.75, 1), key: Sequence[str] = KEY, idx: str = IDX, **how) -> tuple[HybridModel, float, DataFrame]:
    """(model, strength, tuning_table()): the models of all C are fitted, then all trials are scored in one job."""
    models = {float(c): fit(train, c, key=key, idx=idx, **how) for c in c_grid}
    table = tuning_table(cases, fs, models, strengths, width, height, key, idx)
    best = table.where("chosen").first()
    if best is None:
        raise ValueError("there are no development cases")
    return models[best["c"]], best["strength"], table
