"""A Gaussian hidden Markov model fitted by expectation maximisation, one small row of statistics per batch and round."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import IDX, KEY, STATES, ordered, whole
from ..sources.staging import staged, with_small
from .quantiles import exact_quantiles
from .slices import scan
from .states import decode_runs, whole_runs

INPUTS = ("m_t", "r_t", "c_t", "alpha_t", "u_t", "p_t")
LOGGED = ("r_t", "c_t", "alpha_t", "u_t")
K = 5


def logged(df: DataFrame) -> DataFrame:
    """INPUTS as doubles l_<name>; the four scales are log1p of what is above 0."""
    return df.withColumns({f"l_{c}": F.when(F.col(c).isNotNull(), F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0)))) if c in LOGGED else F.col(c).cast("double") for c in INPUTS})


def robust_scale(df: DataFrame) -> DataFrame:
    """One row per input: name, center (exact pooled median) and scale (interquartile range, 1 if below 1e-6)."""
    got = exact_quantiles(logged(df), [f"l_{c}" for c in INPUTS], (0.25, 0.5, 0.75)).select(F.substring("name", 3, 99).alias("name"), "quantiles")
    q = F.col("quantiles")
    every = df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, INPUTS))).alias("place", "name"))  # a column of NULLs has a row too
    return every.join(got, "name", "left").select("place", "name", q[1].alias("center"), F.when(F.coalesce(q[2] - q[0], F.lit(0.0)) < 1e-6, 1.0).otherwise(q[2] - q[0]).alias("scale"))


def scaled(df: DataFrame, center: Sequence[float], scale: Sequence[float], out: str = "z") -> DataFrame:
    cols = [(F.coalesce(F.col(f"l_{c}"), F.lit(float(m))) - float(m)) / float(s) for c, m, s in zip(INPUTS, center, scale, strict=True)]
    return logged(df).withColumn(out, F.array(*cols)).drop(*(f"l_{c}" for c in INPUTS))


def gaussian_log_emission(z: Column, mean: Sequence[float], var: Sequence[float]) -> Column:
    """Log density of a diagonal Gaussian at the array z."""
    terms = [-0.5 * (F.log(F.lit(2 * np.pi * float(v))) + (z[i] - float(m)) * (z[i] - float(m)) / float(v)) for i, (m, v) in enumerate(zip(mean, var, strict=True))]
    return sum(terms[1:], terms[0])


def fit_by(df: DataFrame, by: str = "dataset", rounds: int = 50, **how) -> dict[str, GaussianHMM]:
    """One model for each dataset; `by` has few values."""
    return {r[0]: fit(df.where(F.col(by) == r[0]), rounds, **how) for r in df.select(by).where(F.col(by).isNotNull()).distinct().orderBy(by).collect()}


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def emission_matrix(z: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    return -0.5 * (np.log(2 * np.pi * var).sum(1) + (((z[:, None] - mean) ** 2) / var).sum(2))


#: Rows whose pair posteriors are summed at a time.
PAIR_ROWS = 65_536
#: Rows of whole series that go in step; more series in step take as many steps.
STEP_ROWS = 131_072


def gathered(tables: Iterator[pa.Table], rows: int = STEP_ROWS) -> Iterator[pa.Table]:
    """The same tables, one behind another up to so many rows or one table."""
    held, n = [], 0
    for t in tables:
        if held and n + t.num_rows > rows:
            yield pa.concat_tables(held)
            held, n = [], 0
        held.append(t)
        n += t.num_rows
    if held:
        yield pa.concat_tables(held)


def expectations(z: np.ndarray, begins: np.ndarray, sizes: np.ndarray, start: np.ndarray, change: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple:
    """(log likelihood, occupancy of each row, summed pair posteriors) of series of one row or more that begin at `begins`
    and follow one another; all series in step. Rows are scaled to sums of 1; where that fails for want of digits (a model
    with odds next to nil), in log space."""
    e = emission_matrix(z, mean, var)
    got = scaled_expectations(e, begins, sizes, start, change)
    return log_expectations(e, begins, sizes, start, change) if got is None else got


#: new_model() gives no odds under 1e-12.
LEAST = -30.0


def scaled_expectations(e: np.ndarray, begins: np.ndarray, sizes: np.ndarray, start: np.ndarray, change: np.ndarray) -> tuple | None:
    """expectations() of log emissions without a logarithm for each pair of states. None where a start or change is rarer than
    LEAST: then what is too small to hold could matter later."""
    if min(np.min(start), np.min(change)) < LEAST:
        return None
    top = e.max(1)
    here, move = np.exp(e - top[:, None]), np.exp(change)
    steps = steps_of(begins, sizes)
    a, b, c = np.empty_like(e), np.ones_like(e), np.empty(len(e))
    a[begins] = np.exp(start) * here[begins]
    c[begins] = a[begins].sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        a[begins] /= c[begins, None]
        for rows in steps:
            now = (a[rows - 1] @ move) * here[rows]
            c[rows] = n = now.sum(1)
            a[rows] = now / n[:, None]
        if not (np.isfinite(c).all() and (c > 1e-280).all()):
            return None
        onward = here / c[:, None]  # times what follows
        for rows in reversed(steps):
            onward[rows] *= b[rows]
            b[rows - 1] = onward[rows] @ move.T
    if not np.isfinite(b).all():
        return None
    first = np.zeros(len(e), bool)
    first[begins] = True
    later = np.flatnonzero(~first)
    return float(np.log(c).sum() + top.sum()), a * b, move * (a[later - 1].T @ onward[later])


def log_expectations(e: np.ndarray, begins: np.ndarray, sizes: np.ndarray, start: np.ndarray, change: np.ndarray) -> tuple:
    row_begin = np.zeros(len(e), bool)
    row_begin[begins] = True
    order = np.argsort(-sizes, kind="stable")
    by_size, by_begin = sizes[order], begins[order]
    a, b = np.empty_like(e), np.zeros_like(e)
    a[begins] = start + e[begins]
    steps = [by_begin[: int(np.searchsorted(-by_size, -i, "left"))] + i for i in range(1, int(by_size[0]))]  # rows i of series that have one
    for rows in steps:
        a[rows] = e[rows] + log_sum(a[rows - 1][:, :, None] + change, 1)
    for rows in reversed(steps):
        b[rows - 1] = log_sum(change + (e[rows] + b[rows])[:, None, :], 2)
    total = log_sum(a[begins + sizes - 1], 1)
    of_row = np.repeat(total, sizes)
    pairs = np.zeros((K, K))
    later = np.flatnonzero(~row_begin)
    for k in range(0, len(later), PAIR_ROWS):
        at = later[k : k + PAIR_ROWS]
        pairs += np.exp(a[at - 1][:, :, None] + change + (e[at] + b[at] - of_row[at, None])[:, None, :]).sum(0)
    return float(total.sum()), np.exp(a + b - of_row[:, None]), pairs


@dataclass
class GaussianHMM:
    center: np.ndarray
    scale: np.ndarray
    start_log: np.ndarray
    change_log: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    names: list[str]
    log_likelihood: list[float]

    def predict(self, df: DataFrame, out: str = "state", key: Sequence[str] = KEY, idx: str = IDX) -> DataFrame:
        df = decode_series(scaled(df, self.center, self.scale, "_z"), "_z", self.mean, self.var, self.change_log, self.start_log, "_c", key, idx)
        return df.withColumn(out, F.element_at(F.array(*(F.lit(n) for n in self.names)), F.col("_c") + 1)).drop("_z", "_c")


def decode_series(df: DataFrame, z: str, mean: np.ndarray, var: np.ndarray, change: np.ndarray, start: np.ndarray, out: str, key: Sequence[str], idx: str, slice_rows: int | None = None) -> DataFrame:
    """Add `out`: the component of each row on the best path through its whole series."""
    first = F.row_number().over(ordered(key, idx)) == 1
    return decode_runs(df, z, first, F.lit(True), change, start, out, key, idx, lambda x: emission_matrix(x, mean, var), slice_rows)


def overlap_counts(df: DataFrame, component: str = "component", state: str = "true_regime") -> DataFrame:
    return df.groupBy(component, state).agg(F.count("*").alias("n"))


def align(counts: dict[tuple[int, str], int]) -> list[str]:
    """The one-to-one naming of components that covers most rows; ties go to the first in the order of STATES."""
    best = max(permutations(range(len(STATES))), key=lambda p: (sum(counts.get((k, STATES[s]), 0) for k, s in enumerate(p)), [-s for s in p]))
    return [STATES[s] for s in best]


def dealt(df: DataFrame, z: str, keep: Sequence[str] = (), key: Sequence[str] = KEY, idx: str = IDX) -> DataFrame:
    """Rows as z, sorted by series once, with the marks that em_round() needs; each round is then one pass over what a task holds."""
    w = ordered(key, idx)
    marks = ((F.row_number().over(w) == 1).alias("_begin"), (F.count("*").over(whole(key)) > 1).alias("_many"), F.lit(True).alias("_in"))
    return df.select(*key, idx, *keep, F.col(z).alias("z"), *marks).sortWithinPartitions(*key, idx)


def em_round(rows: DataFrame, start: np.ndarray, change: np.ndarray, mean: np.ndarray, var: np.ndarray) -> DataFrame:
    """One round on dealt rows of series of two rows or more. A row for each component: log_likelihood (under the given
    model), occupancy, and the new model: start and change (logs), mean and var. Tasks send sums of fixed size."""
    start, change, mean, var = (np.asarray(x, np.float64) for x in (start, change, mean, var))
    n_in = mean.shape[1]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(whole_runs(batches)):
            z = t["z"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            at = np.flatnonzero(t["_begin"].to_numpy())
            total, g, pairs = expectations(z, at, np.diff(np.append(at, len(z))), start, change, mean, var)
            flat = np.concatenate([[total], g[at].sum(0), pairs.ravel(), g.sum(0), (g.T @ z).ravel(), (g.T @ z**2).ravel()])
            yield pa.record_batch({"s": [flat]})

    return new_model(rows.select("z", "_begin", "_in").mapInArrow(gather, "s array<double>"), n_in)


def new_model(sums: DataFrame, n_in: int) -> DataFrame:
    """A row for each component from sums (log likelihood, first rows' occupancy, pairs, occupancy, it times z and z squared)."""
    first, pairs, held, ones, squares = np.cumsum([1, K, K * K, K, K * n_in]).tolist()
    sums = sums.agg(F.array(*(F.sum(F.col("s")[i]) for i in range(squares + K * n_in))).alias("s"))
    k, v, tiny = F.col("component"), F.col("s"), F.lit(1e-12)
    part = lambda begin, n: F.slice(v, k * n + begin + 1, F.lit(n))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    out = sums.select("s", F.explode(F.sequence(F.lit(0), F.lit(K - 1))).alias("component"))
    out = out.withColumns({"n": F.greatest(F.get(v, k + held), tiny), "left": F.greatest(add(part(pairs, K)), F.lit(1e-300))})
    out = out.withColumn("mean", F.transform(part(ones, n_in), lambda x: x / F.col("n")))
    return out.select(
        "component",
        v[0].alias("log_likelihood"),
        F.col("n").alias("occupancy"),
        F.log(F.greatest(F.get(v, k + first) / add(F.slice(v, first + 1, K)), tiny)).alias("start"),
        F.transform(part(pairs, K), lambda x: F.log(F.greatest(x / F.col("left"), tiny))).alias("change"),
        "mean",
        F.zip_with(part(squares, n_in), "mean", lambda q, m: F.greatest(q / F.col("n") - m * m, F.lit(1e-3))).alias("var"),
    )


def dealt_slices(df: DataFrame, z: str, slice_rows: int, key: Sequence[str] = KEY, idx: str = IDX) -> DataFrame:
    """(key, _slice, _first, z): the rows z of series of two rows or more in slices of `slice_rows` numbers of idx, staged."""
    cut = df.select(*key, idx, F.col(z).alias("z"), F.floor(F.col(idx) / slice_rows).alias("_slice"))
    packed = cut.groupBy(*key, "_slice").agg(F.array_sort(F.collect_list(F.struct(idx, "z"))).alias("_rows"))
    packed = staged(packed.select(*key, "_slice", F.transform("_rows", lambda r: r["z"]).alias("z")), "slices")
    whole = packed.groupBy(*key).agg(F.sum(F.size("z")).alias("_n"), F.min("_slice").alias("_from"))
    return staged(with_small(packed, whole, list(key)).where("_n > 1").select(*key, "_slice", (F.col("_slice") == F.col("_from")).alias("_first"), "z"), "slices")


def steps_of(begins: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """For i = 1, 2, ...: rows i of all pieces that have one."""
    order = np.argsort(-sizes, kind="stable")
    by_size, by_begin = sizes[order], begins[order]
    return [by_begin[: int(np.searchsorted(-by_size, -i, "left"))] + i for i in range(1, int(by_size[0]) if len(by_size) else 0)]


def em_round_slices(packed: DataFrame, start: np.ndarray, change: np.ndarray, mean: np.ndarray, var: np.ndarray, key: Sequence[str] = KEY) -> DataFrame:
    """em_round() for series of any length, from dealt_slices(): a task holds slices, never a series.

    Each slice is a matrix of log sums over all its paths from each state before it to each at its end. One row for each
    slice is scanned in the order of a series for what enters it, and against it for what follows; then each slice sums its
    statistics, the pair at its beginning with the row before included.
    """
    start, change, mean, var = (np.asarray(x, np.float64) for x in (start, change, mean, var))
    n_in, by = mean.shape[1], [*key, "_slice"]

    def opened(b: pa.RecordBatch) -> tuple:
        z = b["z"].flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, n_in)
        cut = b["z"].offsets.to_numpy().astype(np.int64) - b["z"].offsets[0].as_py()
        return z, cut[:-1], np.diff(cut), emission_matrix(z, mean, var), b["_first"].to_numpy(zero_copy_only=False)

    def onward(e: np.ndarray, begins: np.ndarray, steps: list[np.ndarray], heads: np.ndarray) -> np.ndarray:
        a = np.full_like(e, -np.inf)
        a[begins] = heads + e[begins]
        for rows in steps:
            a[rows] = e[rows] + log_sum(a[rows - 1][:, :, None] + change, 1)
        return a

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, begins, sizes, e, first = opened(b)
            steps, ends = steps_of(begins, sizes), begins + sizes - 1
            of = np.stack([onward(e, begins, steps, np.where(first[:, None], start, change[i]))[ends] for i in range(K)], 1)
            yield pa.record_batch({c: b[c] for c in by} | {"first": b["_first"], "m": pa.array(list(of.reshape(-1, K * K)), pa.list_(pa.float64()))})

    def entering(rows: Iterator[dict]) -> Iterator[dict]:
        v = np.zeros(K)
        for r in rows:
            m = np.array(r["m"]).reshape(K, K)
            yield {c: r[c] for c in by} | {"enter": v.tolist()}  # of no use to a series' first slice
            v = m[0] if r["first"] else log_sum(v[:, None] + m, 0)

    def following(rows: Iterator[dict]) -> Iterator[dict]:
        v = np.zeros(K)
        for r in rows:  # from the last slice to the first
            yield {c: r[c] for c in by} | {"leave": v.tolist()}
            v = np.zeros(K) if r["first"] else log_sum(np.array(r["m"]).reshape(K, K) + v, 1)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, begins, sizes, e, first = opened(b)
            enter, leave = (b[c].flatten().to_numpy(zero_copy_only=False).reshape(-1, K) for c in ("enter", "leave"))
            steps, ends = steps_of(begins, sizes), begins + sizes - 1
            a = onward(e, begins, steps, np.where(first[:, None], start, log_sum(enter[:, :, None] + change, 1)))
            back = np.zeros_like(e)
            back[ends] = leave
            for rows in reversed(steps):
                back[rows - 1] = log_sum(change + (e[rows] + back[rows])[:, None, :], 2)
            total = log_sum(a[ends] + leave, 1)
            g = np.exp(a + back - np.repeat(total, sizes)[:, None])
            # The row before each row: in the slice, or, at its beginning, in the slice before.
            before, of_row = np.empty_like(a), np.repeat(total, sizes)
            before[1:], before[begins] = a[:-1], enter
            there = np.ones(len(z), bool)
            there[begins[first]] = False
            later, pairs = np.flatnonzero(there), np.zeros((K, K))
            for k in range(0, len(later), PAIR_ROWS):
                at = later[k : k + PAIR_ROWS]
                pairs += np.exp(before[at][:, :, None] + change + (e[at] + back[at] - of_row[at, None])[:, None, :]).sum(0)
            flat = np.concatenate([[total[first].sum()], g[begins[first]].sum(0), pairs.ravel(), g.sum(0), (g.T @ z).ravel(), (g.T @ z**2).ravel()])
            yield pa.record_batch({"s": [flat]})

    names = T.StructType([packed.schema[c] for c in by]).fields
    made = staged(packed.mapInArrow(matrices, T.StructType([*names, *T.StructType.fromDDL("first boolean, m array<double>").fields])), "matrices")
    both = with_small(scan(made, entering, "enter array<double>", key), scan(made, following, "leave array<double>", key, forth=False), by)
    return new_model(with_small(packed, both, by).mapInArrow(gather, "s array<double>"), n_in)


def squared_distances(z: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Of each row to each centre of each start."""
    flat = centers.reshape(-1, centers.shape[-1])
    d = (z * z).sum(1)[:, None] - 2 * z @ flat.T + (flat * flat).sum(1)
    return np.maximum(d, 0).reshape(len(z), *centers.shape[:2])


#: Rows whose distances to all centres of all starts are held at once.
NEAR_ROWS = 8_192


def assigned(data: DataFrame, centers: np.ndarray) -> dict[int, np.ndarray]:
    """One pass for all starts: for each the sums (cost; rows, sum and sum of squares of each centre's rows), added over tasks.
    centers is starts x centres x inputs."""
    starts, k, d = centers.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((starts, 1 + k * (1 + 2 * d)))
        flat = np.ascontiguousarray(centers.transpose(1, 0, 2)).reshape(-1, d)  # one centre of each start, then the next
        own = (flat * flat).sum(1)
        for b in batches:
            z = b["z"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
            for x in (z[i : i + NEAR_ROWS] for i in range(0, len(z), NEAR_ROWS)):
                far = (own - 2 * x @ flat.T).reshape(len(x), k, starts)  # less the row's own square, the same for all centres
                near, at = far[:, 0].copy(), np.zeros((len(x), starts), np.int8)
                for c in range(1, k):
                    less = far[:, c] < near
                    np.minimum(near, far[:, c], out=near)
                    at[less] = c
                squares = (x * x).sum(1)
                total[:, 0] += np.maximum(near + squares[:, None], 0).sum(0)
                every = np.column_stack([np.ones(len(x)), x, x**2])
                for c in range(k):
                    got = (at == c).astype(np.float64).T @ every
                    total[:, 1 + c] += got[:, 0]
                    total[:, 1 + k + c * d : 1 + k + (c + 1) * d] += got[:, 1 : 1 + d]
                    total[:, 1 + k + (k + c) * d : 1 + k + (k + c + 1) * d] += got[:, 1 + d :]
        yield pa.record_batch({"start": np.arange(starts), "sums": pa.array(list(total), pa.list_(pa.float64()))})

    width = 1 + k * (1 + 2 * d)
    got = data.select("z").mapInArrow(sums, "start long, sums array<double>").groupBy("start").agg(F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))
    return {r["start"]: np.array(r["sums"]) for r in got.collect()}


def kmeans(data: DataFrame, starts: int, seed: int, rounds: int = 20, tol: float = 1e-4, drawn: int = 2_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, rows, variances) of the cheapest of `starts` runs of k-means on the column z, all moved in the same passes.

    A run's first centres are drawn far apart (each with the odds of its squared distance to those before) from a sample of
    at most `drawn` rows, those with the least hash; only this sample and sums of fixed size come to the driver. Runs that
    no longer move are dropped from the passes; a centre without rows stays where it is.
    """
    sample = np.array([r["z"] for r in data.select("z", F.xxhash64("z", F.lit(seed)).alias("h")).orderBy("h", "z").limit(drawn).collect()], np.float64)
    d = sample.shape[1]
    centers = np.zeros((starts, K, d))
    for s in range(starts):
        r = np.random.default_rng(seed + s)
        centers[s, 0] = sample[r.integers(len(sample))]
        for k in range(1, K):
            near = squared_distances(sample, centers[None, s, :k])[:, 0].min(1)
            centers[s, k] = sample[r.choice(len(sample), p=near / near.sum())] if near.sum() > 0 else centers[s, 0]
    moving = np.arange(starts)
    for _ in range(rounds):
        got = assigned(data, centers[moving])
        far = []
        for i, s in enumerate(moving):
            n, ones = got[i][1 : 1 + K], got[i][1 + K : 1 + K + K * d].reshape(K, d)
            new = np.where(n[:, None] > 0, ones / np.maximum(n, 1)[:, None], centers[s])
            far.append(((new - centers[s]) ** 2).sum(1).max())
            centers[s] = new
        moving = moving[np.array(far) > tol * tol]
        if not len(moving):
            break
    last = assigned(data, centers)
    best = min(range(starts), key=lambda s: last[s][0])
    n, ones, squares = last[best][1 : 1 + K], *(last[best][1 + K + i * K * d :][: K * d].reshape(K, d) for i in (0, 1))
    mean = ones / np.maximum(n, 1)[:, None]
    return centers[best], n, np.maximum(squares / np.maximum(n, 1)[:, None] - mean**2, 0)


def fit(df: DataFrame, rounds: int = 20, seed: int = 42, key: Sequence[str] = KEY, idx: str = IDX, inits: int = 30, tol: float = 1e-3, state: str = "true_regime", slice_rows: int | None = None) -> GaussianHMM:
    """Fit on diagnosed, labelled series. Only sums of statistics (of fixed size) come to the driver in each round; series
    of one row take no part. The start is the best of `inits` k-means runs, made in the same passes. With `slice_rows`, rounds
    and decoding go by slices of so many rows, so that a series may be of any length."""
    scale_rows = sorted(robust_scale(df).collect(), key=lambda r: r["place"])
    center, scale = np.array([r["center"] or 0.0 for r in scale_rows]), np.array([r["scale"] for r in scale_rows])
    data = dealt(scaled(df, center, scale), "z", (state,), key, idx).cache()
    rows = data.where("_many").select("z", "_begin", "_in")
    try:
        if rows.isEmpty():
            raise ValueError("no series of two rows or more")
        mean, held, spread = kmeans(data, inits, seed)
        overall = data.agg(*(F.coalesce(F.var_pop(F.col("z")[i]), F.lit(0.0)).alias(f"v{i}") for i in range(len(INPUTS)))).first()
        var = np.where(held[:, None] > 2, spread, np.array(list(overall))) + 1e-3
        sliced = dealt_slices(data.where("_many").select(*key, idx, "z"), "z", slice_rows, key, idx) if slice_rows else None
        start, change = np.log(np.full(K, 1 / K)), np.log(np.full((K, K), 0.08 / (K - 1)) + np.eye(K) * (0.92 - 0.08 / (K - 1)))
        history: list[float] = []
        for _ in range(rounds):
            now = em_round_slices(sliced, start, change, mean, var, key) if slice_rows else em_round(rows, start, change, mean, var)
            got = sorted(now.collect(), key=lambda r: r["component"])
            history.append(got[0]["log_likelihood"])
            start, change, mean, var = (np.array([r[c] for r in got]) for c in ("start", "change", "mean", "var"))
            if len(history) > 1 and abs(history[-1] - history[-2]) < tol:
                break
        model = GaussianHMM(center, scale, start, change, mean, var, [str(k) for k in range(K)], history)
        named = decode_series(data.drop("_begin", "_many", "_in"), "z", mean, var, change, start, "component", key, idx, slice_rows).withColumnRenamed(state, "true_regime")
        model.names = align({(r["component"], r["true_regime"]): r["n"] for r in overlap_counts(named).collect()})
        return model
    finally:
        data.unpersist()
