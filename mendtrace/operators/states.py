"""States from diagnostics: potentials, the pointwise rule, and Viterbi decoding within finite blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import EXPANDED, IDX, KEY, SHORT_GAP_SECONDS, STATES, argmax_first, gap_limit, ordered, whole
from .longseries import RANGE_ROWS, with_sized
from .quantiles import exact_quantiles
from .slices import decode_slices

STAY, SWITCH = 1.25, -0.75


def quantile_or_inf(value: str, q: float, key: Sequence[str] = KEY) -> Column:
    """The exact quantile of a series' values on rows that are not missing; infinity where there is none."""
    return F.coalesce(F.percentile(F.when(F.col("m_t") == 0, F.col(value)), F.lit(q)).over(whole(key)), F.lit(float("inf")))


def thresholds(df: DataFrame, key: Sequence[str] = KEY, velocity: float = 0.90, jitter: float = 0.995, acceleration: float = 0.995, range_rows: int | None = None) -> DataFrame:
    """Add v_thr, j_thr and a_thr. With `range_rows` by exact quantiles over ranges of so many values, no series held in one buffer."""
    if range_rows:
        told = {"v_thr": ("c_t", velocity), "j_thr": ("u_t", jitter), "a_thr": ("alpha_t", acceleration)}
        return with_quantiles(df, told, F.col("m_t") == 0, key, range_rows).withColumns({o: F.coalesce(o, F.lit(float("inf"))) for o in told})
    return df.withColumns({"v_thr": quantile_or_inf("c_t", velocity, key), "j_thr": quantile_or_inf("u_t", jitter, key), "a_thr": quantile_or_inf("alpha_t", acceleration, key)})


def with_quantiles(df: DataFrame, told: dict[str, tuple[str, float]], where: Column, key: Sequence[str] = KEY, rows: int = RANGE_ROWS) -> DataFrame:
    """Add for each (output: (column, q)) the series' exact quantile over rows `where`; NULL where it has no value."""
    seen = df.where(where)
    qs = sorted({q for _, q in told.values()})
    got = exact_quantiles(seen, sorted({c for c, _ in told.values()}), qs, key, rows)
    wide = got.groupBy(*key).agg(*(F.max(F.when(F.col("name") == c, F.col("quantiles")[qs.index(q)])).alias(o) for o, (c, q) in told.items()))
    counts = df.groupBy(*[F.col(c).alias(f"_k_{c}") for c in key]).agg(F.count("*").alias("_size"))
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    groups = wide.join(counts, same).drop(*(f"_k_{c}" for c in key))
    return with_sized(df, groups, key, "_size", [*key, *(c for c, _ in told.values())]).drop("_size")


def is_unstable() -> Column:
    return (F.col("p_t") == 1) | F.coalesce(F.col("u_t") >= F.col("j_thr"), F.lit(False)) | F.coalesce(F.col("alpha_t") >= F.col("a_thr"), F.lit(False))


def potentials(df: DataFrame, fs: Column, seconds: float = SHORT_GAP_SECONDS, key: Sequence[str] = KEY, range_rows: int | None = None) -> DataFrame:
    """Add one column s_<state> for each of STATES."""
    df = thresholds(df, key, range_rows=range_rows).withColumn("limit", gap_limit(fs, seconds)).withColumn("unstable", is_unstable())
    gone, short = F.col("m_t") == 1, F.col("r_t") <= F.col("limit")

    def at(on_short: float, on_long: float, else_: Column) -> Column:
        return F.when(gone & short, float(on_short)).when(gone, float(on_long)).otherwise(else_)

    moving = F.coalesce(F.col("c_t") >= F.col("v_thr"), F.lit(False))
    off = F.lit(-8.0)
    cols = (
        at(-8, -8, F.when(F.col("unstable"), 0.0).otherwise(2.0)),
        at(-8, -8, F.when(moving, 5.0).otherwise(0.0)),
        at(8, -8, off),
        at(-4, 10, off),
        at(-8, -8, F.when(F.col("unstable"), 7.0).otherwise(0.0)),
    )
    return df.withColumns({f"s_{s}": c for s, c in zip(STATES, cols, strict=True)})


def pointwise(df: DataFrame, out: str = "state") -> DataFrame:
    """The state with the largest potential on each row; ties go to the earlier of STATES."""
    best = argmax_first(F.array(*(F.col(f"s_{s}") for s in STATES)))
    return df.withColumn(out, F.element_at(F.array(*(F.lit(s) for s in STATES)), best + 1))


def finite_blocks(df: DataFrame, key: Sequence[str] = KEY, idx: str = IDX) -> DataFrame:
    """Add `block`: a number for each maximal run of rows that are not missing, NULL on missing rows."""
    w = ordered(key, idx)
    begins = (F.col("m_t") == 0) & (F.coalesce(F.lag("m_t").over(w), F.lit(1)) == 1)
    df = df.withColumn("_b", begins.cast("int"))
    return df.withColumn("block", F.when(F.col("m_t") == 0, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)).drop("_b")


def viterbi_paths(scores: np.ndarray, begins: np.ndarray, sizes: np.ndarray, change: np.ndarray, start: np.ndarray | float = 0.0) -> np.ndarray:
    """The best path of each block of scores (rows x states), all blocks in step; ties go to the first state. `change` and
    `start` serve all blocks, or there is one of each for every block."""
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[order], sizes[order]
    each = np.ndim(change) == 3
    if each:
        change, start = change[order], start[order]
    back, path = np.zeros(scores.shape, np.int8), np.zeros(len(scores), np.int64)
    best = scores[begins] + start
    longest = int(sizes[0]) if len(sizes) else 0
    for i in range(1, longest):
        m = int(np.searchsorted(-sizes, -i, "left"))  # blocks with more than i rows
        rows = begins[:m] + i
        through = best[:m, :, None] + (change[:m] if each else change)
        back[rows] = from_ = through.argmax(1)
        best[:m] = scores[rows] + np.take_along_axis(through, from_[:, None, :], 1)[:, 0]
    at = best.argmax(1)
    path[begins + sizes - 1] = at
    for i in range(longest - 1, 0, -1):
        m = int(np.searchsorted(-sizes, -i, "left"))
        rows = begins[:m] + i
        at[:m] = back[rows, at[:m]]
        path[rows - 1] = at[:m]
    return path


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows in tables that end where runs end: a run begins at `_begin` and goes on over rows `_in`. No more than
    one batch and one run is held."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        there, first = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("_in", "_begin"))
        ends = np.flatnonzero(first | ~there)  # a row here ends the run before it
        if not len(ends):
            held.append(b)
            continue
        cut = int(ends[-1]) if there[ends[-1]] else b.num_rows
        if held or cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
        held = [b.slice(cut)] if cut < b.num_rows else []
    if held:
        yield pa.Table.from_batches(held)


def decode_runs(df: DataFrame, scores: str, begins: Column, inside: Column, change: np.ndarray, start: np.ndarray | float, out: str, key: Sequence[str] = KEY, idx: str = IDX, to_scores: Callable[[np.ndarray], np.ndarray] | None = None, slice_rows: int | None = None, which: str | None = None) -> DataFrame:
    """Add `out`: the place of each row's state on the Viterbi path of its run; NULL on rows outside runs.

    `scores` is an array column (to_scores maps its rows to scores if they are no scores themselves). A run begins where
    `begins` holds and goes on over rows `inside`; both are window expressions over the series. Rows stream through in the
    order of their series, other columns untouched; a task holds one batch and one run. With `slice_rows`, runs are decoded in
    slices of so many rows, over many tasks (see slices.decode_slices()). With `which`, a column that is the same on all rows
    of a series, change and start are stacks and each run takes those of that number; such runs are not sliced.
    """
    if which and slice_rows:
        raise ValueError("runs with matrices of their own are not decoded in slices")
    if slice_rows:
        return decode_slices(df, scores, begins, inside, change, start, out, slice_rows, key, idx, to_scores)
    df = df.withColumns({"_begin": begins, "_in": inside})
    schema = T.StructType([*(f for f in df.schema.fields if f.name not in ("_begin", "_in")), T.StructField(out, T.IntegerType())])

    def decoded(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        there, first = (t[c].to_numpy() for c in ("_in", "_begin"))
        path = np.zeros(t.num_rows, np.int32)
        if there.any():
            flat = t[scores].filter(t["_in"]).combine_chunks().flatten()
            s = flat.to_numpy(zero_copy_only=False).reshape(int(there.sum()), -1)
            at = np.flatnonzero(first[there])
            of = t[which].filter(t["_in"]).to_numpy()[at] if which else slice(None)
            path[there] = viterbi_paths(to_scores(s) if to_scores else s, at, np.diff(np.append(at, len(s))), change[of], start[of] if which else start)
        yield from t.drop_columns(["_begin", "_in"]).append_column(out, pa.array(path, mask=~there)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches):
            yield from decoded(t)

    return df.sortWithinPartitions(*key, idx).mapInArrow(run, schema)


def decode_blocks(df: DataFrame, scores: str, change: np.ndarray, start: np.ndarray | float, out: str, key: Sequence[str] = KEY, idx: str = IDX, slice_rows: int | None = None, which: str | None = None) -> DataFrame:
    """Add `block` and `out`: the place of each finite row's state on its block's Viterbi path; NULL on missing rows."""
    before = F.coalesce(F.lag("m_t").over(ordered(key, idx)), F.lit(1))
    here = F.col("m_t") == 0
    return decode_runs(finite_blocks(df, key, idx), scores, here & (before == 1), here, change, start, out, key, idx, slice_rows=slice_rows, which=which)


def viterbi_d(df: DataFrame, key: Sequence[str] = KEY, idx: str = IDX, out: str = "state", slice_rows: int | None = None) -> DataFrame:
    """Viterbi decoding of the potentials, +1.25 for staying and -0.75 for changing. No path crosses the line between
    missing and finite rows (the potentials outweigh any change), so missing rows follow the gap rule, blocks decode alone."""
    change = np.full((3, 3), SWITCH) + np.eye(3) * (STAY - SWITCH)
    names = F.array(F.lit("Stable"), F.lit("Movement"), F.lit("Unstable"))
    df = df.withColumn("_s", F.array("s_Stable", "s_Movement", "s_Unstable"))
    df = decode_blocks(df, "_s", change, 0.0, "_p", key, idx, slice_rows)
    lost = F.when(F.col("r_t") <= F.col("limit"), "LossShort").otherwise("LossLong")
    return df.withColumn(out, F.when(F.col("m_t") == 1, lost).otherwise(F.element_at(names, F.col("_p") + 1))).drop("_s", "_p", "block")


def viterbi_fold(df: DataFrame, key: Sequence[str] = KEY, idx: str = IDX, out: str = "state") -> DataFrame:
    """The same as viterbi_d without Python, one row per block and state at a time: for blocks of up to a few thousand rows."""
    df = finite_blocks(df, key, idx)
    rows = df.where(F.col("block").isNotNull()).groupBy(*key, "block").agg(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.array("s_Stable", "s_Movement", "s_Unstable").alias("s")))).alias("r"))
    step = F.lit(SWITCH)
    extra = STAY - SWITCH

    def through(dp: Column, j: int) -> Column:
        return F.array(*(F.element_at(dp, i + 1) + step + (extra if i == j else 0.0) for i in range(3)))

    first = F.struct(F.element_at(F.col("r"), 1)["s"].alias("dp"), F.array().cast("array<array<int>>").alias("back"))
    run = F.aggregate(
        F.slice("r", F.lit(2), F.size("r")),
        first,
        lambda a, x: F.struct(
            F.array(*(x["s"][j] + F.array_max(through(a["dp"], j)) for j in range(3))).alias("dp"),
            F.array_append(a["back"], F.array(*(argmax_first(through(a["dp"], j)) for j in range(3)))).alias("back"),
        ),
    )
    rows = rows.withColumn("run", run)
    path = F.aggregate(F.reverse("run.back"), F.array(argmax_first(F.col("run.dp"))), lambda a, b: F.array_append(a, b[F.element_at(a, -1)]))
    rows = rows.select(*key, F.explode(F.arrays_zip(F.transform("r", lambda x: x["i"]).alias("i"), F.reverse(path).alias("p"))).alias("z")).select(*key, F.col("z.i").alias(idx), F.col("z.p").alias("_p"))
    names = F.array(F.lit("Stable"), F.lit("Movement"), F.lit("Unstable"))
    lost = F.when(F.col("r_t") <= F.col("limit"), "LossShort").otherwise("LossLong")
    return df.join(rows, [*key, idx], "left").withColumn(out, F.when(F.col("m_t") == 1, lost).otherwise(F.element_at(names, F.col("_p") + 1))).drop("_p", "block")


def predict_regimes(df: DataFrame, fs: Column, seconds: float = SHORT_GAP_SECONDS, key: Sequence[str] = KEY, idx: str = IDX, out: str = "state") -> DataFrame:
    return viterbi_d(potentials(df, fs, seconds, key), key, idx, out)


def predict_regimes_simple(df: DataFrame, fs: Column, seconds: float = SHORT_GAP_SECONDS, jitter_quantile: float = 0.995, key: Sequence[str] = KEY, idx: str = IDX, out: str = "state") -> DataFrame:
    """Another name of predict_regimes(); jitter_quantile is accepted and has no effect."""
    return predict_regimes(df, fs, seconds, key, idx, out)


def oracle_path(df: DataFrame, out: str = "state") -> DataFrame:
    if "true_regime" not in df.columns:
        raise ValueError("the oracle path needs the column true_regime")
    return df.withColumn(out, F.col("true_regime"))


def public_state(c: Column) -> Column:
    """Expanded names of unstable states become Unstable."""
    return F.when(c.startswith("Unstable"), "Unstable").otherwise(c)


def expanded_label(regime: Column, subtype: Column) -> Column:
    return F.when(regime == "Movement", 1).when(regime == "LossShort", 2).when(regime == "LossLong", 3).when((regime == "Unstable") & (subtype == "impulse"), 4).when(regime == "Unstable", 5).otherwise(0)


def expanded_name(label: Column) -> Column:
    return F.element_at(F.array(*(F.lit(s) for s in EXPANDED)), label + 1)
