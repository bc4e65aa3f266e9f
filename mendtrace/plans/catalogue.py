"""The queries of the signal-cleaning operators and their SQL.

Every query is registered with its columns (name: l long, d double, s string, b boolean; a digit sets a double's decimals),
so both sides give the same names, types and rounding.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import STATES, distance, draw, draw_sql, finite, normalize_id, ordered
from ..operators import aggregate as A
from ..operators import corrupt as CO
from ..operators import diagnostics as DG
from ..operators import generative as GE
from ..operators import hybrid as HY
from ..operators import longseries as L
from ..operators import metrics as ME
from ..operators import repair as R
from ..operators import states as ST
from ..operators import windows as W
from ..sources import recordings as IO
from ..sources.staging import shared_dir, staged
from . import sql as Q

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}
METHODS = ("raw_degraded", "global_interpolate", "pointwise_d", "oracle_policy")
LW, LH = 105000.0, 50.0


def shaped(df: DataFrame, columns: str) -> DataFrame:
    out = []
    for spec in columns.split():
        name, kind = spec.split(":")
        c = F.col(name)
        if kind[0] == "d":
            c = F.round(c.cast("double"), int(kind[1:] or 6)) + F.lit(0.0)
        out.append(c.cast({"l": "long", "d": "double", "s": "string", "b": "boolean"}[kind[0]]).alias(name))
    return df.select(*out)


def sql_text(columns: str, chain: str, source: str) -> str:
    out = []
    for spec in columns.split():
        name, kind = spec.split(":")
        c = f"CAST(q.{name} AS {({'l': 'BIGINT', 'd': 'DOUBLE', 's': 'VARCHAR', 'b': 'BOOLEAN'})[kind[0]]})"
        out.append((f"round({c}, {int(kind[1:] or 6)}) + 0.0::DOUBLE" if kind[0] == "d" else c) + f" AS {name}")
    return f"WITH RECURSIVE {chain}\nSELECT {', '.join(out)} FROM ({source}) AS q" if chain else f"SELECT {', '.join(out)} FROM ({source}) AS q"


def add(name: str, columns: str, make: Callable[[SparkSession, str], DataFrame], chain: str | None = None, source: str = "") -> None:
    """Register a query; with source, its SQL too."""
    _queries[name] = lambda spark, d: shaped(make(spark, d), columns)
    if source:
        _sql[name] = sql_text(columns, chain or "", source)


# Inputs -------------------------------------------------------------------------------------------------------------


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return IO.events_as_series(table(spark, d, "events"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return IO.lineitem_as_series(table(spark, d, "lineitem"))


def diagnosed(spark: SparkSession, d: str) -> DataFrame:
    return DG.diagnose(events(spark, d), Q.WIDTH, Q.HEIGHT)


def with_rate(df: DataFrame) -> DataFrame:
    """hz of each series, from the steps of its own window; no second exchange."""
    dt = F.col("time_s") - F.lag("time_s").over(ordered())
    return df.withColumn("_dt", dt).withColumn("hz", 1 / F.percentile(F.when(F.col("_dt") > 0, F.col("_dt")), F.lit(0.5)).over(Window.partitionBy("series"))).drop("_dt")


def scored(spark: SparkSession, d: str) -> DataFrame:
    return ST.potentials(with_rate(diagnosed(spark, d)), F.col("hz"), Q.GAP_SECONDS)


def stated(spark: SparkSession, d: str) -> DataFrame:
    return ST.pointwise(scored(spark, d))


def cases(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    """Supplier series, each corrupted in the way `kind`, or in the one that its number names."""
    pick = lambda names, n: F.element_at(F.array(*(F.lit(x) for x in names)), (F.col("series") % n + 1).cast("int"))
    df = lines(spark, d).withColumns({"corruption": F.lit(kind) if kind else pick(W.CORRUPTIONS, 5), "severity": pick(("low", "medium", "high"), 3), "seed": F.col("series") % 10})
    return CO.inject(df)


def outputs(spark: SparkSession, d: str) -> DataFrame:
    """METHODS on the corrupted series, under one another: all outputs are columns of one pass, then rows."""
    df = ST.pointwise(ST.potentials(DG.diagnose(cases(spark, d), LW, LH), F.lit(250.0)))
    made = {f"{v}_{m}": c for v in ("x", "y") for m, c in (("global_interpolate", R.interpolated(v)), ("pointwise_d", R.mended(v)), ("oracle_policy", R.mended(v, "true_regime")))}
    df = df.withColumns(made).withColumns({"x_raw_degraded": F.col("x"), "y_raw_degraded": F.col("y")})
    told = {"raw_degraded": F.lit("Stable"), "global_interpolate": F.lit("Stable"), "pointwise_d": F.col("state"), "oracle_policy": F.col("true_regime")}
    each = F.array(*(F.struct(F.lit(m).alias("method"), F.col(f"x_{m}").alias("x"), F.col(f"y_{m}").alias("y"), told[m].alias("pred_regime")) for m in METHODS))
    keep = ("series", "sample_idx", "x_clean", "y_clean", "x_degraded", "y_degraded", "true_regime", "corruption", "severity", "seed")
    return df.select(*keep, F.explode(each).alias("o")).select(*keep, "o.*")


def named(df: DataFrame) -> DataFrame:
    """Names for series: two datasets, participants, corruption and severity as in cases()."""
    pick = lambda names, n: F.element_at(F.array(*(F.lit(x) for x in names)), (F.col("series") % n + 1).cast("int"))
    return df.withColumns({"dataset": F.when(F.col("series") % 2 == 0, "A").otherwise("B"), "participant_id": F.concat(F.lit("p"), F.floor(F.col("series") / 4).cast("long").cast("string")), "corruption": pick(W.CORRUPTIONS, 5), "severity": pick(("low", "medium", "high"), 3)})


def measured(spark: SparkSession, d: str) -> DataFrame:
    return named(ME.evaluate(outputs(spark, d), LW, LH, ("series", "method")))


def participants(spark: SparkSession, d: str) -> DataFrame:
    return A.participant_means(measured(spark, d))


# SQL of the inputs --------------------------------------------------------------------------------------------------

EV = Q.EVENTS
DGQ = f"{EV},\n{Q.diagnose('ev', Q.WIDTH, Q.HEIGHT)}"
POQ = f"{DGQ},\n{Q.rates('ev')},\n{Q.potentials(Q.GAP_SECONDS)}"
LI = Q.LINEITEM
COQ = f"{LI},\n{Q.corrupted()}"
_carry = ", x_clean, y_clean, true_regime, unstable_subtype, corruption, severity, seed"
CDQ = f"{COQ},\n{Q.diagnose('co', LW, LH, 'c', _carry)},\n{Q.potentials(0.5, 'c', '250.0')}"
OUQ = f"""{CDQ},
{Q.repair('cpw', 'state', 'rp')},
{Q.repair('cpw', 'true_regime', 'ro')},
ou AS (SELECT series, sample_idx, x, y, x_clean, y_clean, x AS x_degraded, y AS y_degraded, true_regime, 'Stable' AS pred_regime, 'raw_degraded' AS method FROM cpw
 UNION ALL SELECT series, sample_idx, xi, yi, x_clean, y_clean, x, y, true_regime, 'Stable', 'global_interpolate' FROM rpi
 UNION ALL SELECT series, sample_idx, xr, yr, x_clean, y_clean, x, y, true_regime, state, 'pointwise_d' FROM rp
 UNION ALL SELECT series, sample_idx, xr, yr, x_clean, y_clean, x, y, true_regime, true_regime, 'oracle_policy' FROM ro)"""
_names = f"CASE WHEN series % 2 = 0 THEN 'A' ELSE 'B' END AS dataset, 'p' || CAST(series // 4 AS VARCHAR) AS participant_id, {list(W.CORRUPTIONS)!r}[CAST(series % 5 + 1 AS INTEGER)] AS corruption, ['low', 'medium', 'high'][CAST(series % 3 + 1 AS INTEGER)] AS severity"
MEQ = f"{OUQ},\n{Q.metrics('ou', LW, LH, 'mq')},\nme AS (SELECT *, {_names} FROM mq)"
_means = ", ".join(f"avg({m}) AS {m}" for m in ME.METRICS)
PAQ = f"{MEQ},\npa AS (SELECT *, {Q.AVAILABLE} AS Q_local FROM (SELECT dataset, participant_id, method, {_means} FROM me GROUP BY ALL))"
_meansq = _means + ", avg(Q_local) AS Q_local"
DSQ = f"{PAQ},\nds AS (SELECT dataset, method, {_meansq} FROM pa GROUP BY ALL)"
_m = " ".join(f"{m}:d" for m in ME.METRICS)
_row = "series:l sample_idx:l "


# Diagnostics and states
add("diag_flags", _row + "m_t:l p_t:l", diagnosed, DGQ, "FROM dg")
add("diag_run_length", _row + "r_t:l", diagnosed, DGQ, "FROM dg")
add("diag_velocity", _row + "c_t:d9", diagnosed, DGQ, "FROM dg")
add("diag_acceleration", _row + "alpha_t:d9", diagnosed, DGQ, "FROM dg")
add("diag_jitter", _row + "u_t:d", diagnosed, DGQ, "FROM dg")
add("potentials", _row + " ".join(f"s_{s}:d" for s in STATES), scored, POQ, f"SELECT *, {', '.join(f's{i + 1} AS s_{s}' for i, s in enumerate(STATES))} FROM po")
add("gap_limit", "series:l lim:l", lambda s, d: scored(s, d).select("series", F.col("limit").alias("lim")).distinct(), POQ, "SELECT DISTINCT series, lim FROM th")
add("safe_quantiles", "series:l v_thr:d9 j_thr:d", lambda s, d: ST.thresholds(diagnosed(s, d)).groupBy("series").agg(F.max("v_thr").alias("v_thr"), F.max("j_thr").alias("j_thr")), POQ, "SELECT series, max(v_thr) AS v_thr, max(j_thr) AS j_thr FROM th GROUP BY series")
add("pointwise_d", _row + "state:s", stated, POQ, "FROM pw")
_change = [[1.25 if i == j else -0.75 for j in range(3)] for i in range(3)]
VIQ = f"{POQ},\n{Q.viterbi('po', ['s1', 's2', 's5'], _change, [0.0] * 3, 'vi')}"
_vit = "SELECT pw.series, pw.sample_idx, CASE WHEN m_t = 1 THEN state ELSE ['Stable', 'Movement', 'Unstable'][p + 1] END AS state FROM pw LEFT JOIN vi USING (series, sample_idx)"
add("viterbi_d", _row + "state:s", lambda s, d: ST.viterbi_d(scored(s, d)), VIQ, _vit)
SLICE = 16  # few rows, so that these short series have several slices
add("viterbi_d_slices", _row + "state:s", lambda s, d: ST.viterbi_d(scored(s, d), slice_rows=SLICE), VIQ, _vit)
add("viterbi_fold", _row + "state:s", lambda s, d: ST.viterbi_fold(scored(s, d)), VIQ, _vit)
add("predict_regimes", _row + "state:s", lambda s, d: ST.predict_regimes(with_rate(diagnosed(s, d)), F.col("hz"), Q.GAP_SECONDS), VIQ, _vit)
add("finite_blocks", "series:l blocks:l n:l", lambda s, d: ST.finite_blocks(diagnosed(s, d)).groupBy("series").agg(F.count_distinct("block").alias("blocks"), F.count("block").alias("n")), VIQ, "SELECT series, count(DISTINCT block) AS blocks, count(*) AS n FROM vib GROUP BY series")
add("oracle_path", _row + "state:s", lambda s, d: ST.oracle_path(cases(s, d)), COQ, "SELECT *, true_regime AS state FROM co")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    df = stated(spark, d).withColumns({"_x": F.col("x"), "_y": F.col("y")})
    moved = distance(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))
    return shaped(R.repair(df).groupBy("state").agg(F.count("*").alias("n"), F.avg(moved).alias("mean_shift"), F.count("x").alias("n_x")), "state:s n:l mean_shift:d n_x:l")


_queries["state_summary"] = flagship
RPQ = f"{POQ},\n{Q.repair('pw', 'state', 'rr')}"
_sql["state_summary"] = sql_text("state:s n:l mean_shift:d n_x:l", RPQ, "SELECT state, count(*) AS n, avg(sqrt((xr - x) * (xr - x) + (yr - y) * (yr - y))) AS mean_shift, count(xr) AS n_x FROM rr GROUP BY state")

# Repair and cleaners
_xy = _row + "x:d y:d"


RANGE = 4096  # few rows likewise


# The same over series cut into slices: frames with halos, runs and neighbours carried over slices, ranks by ranges of values
def diagnosed_split(spark: SparkSession, d: str) -> DataFrame:
    return DG.diagnose(events(spark, d), Q.WIDTH, Q.HEIGHT, slice_rows=SLICE)


def stated_split(spark: SparkSession, d: str) -> DataFrame:
    df = L.own_rows(L.with_halo(diagnosed_split(spark, d), 1, SLICE).withColumn("_dt", F.col("time_s") - F.lag("time_s").over(ordered(("series", "_slice")))))
    df = ST.with_quantiles(df, {"_mid": ("_dt", 0.5)}, F.col("_dt") > 0, ("series",), RANGE).withColumn("hz", 1 / F.col("_mid"))
    return ST.pointwise(ST.potentials(df.drop("_dt", "_mid"), F.col("hz"), Q.GAP_SECONDS, range_rows=RANGE))


def numbered_split(spark: SparkSession, d: str) -> DataFrame:
    return L.number_rows(lines(spark, d).drop("sample_idx"), ("time_s", "x"), rows=RANGE)


add("number_rows_split", _row + "time_s:d", numbered_split, LI, "SELECT series, row_number() OVER (PARTITION BY series ORDER BY time_s) - 1 AS sample_idx, time_s FROM li")
add("diagnose_split", _row + "m_t:l r_t:l p_t:l c_t:d9 alpha_t:d9 u_t:d", diagnosed_split, DGQ, "FROM dg")
add("pointwise_split", _row + "state:s", stated_split, POQ, "FROM pw")
add("repair_split", _xy, lambda s, d: R.repair(stated_split(s, d), slice_rows=SLICE), RPQ, "SELECT series, sample_idx, xr AS x, yr AS y FROM rr")
add("repair_policy", _xy, lambda s, d: R.repair(stated(s, d)), RPQ, "SELECT series, sample_idx, xr AS x, yr AS y FROM rr")
add("repair_stable_smoothing", _xy, lambda s, d: R.repair(stated(s, d), stable_smoothing=True), RPQ, "SELECT series, sample_idx, " + ", ".join(f"CASE WHEN state = 'Stable' THEN avg({v}) OVER (PARTITION BY series ORDER BY sample_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) ELSE {v}r END AS {v}" for v in "xy") + " FROM rr")
add("oracle_policy", _xy, lambda s, d: outputs(s, d).where("method = 'oracle_policy'"), OUQ, "FROM ou WHERE method = 'oracle_policy'")
IPQ = f"{EV},\n{Q.interpolate('ev', 'ip')}"
add("interpolate_split", _xy, lambda s, d: R.global_interpolate(events(s, d), slice_rows=SLICE), IPQ, "SELECT series, sample_idx, xi AS x, yi AS y FROM ip")
add("interpolate_both", _xy, lambda s, d: R.global_interpolate(events(s, d)), IPQ, "SELECT series, sample_idx, xi AS x, yi AS y FROM ip")
_clean = R.cleaners(Q.WIDTH, Q.HEIGHT, max_gap=2)
_near7 = "(PARTITION BY series ORDER BY sample_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
_clip = lambda v, m: f"CASE WHEN {v} < 0 THEN 0.0 WHEN {v} > {m} THEN {m} ELSE {v} END AS {v}"
for _name, _chain, _from in (
    ("raw_degraded", EV, "FROM ev"),
    ("global_interpolate", IPQ, "SELECT series, sample_idx, xi AS x, yi AS y FROM ip"),
    ("short_gap_only", f"{DGQ},\n{Q.interpolate('dg', 'ip')}", "SELECT series, sample_idx, " + ", ".join(f"CASE WHEN m_t = 1 AND r_t <= 2 THEN {v}i ELSE {v} END AS {v}" for v in "xy") + " FROM ip"),
    ("global_smooth", EV, f"SELECT series, sample_idx, avg(x) OVER {_near7} AS x, avg(y) OVER {_near7} AS y FROM ev"),
    ("interp_smooth", IPQ, f"SELECT series, sample_idx, avg(xi) OVER {_near7} AS x, avg(yi) OVER {_near7} AS y FROM ip"),
    ("robust_clip", EV, f"SELECT series, sample_idx, {_clip('x', '400.0')}, {_clip('y', '100.0')} FROM ev"),
):
    add(f"clean_{_name}", _xy, lambda s, d, f=_clean[_name]: f(events(s, d)), _chain, _from)

# Metrics, scores and grouped means
_key = "series:l method:s "
for _name, _cols in {"metrics_reconstruction": "mae:d rmse:d retention:d", "metrics_gap": "long_hallucination:d short_recovery:d", "metrics_movement": "movement_preservation:d", "metrics_stable": "stable_preservation:d", "metrics_unstable": "unstable_repair_gain:d unstable_repair_score:d", "metrics_plausibility": "plausibility_score:d"}.items():
    add(_name, _key + _cols, measured, MEQ, "FROM me")
F1Q = f"{OUQ},\nf1 AS (SELECT series, method, r AS regime, CASE WHEN sum(CASE WHEN true_regime = r THEN 1 ELSE 0 END) > 0 THEN 2.0 * sum(CASE WHEN true_regime = r AND pred_regime = r THEN 1 ELSE 0 END)::DOUBLE / (sum(CASE WHEN true_regime = r THEN 1 ELSE 0 END) + sum(CASE WHEN pred_regime = r THEN 1 ELSE 0 END))::DOUBLE END AS f1, sum(CASE WHEN true_regime = r THEN 1 ELSE 0 END) AS support FROM ou, (SELECT unnest({Q.STATE_LIST}) AS r) AS st GROUP BY ALL)"
_f1 = lambda s, d: ME.regime_f1(outputs(s, d), ("series", "method"))
add("regime_f1", _key + "regime:s f1:d support:l", _f1, F1Q, "FROM f1")
add("f1_summary", "method:s regime:s mean_f1:d std_f1:d n:l support:l", lambda s, d: A.f1_summary(_f1(s, d)), F1Q, "SELECT method, regime, avg(f1) AS mean_f1, stddev_samp(f1) AS std_f1, count(f1) AS n, sum(support) AS support FROM f1 GROUP BY ALL")
add("score_skipna", _key + "Q_local:d", lambda s, d: A.score_available(measured(s, d)), MEQ, f"SELECT *, {Q.AVAILABLE} AS Q_local FROM me")
add("score_strict", "method:s local_action_score:d", lambda s, d: A.score_strict(A.means(measured(s, d), ("method",))), MEQ, f"SELECT *, {Q.STRICT} AS local_action_score FROM (SELECT method, {_means} FROM me GROUP BY method) AS z")
add("participant_agg", f"dataset:s participant_id:s method:s {_m} Q_local:d", participants, PAQ, "FROM pa")
add("dataset_agg", f"dataset:s method:s {_m} Q_local:d", lambda s, d: A.dataset_and_macro(participants(s, d))[0], DSQ, "FROM ds")
add("dataset_macro", f"method:s {_m} Q_local:d", lambda s, d: A.dataset_and_macro(participants(s, d))[1], DSQ, f"SELECT method, {_meansq} FROM ds GROUP BY method")
for _name, _by in {"pooled": ("method",), "by_corruption": ("corruption", "method"), "by_severity": ("severity", "method"), "by_dataset": ("dataset", "method"), "by_participant": ("dataset", "participant_id", "method")}.items():
    add(_name, " ".join(f"{b}:s" for b in _by) + f" {_m}", lambda s, d, by=_by: A.means(measured(s, d), by), MEQ, f"SELECT {', '.join(_by)}, {_means} FROM me GROUP BY ALL")
add("corruption_scores", "dataset:s corruption:s method:s Q_local:d", lambda s, d: A.means(A.score_available(measured(s, d)), ("dataset", "corruption", "method"), ("Q_local",)), MEQ, f"SELECT dataset, corruption, method, avg(Q_local) AS Q_local FROM (SELECT *, {Q.AVAILABLE} AS Q_local FROM me) AS z GROUP BY ALL")
_sides = ", ".join(A.SIDES)
_sets = ", ".join("(" + ", ".join((*by, "method")) + ")" for by in A.GROUPINGS.values())
_which = "CASE " + " ".join("WHEN " + " AND ".join(f"grouping({c}) = {int(c not in by)}" for c in A.SIDES) + f" THEN '{n}'" for n, by in A.GROUPINGS.items()) + " END"
GRQ = f"""{MEQ},
g1 AS (SELECT {_which} AS grouping_name, {_sides}, method, {_means}, avg(Q_sequences) AS Q_sequences FROM (SELECT *, {Q.AVAILABLE} AS Q_sequences FROM me) AS z GROUP BY GROUPING SETS ({_sets})),
g2 AS (SELECT *, {Q.AVAILABLE} AS Q_local FROM g1),
g3 AS (SELECT dataset, method, {_meansq}, avg(Q_sequences) AS Q_sequences FROM g2 WHERE grouping_name = 'by_participant' GROUP BY dataset, method)"""
_mcols = ", ".join((*ME.METRICS, "Q_local", "Q_sequences"))
add("all_groupings", f"grouping:s dataset:s participant_id:s corruption:s severity:s method:s {_m} Q_local:d Q_sequences:d", lambda s, d: A.all_groupings(measured(s, d)), GRQ, f"SELECT grouping_name AS grouping, {_sides}, method, {_mcols} FROM g2 UNION ALL SELECT 'dataset_agg', dataset, NULL, NULL, NULL, method, {_mcols} FROM g3 UNION ALL SELECT 'macro', NULL, NULL, NULL, NULL, method, {_meansq}, avg(Q_sequences) FROM g3 GROUP BY method")
_weights = ", ".join(f"('{n}', " + ", ".join(f"{x!r}::DOUBLE" for x in ws) + ")" for n, ws in A.WEIGHTINGS.items())
WRQ = f"{DSQ},\nma AS (SELECT 'primary' AS evaluation, method, {_meansq} FROM ds GROUP BY method),\nws AS (SELECT evaluation, method, weighting, (1 - long_hallucination + short_recovery) / 2 * a + movement_preservation * b + stable_preservation * c + unstable_repair_score * e AS score FROM ma, (VALUES {_weights}) AS w(weighting, a, b, c, e))"
add("weight_ranks", "evaluation:s weighting:s method:s score:d rank:l", lambda s, d: A.weight_ranks(A.dataset_and_macro(participants(s, d))[1].withColumn("evaluation", F.lit("primary"))), WRQ, "SELECT *, rank() OVER (PARTITION BY evaluation, weighting ORDER BY score DESC) AS rank FROM ws")
add("pivot_methods", "dataset:s participant_id:s " + " ".join(f"{m}:d" for m in METHODS), lambda s, d: participants(s, d).groupBy("dataset", "participant_id").pivot("method", list(METHODS)).agg(F.first("mae")), PAQ, "SELECT dataset, participant_id, " + ", ".join(f"max(CASE WHEN method = '{m}' THEN mae END) AS {m}" for m in METHODS) + " FROM pa GROUP BY ALL")
add("unpivot_metrics", "method:s metric:s value:d", lambda s, d: A.means(measured(s, d), ("method",)).unpivot(["method"], list(ME.METRICS), "metric", "value"), MEQ, " UNION ALL ".join(f"SELECT method, '{m}' AS metric, avg({m}) AS value FROM me GROUP BY method" for m in ME.METRICS))

# Bootstrap with portable draws
REPS = 2000
_bs = f"""un AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY participant_id) - 1 AS i, count(*) OVER (PARTITION BY dataset) AS n FROM (SELECT DISTINCT dataset, participant_id FROM pa) AS z),
s0 AS (SELECT dataset, replicate, i, n, CASE WHEN n > {A.BLOCK_UNITS} THEN CAST(floor({draw_sql('replicate', 'i', '20260728', 8)} * n) AS BIGINT) // {A.BLOCK_UNITS} * {A.BLOCK_UNITS} ELSE 0 END AS start FROM un, (SELECT unnest(range({REPS})) AS replicate) AS r),
s1 AS (SELECT dataset, replicate, n, start, start + row_number() OVER (PARTITION BY dataset, replicate, start ORDER BY i) - 1 AS slot FROM s0),
sl AS (SELECT dataset, replicate, start + floor({draw_sql('replicate', 'slot', '20260728', 7)} * least({A.BLOCK_UNITS}, n - start)) AS pick FROM s1),
sa AS (SELECT sl.dataset, sl.replicate, un.participant_id FROM sl JOIN un ON un.dataset = sl.dataset AND un.i = sl.pick)"""
_all = ("Q_local", "long_safety", *ME.METRICS)
_safe = lambda df: df.withColumn("long_safety", 1 - F.col("long_hallucination"))
_good = f"CASE WHEN o.metric IN {A.LOWER_IS_BETTER!r} THEN 'negative' ELSE 'positive' END AS favorable_direction"
_union = lambda t, by, v: " UNION ALL ".join(f"SELECT {by}'{m}' AS metric, {m} AS {v} FROM {t}" for m in _all)
_paired = lambda a, b: f"""{_bs},
pb AS (SELECT *, 1 - long_hallucination AS long_safety FROM pa),
df AS (SELECT dataset, participant_id, {', '.join(f"max(CASE WHEN method = '{a}' THEN {m} END) - max(CASE WHEN method = '{b}' THEN {m} END) AS {m}" for m in _all)} FROM pb GROUP BY ALL),
ob AS (SELECT {', '.join(f'avg({m}) AS {m}' for m in _all)} FROM (SELECT dataset, {', '.join(f'avg({m}) AS {m}' for m in _all)} FROM df GROUP BY dataset) AS z),
dr AS (SELECT replicate, {', '.join(f'avg({m}) AS {m}' for m in _all)} FROM (SELECT replicate, dataset, {', '.join(f'avg({m}) AS {m}' for m in _all)} FROM sa JOIN df USING (dataset, participant_id) GROUP BY ALL) AS z GROUP BY replicate)"""
_interval = f"SELECT o.metric, o.difference, l.ci_low, l.ci_high, {_good} FROM ({_union('ob', '', 'difference')}) AS o JOIN (SELECT metric, quantile_cont(v, 0.025) AS ci_low, quantile_cont(v, 0.975) AS ci_high FROM ({_union('dr', '', 'v')}) AS z GROUP BY metric) AS l USING (metric)"
add("paired_bootstrap_portable", "metric:s difference:d5 ci_low:d5 ci_high:d5 favorable_direction:s", lambda s, d: A.paired_bootstrap(_safe(participants(s, d)), "pointwise_d", "global_interpolate", REPS, metrics=_all), f"{PAQ},\n{_paired('pointwise_d', 'global_interpolate')}", _interval)
HBQ = f"""{PAQ},\n{_bs},
pb AS (SELECT *, 1 - long_hallucination AS long_safety FROM pa),
dr AS (SELECT method, replicate, {', '.join(f'avg({m}) AS {m}' for m in _all)} FROM (SELECT method, replicate, dataset, {', '.join(f'avg({m}) AS {m}' for m in _all)} FROM sa JOIN pb USING (dataset, participant_id) GROUP BY ALL) AS z GROUP BY ALL),
ob AS (SELECT method, {', '.join(f'avg({m}) AS {m}' for m in _all)} FROM (SELECT method, dataset, {', '.join(f'avg({m}) AS {m}' for m in _all)} FROM pb GROUP BY ALL) AS z GROUP BY method)"""
add("hierarchical_bootstrap_portable", "method:s metric:s mean:d5 ci_low:d5 ci_high:d5", lambda s, d: A.hierarchical_bootstrap(_safe(participants(s, d)), _all, REPS), HBQ, f"SELECT o.method, o.metric, o.mean, l.ci_low, l.ci_high FROM ({_union('ob', 'method, ', 'mean')}) AS o JOIN (SELECT method, metric, quantile_cont(v, 0.025) AS ci_low, quantile_cont(v, 0.975) AS ci_high FROM ({_union('dr', 'method, ', 'v')}) AS z GROUP BY ALL) AS l USING (method, metric)")

# Timing tables: shipping delays of order lines stand for milliseconds, two lines of an order for two methods
_timing = "SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS dataset, l_linenumber AS duration_setting_s, CASE WHEN l_partkey % 2 = 0 THEN 'P' ELSE 'H' END AS method, l_orderkey % 50 AS pair, l_extendedprice AS milliseconds FROM lineitem"


def timings(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.when(F.col("l_suppkey") % 2 == 0, "A").otherwise("B").alias("dataset"), F.col("l_linenumber").alias("duration_setting_s"), F.when(F.col("l_partkey") % 2 == 0, "P").otherwise("H").alias("method"), (F.col("l_orderkey") % 50).alias("pair"), F.col("l_extendedprice").alias("milliseconds"))


add("timing_summary", "dataset:s duration_setting_s:l method:s n:l median_ms:d min_ms:d max_ms:d", lambda s, d: A.timing_summary(timings(s, d)), f"ti AS ({_timing})", "SELECT dataset, duration_setting_s, method, count(milliseconds) AS n, median(milliseconds) AS median_ms, min(milliseconds) AS min_ms, max(milliseconds) AS max_ms FROM ti GROUP BY ALL")
add("paired_difference", "dataset:s duration_setting_s:l median_difference:d pairs:l", lambda s, d: A.paired_difference(timings(s, d), "P", "H", ("pair",), ("dataset", "duration_setting_s")), f"ti AS ({_timing}), pr AS (SELECT dataset, duration_setting_s, pair, max(CASE WHEN method = 'P' THEN milliseconds END) AS a, max(CASE WHEN method = 'H' THEN milliseconds END) AS b FROM ti GROUP BY ALL)", "SELECT dataset, duration_setting_s, median(b - a) AS median_difference, count(*) AS pairs FROM pr WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL")


# Cadence, windows, splits and specifications
def recordings(spark: SparkSession, d: str) -> DataFrame:
    """Supplier series as recordings: times with repeats, pauses and holes."""
    i, s = F.col("sample_idx"), F.col("series")
    df = lines(spark, d).withColumn("time_s", (i - F.when(i % 97 == 5, 1).otherwise(0) + F.floor(i / 150) * F.when(s % 3 == 0, 5).otherwise(0)) / 60.0)
    df = df.withColumn("x", F.when(i % 211 != 3, F.col("x"))).withColumns({"source_file": F.concat(F.lit("f"), (s % 7).cast("string")), "participant_id": F.concat(F.lit("p"), (s % 11).cast("string")), "segment_id": F.concat(F.lit("s"), s.cast("string")), "dataset": F.when(s % 2 == 0, "A").otherwise("B")})
    return df


REQ = f"""{LI},
re AS (SELECT series, sample_idx, (sample_idx - CASE WHEN sample_idx % 97 = 5 THEN 1 ELSE 0 END + (sample_idx // 150) * CASE WHEN series % 3 = 0 THEN 5 ELSE 0 END) / 60.0::DOUBLE AS time_s, CASE WHEN sample_idx % 211 <> 3 THEN x END AS x, y,
  'f' || series % 7 AS source_file, 'p' || series % 11 AS participant_id, 's' || series AS segment_id, CASE WHEN series % 2 = 0 THEN 'A' ELSE 'B' END AS dataset FROM li),
dt AS (SELECT *, time_s - lag(time_s) OVER (PARTITION BY source_file, participant_id, segment_id ORDER BY time_s) AS dt FROM re)"""
add("segment_rate", "source_file:s participant_id:s segment_id:s hz:d", lambda s, d: W.sampling_rate(recordings(s, d)), REQ, "SELECT source_file, participant_id, segment_id, 1 / median(dt) AS hz FROM dt WHERE dt > 0 GROUP BY ALL")
add("dataset_rate", "dataset:s hz:d", lambda s, d: W.sampling_rate(recordings(s, d), by=("dataset",)), REQ, "SELECT dataset, 1 / median(dt) AS hz FROM dt WHERE dt > 0 GROUP BY ALL")
add("rate_fallback", "source_file:s participant_id:s segment_id:s hz:d", lambda s, d: W.rate_or(recordings(s, d).withColumn("time_s", F.when(F.col("series") % 2 == 0, F.col("time_s")).otherwise(0.0)), F.lit(59.88)), REQ, "SELECT source_file, participant_id, segment_id, coalesce(1 / median(CASE WHEN series % 2 = 0 AND dt > 0 THEN dt END), 59.88) AS hz FROM dt GROUP BY source_file, participant_id, segment_id")
add("rate_report", "source_file:s median_hz:d min_recording_hz:d max_recording_hz:d n_recordings:l n_participants:l", lambda s, d: W.rate_report(recordings(s, d)), REQ, "SELECT source_file, median(hz) AS median_hz, min(hz) AS min_recording_hz, max(hz) AS max_recording_hz, count(*) AS n_recordings, count(DISTINCT participant_id) AS n_participants FROM (SELECT source_file, participant_id, segment_id, 1 / median(dt) AS hz FROM dt WHERE dt > 0 GROUP BY ALL) AS z GROUP BY source_file")
_k3 = "source_file, participant_id, segment_id"
FWQ = f"""{REQ},
w0 AS (SELECT * FROM (SELECT * EXCLUDE (dt), row_number() OVER (PARTITION BY {_k3}, time_s ORDER BY sample_idx) AS n FROM dt) AS z WHERE n = 1),
w1 AS (SELECT *, time_s - lag(time_s) OVER (PARTITION BY {_k3} ORDER BY time_s) AS dt, (x IS NOT NULL AND y IS NOT NULL) AS ok FROM w0),
w2 AS (SELECT *, median(CASE WHEN dt > 0 THEN dt END) OVER (PARTITION BY {_k3}) AS mid, lag(ok) OVER (PARTITION BY {_k3} ORDER BY time_s) AS was FROM w1),
w3 AS (SELECT *, sum(CASE WHEN ok AND was AND dt > 0 AND dt <= 3.0 * mid THEN 0 ELSE 1 END) OVER (PARTITION BY {_k3} ORDER BY time_s) AS run FROM w2),
w4 AS (SELECT *, min(time_s) OVER (PARTITION BY {_k3}, run) AS t0, max(time_s) OVER (PARTITION BY {_k3}, run) AS t1 FROM w3 WHERE ok),
w5 AS (SELECT *, min(CASE WHEN time_s >= t0 + 2.0 THEN time_s END) OVER (PARTITION BY {_k3}, run) AS fin FROM w4),
w6 AS (SELECT *, min(run) OVER (PARTITION BY {_k3}) AS first_run FROM w5 WHERE t1 - t0 >= 2.0 AND fin IS NOT NULL),
w7 AS (SELECT * FROM w6 WHERE run = first_run AND time_s <= fin)"""
_window = lambda s, d: W.first_exact_window(recordings(s, d), 2.0, order="sample_idx")
add("first_exact_window", "segment_id:s sample_idx:l time_s:d", _window, FWQ, "FROM w7")
EXQ = f"""{FWQ},
ky AS (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY ('0x' || substr(md5('42|' || k), 1, 15))::BIGINT, k) AS r FROM (SELECT DISTINCT participant_id, participant_id || '__' || source_file || '__' || segment_id AS k FROM w7) AS z),
kx AS (SELECT k, row_number() OVER (ORDER BY participant_id, k) - 1 AS case_index FROM ky WHERE r <= 2),
ex AS (SELECT w7.*, case_index, dataset || '__' || participant_id || '__seg' || case_index AS case_segment FROM w7 JOIN kx ON kx.k = participant_id || '__' || source_file || '__' || segment_id)"""
_extracted = lambda s, d: W.extract_segments(recordings(s, d), 2.0, 2, 42)
add("extract_segments", "case_segment:s case_index:l segment_id:s n:l", lambda s, d: _extracted(s, d).groupBy("case_segment", "case_index", "segment_id").agg(F.count("*").alias("n")), EXQ, "SELECT case_segment, case_index, segment_id, count(*) AS n FROM ex GROUP BY ALL")
add("extraction_summary", "dataset:s files:l participants:l segments:l median_duration_s:d", lambda s, d: W.extraction_summary(_extracted(s, d)), EXQ, "SELECT dataset, count(DISTINCT source_file) AS files, count(DISTINCT participant_id) AS participants, count(DISTINCT case_segment) AS segments, median(span) AS median_duration_s FROM (SELECT dataset, source_file, participant_id, case_segment, max(time_s) - min(time_s) AS span FROM ex GROUP BY ALL) AS z GROUP BY dataset")
_up = lambda c: f"greatest(100, ceil(quantile_cont({c}, 0.999) / 100) * 100)"
add("coordinate_bounds", "width:d height:d", lambda s, d: W.coordinate_bounds(events(s, d)), EV, f"SELECT {_up('x')} AS width, {_up('y')} AS height FROM ev")
add("dataset_metadata", "dataset:s n:l files:l participants:l hz:d width:d height:d", lambda s, d: (r := recordings(s, d)).groupBy("dataset").agg(F.count("*").alias("n"), F.count_distinct("source_file").alias("files"), F.count_distinct("participant_id").alias("participants")).join(W.sampling_rate(r, by=("dataset",)), "dataset").join(W.coordinate_bounds(r, by=("dataset",)), "dataset"), REQ, f"SELECT dataset, count(*) AS n, count(DISTINCT source_file) AS files, count(DISTINCT participant_id) AS participants, 1 / median(CASE WHEN dt > 0 THEN dt END) AS hz, {_up('x')} AS width, {_up('y')} AS height FROM dt GROUP BY dataset")
add("prefix_window", _row + "time_s:d", lambda s, d: W.prefix(lines(s, d), 1.5, ("series",)), LI, "SELECT * FROM (SELECT *, min(time_s) OVER (PARTITION BY series) AS t0 FROM li) AS z WHERE time_s <= t0 + 1.5")
add("finite_pairs", "series:l n:l finite:l", lambda s, d: events(s, d).groupBy("series").agg(F.count("*").alias("n"), F.sum((F.col("x").isNotNull() & F.col("y").isNotNull()).cast("int")).alias("finite")), EV, "SELECT series, count(*) AS n, sum(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 1 ELSE 0 END) AS finite FROM ev GROUP BY series")


def units(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select(F.when(s % 2 == 0, "A").otherwise("B").alias("dataset"), F.concat(F.lit("p"), s.cast("string")).alias("participant_id"), s.alias("series"))


UNQ = "un AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS dataset, 'p' || s_suppkey AS participant_id, s_suppkey AS series FROM supplier)"
_split = lambda seed, frac, a, b: f"SELECT dataset, participant_id, CASE WHEN r <= least(greatest(1, CAST(round_even({frac} * n, 0) AS INTEGER)), n - 1) THEN '{b}' ELSE '{a}' END AS split FROM (SELECT *, count(*) OVER (PARTITION BY dataset) AS n, row_number() OVER (PARTITION BY dataset ORDER BY ('0x' || substr(md5('{seed}|' || dataset || '|' || participant_id), 1, 15))::BIGINT, participant_id) AS r FROM (SELECT DISTINCT dataset, participant_id FROM un) AS z) AS y"
SPQ = f"{UNQ},\nsp AS ({_split(20260728, '0.3::DOUBLE', 'train', 'test')})"
add("split_train_test", "dataset:s participant_id:s split:s", lambda s, d: W.split_units(units(s, d)), SPQ, "FROM sp")
add("split_inner", "dataset:s participant_id:s split:s", lambda s, d: W.split_units(W.split_units(units(s, d)).where("split = 'train'").drop("split"), 0.25, 7, names=("inner_train", "development")), f"{UNQ.replace('un AS', 'u0 AS')},\nsp AS ({_split(20260728, '0.3::DOUBLE', 'train', 'test').replace('FROM un)', 'FROM u0)')}),\nun AS (SELECT dataset, participant_id FROM sp WHERE split = 'train')", _split(7, "0.25::DOUBLE", "inner_train", "development"))
add("split_semi_join", "series:l n:l", lambda s, d: lines(s, d).join(units(s, d).join(W.split_units(units(s, d)).where("split = 'test'"), ["dataset", "participant_id"]), "series", "left_semi").groupBy("series").agg(F.count("*").alias("n")), f"{SPQ},\n{LI}", "SELECT series, count(*) AS n FROM li WHERE series IN (SELECT series FROM un JOIN sp USING (dataset, participant_id) WHERE split = 'test') GROUP BY series")
_specs = lambda s, d: W.case_specs(units(s, d).select("dataset", F.col("participant_id").alias("case_segment")), (0, 1, 2), cap=40)
add("case_specs", "dataset:s case_segment:s seed:l severity:s corruption:s", _specs, UNQ, f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY ('0x' || substr(md5('0|' || case_segment || '|' || seed || '|' || severity || '|' || corruption), 1, 15))::BIGINT, case_segment, seed, severity, corruption) AS r FROM (SELECT dataset, participant_id AS case_segment, seed, severity, corruption FROM un, (SELECT unnest([0, 1, 2]) AS seed) AS a, (SELECT unnest(['low', 'medium', 'high']) AS severity) AS b, (SELECT unnest({list(W.CORRUPTIONS)!r}) AS corruption) AS c) AS z) AS y WHERE r <= 40")

# Corruptions
add("movement_label_split", _row + "true_regime:s", lambda s, d: CO.mark_movement(lines(s, d), slice_rows=SLICE, range_rows=RANGE), COQ, "SELECT series, sample_idx, reg0 AS true_regime FROM co2")
add("movement_label", _row + "true_regime:s", lambda s, d: CO.mark_movement(lines(s, d)), COQ, "SELECT series, sample_idx, reg0 AS true_regime FROM co2")
_co = _row + "x:d4 y:d4 true_regime:s unstable_subtype:s"
for _name, _k in {"corrupt_short_gap": "short_gap", "corrupt_long_gap": "long_gap", "corrupt_jitter_portable": "jitter", "corrupt_spike_portable": "spike", "corrupt_mixed": "mixed"}.items():
    add(_name, _co, lambda s, d, k=_k: cases(s, d, k), f"{LI},\n{Q.corrupted(kind=_k)}", "FROM co")
add("prepared_cases", _row + "m_t:l r_t:l p_t:l c_t:d2 true_regime:s", lambda s, d: DG.diagnose(cases(s, d), LW, LH), CDQ, "FROM cdg")


# The learned hybrid
def featured(spark: SparkSession, d: str) -> DataFrame:
    return HY.features(diagnosed(spark, d).withColumn("hz", F.when(F.col("series") % 2 == 0, 80.0).otherwise(100.0)), sizes=((4, 5), (12, 15)))


_rank = lambda c: f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY series ORDER BY {c} NULLS LAST) + (count({c}) OVER (PARTITION BY series, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY series) ELSE 0.5 END"
_frame = lambda f, v, e, o: f"CASE WHEN series % 2 = 0 THEN {f}({v}) OVER (PARTITION BY series ORDER BY sample_idx ROWS BETWEEN {e // 2} PRECEDING AND {e - 1 - e // 2} FOLLOWING) ELSE {f}({v}) OVER (PARTITION BY series ORDER BY sample_idx ROWS BETWEEN {o // 2} PRECEDING AND {o // 2} FOLLOWING) END"
FTQ = f"""{DGQ},
f0 AS (SELECT *, {', '.join(f'coalesce(ln(1 + greatest({c}, 0)), 0) AS log_{k}, {_rank(c)} AS rank_{k}' for k, c in (('c', 'c_t'), ('a', 'alpha_t'), ('u', 'u_t')))} FROM dg),
f1 AS (SELECT *, {', '.join(f"{_frame('avg', f'rank_{k}', 4, 5)} AS short_{k}, {_frame('max', f'rank_{k}', 12, 15)} AS long_{k}" for k in 'au')}, p_t AS p FROM f0),
ft AS (SELECT *, rank_a - short_a AS over_a, rank_u - short_u AS over_u FROM f1)"""
add("features13_split", _row + " ".join(f"{f}:d" for f in HY.FEATURES), lambda s, d: HY.features(diagnosed_split(s, d).withColumn("hz", F.when(F.col("series") % 2 == 0, 80.0).otherwise(100.0)), sizes=((4, 5), (12, 15)), slice_rows=SLICE, range_rows=RANGE), FTQ, "FROM ft")
add("percent_rank_avg", _row + "rank_c:d rank_a:d rank_u:d", featured, FTQ, "FROM ft")
add("features13", _row + " ".join(f"{f}:d" for f in HY.FEATURES), featured, FTQ, "FROM ft")
_label = "CASE WHEN true_regime = 'Movement' THEN 1 WHEN true_regime = 'LossShort' THEN 2 WHEN true_regime = 'LossLong' THEN 3 WHEN true_regime = 'Unstable' AND unstable_subtype = 'impulse' THEN 4 WHEN true_regime = 'Unstable' THEN 5 ELSE 0 END AS label"
_labelled = lambda s, d: HY.labels(DG.diagnose(cases(s, d), LW, LH))
LAQ = f"{CDQ},\nla AS (SELECT *, {_label} FROM cdg),\nlb AS (SELECT *, sample_idx - row_number() OVER {Q.OVER} AS block FROM la WHERE m_t = 0)"
add("expanded_labels", _row + "label:l", _labelled, LAQ, "FROM la")
_grid = f"(SELECT unnest({Q.FINITE_LIST}) AS l)"
TRQ = f"{LAQ},\ntr AS (SELECT g.l AS l, h.r AS r, 0.5 + count(z.label) AS n FROM {_grid} AS g CROSS JOIN (SELECT unnest({Q.FINITE_LIST}) AS r) AS h LEFT JOIN (SELECT label, lead(label) OVER (PARTITION BY series, block ORDER BY sample_idx) AS nxt FROM lb) AS z ON z.label = g.l AND z.nxt = h.r GROUP BY ALL)"
add("transition_counts", "left_state:l right_state:l n:d log_p:d", lambda s, d: HY.transition_counts(_labelled(s, d)).withColumnsRenamed({"left": "left_state", "right": "right_state"}), TRQ, "SELECT l AS left_state, r AS right_state, n, ln(greatest(n / sum(n) OVER (PARTITION BY l), 1e-12)) AS log_p FROM tr")
STQ = f"{LAQ},\nsc AS (SELECT g.l AS state, 0.5 + count(z.label) AS n FROM {_grid} AS g LEFT JOIN (SELECT label FROM (SELECT label, row_number() OVER (PARTITION BY series, block ORDER BY sample_idx) AS i FROM lb) AS y WHERE i = 1) AS z ON z.label = g.l GROUP BY ALL)"
add("start_counts", "state:l n:d log_p:d", lambda s, d: HY.start_counts(_labelled(s, d)), STQ, "SELECT state, n, ln(greatest(n / sum(n) OVER (), 1e-12)) AS log_p FROM sc")
add("balanced_sample", _row + "label:l", lambda s, d: HY.balanced_sample(_labelled(s, d).where("m_t = 0"), 50), LAQ, f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {draw_sql('series', 'sample_idx', '20260728', 31)}, series, sample_idx) AS r FROM la WHERE m_t = 0) AS z WHERE r <= 50")
_even, _odd = (0.55, 0.25, 0.15, 0.05), (0.20, 0.60, 0.15, 0.05)
_T = np.full((4, 4), np.log(0.05)) + np.eye(4) * (np.log(0.85) - np.log(0.05))


def stubbed(spark: SparkSession, d: str) -> DataFrame:
    logs = lambda ps: F.array(*(F.lit(float(np.log(p))) for p in ps))
    return with_rate(diagnosed(spark, d)).withColumn("emissions", F.when(F.col("sample_idx") % 2 == 0, logs(_even)).otherwise(logs(_odd)))


def hybrid_stub(spark: SparkSession, d: str, strength: float, slice_rows: int | None = None) -> DataFrame:
    df = HY.predict(stubbed(spark, d), F.col("hz"), _T, np.full(4, np.log(0.25)), strength, seconds=Q.GAP_SECONDS, slice_rows=slice_rows)
    return df.withColumn("state", HY.state_name())


_em = ", ".join(f"CASE WHEN sample_idx % 2 = 0 THEN {float(np.log(a))!r}::DOUBLE ELSE {float(np.log(b))!r}::DOUBLE END AS e{i}" for i, (a, b) in enumerate(zip(_even, _odd, strict=True)))
HSQ = f"{POQ},\nem AS (SELECT *, {_em} FROM th),\n{Q.viterbi('em', ['em.e0', 'em.e1', 'em.e2', 'em.e3'], (0.5 * _T).tolist(), [0.5 * float(np.log(0.25))] * 4, 'hv')}"
_expand = "['Stable', 'Movement', 'UnstableImpulse', 'UnstableBurst']"
_lost = "WHEN m_t = 1 AND r_t <= lim THEN 'LossShort' WHEN m_t = 1 THEN 'LossLong'"
add("hybrid_p_stub", _row + "state:s", lambda s, d: hybrid_stub(s, d, 0.0), POQ, f"SELECT series, sample_idx, CASE {_lost} WHEN sample_idx % 2 = 0 THEN 'Stable' ELSE 'Movement' END AS state FROM th")
add("hybrid_h_stub", _row + "state:s", lambda s, d: hybrid_stub(s, d, 0.5), HSQ, f"SELECT em.series, em.sample_idx, CASE {_lost} ELSE {_expand}[p + 1] END AS state FROM em LEFT JOIN hv USING (series, sample_idx)")
_hstates = f"SELECT em.series, em.sample_idx, CASE {_lost} ELSE {_expand}[p + 1] END AS state FROM em LEFT JOIN hv USING (series, sample_idx)"
add("hybrid_h_slices", _row + "state:s", lambda s, d: hybrid_stub(s, d, 0.5, SLICE), HSQ, _hstates)
add("public_states", _row + "state:s public:s", lambda s, d: hybrid_stub(s, d, 0.5).withColumn("public", ST.public_state(F.col("state"))), HSQ, f"SELECT *, CASE WHEN state LIKE 'Unstable%' THEN 'Unstable' ELSE state END AS public FROM ({_hstates}) AS z")
add("prediction_disagreement", "series:l state_disagreement_fraction:d", lambda s, d: ST.viterbi_d(stated(s, d), out="h").groupBy("series").agg(F.avg((F.col("state") != F.col("h")).cast("double")).alias("state_disagreement_fraction")), VIQ, f"SELECT pw.series, avg(CASE WHEN pw.state <> h.state THEN 1.0 ELSE 0.0 END) AS state_disagreement_fraction FROM pw JOIN ({_vit}) AS h USING (series, sample_idx) GROUP BY pw.series")

_fixed = HY.HybridModel(*(np.array(v, float) for v in ([i / 10 for i in range(13)], [1 + i / 20 for i in range(13)], [[((13 * k + i) % 7 - 3) / 10 for i in range(13)] for k in range(4)], [k / 10 for k in range(4)])), _T, np.full(4, np.log(0.25)), 1.0)
_logits = ", ".join(" + ".join([f"{b!r}::DOUBLE", *(f"({f} - {m!r}::DOUBLE) / {s!r}::DOUBLE * {w!r}::DOUBLE" for f, m, s, w in zip(HY.FEATURES, _fixed.mean.tolist(), _fixed.scale.tolist(), ws, strict=True))]) + f" AS l{k}" for k, (ws, b) in enumerate(zip(_fixed.coefficients.tolist(), _fixed.intercepts.tolist(), strict=True)))
EMQ = f"{FTQ},\nlo AS (SELECT series, sample_idx, {_logits} FROM ft),\nnm AS (SELECT *, greatest(l0, l1, l2, l3) AS top FROM lo)"
_soft = ", ".join(f"ln(greatest(exp(l{k} - top) / ({' + '.join(f'exp(l{j} - top)' for j in range(4))}), 1e-12)) AS e{k}" for k in range(4))
add("hybrid_emissions", _row + "e0:d e1:d e2:d e3:d", lambda s, d: _fixed.emissions(featured(s, d)).withColumns({f"e{k}": F.col("emissions")[k] for k in range(4)}), EMQ, f"SELECT series, sample_idx, {_soft} FROM nm")


# Tuning of C and strength: fixed models stand for the fitted ones of three C, corrupted supplier series for development cases
_by_c = {c: HY.HybridModel(_fixed.mean, _fixed.scale, _fixed.coefficients * f, _fixed.intercepts[::-1] * (4 - f), _T, np.full(4, np.log(0.25)), c) for c, f in ((0.1, 0.5), (1.0, 1.0), (10.0, 2.0))}
STRENGTHS = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)


def tuning_cases(spark: SparkSession, d: str) -> DataFrame:
    df = DG.diagnose(cases(spark, d), LW, LH).withColumn("hz", F.lit(250.0))
    return named(HY.features(df, sizes=((12,), (38,))))


def _logits_of(m: HY.HybridModel) -> str:
    terms = [" + ".join([f"{b!r}::DOUBLE", *(f"({f} - {a!r}::DOUBLE) / {z!r}::DOUBLE * {w!r}::DOUBLE" for f, a, z, w in zip(HY.FEATURES, m.mean.tolist(), m.scale.tolist(), ws, strict=True))]) for ws, b in zip(m.coefficients.tolist(), m.intercepts.tolist(), strict=True)]
    return ", ".join(f"{t} AS l{k}" for k, t in enumerate(terms))


def tuning_sql(models: dict[float, HY.HybridModel], strengths: tuple[float, ...]) -> str:
    """Expressions that end in tt: (c, strength, Q_local, mae, rmse) of the trials, without the choice."""
    centred = lambda f, v, n: f"{f}({v}) OVER (PARTITION BY series ORDER BY sample_idx ROWS BETWEEN {n // 2} PRECEDING AND {n - 1 - n // 2} FOLLOWING)"
    chain = [CDQ, f"t0 AS (SELECT *, {', '.join(f'coalesce(ln(1 + greatest({c}, 0)), 0) AS log_{k}, {_rank(c)} AS rank_{k}' for k, c in (('c', 'c_t'), ('a', 'alpha_t'), ('u', 'u_t')))} FROM cpw)"]
    chain.append(f"t1 AS (SELECT *, {', '.join(f"{centred('avg', f'rank_{k}', 12)} AS short_{k}, {centred('max', f'rank_{k}', 38)} AS long_{k}" for k in 'au')}, p_t AS p FROM t0)")
    chain.append("t2 AS (SELECT *, rank_a - short_a AS over_a, rank_u - short_u AS over_u FROM t1)")
    states = []
    first = "CASE WHEN e0 >= e1 AND e0 >= e2 AND e0 >= e3 THEN 0 WHEN e1 >= e2 AND e1 >= e3 THEN 1 WHEN e2 >= e3 THEN 2 ELSE 3 END"
    for k, (c, m) in enumerate(models.items()):
        chain.append(f"lo{k} AS (SELECT *, greatest(l0, l1, l2, l3) AS top FROM (SELECT series, sample_idx, m_t, r_t, lim, {_logits_of(m)} FROM t2) AS z)")
        chain.append(f"em{k} AS (SELECT series, sample_idx, m_t, r_t, lim, {_soft} FROM lo{k})")
        for j, s in enumerate(strengths):
            at = f"SELECT {c!r}::DOUBLE AS c, {s!r}::DOUBLE AS strength, e.series, e.sample_idx, CASE {_lost} ELSE {_expand}["
            if s:
                chain.append(Q.viterbi(f"em{k}", [f"em{k}.e{i}" for i in range(4)], (s * _T).tolist(), [s * float(np.log(0.25))] * 4, f"v{k}{j}"))
                states.append(f"{at}p + 1] END AS state FROM em{k} AS e LEFT JOIN v{k}{j} USING (series, sample_idx)")
            else:
                states.append(f"{at}{first} + 1] END AS state FROM em{k} AS e")
    mend = ", ".join(f"CASE WHEN state = 'LossShort' THEN {v}i WHEN state = 'LossLong' THEN NULL WHEN state LIKE 'Unstable%' THEN {v}7 ELSE {v} END AS {v}, {v} AS {v}_degraded" for v in "xy")
    chain += [f"ts AS ({' UNION ALL '.join(states)})", Q.interpolate("cpw", "ti"), f"t7 AS (SELECT * EXCLUDE (state), median(x) OVER {_near7} AS x7, median(y) OVER {_near7} AS y7 FROM ti)"]
    chain.append(f"tm AS (SELECT t7.series, t7.sample_idx, x_clean, y_clean, true_regime, struct_pack(c := c, s := strength) AS method, {mend} FROM t7 JOIN ts USING (series, sample_idx))")
    chain += [Q.metrics("tm", LW, LH, "tq"), f"tn AS (SELECT *, {_names} FROM tq)"]
    chain.append(f"tp AS (SELECT *, {Q.AVAILABLE} AS Q_local FROM (SELECT dataset, participant_id, method, {_means} FROM tn GROUP BY ALL) AS z)")
    chain.append(f"td AS (SELECT dataset, method, {_meansq} FROM tp GROUP BY ALL)")
    chain.append(f"tt AS (SELECT method.c AS c, method.s AS strength, Q_local, mae, rmse FROM (SELECT method, {_meansq} FROM td GROUP BY method) AS z)")
    return ",\n".join(chain)


_tcols = "c:d strength:d Q_local:d mae:d rmse:d chosen:b"
_better = "round(Q_local, 9) DESC NULLS LAST, round(mae, 6) NULLS LAST"
_tbest = f"SELECT tt.*, (tt.c = b.c AND tt.strength = b.strength) AS chosen FROM tt, (SELECT c, strength FROM tt WHERE c = (SELECT c FROM tt WHERE strength = 0 ORDER BY {_better}, c LIMIT 1) ORDER BY {_better}, strength LIMIT 1) AS b"
add("tune_observation_model", _tcols, lambda s, d: HY.tuning_table(tuning_cases(s, d), F.lit(250.0), _by_c, (0.0,), LW, LH), tuning_sql(_by_c, (0.0,)), _tbest)
_one = {1.0: _by_c[1.0]}
add("tune_transition_strength", _tcols, lambda s, d: HY.tuning_table(tuning_cases(s, d), F.lit(250.0), _one, STRENGTHS, LW, LH), tuning_sql(_one, STRENGTHS), _tbest)
# All trials at once; the SQL of its 15 decodings is too much for one engine's memory.
add("tune_c_and_strength", _tcols, lambda s, d: HY.tuning_table(tuning_cases(s, d), F.lit(250.0), _by_c, STRENGTHS, LW, LH))


def both_states(spark: SparkSession, d: str) -> DataFrame:
    """Corrupted series with pointwise states and, as h, Viterbi states."""
    return ST.viterbi_d(ST.pointwise(ST.potentials(DG.diagnose(cases(spark, d), LW, LH), F.lit(250.0))), out="h")


def both_measured(df: DataFrame, told: tuple[str, ...] = ()) -> DataFrame:
    """Metrics of repairs after pointwise and after Viterbi states, by series and method. `told` are columns of the series."""
    df = df.withColumns({f"{v}_{m}": R.mended(v, c) for v in ("x", "y") for m, c in (("p", "state"), ("h", "h"))})
    each = F.array(*(F.struct(F.lit(m).alias("method"), F.col(f"x_{c}").alias("x"), F.col(f"y_{c}").alias("y"), F.col(s).alias("pred_regime")) for m, c, s in (("pointwise_d", "p", "state"), ("viterbi_d", "h", "h"))))
    keep = ("series", "sample_idx", "x_clean", "y_clean", "x_degraded", "y_degraded", "true_regime", *told)
    return ME.evaluate(df.select(*keep, F.explode(each).alias("o")).select(*keep, "o.*"), LW, LH, ("series", *told, "method"))


def pointwise_and_viterbi(spark: SparkSession, d: str) -> DataFrame:
    """Participants' means of both."""
    return A.participant_means(named(both_measured(both_states(spark, d))))


def examples(spark: SparkSession, d: str) -> DataFrame:
    """Each series as an example: the share of rows on which both disagree, and Q_local and MAE of each."""
    share = "state_disagreement_fraction"  # from the series' own window, so the states are decoded once
    df = both_states(spark, d).withColumn(share, F.avg((F.col("state") != F.col("h")).cast("double")).over(Window.partitionBy("series")))
    of = lambda c, m: F.max(F.when(F.col("method") == m, F.col(c))).alias(f"{c}_{m}")
    return A.score_available(both_measured(df, (share,))).groupBy("series", share).agg(*(of(c, m) for c in ("Q_local", "mae") for m in ("pointwise_d", "viterbi_d")))


_carried = "series, sample_idx, xr AS x, yr AS y, x_clean, y_clean, x AS x_degraded, y AS y_degraded, true_regime"
BOQ = f"""{CDQ},
{Q.viterbi('cpo', ['s1', 's2', 's5'], _change, [0.0] * 3, 'cv')},
cvh AS (SELECT cpw.*, CASE WHEN m_t = 1 THEN state ELSE ['Stable', 'Movement', 'Unstable'][p + 1] END AS h FROM cpw LEFT JOIN cv USING (series, sample_idx)),
{Q.repair('cvh', 'state', 'rp')},
{Q.repair('cvh', 'h', 'rh')},
ou AS (SELECT {_carried}, state AS pred_regime, 'pointwise_d' AS method FROM rp UNION ALL SELECT {_carried}, h, 'viterbi_d' FROM rh),
{Q.metrics('ou', LW, LH, 'mq')}"""
PVQ = f"""{BOQ},\nme AS (SELECT *, {_names} FROM mq),
pa AS (SELECT *, {Q.AVAILABLE} AS Q_local FROM (SELECT dataset, participant_id, method, {_means} FROM me GROUP BY ALL)),
{_paired('pointwise_d', 'viterbi_d')}"""
_of = ", ".join(f"max(CASE WHEN method = '{m}' THEN {c} END) AS {c}_{m}" for c in ("Q_local", "mae") for m in ("pointwise_d", "viterbi_d"))
add("qualitative_examples", "series:l state_disagreement_fraction:d Q_local_pointwise_d:d Q_local_viterbi_d:d mae_pointwise_d:d mae_viterbi_d:d", examples, BOQ, f"SELECT * FROM (SELECT series, avg(CASE WHEN state <> h THEN 1.0 ELSE 0.0 END) AS state_disagreement_fraction FROM cvh GROUP BY series) AS a JOIN (SELECT series, {_of} FROM (SELECT *, {Q.AVAILABLE} AS Q_local FROM mq) AS y GROUP BY series) AS b USING (series)")
add("pointwise_minus_viterbi", "metric:s difference:d5 ci_low:d5 ci_high:d5 favorable_direction:s", lambda s, d: A.paired_bootstrap(_safe(pointwise_and_viterbi(s, d)), "pointwise_d", "viterbi_d", REPS, metrics=_all), PVQ, _interval)

# The generative model
_logged = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN ln(1 + greatest({c}, 0)) END::DOUBLE AS l_{c}" if c in GE.LOGGED else f"{c}::DOUBLE AS l_{c}" for c in GE.INPUTS)
add("robust_scale", "name:s center:d9 scale:d9", lambda s, d: GE.robust_scale(diagnosed(s, d)), f"{DGQ},\nlg AS (SELECT {_logged} FROM dg)", " UNION ALL ".join(f"SELECT '{c}' AS name, median(l_{c}) AS center, CASE WHEN coalesce(quantile_cont(l_{c}, 0.75) - quantile_cont(l_{c}, 0.25), 0) < 1e-6 THEN 1.0 ELSE quantile_cont(l_{c}, 0.75) - quantile_cont(l_{c}, 0.25) END AS scale FROM lg" for c in GE.INPUTS))
_ge_mean, _ge_var = [0.2, 0.4, 0.1, 0.3, 2.0, 0.0], [0.5, 1.5, 0.2, 0.7, 3.0, 0.1]
_dens = " + ".join(f"-0.5::DOUBLE * (ln({2 * np.pi * v!r}::DOUBLE) + (coalesce(l_{c}, 0) - {m}::DOUBLE) * (coalesce(l_{c}, 0) - {m}::DOUBLE) / {v}::DOUBLE)" for c, m, v in zip(GE.INPUTS, _ge_mean, _ge_var, strict=True))
add("gaussian_emission", _row + "log_density:d", lambda s, d: GE.scaled(diagnosed(s, d), [0.0] * 6, [1.0] * 6).withColumn("log_density", GE.gaussian_log_emission(F.col("z"), _ge_mean, _ge_var)), f"{DGQ},\nlg AS (SELECT series, sample_idx, {_logged} FROM dg)", f"SELECT series, sample_idx, {_dens} AS log_density FROM lg")
# A fixed model of five components: one round of expectation maximisation, and the best paths.
_k = range(GE.K)
_gm = [[0.05 + 0.17 * k, 0.1 + 0.3 * k, 1.1 + 1.7 * k, 0.9 + 2.3 * k, 0.7 + 0.9 * k, 0.03 + 0.11 * k] for k in _k]
_gv = [[0.31 + 0.07 * k, 0.8 + 0.2 * k, 4.1 + 1.3 * k, 5.3 + 1.1 * k, 3.7 + 0.6 * k, 0.21 + 0.05 * k] for k in _k]
_gc = np.log(np.full((GE.K, GE.K), 0.04) + np.eye(GE.K) * 0.8).tolist()
_gs = np.log([0.3, 0.25, 0.2, 0.15, 0.1]).tolist()


def five(alias: str, of: Callable[[int], str]) -> str:
    return ", ".join(f"{of(k)} AS {alias}{k}" for k in _k)


def log_sum_sql(terms: list[str], weights: list[float]) -> str:
    top = f"greatest({', '.join(terms)})"
    return f"({top} + ln({' + '.join(f'{w!r}::DOUBLE * exp({t} - {top})' for t, w in zip(terms, weights, strict=True))}))"


_gp = np.exp(_gc).tolist()
_gdens = [" + ".join(f"-0.5::DOUBLE * (ln({2 * np.pi * v!r}::DOUBLE) + (z{i} - {m!r}::DOUBLE) * (z{i} - {m!r}::DOUBLE) / {v!r}::DOUBLE)" for i, (m, v) in enumerate(zip(_gm[k], _gv[k], strict=True))) for k in _k]
_gz = ", ".join(f"coalesce(l_{c}, 0) AS z{i}" for i, c in enumerate(GE.INPUTS))
GMQ = f"""{DGQ},
gz AS (SELECT series, sample_idx, {_gz} FROM (SELECT series, sample_idx, {_logged} FROM dg) AS lg),
ge AS (SELECT *, 0 AS m_t, row_number() OVER (PARTITION BY series ORDER BY sample_idx) AS pos, count(*) OVER (PARTITION BY series) AS size, {five('e', lambda k: _gdens[k])} FROM gz)"""
EMR = f"""{GMQ},
fw AS (SELECT series, pos, size, {five('a', lambda k: f'e{k} + ({_gs[k]!r}::DOUBLE)')} FROM ge WHERE pos = 1 AND size > 1
  UNION ALL SELECT n.series, n.pos, n.size, {', '.join(f"n.e{j} + {log_sum_sql([f'f.a{i}' for i in _k], [_gp[i][j] for i in _k])}" for j in _k)} FROM fw f JOIN ge n ON n.series = f.series AND n.pos = f.pos + 1),
bw AS (SELECT series, pos, {five('e', lambda k: f'e{k}')}, {five('b', lambda k: '0.0::DOUBLE')} FROM ge WHERE pos = size AND size > 1
  UNION ALL SELECT n.series, n.pos, {', '.join(f'n.e{k}' for k in _k)}, {', '.join(log_sum_sql([f'(f.e{j} + f.b{j})' for j in _k], _gp[i]) for i in _k)} FROM bw f JOIN ge n ON n.series = f.series AND n.pos = f.pos - 1),
lt AS (SELECT series, {log_sum_sql([f'a{k}' for k in _k], [1.0] * GE.K)} AS total FROM fw WHERE pos = size),
gg AS (SELECT f.pos, total, z2, {five('g', lambda k: f'exp(a{k} + b{k} - total)')}, {five('x', lambda k: f'exp(lag(a{k}) OVER w + ({_gc[k][k]!r}::DOUBLE) + b.e{k} + b{k} - total)')},
  {five('y', lambda k: ' + '.join(f'exp(lag(a{k}) OVER w + ({_gc[k][j]!r}::DOUBLE) + b.e{j} + b{j} - total)' for j in _k))}
  FROM fw f JOIN bw b USING (series, pos) JOIN lt USING (series) JOIN (SELECT series, pos, z2 FROM ge) AS z USING (series, pos) WINDOW w AS (PARTITION BY series ORDER BY f.pos))"""
_round = " UNION ALL ".join(f"SELECT {k} AS component, sum(CASE WHEN pos = 1 THEN total END) AS log_likelihood, sum(g{k}) AS occupancy, ln(sum(CASE WHEN pos = 1 THEN g{k} END) / count(CASE WHEN pos = 1 THEN 1 END)) AS start, ln(sum(x{k}) / sum(y{k})) AS stay, sum(g{k} * z2) / sum(g{k}) AS mean_c, sum(g{k} * z2 * z2) / sum(g{k}) - (sum(g{k} * z2) / sum(g{k})) ** 2 AS var_c FROM gg" for k in _k)


def em_round(spark: SparkSession, d: str, slice_rows: int | None = None) -> DataFrame:
    df = GE.scaled(diagnosed(spark, d), [0.0] * 6, [1.0] * 6)
    got = GE.em_round_slices(GE.dealt_slices(df, "z", slice_rows), _gs, _gc, _gm, _gv) if slice_rows else GE.em_round(GE.dealt(df, "z").where("_many"), _gs, _gc, _gm, _gv)
    return got.withColumns({"stay": F.get("change", F.col("component")), "mean_c": F.col("mean")[2], "var_c": F.col("var")[2]})


add("gaussian_em_round", "component:l log_likelihood:d3 occupancy:d4 start:d5 stay:d5 mean_c:d5 var_c:d5", em_round, EMR, _round)
add("gaussian_em_round_slices", "component:l log_likelihood:d3 occupancy:d4 start:d5 stay:d5 mean_c:d5 var_c:d5", lambda s, d: em_round(s, d, SLICE), EMR, _round)
add("gaussian_decode", _row + "component:l", lambda s, d: GE.decode_series(GE.scaled(diagnosed(s, d), [0.0] * 6, [1.0] * 6), "z", np.array(_gm), np.array(_gv), np.array(_gc), np.array(_gs), "component", ("series",), "sample_idx"), f"{GMQ},\n{Q.viterbi('ge', [f'e{k}' for k in _k], _gc, _gs, 'gd')}", "SELECT series, sample_idx, p AS component FROM gd")
add("gaussian_decode_slices", _row + "component:l", lambda s, d: GE.decode_series(GE.scaled(diagnosed(s, d), [0.0] * 6, [1.0] * 6), "z", np.array(_gm), np.array(_gv), np.array(_gc), np.array(_gs), "component", ("series",), "sample_idx", SLICE), f"{GMQ},\n{Q.viterbi('ge', [f'e{k}' for k in _k], _gc, _gs, 'gd')}", "SELECT series, sample_idx, p AS component FROM gd")
add("component_overlap", "component:l state:s n:l", lambda s, d: GE.overlap_counts(stated(s, d).withColumn("component", F.col("sample_idx") % 5), state="state"), POQ, "SELECT sample_idx % 5 AS component, state, count(*) AS n FROM pw GROUP BY ALL")


# Sources over tables shaped like raw files
def raw_micro(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k")
    return e.select(F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("time"), F.when(F.col("event_type") != "error", F.round("value", 3).cast("string")).otherwise("0").alias("gaze_x_left"), k.alias("gaze_y_left"), F.when(F.col("event_id") % 3 == 0, "bad").otherwise(k).alias("gaze_x_right"), F.when(F.col("event_id") % 4 == 0, "0").otherwise(k).alias("gaze_y_right"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".csv")).alias("source_file"), F.col("event_type").alias("task"), F.lit("st").alias("stimfile"), F.row_number().over(w).alias("_row"))


_mean2 = lambda l, r: f"coalesce(({l} + {r}) / 2, {l}, {r})"
MIQ = f"""rw AS (SELECT user_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, nullif(CASE WHEN event_type <> 'error' THEN round(value, 3) ELSE 0 END, 0) AS xl,
  nullif(CAST(props->>'$.k' AS DOUBLE), 0) AS k, CASE WHEN event_id % 3 <> 0 THEN nullif(CAST(props->>'$.k' AS DOUBLE), 0) END AS xr, CASE WHEN event_id % 4 <> 0 THEN nullif(CAST(props->>'$.k' AS DOUBLE), 0) END AS yr FROM events)"""
_can = "source_file:s participant_id:s segment_id:s time_s:d x:d y:d"
add("binocular_source", _can, lambda s, d: IO.binocular_micro(raw_micro(s, d)), MIQ, f"SELECT 'u' || user_id || '.csv' AS source_file, 'u' || user_id AS participant_id, event_type || '__st' AS segment_id, (us - first_value(us) OVER (PARTITION BY user_id ORDER BY n)) / 1e6 AS time_s, {_mean2('xl', 'xr')} AS x, {_mean2('k', 'yr')} AS y FROM rw")


def raw_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The recordings of raw_micro() written as a CSV file for each user, in folders by header, and read back. Users whose number
    ends in 7 have a file whose clock has another name, other users of odd numbers have their columns in another order."""
    raw = raw_micro(spark, d).withColumns({"user": F.col("source_file"), "subject_id": F.regexp_replace("source_file", r"\.csv$", "")})
    last = F.regexp_extract("subject_id", r"(\d)$", 1).cast("int")
    cols = [c for c in raw.columns if c not in ("user", "time", "source_file", "_row")]
    root = f"{shared_dir(spark)}/raw-{uuid.uuid4().hex}"
    for name, rows, order in (("broken", last == 7, ["clock", *cols]), ("turned", (last % 2 == 1) & (last != 7), [*cols[::-1], "time"]), ("plain", last % 2 == 0, ["time", *cols])):
        line = F.concat_ws(",", *(F.coalesce(F.col("time" if c == "clock" else c), F.lit("")) for c in order))
        file = raw.where(rows).groupBy("user").agg(F.array_sort(F.collect_list(F.struct("_row", line.alias("line")))).alias("all"))
        text = F.concat_ws("\n", F.lit(",".join(order)), F.transform("all", lambda r: r["line"]))
        file.select("user", text.alias("value")).write.partitionBy("user").option("compression", "none").text(f"{root}/{name}")
    return IO.read_recordings(spark, root, "ETDD70", "*.txt")


_raw = "participant_id:s segment_id:s time_s:d x:d y:d"
add("raw_files", _raw, lambda s, d: raw_files(s, d)[0], MIQ, f"SELECT 'u' || user_id AS participant_id, event_type || '__st' AS segment_id, (us - first_value(us) OVER (PARTITION BY user_id ORDER BY n)) / 1e6 AS time_s, {_mean2('xl', 'xr')} AS x, {_mean2('k', 'yr')} AS y FROM rw WHERE user_id % 10 <> 7")
add("rejected_files", "missing:s files:l", lambda s, d: raw_files(s, d)[1].groupBy(F.array_join("missing", ",").alias("missing")).agg(F.count("*").alias("files")), None, "SELECT 'time' AS missing, count(DISTINCT user_id) AS files FROM events WHERE user_id % 10 = 7 HAVING count(*) > 0")


def raw_milli(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("double").cast("string")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias(IO.MILLI[0]), q.alias(IO.MILLI[1]), F.when(F.col("l_linenumber") == 1, "-").otherwise(q).alias(IO.MILLI[2]), F.when(F.col("l_linenumber") == 2, "-").otherwise(F.col("l_partkey").cast("string")).alias(IO.MILLI[3]), F.col("l_suppkey").cast("string").alias(IO.MILLI[4]), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey").cast("string")).otherwise("-").alias("Participant"), F.col("l_returnflag").alias("Trial"), F.lit("f.csv").alias("source_file"), F.lit(0).alias("_row"))


MLQ = """ml AS (SELECT l_orderkey * 10 + l_linenumber AS t, nullif(l_quantity::DOUBLE, 0) AS xr, CASE WHEN l_linenumber <> 1 THEN nullif(l_quantity::DOUBLE, 0) END AS yr, CASE WHEN l_linenumber <> 2 THEN nullif(l_partkey::DOUBLE, 0) END AS xl, nullif(l_suppkey::DOUBLE, 0) AS yl,
  CASE WHEN l_suppkey % 5 <> 0 THEN CAST(l_suppkey AS VARCHAR) ELSE 'unknown' END AS participant_id, l_returnflag FROM lineitem),
mm AS (SELECT *, participant_id || '__' || l_returnflag || '__stimulus' AS segment_id FROM ml)"""
add("participants_source", _can, lambda s, d: IO.participants_milli(raw_milli(s, d)), MLQ, f"SELECT 'f.csv' AS source_file, participant_id, segment_id, (t - min(t) OVER (PARTITION BY participant_id, segment_id)) / 1000.0::DOUBLE AS time_s, {_mean2('xl', 'xr')} AS x, {_mean2('yl', 'yr')} AS y FROM mm")
_ids = lambda s, d: table(s, d, "supplier").select(F.explode(F.array(*(F.concat(F.lit(a), F.col("s_suppkey").cast("string"), F.lit(b)) for a, b in ((" 00", ".0"), ("", " "), ("p", ".0"), ("-", ".0"), ("", ".50"))))).alias("raw"))
add("normalize_ids", "raw:s id:s", lambda s, d: _ids(s, d).withColumn("id", normalize_id(F.col("raw"))), "ids AS (SELECT unnest([' 00' || s_suppkey || '.0', s_suppkey || ' ', 'p' || s_suppkey || '.0', '-' || s_suppkey || '.0', s_suppkey || '.50']) AS raw FROM supplier)", "SELECT raw, CASE WHEN regexp_full_match(trim(raw), '[+-]?[0-9]{1,18}\\.0') THEN CAST(CAST(regexp_replace(trim(raw), '\\.0$', '') AS BIGINT) AS VARCHAR) ELSE trim(raw) END AS id FROM ids")
add("build_cases", "case_segment:l sample_idx:l time_s:d", lambda s, d: IO.build_cases(lines(s, d).drop("sample_idx").withColumnRenamed("series", "case_segment")), LI, "SELECT series AS case_segment, row_number() OVER (PARTITION BY series ORDER BY time_s) - 1 AS sample_idx, time_s FROM li")

# Relational primitives
RLQ = DSQ
add("rl_left_join", "dataset:s method:s mae:d macro_mae:d", lambda s, d: (lambda a, b: a.select("dataset", "method", "mae").join(b.where("method <> 'raw_degraded'").select("method", F.col("mae").alias("macro_mae")), "method", "left"))(*A.dataset_and_macro(participants(s, d))), RLQ, "SELECT ds.dataset, ds.method, ds.mae, m.macro_mae FROM ds LEFT JOIN (SELECT method, avg(mae) AS macro_mae FROM ds WHERE method <> 'raw_degraded' GROUP BY method) AS m USING (method)")


def one_to_one(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Inner join that fails, within the job itself, where a key comes twice on either side."""
    once = lambda df: df.withColumn("_n", F.count("*").over(Window.partitionBy(*key))).withColumn("_n", F.assert_true(F.col("_n") == 1, F.lit("a key of a one-to-one join comes twice")))
    left, right = once(a), once(b).withColumnRenamed("_n", "_m")
    return left.join(right, key).where("_n is null and _m is null").drop("_n", "_m")


add("rl_one_to_one", "dataset:s method:s mae:d rmse:d", lambda s, d: one_to_one((x := A.dataset_and_macro(participants(s, d))[0]).select("dataset", "method", "mae"), x.select("dataset", "method", "rmse"), ["dataset", "method"]), RLQ, "SELECT dataset, method, mae, rmse FROM ds")
add("rl_disjoint_check", "shared:l", lambda s, d: (x := W.split_units(units(s, d))).where("split = 'train'").select("dataset", "participant_id").intersect(x.where("split = 'test'").select("dataset", "participant_id")).agg(F.count("*").alias("shared")), SPQ, "SELECT count(*) AS shared FROM (SELECT dataset, participant_id FROM sp WHERE split = 'train' INTERSECT SELECT dataset, participant_id FROM sp WHERE split = 'test') AS z")
add("rl_union_all", "kind:s n:l", lambda s, d: events(s, d).select("x", "y").unionByName(lines(s, d).select("y", "x")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("rows")), f"{EV},\n{LI}", "SELECT 'rows' AS kind, count(*) AS n FROM (SELECT x, y FROM ev UNION ALL SELECT x, y FROM li) AS z")
add("rl_distinct_first", "user_id:l event_type:s event_id:l", lambda s, d: table(s, d, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")), None, "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) AS z WHERE n = 1")
add("rl_top1", "method:s Q_local:d mae:d", lambda s, d: A.dataset_and_macro(participants(s, d))[1].orderBy(F.desc("Q_local"), "mae", "method").limit(1), RLQ, "SELECT method, avg(Q_local) AS Q_local, avg(mae) AS mae FROM ds GROUP BY method ORDER BY 2 DESC, 3, 1 LIMIT 1")
add("rl_grouped_duration", "series:l span:d", lambda s, d: events(s, d).groupBy("series").agg((F.max("time_s") - F.min("time_s")).alias("span")), EV, "SELECT series, max(time_s) - min(time_s) AS span FROM ev GROUP BY series")
add("rl_null_groups", "kind:s n:l", lambda s, d: table(s, d, "events").groupBy(F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind")).agg(F.count("*").alias("n")), None, "SELECT CASE WHEN event_type <> 'error' THEN event_type END AS kind, count(*) AS n FROM events GROUP BY ALL")
add("sc_functions", "event_id:l a:d b:l c:d e:s", lambda s, d: table(s, d, "events").select("event_id", F.log1p(F.abs("value")).alias("a"), F.bround(F.col("value") / 2).cast("long").alias("b"), finite(F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.exp(-F.abs("value")))).alias("c"), F.lower(F.concat_ws("__", "event_type", F.trim(F.lit(" X ")))).alias("e")), None, "SELECT event_id, ln(1 + abs(value)) AS a, round_even(value / 2, 0) AS b, CASE WHEN event_id % 5 <> 0 THEN exp(-abs(value)) END AS c, lower(event_type || '__' || trim(' X ')) AS e FROM events")
add("portable_draws", "event_id:l u:d9", lambda s, d: table(s, d, "events").select("event_id", draw(F.col("user_id"), F.col("event_id"), 3, 5).alias("u")), None, f"SELECT event_id, {draw_sql('user_id', 'event_id', '3', 5)} AS u FROM events")


# What SQL cannot express
def hybrid_fit_predict(spark: SparkSession, d: str) -> DataFrame:
    df = HY.features(DG.diagnose(cases(spark, d), LW, LH).withColumn("hz", F.lit(250.0)), sizes=((12,), (38,)))
    df = HY.staged_features(df, ("m_t", "r_t", "true_regime", "unstable_subtype"))
    model = HY.fit(df)
    few = model.emissions(df).select("series", "sample_idx", "m_t", "r_t", "true_regime", "emissions")
    out = HY.predict(few, F.lit(250.0), model.transition_log, model.start_log)
    return out.groupBy("true_regime", HY.state_name().alias("state")).agg(F.count("*").alias("n"))


def gaussian_fit_predict(spark: SparkSession, d: str) -> DataFrame:
    df = staged(DG.diagnose(cases(spark, d), LW, LH).select("series", "sample_idx", "true_regime", *GE.INPUTS), "diagnosed")
    return GE.fit(df).predict(df).groupBy("true_regime", "state").agg(F.count("*").alias("n"))


def shifted(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*(F.lit(x) for x in names)), (F.col("series") % n + 1).cast("int"))
    df = lines(spark, d).withColumns({"corruption": pick(W.CORRUPTIONS, 5), "severity": pick(("low", "medium", "high"), 3), "seed": F.col("series") % 10})
    return CO.inject_shifted(df, 250.0)


add("hybrid_fit_predict", "true_regime:s state:s n:l", hybrid_fit_predict)
add("gaussian_hmm_fit_predict", "true_regime:s state:s n:l", gaussian_fit_predict)
add("shifted_generator", _row + "x:d4 y:d4 true_regime:s unstable_subtype:s", shifted, f"{LI},\n{Q.shifted()}", "FROM sh")
def supplier_traces(spark: SparkSession, d: str) -> DataFrame:
    """A made-up trace for each supplier: the odd ones at 250 samples a second, the even ones at 60."""
    odd = F.col("s_suppkey") % 2 == 1
    people = table(spark, d, "supplier").select(F.when(odd, "ETDD70").otherwise("Autism").alias("dataset"), F.col("s_suppkey").cast("string").alias("participant_id"), F.col("s_suppkey").cast("long").alias("number"), F.when(odd, 250.0).otherwise(60.0).alias("hz"))
    return IO.traces(people)


add("synthetic_traces", "dataset:s participant_id:s sample_idx:l time_s:d x:d y:d", supplier_traces, Q.TRACES, "SELECT * FROM tr")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
