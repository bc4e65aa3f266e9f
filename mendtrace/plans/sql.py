"""SQL of the operators as chains of named table expressions, for engines that check the queries."""

from __future__ import annotations

from ..functions.core import FINITE_STATES, STATES, draw_sql, normal_sql

WIDTH, HEIGHT, GAP_SECONDS = 400.0, 100.0, 60000.0
OVER = "(PARTITION BY series ORDER BY sample_idx)"

EVENTS = f"""ev AS (SELECT series, sample_idx, (us - first_value(us) OVER {OVER}) / 1e6 AS time_s, x, y FROM (
  SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx, epoch_us(ts) AS us,
    CASE WHEN event_type <> 'error' THEN value END AS x, CASE WHEN event_type <> 'error' THEN CAST(props->>'$.k' AS DOUBLE) END AS y FROM events))"""

LINEITEM = """li AS (SELECT series, sample_idx, sample_idx / 250.0 AS time_s, x, y FROM (
  SELECT l_suppkey AS series, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS sample_idx,
    l_extendedprice AS x, CAST(l_quantity AS DOUBLE) AS y FROM lineitem))"""


def diagnose(src: str, width: float, height: float, p: str = "", more: str = "") -> str:
    """Expressions that end in {p}dg; `more` names columns to carry along."""
    w = OVER
    near = "(PARTITION BY series ORDER BY sample_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
    return f"""{p}mt AS (SELECT *, CASE WHEN x IS NULL OR y IS NULL THEN 1 ELSE 0 END AS m_t FROM {src}),
{p}il AS (SELECT *, row_number() OVER {w} - row_number() OVER (PARTITION BY series, m_t ORDER BY sample_idx) AS island FROM {p}mt),
{p}rl AS (SELECT *, CASE WHEN m_t = 1 THEN count(*) OVER (PARTITION BY series, m_t, island) ELSE 0 END AS r_t,
  CASE WHEN m_t = 0 AND (x < 0 OR x > {width} OR y < 0 OR y > {height}) THEN 1 ELSE 0 END AS p_t FROM {p}il),
{p}d1 AS (SELECT *, (m_t = 0 AND p_t = 0) AS ok, CASE WHEN time_s - lag(time_s) OVER {w} > 0 THEN time_s - lag(time_s) OVER {w} END AS dt, lag(x) OVER {w} AS px, lag(y) OVER {w} AS py FROM {p}rl),
{p}d2 AS (SELECT *, CASE WHEN ok AND lag(ok) OVER {w} THEN sqrt((x - px) * (x - px) + (y - py) * (y - py)) / dt END AS c_t,
  CASE WHEN count(x) OVER {near} >= 3 THEN median(x) OVER {near} END AS mx, CASE WHEN count(y) OVER {near} >= 3 THEN median(y) OVER {near} END AS my FROM {p}d1),
{p}dg AS (SELECT series, sample_idx, time_s, x, y, m_t, r_t, p_t, c_t, CASE WHEN ok THEN abs(c_t - lag(c_t) OVER {w}) / dt END AS alpha_t,
  CASE WHEN ok THEN sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) END AS u_t{more} FROM {p}d2)"""


def rates(src: str, p: str = "") -> str:
    return f"{p}hz AS (SELECT series, 1 / median(dt) AS hz FROM (SELECT series, time_s - lag(time_s) OVER {OVER} AS dt FROM {src}) AS steps WHERE dt > 0 GROUP BY series)"


def potentials(seconds: float, p: str = "", hz: str | None = None) -> str:
    """Expressions that end in {p}po (scores s1 to s5) and {p}pw (pointwise state); hz: a rate for all series."""
    q = lambda c, v: f"coalesce(quantile_cont(CASE WHEN m_t = 0 THEN {c} END, {v}) OVER (PARTITION BY series), CAST('inf' AS DOUBLE))"
    rate, join = ("h.hz", f"LEFT JOIN {p}hz h USING (series)") if hz is None else (hz, "")
    return f"""{p}th AS (SELECT d.*, greatest(1, CAST(round_even({rate} * {seconds}, 0) AS INTEGER)) AS lim, {q('c_t', 0.9)} AS v_thr, {q('u_t', 0.995)} AS j_thr, {q('alpha_t', 0.995)} AS a_thr FROM {p}dg d {join}),
{p}un AS (SELECT *, (p_t = 1 OR coalesce(u_t >= j_thr, FALSE) OR coalesce(alpha_t >= a_thr, FALSE)) AS unstable, coalesce(c_t >= v_thr, FALSE) AS moving FROM {p}th),
{p}po AS (SELECT *, CASE WHEN m_t = 1 THEN -8.0 WHEN unstable THEN 0.0 ELSE 2.0 END AS s1, CASE WHEN m_t = 1 THEN -8.0 WHEN moving THEN 5.0 ELSE 0.0 END AS s2,
  CASE WHEN m_t = 1 AND r_t <= lim THEN 8.0 ELSE -8.0 END AS s3, CASE WHEN m_t = 1 AND r_t <= lim THEN -4.0 WHEN m_t = 1 THEN 10.0 ELSE -8.0 END AS s4,
  CASE WHEN m_t = 1 THEN -8.0 WHEN unstable THEN 7.0 ELSE 0.0 END AS s5 FROM {p}un),
{p}pw AS (SELECT *, CASE WHEN m_t = 1 AND r_t <= lim THEN 'LossShort' WHEN m_t = 1 THEN 'LossLong' WHEN unstable THEN 'Unstable' WHEN moving THEN 'Movement' ELSE 'Stable' END AS state FROM {p}po)"""


def interpolate(src: str, out: str, more: str = "*") -> str:
    """Expressions that end in {out}, with xi and yi."""
    b, a = f"{OVER[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"{OVER[:-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    cols = ", ".join(f"last_value({v} IGNORE NULLS) OVER {b} AS p{v}v, last_value(CASE WHEN {v} IS NOT NULL THEN sample_idx END IGNORE NULLS) OVER {b} AS p{v}i, first_value({v} IGNORE NULLS) OVER {a} AS n{v}v, first_value(CASE WHEN {v} IS NOT NULL THEN sample_idx END IGNORE NULLS) OVER {a} AS n{v}i" for v in "xy")
    mid = ", ".join(f"CASE WHEN {v} IS NOT NULL THEN {v} WHEN p{v}v IS NULL THEN n{v}v WHEN n{v}v IS NULL THEN p{v}v ELSE p{v}v + (n{v}v - p{v}v) * (sample_idx - p{v}i) / (n{v}i - p{v}i) END AS {v}i" for v in "xy")
    return f"{out}0 AS (SELECT *, {cols} FROM {src}),\n{out} AS (SELECT {more}, {mid} FROM {out}0)"


def repair(src: str, state: str, out: str) -> str:
    near = "(PARTITION BY series ORDER BY sample_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
    mend = ", ".join(f"CASE WHEN {state} = 'LossShort' THEN {v}i WHEN {state} = 'LossLong' THEN NULL WHEN {state} LIKE 'Unstable%' THEN median({v}) OVER {near} ELSE {v} END AS {v}r" for v in "xy")
    return interpolate(src, f"{out}i") + f",\n{out} AS (SELECT *, {mend} FROM {out}i)"


def viterbi(src: str, scores: list[str], change: list[list[float]], start: list[float], out: str) -> str:
    """Expressions that end in {out}: (series, sample_idx, p), the best path within finite blocks. Needs WITH RECURSIVE."""
    k = range(len(scores))
    thru = [[f"f.s{i} + ({change[i][j]!r}::DOUBLE)" for i in k] for j in k]
    best = ", ".join(f"n.e{j} + greatest({', '.join(thru[j])})" for j in k)
    first = lambda xs: "CASE " + " ".join("WHEN " + " AND ".join(f"{xs[i]} >= {xs[m]}" for m in k if m != i) + f" THEN {i}" for i in k[:-1]) + f" ELSE {k[-1]} END"
    back = ", ".join(first(thru[j]) for j in k)
    return f"""{out}b AS (SELECT series, sample_idx, {', '.join(f'CAST({c} AS DOUBLE) AS e{j}' for j, c in enumerate(scores))}, sample_idx - row_number() OVER {OVER} AS block FROM {src} WHERE m_t = 0),
{out}n AS (SELECT *, row_number() OVER (PARTITION BY series, block ORDER BY sample_idx) AS pos, count(*) OVER (PARTITION BY series, block) AS size FROM {out}b),
{out}f AS (SELECT series, block, pos, size, sample_idx, {', '.join(f'e{j} + ({start[j]!r}::DOUBLE) AS s{j}' for j in k)}, {', '.join(f'-1 AS b{j}' for j in k)} FROM {out}n WHERE pos = 1
  UNION ALL SELECT n.series, n.block, n.pos, n.size, n.sample_idx, {best}, {back} FROM {out}f f JOIN {out}n n ON n.series = f.series AND n.block = f.block AND n.pos = f.pos + 1),
{out}g AS (SELECT series, block, pos, sample_idx, {first([f's{j}' for j in k])} AS p FROM {out}f WHERE pos = size
  UNION ALL SELECT h.series, h.block, h.pos, h.sample_idx, CASE g.p {' '.join(f'WHEN {j} THEN f.b{j}' for j in k)} END FROM {out}g g JOIN {out}f f ON f.series = g.series AND f.block = g.block AND f.pos = g.pos JOIN {out}n h ON h.series = g.series AND h.block = g.block AND h.pos = g.pos - 1),
{out} AS (SELECT series, sample_idx, p FROM {out}g)"""


def corrupted(src: str = "li", out: str = "co", kind: str | None = None) -> str:
    """Expressions that end in {out}: each series corrupted in the way `kind`, or in the one that its number names."""
    way = f"'{kind}'" if kind else "['short_gap', 'long_gap', 'jitter', 'spike', 'mixed'][CAST(series % 5 + 1 AS INTEGER)]"
    n = lambda s: normal_sql("series", "sample_idx", "seed", s)
    inside = lambda a, b: f"(sample_idx >= floor(n * {a}::DOUBLE) AND sample_idx < floor(n * {a}::DOUBLE) + greatest(2, floor(n * {b})))"
    med = lambda c: f"median({c}) OVER (PARTITION BY series)"
    return f"""{out}1 AS (SELECT *, count(*) OVER (PARTITION BY series) AS n, {way} AS corruption,
  ['low', 'medium', 'high'][CAST(series % 3 + 1 AS INTEGER)] AS severity, [1.0, 1.7, 2.5][CAST(series % 3 + 1 AS INTEGER)]::DOUBLE AS f, series % 10 AS seed,
  sqrt((x - lag(x) OVER {OVER}) * (x - lag(x) OVER {OVER}) + (y - lag(y) OVER {OVER}) * (y - lag(y) OVER {OVER})) AS step FROM {src}),
{out}2 AS (SELECT *, x AS x_clean, y AS y_clean, CASE WHEN coalesce(step >= quantile_cont(step, 0.9) OVER (PARTITION BY series), FALSE) THEN 'Movement' ELSE 'Stable' END AS reg0,
  CASE WHEN corruption IN ('long_gap', 'mixed') AND {inside(0.55, '0.08::DOUBLE * f')} THEN 'LossLong' WHEN corruption IN ('short_gap', 'mixed') AND {inside(0.25, '0.025::DOUBLE * f')} THEN 'LossShort' END AS g FROM {out}1),
{out}3 AS (SELECT *, CASE WHEN g IS NULL THEN x END AS x1, CASE WHEN g IS NULL THEN y END AS y1, (g IS NULL AND corruption IN ('jitter', 'mixed') AND {inside(0.78, '0.08::DOUBLE')}) AS j FROM {out}2),
{out}4 AS (SELECT *, CASE WHEN j THEN x1 + {n(11)} * 8.0::DOUBLE * f ELSE x1 END AS x2, CASE WHEN j THEN y1 + {n(13)} * 8.0::DOUBLE * f ELSE y1 END AS y2, (x1 IS NOT NULL AND y1 IS NOT NULL) AS ok FROM {out}3),
{out}5 AS (SELECT *, (corruption IN ('spike', 'mixed') AND ok AND row_number() OVER (PARTITION BY series, ok ORDER BY {draw_sql('series', 'sample_idx', 'seed', 17)}, sample_idx)
  <= least(greatest(2, floor(0.015::DOUBLE * n * f)), sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY series))) AS s FROM {out}4),
{out} AS (SELECT series, sample_idx, time_s, corruption, severity, seed, x_clean, y_clean, CASE WHEN s THEN {med('x_clean')} + {n(19)} * 350.0::DOUBLE * f ELSE x2 END AS x,
  CASE WHEN s THEN {med('y_clean')} + {n(23)} * 250.0::DOUBLE * f ELSE y2 END AS y, CASE WHEN s OR j THEN 'Unstable' ELSE coalesce(g, reg0) END AS true_regime,
  CASE WHEN s THEN 'impulse' WHEN j THEN 'burst' ELSE '' END AS unstable_subtype FROM {out}5)"""


def shifted(src: str = "li", out: str = "sh", fallback: str = "250.0") -> str:
    """Expressions that end in {out}: the shifted generator on each series in the way that its number names."""
    d = lambda i, s: draw_sql("series", str(i), "seed", s)
    row = lambda s: draw_sql("series", "sample_idx", "seed", s)
    n = lambda s: normal_sql("series", "sample_idx", "seed", s)
    spans = (("short_gap", "0.10::DOUBLE * f", "least(0.49::DOUBLE, 0.22::DOUBLE * f)"), ("long_gap", "greatest(0.51::DOUBLE, 0.58::DOUBLE * f)", "least(1.8::DOUBLE, 0.85::DOUBLE * f)"), ("jitter", "0.12::DOUBLE", "least(0.65::DOUBLE, 0.25::DOUBLE * f)"))
    sizes = ", ".join(f"CASE WHEN corruption IN ('{k}', 'mixed') THEN greatest(2, CAST(round_even(({a} + {d(i, 41)} * ({b} - ({a}))) * hz, 0) AS INTEGER)) ELSE 0 END AS l{i}" for i, (k, a, b) in enumerate(spans))
    ranks = ", ".join(f"{' + '.join(f'CASE WHEN {d(j, 43)} < {d(i, 43)} THEN 1 ELSE 0 END' for j in range(3) if j != i)} AS k{i}" for i in range(3))
    begins = ", ".join(f"first + floor(free * list_sort([{', '.join(d(j, 47) for j in range(3))}])[k{i} + 1]) + {' + '.join(f'CASE WHEN k{j} < k{i} THEN l{j} ELSE 0 END' for j in range(3) if j != i)} AS s{i}" for i in range(3))
    inside = lambda i: f"(sample_idx >= s{i} AND sample_idx < s{i} + l{i})"
    laplace = lambda s: f"(-sign({row(s)} - 0.5) * ln(1 - 2 * abs({row(s)} - 0.5)))"
    phase = f"((sample_idx - s2) / greatest(l2 - 1, 1)::DOUBLE * (1 + 1.5::DOUBLE * {d(0, 53)}) * 3.141592653589793::DOUBLE)"
    student = lambda s: f"({n(s)} / sqrt(({' + '.join(f'{n(s + 2 * k)} * {n(s + 2 * k)}' for k in (1, 2, 3))}) / 3))"
    return f"""{out}0 AS (SELECT *, count(*) OVER (PARTITION BY series) AS n, time_s - lag(time_s) OVER {OVER} AS dt, ['short_gap', 'long_gap', 'jitter', 'spike', 'mixed'][CAST(series % 5 + 1 AS INTEGER)] AS corruption,
  [1.0, 1.7, 2.5][CAST(series % 3 + 1 AS INTEGER)]::DOUBLE AS f, series % 10 AS seed, sqrt((x - lag(x) OVER {OVER}) * (x - lag(x) OVER {OVER}) + (y - lag(y) OVER {OVER}) * (y - lag(y) OVER {OVER})) AS step FROM {src}),
{out}1 AS (SELECT *, coalesce(1 / median(CASE WHEN dt > 0 THEN dt END) OVER (PARTITION BY series), {fallback}) AS hz, CASE WHEN coalesce(step >= quantile_cont(step, 0.85) OVER (PARTITION BY series), FALSE) THEN 'Movement' ELSE 'Stable' END AS reg0 FROM {out}0),
{out}2 AS (SELECT *, {sizes}, {ranks}, floor(0.08::DOUBLE * n) AS first, floor(0.92::DOUBLE * n) AS last FROM {out}1),
{out}3 AS (SELECT *, greatest(0, last - first - l0 - l1 - l2) AS free FROM {out}2),
{out}4 AS (SELECT *, {begins} FROM {out}3),
{out}5 AS (SELECT *, CASE WHEN {inside(1)} THEN 'LossLong' WHEN {inside(0)} THEN 'LossShort' END AS g FROM {out}4),
{out}6 AS (SELECT *, (g IS NULL AND x IS NOT NULL AND y IS NOT NULL) AS ok, CASE WHEN g IS NULL THEN x END AS x1, CASE WHEN g IS NULL THEN y END AS y1 FROM {out}5),
{out}7 AS (SELECT *, ({inside(2)} AND ok) AS j, (ok AND (sample_idx < n - 2 OR n <= 2) AND corruption IN ('spike', 'mixed')) AS may FROM {out}6),
{out}8 AS (SELECT *, CASE WHEN j THEN x1 + f * (4.5::DOUBLE * {laplace(59)} + 5.0::DOUBLE * sin({phase})) ELSE x1 END AS x2, CASE WHEN j THEN y1 + f * (4.5::DOUBLE * {laplace(61)} + 5.0::DOUBLE * cos({phase})) ELSE y1 END AS y2,
  CASE WHEN may AND row_number() OVER (PARTITION BY series, may ORDER BY {row(67)}, sample_idx) <= greatest(1, CAST(round_even(0.006::DOUBLE * n * f, 0) AS INTEGER)) THEN CASE WHEN {row(71)} < 0.5 THEN 1 WHEN {row(71)} < 0.85 THEN 2 ELSE 3 END ELSE 0 END AS w FROM {out}7),
{out}9 AS (SELECT *, (ok AND (w >= 1 OR coalesce(lag(w) OVER {OVER}, 0) >= 2 OR coalesce(lag(w, 2) OVER {OVER}, 0) >= 3)) AS p FROM {out}8),
{out} AS (SELECT series, sample_idx, time_s, corruption, CASE WHEN p THEN x2 + {student(73)} * 220.0::DOUBLE * f ELSE x2 END AS x, CASE WHEN p THEN y2 + {student(83)} * 160.0::DOUBLE * f ELSE y2 END AS y,
  CASE WHEN p OR j THEN 'Unstable' ELSE coalesce(g, reg0) END AS true_regime, CASE WHEN p THEN 'impulse' WHEN j THEN 'burst' ELSE '' END AS unstable_subtype FROM {out}9)"""


def metrics(src: str, width: float, height: float, out: str) -> str:
    """Expressions that end in {out}: one row per series and method. src: x, y, x_clean, y_clean, x_degraded, y_degraded, true_regime, method."""
    w = "(PARTITION BY series, method ORDER BY sample_idx)"
    d = lambda a, b, c, e: f"sqrt(({a} - {b}) * ({a} - {b}) + ({c} - {e}) * ({c} - {e}))"
    return f"""{out}1 AS (SELECT *, (x IS NOT NULL AND y IS NOT NULL) AS fo, (x_clean IS NOT NULL AND y_clean IS NOT NULL) AS fr, (x_degraded IS NOT NULL AND y_degraded IS NOT NULL) AS fd,
  lag(x) OVER {w} AS lx, lag(y) OVER {w} AS ly, lag(x_clean) OVER {w} AS lcx, lag(y_clean) OVER {w} AS lcy FROM {src}),
{out}2 AS (SELECT *, {d('x', 'x_clean', 'y', 'y_clean')} AS off, {d('x_degraded', 'x_clean', 'y_degraded', 'y_clean')} AS was, {d('x', 'lx', 'y', 'ly')} AS so, {d('x_clean', 'lcx', 'y_clean', 'lcy')} AS sc,
  (fo AND fr AND coalesce(lag(fo) OVER {w} AND lag(fr) OVER {w}, FALSE) AND true_regime = 'Movement') AS mv, (true_regime = 'Unstable' AND fr AND fd) AS bad FROM {out}1),
{out}3 AS (SELECT series, method, avg(CASE WHEN fo AND fr THEN off END) AS mae, sqrt(avg(CASE WHEN fo AND fr THEN off * off END)) AS rmse, avg(CASE WHEN fo THEN 1.0 ELSE 0.0 END) AS retention,
  avg(CASE WHEN true_regime = 'LossLong' THEN CASE WHEN fo THEN 1.0 ELSE 0.0 END END) AS long_hallucination, avg(CASE WHEN true_regime = 'LossShort' THEN CASE WHEN fo THEN 1.0 ELSE 0.0 END END) AS short_recovery,
  avg(CASE WHEN mv THEN so END) AS mo, avg(CASE WHEN mv THEN sc END) AS mc,
  avg(CASE WHEN true_regime = 'Stable' AND fr THEN CASE WHEN fo AND abs(x - x_clean) <= 1e-9 AND abs(y - y_clean) <= 1e-9 THEN 1.0 ELSE 0.0 END END) AS stable_preservation,
  avg(CASE WHEN bad THEN CASE WHEN fo THEN off ELSE was END END) AS eo, avg(CASE WHEN bad THEN was END) AS ei,
  avg(CASE WHEN fo THEN CASE WHEN x >= 0 AND x <= {width} AND y >= 0 AND y <= {height} THEN 1.0 ELSE 0.0 END END) AS plausibility_score FROM {out}2 GROUP BY series, method),
{out}4 AS (SELECT *, CASE WHEN ei > 1e-12 THEN 1 - eo / ei END AS unstable_repair_gain, CASE WHEN mc > 0 THEN 1 - abs(mo / mc - 1) END AS mp FROM {out}3),
{out} AS (SELECT *, CASE WHEN unstable_repair_gain < 0 THEN 0.0 WHEN unstable_repair_gain > 1 THEN 1.0 ELSE unstable_repair_gain END AS unstable_repair_score,
  CASE WHEN mp < 0 THEN 0.0 WHEN mp > 1 THEN 1.0 ELSE mp END AS movement_preservation FROM {out}4)"""


_u = lambda idx, s: draw_sql("number", idx, "20260728", s)
_step = lambda s: f"sum({normal_sql('number', 'sample_idx', '20260728', s)} * 0.06::DOUBLE) OVER (PARTITION BY number, spell ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_w = "(PARTITION BY number ORDER BY spell)"
#: Expressions that end in tr: a made-up trace for each supplier.
TRACES = f"""pe AS (SELECT CASE WHEN s_suppkey % 2 = 1 THEN 'ETDD70' ELSE 'Autism' END AS dataset, CAST(s_suppkey AS VARCHAR) AS participant_id, CAST(s_suppkey AS BIGINT) AS number, CASE WHEN s_suppkey % 2 = 1 THEN 250.0 ELSE 60.0 END::DOUBLE AS hz FROM supplier),
p1 AS (SELECT *, unnest(range(0, 22)) AS spell FROM pe),
p2 AS (SELECT *, greatest(4, CAST(floor((0.4::DOUBLE + 0.5::DOUBLE * {_u('spell', 101)}) * hz) AS BIGINT)) AS stay, greatest(3, CAST(floor(0.04::DOUBLE * hz) AS BIGINT)) AS go, 200 + 1000 * {_u('spell', 103)} AS x_to, 150 + 700 * {_u('spell', 107)} AS y_to FROM p1),
p3 AS (SELECT *, coalesce(sum(stay + go) OVER (PARTITION BY number ORDER BY spell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead, coalesce(lag(x_to) OVER {_w}, 600) AS x_at, coalesce(lag(y_to) OVER {_w}, 400) AS y_at FROM p2),
p4 AS (SELECT *, unnest(range(0, stay + go)) AS j FROM p3),
p5 AS (SELECT *, ahead + j AS sample_idx FROM p4 WHERE ahead + j < round_even(8.05::DOUBLE * hz, 0)),
tr AS (SELECT dataset, participant_id, sample_idx, sample_idx / hz AS time_s, {', '.join(f'CASE WHEN j < stay THEN {a}_at + {_step(s)} ELSE {a}_at + (j - stay + 1)::DOUBLE / (go + 1) * ({a}_to - {a}_at) END AS {a}' for a, s in (('x', 109), ('y', 113)))} FROM p5)"""


PARTS = ("1 - long_hallucination", "short_recovery", "movement_preservation", "stable_preservation", "unstable_repair_score")
AVAILABLE = "(" + " + ".join(f"coalesce({p}, 0)" for p in PARTS) + ") / nullif(" + " + ".join(f"CASE WHEN ({p}) IS NULL THEN 0 ELSE 1 END" for p in PARTS) + ", 0)"
STRICT = "(" + " + ".join(f"({p})" for p in PARTS) + ") / 5"
STATE_LIST = "[" + ", ".join(f"'{s}'" for s in STATES) + "]"
FINITE_LIST = "[" + ", ".join(str(s) for s in FINITE_STATES) + "]"
