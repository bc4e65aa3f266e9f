"""Bootstraps by counts of draws give what drawing row by row gives, in one block of units and in several."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendtrace.functions.core import draw, draw_values
from mendtrace.operators import aggregate as A

SEED, REPS = 20260728, 40


def rows():
    """Two strata of 10 and 7 units and one of a single unit; values that are missing; a unit without method b; a row twice."""
    out = []
    for s, n in (("p", 10), ("q", 7), ("r", 1)):
        for u in range(n):
            for k, m in enumerate("ab"):
                if (s, u, m) == ("q", 3, "b"):
                    continue
                out.append((s, f"u{u:02d}", m, None if (u + k) % 4 == 0 else math.sin(u * 3.1 + k), float(u * u + k)))
    return [*out, out[0], (None, "u00", "a", 1.0, 1.0), ("p", None, "a", 1.0, 1.0)]


def mean(xs):
    xs = [x for x in xs if x is not None]
    return sum(xs) / len(xs) if xs else None


def plain(table, block, methods):
    """{(method, replicate): [means]}: every slot draws its block, then its unit."""
    one = lambda r, i, stream: float(draw_values(np.array([r]), np.array([i]), SEED, stream)[0])
    strata = defaultdict(lambda: defaultdict(list))
    for s, u, m, x, y in table:
        if s is not None and u is not None:
            strata[s][u].append((m, x, y))
    out = {}
    for r in range(REPS):
        drawn = defaultdict(list)
        for s, units in strata.items():
            names, n = sorted(units), len(units)
            got = defaultdict(int)
            for i in range(n):
                got[math.floor(one(r, i, 8) * n) // block if n > block else 0] += 1
            for b, slots in got.items():
                size = min(block, n - b * block)
                for k in range(slots):
                    for m, x, y in units[names[b * block + math.floor(one(r, b * block + k, 7) * size)]]:
                        drawn[m, s].append((x, y))
        for m in methods:
            by = [drawn[m, s] for s in strata if drawn[m, s]]
            out[m, r] = [mean([mean([v[c] for v in vs]) for vs in by]) for c in (0, 1)]
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows(), "dataset string, participant_id string, method string, x double, y double")


@pytest.mark.parametrize("block", [1, 3, 7, 4096])
def test_resampled_means(frame, block):
    got = {(r.method, r.replicate): [r.x, r.y] for r in A.resampled_means(frame, ("x", "y"), REPS, SEED, ("method",), block=block).collect()}
    want = plain(rows(), block, "ab")
    assert set(got) == {k for k, v in want.items() if v != [None, None]}
    for k, v in got.items():
        assert v == pytest.approx(want[k], rel=1e-12, nan_ok=True)


def test_draws_are_uniform_over_blocks(frame):
    """Over many replicates the mean of a stratum of several blocks is that of the stratum."""
    p = frame.where("dataset = 'p' and method = 'a'").dropDuplicates()
    got = A.resampled_means(p, ("y",), 4000, SEED, block=4).agg(F.avg("y"), F.stddev_pop("y")).first()
    y = np.array([u * u for u in range(10)], float)
    assert got[0] == pytest.approx(y.mean(), abs=4 * y.std() / math.sqrt(10 * 4000)) and got[1] == pytest.approx(y.std() / math.sqrt(10), rel=0.05)


def test_intervals(frame):
    once = frame.dropDuplicates()
    drawn = A.resampled_means(once, ("y",), 200, SEED, ("method",), block=3)
    want = {r.method: np.percentile(r.v, [2.5, 97.5]) for r in drawn.groupBy("method").agg(F.collect_list("y").alias("v")).collect()}
    got = {r.method: r for r in A.hierarchical_bootstrap(once, ("y",), 200, SEED, block=3).collect()}
    assert got.keys() == want.keys() == {"a", "b"}
    for m, r in got.items():
        assert [r.ci_low, r.ci_high] == pytest.approx(list(want[m]))
    pair = A.paired_bootstrap(once, "b", "a", 50, SEED, ("y", "x"), block=3).collect()
    assert {r.metric: r.difference for r in pair}["y"] == pytest.approx(1.0)
    assert all(r.ci_low <= r.ci_high for r in pair)


def test_nothing(frame):
    assert A.resampled_means(frame.where("false"), ("x",), 10, SEED, ("method",)).count() == 0


def test_draws_alike(spark):
    df = spark.range(2000).select(draw(F.col("id") * 977, F.col("id"), SEED, 7).alias("u")).toPandas()["u"].to_numpy()
    assert np.array_equal(df, draw_values(np.arange(2000) * 977, np.arange(2000), SEED, 7))
