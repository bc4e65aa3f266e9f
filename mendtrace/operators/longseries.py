"""Frames, runs and order statistics of series of any length: no task holds more than a slice of a series.

Series are cut into slices of `rows` numbers of their index, which must count 0, 1, 2 ... without holes (number_rows() gives
such an index). Fixed frames see a halo of the neighbouring slices' rows; what reaches further (runs, the nearest value on
either side) is carried over a table of one row for each slice; ranks come from ranges of values and the ranges' sizes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import IDX, KEY
from ..sources.staging import BROADCAST_ROWS, staged, with_small

#: Rows of a range of values, if nothing else is told.
RANGE_ROWS = 1_000_000


def sliced(df: DataFrame, rows: int, idx: str = IDX) -> DataFrame:
    return df.withColumn("_slice", F.floor(F.col(idx) / rows).cast("long"))


def with_halo(df: DataFrame, reach: int, rows: int, idx: str = IDX) -> DataFrame:
    """Each row in its own slice and, with `_own` false, in every other slice within `reach` rows of it."""
    at = lambda shift: F.floor((F.col(idx) + shift) / rows).cast("long")
    near = F.sequence(F.greatest(at(-reach), F.lit(0).cast("long")), at(reach))
    return df.withColumn("_slice", F.explode(near)).withColumn("_own", F.col("_slice") == at(0))


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_slice")


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence[str], weight: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Add `_before`, the sum of `weight` over the rows of the same group that come earlier in `order`, and `_total`, the
    group's sum. `by` and `order` together must name a row. Rows are dealt to ranges of about `rows` rows; the ranges' sums
    are added up first, then those within each range, so a group may be of any size. No rows give no rows."""
    df = staged(df, "unordered")
    parts = max(1, -(-df.count() // rows))
    cut = staged(df.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    group = Window.partitionBy(*by)
    ends = cut.groupBy(*by, "_part").agg(F.sum(weight).alias("_w"))
    ahead = F.sum("_w").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumns({"_ahead": F.coalesce(ahead, F.lit(0)), "_total": F.sum("_w").over(group)}).drop("_w")
    inside = F.sum(weight).over(Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return with_small(cut, ends, [*by, "_part"]).withColumn("_before", F.coalesce(inside, F.lit(0)) + F.col("_ahead")).drop("_ahead", "_part")


def number_rows(df: DataFrame, order: Sequence[str], out: str = IDX, key: Sequence[str] = KEY, rows: int = RANGE_ROWS) -> DataFrame:
    """Add `out`: each row's place in its series, from 0. Rows alike in all of `order` take either place."""
    df = df.withColumns({"_one": F.lit(1), "_tie": F.monotonically_increasing_id()})
    return running_totals(df, key, [*order, "_tie"], "_one", rows).withColumnRenamed("_before", out).drop("_one", "_tie", "_total")


def with_sized(big: DataFrame, groups: DataFrame, on: Sequence[str], size: str, spread: Sequence[str]) -> DataFrame:
    """big with the columns of its group, null keys being equal; `size` counts the rows of big that a group meets.

    Groups are broadcast within a counted bound. Beyond it those that meet most rows are broadcast, as many as the bound
    allows, and their rows, which need no other partner, are spread over all tasks by a hash of `spread`."""
    groups = staged(groups, "groups")
    limits = [10**k for k in range(3, 16)]
    n, *over = groups.agg(F.count("*"), *(F.count(F.when(F.col(size) > m, 1)) for m in limits)).first()
    cols = [c for c in groups.columns if c not in on]

    def joined(left: DataFrame, right: DataFrame, out: str, by: Sequence[str]) -> DataFrame:
        right = right.select(*(F.col(c).alias(f"_{c}") for c in by), F.struct(*cols).alias(out))
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
        return left.join(right, same, "left").drop(*(f"_{c}" for c in by))

    limit = 0 if n <= BROADCAST_ROWS else next(m for m, k in zip(limits, over, strict=True) if k <= BROADCAST_ROWS)
    big = joined(big, F.broadcast(groups.where(F.col(size) > limit)), "_group", on)
    if limit:
        rest = groups.where(F.col(size) <= limit).withColumn("salt", F.lit(0).cast("long"))
        big = big.withColumn("salt", F.when(F.col("_group").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*spread), F.lit(4096))))
        big = joined(big, rest, "_rest", [*on, "salt"]).withColumn("_group", F.coalesce("_group", "_rest")).drop("_rest", "salt")
    return big.withColumns({c: F.col(f"_group.{c}") for c in cols}).drop("_group")


def run_lengths(df: DataFrame, flag: str, out: str, rows: int, key: Sequence[str] = KEY, idx: str = IDX) -> DataFrame:
    """Add `out`: on each row of a run of true flags the run's length, else 0. Runs are counted within slices; a run that
    reaches its slice's edge goes on with what the slices beside it say, over any number of slices."""
    on = F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    df = sliced(df.withColumn("_on", on), rows, idx)
    piece = [*key, "_slice"]
    order = Window.partitionBy(*piece).orderBy(idx)
    df = df.withColumn("_island", F.row_number().over(order) - F.row_number().over(Window.partitionBy(*piece, "_on").orderBy(idx)))
    df = df.withColumn("_len", F.when(F.col("_on"), F.count(F.lit(1)).over(Window.partitionBy(*piece, "_on", "_island"))).otherwise(0))
    df = staged(df.drop("_island"), "runs")
    ends = df.groupBy(*piece).agg(F.count("*").alias("_n"), F.min_by("_len", idx).alias("_head"), F.max_by("_len", idx).alias("_tail"))

    def carried(edge: str, forth: bool) -> Column:
        """The length of the run that ends where the slice begins, or begins where it ends: the nearest slice that is not
        one run gives its edge, those between give all their rows."""
        side = F.col("_slice").asc() if forth else F.col("_slice").desc()
        return F.coalesce(F.lag(f"_sum{edge}").over(Window.partitionBy(*key).orderBy(side)), F.lit(0))

    whole = (F.col("_head") == F.col("_n")) & (F.col("_tail") == F.col("_n"))
    for edge, forth in (("_tail", True), ("_head", False)):
        side = F.col("_slice").asc() if forth else F.col("_slice").desc()
        w = Window.partitionBy(*key).orderBy(side).rowsBetween(Window.unboundedPreceding, 0)
        ends = ends.withColumn("_stretch", F.sum((~whole).cast("int")).over(w))
        ends = ends.withColumn(f"_sum{edge}", F.sum(F.when(whole, F.col("_n")).otherwise(F.col(edge))).over(Window.partitionBy(*key, "_stretch").orderBy(side).rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumns({"_from": carried("_tail", True), "_on_to": carried("_head", False)}).select(*piece, "_n", "_head", "_tail", "_from", "_on_to")
    df = with_small(df, ends, piece)
    place = F.col(idx) - F.col("_slice") * rows
    size = F.col("_len") + F.when(place < F.col("_head"), F.col("_from")).otherwise(0) + F.when(place >= F.col("_n") - F.col("_tail"), F.col("_on_to")).otherwise(0)
    return df.withColumn(out, F.when(F.col("_on"), size).otherwise(0).cast("int")).drop("_on", "_len", "_slice", "_n", "_head", "_tail", "_from", "_on_to")


def nearest(df: DataFrame, values: Sequence[str], rows: int, key: Sequence[str] = KEY, idx: str = IDX) -> DataFrame:
    """Add `_slice` and for each value v what its slice is entered with: `_prev_v` and `_next_v`, the last value (v, place)
    that is not NULL in slices before and the first in slices after."""
    df = sliced(df, rows, idx)
    piece = [*key, "_slice"]
    pair = lambda v: F.when(F.col(v).isNotNull(), F.struct(F.col(v).alias("v"), F.col(idx).alias("place")))
    at = lambda v: F.when(F.col(v).isNotNull(), F.col(idx))
    ends = df.groupBy(*piece).agg(*(f(pair(v), at(v)).alias(f"{side}{v}") for v in values for side, f in (("_last_", F.max_by), ("_first_", F.min_by))))
    before = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*key).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = [c for v in values for c in (F.last(f"_last_{v}", True).over(before).alias(f"_prev_{v}"), F.last(f"_first_{v}", True).over(after).alias(f"_next_{v}"))]
    return with_small(df, ends.select(*piece, *carried), piece)


def average_ranks(df: DataFrame, values: dict[str, str], key: Sequence[str] = KEY, idx: str = IDX, rows: int = RANGE_ROWS) -> DataFrame:
    """Add for each (column: its output) the share of the average rank among the series' values; 0.5 where there is none.

    Values are counted first, so ties are one row each and never meet across ranges; ranks are running totals of the counts."""
    df = staged(df, "ranked")
    long = df.select(*key, idx, *(F.col(v).cast("double").alias(v) for v in values)).unpivot([*key, idx], list(values), "_name", "_v").where("_v is not null")
    counts = long.groupBy(*key, "_name", "_v").agg(F.count("*").alias("_c"))
    totals = running_totals(counts, [*key, "_name"], ["_v"], "_c", rows)
    shares = totals.select(*key, "_name", "_v", "_c", ((F.col("_before") + 1 + (F.col("_c") - 1) / 2) / F.col("_total")).alias("_share"))
    told = with_sized(long, shares, [*key, "_name", "_v"], "_c", [*key, idx])
    told = told.groupBy(*key, idx).agg(*(F.max(F.when(F.col("_name") == v, F.col("_share"))).alias(out) for v, out in values.items()))
    told = told.select(*(F.col(c).alias(f"_k_{c}") for c in (*key, idx)), *values.values())
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*key, idx)))
    out = df.join(told, same, "left").drop(*(f"_k_{c}" for c in (*key, idx)))
    return out.withColumns({o: F.coalesce(o, F.lit(0.5)) for o in values.values()})
