"""Exact quantiles of long columns without a buffer of their values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .longseries import RANGE_ROWS, running_totals, with_sized

#: A sketch of this accuracy brackets each rank; the bracket reaches four times its error to both sides.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, values: Sequence[str], qs: Sequence[float], by: Sequence[str] = (), rows: int = RANGE_ROWS) -> DataFrame:
    """(by, name, quantiles): for each of `values` its exact, linearly interpolated quantiles qs over values that are not
    NULL. A group without any has no row.

    A sketch of fixed size brackets each rank. Values below the bracket are counted; only those inside it, less than a
    thousandth of the rows, are counted by value and put in order, by ranges of about `rows` values. A rank outside its
    bracket is an error, never a guess.
    """
    group = [*by, "name"]
    long = df.select(*by, *(F.col(v).cast("double").alias(v) for v in values)).unpivot(list(by), list(values), "name", "v").where("v is not null")
    reach = 4.0 / ACCURACY
    ends = [e for q in qs for e in (max(q - reach, 0.0), min(q + reach, 1.0))]
    sketch = long.groupBy(*group).agg(F.percentile_approx("v", F.array(*map(F.lit, ends)), F.lit(ACCURACY)).alias("_ends"), F.count("*").alias("_n"))
    near = with_sized(long, sketch, group, "_n", ["v"])
    # For each rank: one row for each value inside the bracket, one for all below and one for all above it.
    side = lambda k: F.when(F.col("v") < F.col("_ends")[2 * k], -1).when(F.col("v") > F.col("_ends")[2 * k + 1], 1).otherwise(0)
    placed = near.select(*group, "_n", "v", F.posexplode(F.array(*(side(k) for k in range(len(qs))))).alias("k", "_side"))
    counts = placed.groupBy(*group, "_n", "k", "_side", F.when(F.col("_side") == 0, F.col("v")).alias("_v")).agg(F.count("*").alias("_c"), F.min("v").alias("_least"), F.max("v").alias("_most"))
    counts = running_totals(counts, [*group, "k"], ["_side", "_v"], "_c", rows).withColumn("_to", F.col("_before") + F.col("_c"))
    counts = counts.withColumn("_rank", (F.col("_n") - 1) * F.element_at(F.array(*(F.lit(float(q)) for q in qs)), F.col("k") + 1))

    def at(rank: Column) -> Column:
        """The value at a rank: inside the bracket, or next to it."""
        here = (F.col("_to") - F.col("_c") <= rank) & (rank < F.col("_to"))
        told = F.when(F.col("_side") == 0, F.col("_v")).when((F.col("_side") < 0) & (rank == F.col("_to") - 1), F.col("_most")).when((F.col("_side") > 0) & (rank == F.col("_to") - F.col("_c")), F.col("_least"))
        return F.max(F.when(here, told))

    low, high = F.floor("_rank"), F.ceil("_rank")
    found = counts.groupBy(*group, "k", "_rank").agg(at(low).alias("_a"), at(high).alias("_b"))
    between = F.when(low == high, F.col("_a")).otherwise((high - F.col("_rank")) * F.col("_a") + (F.col("_rank") - low) * F.col("_b"))
    value = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")).otherwise(between)
    found = found.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("k", value.alias("v")))).alias("_all"))
    return found.select(*group, F.transform("_all", lambda s: s["v"]).alias("quantiles"))
