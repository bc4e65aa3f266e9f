"""Tables in the folder that the cluster shares: they cut lineage, and lost executors cost nothing."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers that may be broadcast; beyond it the same join is shuffled.
BROADCAST_ROWS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and Spark runs in this process alone."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="mendtrace-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


#: With it Spark removes a query's shuffle files as soon as the query ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """For queries planned within; a DataFrame that ran once within must not run again."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read again; the files go when the driver ends, what was shuffled for them at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def with_small(big: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """big with small's columns, null keys being equal; small is staged, and broadcast only if its counted rows are few."""
    small = staged(small, "small").withColumnsRenamed({c: f"_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    right = F.broadcast(small) if small.count() <= BROADCAST_ROWS else small
    return big.join(right, same, "left").drop(*(f"_{c}" for c in on))
