"""Helpers that several operators share: tables in the shared folder, size-checked joins, text buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two longs that may be broadcast; beyond it the same join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Bytes of text that one vectorised step handles; a longer single text is handled alone.
CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only where none is set and Spark runs in this process alone."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="mendtrace-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


#: With it Spark removes a query's shuffle files as soon as the query ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage is cut, lost executors cost nothing, and what was shuffled for
    it is removed at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join; small is broadcast only if its counted rows are within BROADCAST_ROWS, else both sides are shuffled."""
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small.hint("shuffle_hash"), on, how)


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts behind one another, and the n + 1 places where they begin; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    begins = np.frombuffer(col.buffers()[1], "<i8", len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[begins[0] : begins[-1]], begins - begins[0]


def chunks(begins: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many bytes; each has one text at least."""
    a, n = 0, len(begins) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(begins, begins[a] + most, "right")) - 1)
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Hashes of any range of a buffer of bytes, or of 64-bit values, from sums of values times powers of an odd base modulo 2**64."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        self.table = r.integers(1, 2**64 - 1, 256, np.uint64)
        self.base = int(r.integers(1, 2**63, dtype=np.uint64)) | 1
        self.inverse = pow(self.base, -1, 2**64)
        self.powers = self.backs = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        while len(self.powers) <= n:
            k = len(self.powers)
            self.powers = np.concatenate([self.powers, self.powers * np.uint64(pow(self.base, k, 2**64))])
            self.backs = np.concatenate([self.backs, self.backs * np.uint64(pow(self.inverse, k, 2**64))])

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        terms = self.table[data] if data.dtype == np.uint8 else data.copy()
        terms *= self.powers[: len(data)]
        np.cumsum(terms, out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.backs[start] + (end - start).astype(np.uint64))


def per_batch(f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable:
    """For mapInArrow: f maps one batch to batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from f(b)

    return run


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of the graph with edges (a, b): rows (node, label), label being the smallest node.

    Alternating large-star and small-star steps; each is a pre-aggregated minimum and an equi-join, staged in the
    shared folder, until the edges no longer change. Nodes without an edge are absent.
    """
    e = stage_table(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        # Large: each u sends its larger neighbours to the least of its neighbours and itself; small: the not larger ones.
        both = e.union(e.select(F.col("v"), F.col("u")).toDF("u", "v")) if large else e
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        at = both.join(least, "u")
        if large:
            out = at.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = at.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was = mark(e)
    while True:
        e = stage_table(star(star(e, True), False), "edges")
        if (now := mark(e)) == was:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        was = now


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all runs of bytes without ASCII white space; no run goes beyond a text."""
    blank = SPACE[raw]
    start = ~blank
    start[1:] &= blank[:-1]
    first = off[:-1][off[:-1] < len(raw)]
    start[first] = ~blank[first]
    end = ~blank
    end[:-1] &= blank[1:]
    last = off[1:][off[1:] > off[:-1]] - 1
    end[last] = ~blank[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1
