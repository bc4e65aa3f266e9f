"""Target-distribution importance resampling by bucket-partitioned inverted postings."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Buckets that words fall in; a bucket's totals are one row, so all gains are at most so many rows.
BUCKETS = 10_000
#: Bytes of text whose postings stand in one block; a longer single text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Blocks of one bucket that go to one task; a bucket with more is split.
SPLIT_BLOCKS = 4096

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

POSTINGS = "block long, bucket int, places array<int>, counts array<int>, n_features long, doc_id string"


def text_postings(raw: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text, count) of every bucket in every text, by bucket and text, and the words of each text."""
    low = LOWER[raw]
    inside = WORD[low]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    first = off[:-1][off[1:] > off[:-1]]
    begin[first] = inside[first]
    end[:-1] &= ~inside[1:]
    last = off[1:][off[1:] > off[:-1]] - 1
    end[last] = inside[last]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    doc = np.searchsorted(off, s, "right") - 1
    offs = np.zeros(len(s) + 1, np.int64)
    np.cumsum(e - s, out=offs[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(offs), pa.py_buffer(low[inside])]).dictionary_encode()
    of = np.fromiter((zlib.crc32(x.as_buffer()) % buckets for x in words.dictionary), np.int64, len(words.dictionary))
    n = len(off) - 1
    key, count = np.unique(of[words.indices.to_numpy()] * n + doc, return_counts=True)
    return key // max(n, 1), key % max(n, 1), count, np.bincount(doc, minlength=n)


def postings(docs: DataFrame, text: str, doc_id: str, buckets: int) -> DataFrame:
    """A row for each block and bucket: which texts of the block hold words of the bucket (`places`), and how many. A row
    with bucket NULL for each text: its place, its id, its words."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, begins = C.utf8(b["text"])
        for x, y in C.chunks(begins, BLOCK_BYTES):
            bucket, place, count, words = text_postings(data[begins[x] : begins[y]], begins[x : y + 1] - begins[x], buckets)
            block, m = b["row"][x].as_py(), y - x  # the block is named by its first row
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
            cut = pa.array(np.append(starts, len(bucket)), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pa.array(v, pa.int32())) for v in (place, count)]
            k = len(starts)
            yield pa.record_batch({"block": pa.array([block] * k, pa.int64()), "bucket": pa.array(bucket[starts], pa.int32()), "places": lists[0], "counts": lists[1], "n_features": pa.nulls(k, pa.int64()), "doc_id": pa.nulls(k, pa.string())})
            own = pa.ListArray.from_arrays(pa.array(np.arange(m + 1), pa.int32()), pa.array(np.arange(m), pa.int32()))
            yield pa.record_batch({"block": pa.array([block] * m, pa.int64()), "bucket": pa.nulls(m, pa.int32()), "places": own, "counts": pa.nulls(m, pa.list_(pa.int32())), "n_features": pa.array(words, pa.int64()), "doc_id": b["doc_id"].slice(x, m)})

    return rows.mapInArrow(C.per_batch(run), POSTINGS)


def total(counts: str) -> Column:
    return F.sum(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for each bucket of the source: both corpora's totals meet by bucket, one row each."""
    s = C.stage_table(source.where("bucket is not null").groupBy("bucket").agg(total("counts").alias("s")), "source-totals")
    t = C.stage_table(target.where("bucket is not null").groupBy("bucket").agg(total("counts").alias("t")), "target-totals")
    all_s, all_t = (df.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0] for df, c in ((s, "s"), (t, "t")))
    d = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    ratio = (d("t") + 1) * float(all_s + buckets) / ((d("s") + 1) * float(all_t + buckets))
    met = s.join(t, "bucket", "left")
    return met.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(row, doc_id as text, n_features, weight) for each document; row is a number of its own."""
    source = C.stage_table(postings(docs, text, doc_id, buckets), "postings")
    other = C.stage_table(postings(target, target_text, target_text, buckets).drop("doc_id"), "target-postings")
    gain = gains(source, other, buckets)
    # Postings go to their buckets. A bucket's blocks are dealt over as many parts as keep each within SPLIT_BLOCKS.
    texts = source.where("bucket is null").select("block", F.col("places")[0].alias("place"), "doc_id", "n_features")
    parts = -(-texts.where("place = 0").count() // SPLIT_BLOCKS) or 1
    gain = gain.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    lists = source.where("bucket is not null").select("block", "bucket", "places", "counts", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"))
    met = lists.join(gain.hint("shuffle_hash"), ["bucket", "part"])
    shares = met.select("block", "gain", F.inline(F.arrays_zip("places", "counts")).alias("place", "n"))
    shares = shares.groupBy("block", "place").agg(F.sum(F.col("n") * F.col("gain")).alias("weight"))
    rows = texts.join(shares, ["block", "place"], "left")
    return rows.select((F.col("block") + F.col("place")).alias("row"), "doc_id", "n_features", F.coalesce("weight", F.lit(0)).alias("weight"))


def first_ranks(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """df's first `most` rows with their rank from 1: sorted by ranges, then numbered within each range behind those before it."""
    cut = C.stage_table(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_n"))  # as many rows as ranges
    begins = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).where(F.col("_before") < most)
    near = cut.join(F.broadcast(begins.select("_part", "_before")), "_part")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return near.withColumn("rank", rank).where(F.col("rank") <= most).drop("_part", "_before")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", buckets: int = BUCKETS, share: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each document: `share` percent of the documents with `least_words` words
    or more are drawn so that their words follow the target's; rank is NULL for others.

    A bucket's gain is 1000 times the log ratio of its shares in the target and in all documents, rounded down; a document's
    weight is the sum over its words; the score adds a Gumbel draw from a hash of seed and doc_id. The highest scores are
    drawn, ties to the smaller doc_id (null last).

    Null or empty texts have no words, weight 0 and a score; a null doc_id is hashed as an empty one; rows with one doc_id
    are judged one by one; an empty target gives gains from smoothing alone; no documents give no rows; other columns are
    ignored. A very long text is a block of its own; all its words count.
    """
    found = weights(docs, target, text, doc_id, target_text, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("doc_id", F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    found = found.select("row", F.col("doc_id").cast(docs.schema[doc_id].dataType), "n_features", "weight", (F.col("weight") + gumbel).cast("long").alias("score"))
    found = C.stage_table(found, "scores")
    may = found.where(F.col("n_features") >= least_words)
    most = share * may.count() // 100
    drawn = first_ranks(may.select("row", "doc_id", "score"), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], most)
    out = found.join(drawn.select("row", F.col("rank").cast("long")), "row", "left")
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
