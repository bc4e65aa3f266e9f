"""Nearest neighbours by multi-index hashing over learned rotated binary codes, reranked on the vectors themselves."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import ceil, comb, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Vectors that the rotation is fitted on, queries that the radius is fitted on: bounds of these samples.
FIT_ROWS, RADIUS_QUERIES = 8_192, 256
#: Share of true neighbours that the fitted radius must reach on the sampled queries.
REACHED = 0.97
#: Rows of one block of vectors and of one block of queries, about; bits of a bucket's prefix at most.
BLOCK, QUERY_BLOCK, PREFIX = 8_192, 32_768, 16
#: Bits of a substring.
SUB = 8
#: Queries of which one matrix product is made.
QUERY_STEP = 256
MASKS = np.arange(256)
POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def fit_rotation(x: np.ndarray, rounds: int = 20, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal axes, then the rotation that brings the projections nearest to their signs."""
    mean = x.mean(0)
    y = x - mean
    _, vectors = np.linalg.eigh(y.T @ y)
    bits = vectors.shape[1] - vectors.shape[1] % SUB or vectors.shape[1]
    axes = vectors[:, ::-1][:, :bits]
    v = y @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
        rotation = (u @ w).T
    return mean, axes @ rotation


def encode(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes: one byte per substring of SUB bits."""
    return np.packbits((x - mean) @ projection >= 0, axis=1)


@dataclass
class Tables:
    """How codes are dealt out: `m` substrings of `width` bits, of each of which the first `prefix` bits name a bucket.

    Two codes within the radius differ in at most reach[j] bits of some substring j, so in no more bits of its prefix.
    """

    m: int
    width: int
    prefix: int
    reach: list[int]

    @classmethod
    def of(cls, bits: int, rows: int, radius: int) -> Tables:
        """Buckets of about BLOCK rows, and as many substrings as let a query meet the fewest rows of evenly dealt codes."""
        want = min(PREFIX, max(0, ceil(log2(max(1, rows) / BLOCK))))
        best = None
        for m in (x for x in range(1, bits // SUB + 1) if (bits // SUB) % x == 0):
            near, extra = divmod(radius, m)
            reach = [near if j <= extra else near - 1 for j in range(m)]
            prefix = min(want, bits // m)
            met = sum(comb(prefix, i) for r in reach for i in range(min(r, prefix) + 1)) / 2**prefix
            if best is None or met < best[0]:
                best = met, cls(m, bits // m, prefix, reach)
        return best[1]

    def buckets(self, codes: np.ndarray) -> np.ndarray:
        """codes x substrings: numbers of the buckets."""
        b = np.unpackbits(codes, axis=1)
        weights = 1 << np.arange(self.prefix)[::-1]
        return np.column_stack([b[:, j * self.width : j * self.width + self.prefix] @ weights for j in range(self.m)]).astype(np.int64)

    def masks(self, j: int) -> np.ndarray:
        """What a bucket's number differs by from those of the buckets that a query visits."""
        every = np.arange(1 << self.prefix)
        return every[ones(every) <= self.reach[j]]

    def seen_before(self, j: int, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Which rows (of buckets) a query meets in a substring before j already."""
        out = np.zeros(len(rows), bool)
        for i in range(j):
            out |= ones(rows[:, i] ^ query[i]) <= self.reach[i]
        return out


def ones(x: np.ndarray) -> np.ndarray:
    return POP[x & 255] + POP[x >> 8]


class Index:
    """For each substring, rows grouped by its value; the rest of a code is compared only for rows that a probe finds."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.words = words(codes)
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.start = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code lies within the radius: in one of m substrings at most radius // m bits differ, and in
        all but the first radius % m + 1 of them one less will do. Lists that name a row more than once on the average
        (a radius of almost half the bits) are not read; each row is compared then, as it would be after them."""
        m = len(code)
        near, extra = divmod(radius, m)
        lists = []
        for j in range(m):
            r = near if j <= extra else near - 1
            if r >= 0:
                v = MASKS[POP <= r] ^ int(code[j])
                lists.append((j, self.start[j][v], self.start[j][v + 1]))
        rows = np.arange(len(self.codes))
        if sum(int((e - s).sum()) for _, s, e in lists) < len(rows):
            hit = np.zeros(len(rows), bool)
            for j, s, e in lists:
                for a, b in zip(s.tolist(), e.tolist(), strict=True):
                    hit[self.order[j][a:b]] = True
            rows = np.flatnonzero(hit)
        theirs = self.words if len(rows) == len(self.words) else self.words[rows]
        return rows[np.bitwise_count(theirs ^ words(code[None])).sum(1, dtype=np.int64) <= radius]


def words(codes: np.ndarray) -> np.ndarray:
    """Codes as numbers of 64 bits, zeros behind them."""
    out = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), np.uint8)
    out[:, : codes.shape[1]] = codes
    return out.view(np.uint64)


def exact_top(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, rows_of: Callable[[int], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) as places: of rows_of(query), the k with the largest inner product with the query, ties to
    smaller ids, without the query's id. Matrix products tell which rows can be among them, up to their rounding; the
    scores are sums of these rows' own products."""
    longest = np.sqrt((x * x).sum(1).max(initial=0.0))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for a in range(0, len(q), QUERY_STEP):
        rough = q[a : a + QUERY_STEP] @ x.T
        slack = 4 * x.shape[1] * np.finfo(np.float64).eps * longest * np.sqrt((q[a : a + QUERY_STEP] ** 2).sum(1))
        for i in range(a, min(a + QUERY_STEP, len(q))):
            rows = rows_of(i)
            rows = rows[ids[rows] != query_ids[i]]
            if len(rows) > k and np.isfinite(slack[i - a]):
                near = rough[i - a, rows]
                rows = rows[near >= np.partition(near, len(near) - k)[len(near) - k] - slack[i - a]]
            score = (x[rows] * q[i]).sum(1)
            best = np.lexsort((ids[rows], -score))[:k]
            best = best[score[best] > -np.inf]
            out.append((np.full(len(best), i), rows[best], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in col]) if len(col) else np.zeros((0, 0))


def search(vectors: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): for each row whose key is divisible by `every`, its k nearest other rows found.

    Nearness is the inner product in double precision. Rotation and radius are fitted on bounded samples; every row is
    indexed: rows are shuffled by (substring number, first bits of the substring), queries go to the buckets that the
    radius allows, and each bucket, or block of BLOCK rows of a larger one, is indexed by all its substrings; a row that
    an earlier substring finds is left out, and at most k rows per query and block leave. Tables.of() says how many
    substrings and bits a number of rows asks for: where the radius spans so many bits that buckets save nothing, as for
    uniform vectors, there is one table and every query visits every bucket. The radius is the one within which REACHED of the sampled queries' true neighbours lie; for
    queries with fewer than k rows within it (or than all others, if those are fewer than k), it is doubled until none is short.
    Vectors that are null, zero, or hold null or non-finite components take no part, and rows with a null key take none
    either. Vectors of different lengths have no inner product: each length is searched on its own. Repeated rows are
    candidates of their own; other columns are ignored; without vectors or queries there are no rows.
    """
    v = F.col("v")
    src = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    src = src.where(F.col("id").isNotNull() & v.isNotNull()).where(F.coalesce(sound, F.lit(False)))
    sizes = src.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()  # a row for each length
    parts = [_search(src.where(F.size("v") == r["d"]), r["n"], every, k) for r in sizes]
    if not parts:
        return src.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double").withColumnRenamed("id", key)
    return reduce(DataFrame.union, parts).withColumnRenamed("id", key)


def _search(src: DataFrame, n: int, every: int, k: int) -> DataFrame:
    """search() over n sound rows (id, v) of one length."""
    src = C.stage_table(src.withColumn("deal", F.xxhash64("id", "v")), "vectors")
    queries = src.where(F.col("id") % every == 0).groupBy("id").agg(F.min_by("v", "deal").alias("v"), F.min("deal").alias("deal"), F.count("*").alias("own"))
    mean, projection = fit_rotation(matrix(src.orderBy("deal", "id").limit(FIT_ROWS).toPandas()["v"]))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")

    # Radius: where the sampled queries' true neighbours lie, found in one pass, of which k rows per query and batch leave.
    sample = queries.orderBy("deal", "id").limit(RADIUS_QUERIES).toPandas()
    q_ids, q = sample["id"].to_numpy(np.int64), matrix(sample["v"])
    theirs = encode(q, mean, projection) if len(q) else None

    def nearest(batches):
        for b in batches:
            if not len(b):
                continue
            ids, x = b["id"].to_numpy(np.int64), matrix(b["v"])
            codes = encode(x, mean, projection)
            i, at, score = exact_top(ids, x, q_ids, q, k, lambda i: np.arange(len(ids)))
            bits = POP[codes[at] ^ theirs[i]].sum(1, dtype=np.int64)
            yield pd.DataFrame({"query_id": q_ids[i], "id": ids[at], "score": score, "bits": bits})

    radius = 0
    if len(q):
        true = src.select("id", "v").mapInPandas(nearest, "query_id long, id long, score double, bits long")
        true = true.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        radius = int(true.agg(F.percentile("bits", F.lit(REACHED))).first()[0] or 0)

    bits = -(-projection.shape[1] // SUB) * SUB

    def look(queries: DataFrame, radius: int) -> DataFrame:
        """(query_id, id, score, rank): the k best rows within the radius of each query, staged."""
        tables = Tables.of(bits, n, radius)

        def deal(masks: list[np.ndarray]):
            """Each row once for every substring and mask, under the numbers of its buckets."""

            def f(batches):
                for b in batches:
                    if len(b):
                        own = tables.buckets(encode(matrix(b["v"]), mean, projection))
                        for j, mask in enumerate(masks):
                            out = b.loc[b.index.repeat(len(mask))]
                            yield out.assign(j=np.int32(j), bucket=(own[:, j, None] ^ mask).ravel())

            return f

        def pair(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(asked):
                return pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
            j = int(rows["j"].iloc[0])
            ids, x = rows["id"].to_numpy(np.int64), matrix(rows["v"])
            query_ids, q = asked["id"].to_numpy(np.int64), matrix(asked["v"])
            index, codes = Index(encode(x, mean, projection)), encode(q, mean, projection)
            buckets, theirs = tables.buckets(index.codes), tables.buckets(codes)

            def found(i: int) -> np.ndarray:
                at = index.within(codes[i], radius)
                return at[~tables.seen_before(j, buckets[at], theirs[i])] if j else at

            i, at, score = exact_top(ids, x, query_ids, q, k, found)
            return pd.DataFrame({"query_id": query_ids[i], "id": ids[at], "score": score})

        schema = "id long, v array<double>, deal long, j int, bucket long"
        whole = [np.zeros(1, np.int64)] * tables.m
        left = src.select("id", "v", "deal").mapInPandas(deal(whole), schema)
        right = queries.select("id", "v", "deal").mapInPandas(deal([tables.masks(j) for j in range(tables.m)]), schema)
        # Buckets of more rows or queries than a block are split; there are few of these counts, and they are staged.
        n_rows = C.stage_table(left.groupBy("j", "bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "buckets")
        n_asked = C.stage_table(right.groupBy("j", "bucket").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("asks")), "asks")
        split = C.stage_table(n_rows.join(n_asked, ["j", "bucket"]), "splits")
        own = lambda n: F.pmod("deal", F.col(n))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = C.join_small(left, split, ["j", "bucket"], "inner").select("id", "v", "j", "bucket", own("blocks").alias("block"), each("asks").alias("ask"))
        right = C.join_small(right, split, ["j", "bucket"], "inner").select("id", "v", "j", "bucket", own("asks").alias("ask"), each("blocks").alias("block"))
        at = ("j", "bucket", "block", "ask")
        found = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(pair, "query_id long, id long, score double")
        return C.stage_table(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "found")

    # Queries with fewer rows than there are to find are searched again with a doubled radius, at last over all bits.
    found = look(queries, radius)
    while radius < bits:
        held = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("held"))
        few = queries.join(held, "id", "left").where(F.coalesce("held", F.lit(0)) < F.least(F.lit(k), F.lit(n) - F.col("own")))
        few = C.stage_table(few.select(*queries.columns), "few")
        if not few.limit(1).count():
            break
        radius = min(max(1, 2 * radius), bits)
        kept = found.join(few.select(F.col("id").alias("query_id")), "query_id", "left_anti")
        found = C.stage_table(kept.select(*found.columns).union(look(few, radius).select(*found.columns)), "found")
    return found.select("query_id", "rank", "id", "score")


def op10(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
