"""Phrase collocation mining: word-id suffix arrays by prefix doubling for each shard, LCP intervals as counts, merged by key."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Words in the longest phrase; prefix doubling ranks suffixes by 1, 2 and 4 words.
LONGEST = 4
#: Bytes of text in a shard; a longer single text is a shard of its own.
SHARD_BYTES = 2 << 20
#: Phrases that are spelt out at once: a place for each of their bytes is held in 64 bits meanwhile.
SPELT = 1 << 15
#: Bits of the filter that tells which shorter phrases are frequent: it is broadcast, so its size is bounded; when it
#: fills up, more phrases are counted in vain and the result is the same.
FILTER_BITS = (12, 26)
#: Slices in which the best of a language are found before they meet.
SLICES = 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
STOP, BLANK = np.zeros(256, bool), np.zeros(256, bool)
STOP[[10, 11, 12, 13, 33, 44, 46, 58, 59, 63]] = True
BLANK[[9, 32]] = True
HASH = C.Rolling(41)


@dataclass
class Filter:
    """A Bloom filter with three probes."""

    words: np.ndarray
    bits: int

    @staticmethod
    def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
        most = np.uint64((1 << bits) - 1)
        return [(h >> np.uint64(s)) & most for s in (0, 19, 38)]

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in self.probes(h, self.bits):
            out &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out


def key_hash(lang: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    return C.mix(phrase + lang * np.uint64(0x9E3779B97F4A7C15))


def text_hashes(col: pa.Array) -> np.ndarray:
    data, begins = C.utf8(col)
    return HASH.of(HASH.sums(data), begins[:-1], begins[1:])


def make_filter(frequent: DataFrame) -> Filter:
    """The filter of the rows (lang, phrase): tasks set bits, 64 at a time are put together, so at most 2**20 numbers come to
    the driver whatever the number of rows."""
    low, high = FILTER_BITS
    bits = min(high, max(low, int(16 * frequent.count()).bit_length()))

    def places(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p = np.concatenate(Filter.probes(key_hash(text_hashes(b["lang"]), text_hashes(b["phrase"])), bits))
        yield pa.record_batch({"word": (p >> np.uint64(6)).astype(np.int64), "bit": (p & np.uint64(63)).astype(np.int32)})

    got = frequent.select("lang", "phrase").mapInArrow(C.per_batch(places), "word long, bit int")
    got = got.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return Filter(words, bits)


def gather(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings at buf[start:end]."""
    off = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=off[1:])
    at = np.arange(off[-1]) + np.repeat(start - off[:-1], end - start)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(off), pa.py_buffer(buf[at])).cast(pa.string())


def dense(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ranks, from 1, of the pairs (left, right); the order of pairs is kept."""
    pair = left * (int(right.max(initial=0)) + 1) + right
    order = np.argsort(pair, kind="stable")
    new = np.ones(len(pair), np.int64)
    new[1:] = pair[order][1:] != pair[order][:-1]
    out = np.empty(len(pair), np.int64)
    out[order] = np.cumsum(new)
    return out


def ahead(x: np.ndarray, k: int, there: np.ndarray) -> np.ndarray:
    """x k places further on, 0 where the piece ends before that."""
    out = np.zeros(len(x), x.dtype)
    out[: max(0, len(x) - k)] = x[k:]
    return np.where(there, out, 0)


def shard_counts(langs: pa.Array, raw: np.ndarray, off: np.ndarray, least: int, most: int, known: Filter | None) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n): how often phrases of `least` to `most` words come within pieces of the shard's texts. known has
    the frequent phrases of one word (most <= 2) or of two (most > 2): what holds any other is left out. With least = 1
    each language also has a row with an empty phrase, the number of its words."""
    low = LOWER[raw]
    stop, gap = STOP[low], STOP[low] | BLANK[low]
    begin, end = ~gap, ~gap
    begin[1:] &= gap[:-1]
    first = off[:-1][off[1:] > off[:-1]]
    begin[first] = ~gap[first]
    end[:-1] &= gap[1:]
    last = off[1:][off[1:] > off[:-1]] - 1
    end[last] = ~gap[last]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    w = len(s)
    if not w:
        return
    size = e - s
    doc = np.searchsorted(off, s, "right") - 1
    stops = np.cumsum(stop, dtype=np.int32)
    near = np.zeros(w, bool)  # the next word is in the same piece
    near[:-1] = (doc[1:] == doc[:-1]) & (stops[e[:-1] - 1] == stops[s[1:] - 1])
    # Words behind one another, a blank after each, so that a phrase is one stretch of buf.
    only = low[~gap]
    del stops, stop, gap, begin, end, low
    buf = np.full(len(only) + w, 32, np.uint8)
    buf[np.arange(len(only)) + np.repeat(np.arange(w), size)] = only
    at = np.cumsum(size + 1) - size - 1
    offs = np.zeros(w + 1, np.int64)
    np.cumsum(size, out=offs[1:])
    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), w, [None, pa.py_buffer(offs), pa.py_buffer(only)]).dictionary_encode().indices.to_numpy().astype(np.int64)
    lang = langs.dictionary_encode()
    of = lang.indices.to_numpy()[doc].astype(np.int64)
    one = dense(of, ids)  # word ids, apart for each language
    lang_hash = text_hashes(lang.dictionary)
    sums = HASH.sums(buf) if known is not None else None

    def frequent(rank: np.ndarray, n: int) -> np.ndarray:
        """Whether the n words from each place on are frequent, looked up once for each rank."""
        _, where, back = np.unique(rank, return_index=True, return_inverse=True)
        to = np.minimum(where + n - 1, w - 1)
        return known.has(key_hash(lang_hash[of[where]], HASH.of(sums, at[where], at[to] + size[to])))[back]

    if known is not None and most <= 2:
        fine = frequent(one, 1)
        near &= fine & np.append(fine[1:], False)
    two = dense(one, ahead(one, 1, near)) if most > 1 else one
    if known is not None and most > 2:
        near &= frequent(two, 2)
        two = dense(one, ahead(one, 1, near))
    # How many words, up to 4, the piece has from each word on.
    left = np.ones(w, np.int64)
    for k in range(1, most):
        through = np.zeros(w, bool)
        through[: max(0, w - k)] = near[k - 1 : w - 1]
        left += (left == k) & through
    del sums
    rank = two
    if most > 2:
        rank = dense(two, ahead(two, 2, left > 2))
    keep = np.flatnonzero(left >= least)
    suffixes = keep[np.argsort(rank[keep], kind="stable")]
    here, there = suffixes[1:], suffixes[:-1]
    both = np.minimum(left[here], left[there])
    same = lambda x, k: np.append(False, (both > k) & (x[np.minimum(here + k, w - 1)] == x[np.minimum(there + k, w - 1)]))
    lcp = np.zeros(len(suffixes), np.int64)
    for k in range(most):
        lcp += (lcp == k) & same(one, k)
    for n in range(least, most + 1):
        long = np.flatnonzero(left[suffixes] >= n)
        starts = np.flatnonzero(lcp[long] < n)  # each begins an interval whose suffixes share n words
        times = np.diff(np.append(starts, len(long)))
        for x in range(0, len(starts), SPELT):
            p = suffixes[long[starts[x : x + SPELT]]]
            yield pa.record_batch({"lang": lang.dictionary.take(pa.array(of[p])).cast(pa.string()), "phrase": gather(buf, at[p], at[p + n - 1] + size[p + n - 1]), "n": times[x : x + SPELT]})
    if least == 1:
        total = np.bincount(of, minlength=len(lang.dictionary))
        yield pa.record_batch({"lang": lang.dictionary.cast(pa.string()), "phrase": pa.array([""] * len(total)), "n": total})


def counts(docs: DataFrame, least: int, most: int, known: Filter | None, often: int) -> DataFrame:
    """(lang, phrase, f) of phrases that come `often` times or more in all shards, and of empty ones."""
    held = docs.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, begins = C.utf8(b["text"])
        for x, y in C.chunks(begins, SHARD_BYTES):
            yield from shard_counts(b["lang"].slice(x, y - x), data[begins[x] : begins[y]], begins[x : y + 1] - begins[x], least, most, held.value if held else None)

    got = docs.mapInArrow(C.per_batch(run), "lang string, phrase string, n long")
    got = got.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    return got.where((F.col("f") >= often) | (F.col("phrase") == ""))


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", often: int = 30) -> DataFrame:
    """(lang, phrase, words, f): all phrases of 1 to LONGEST words that come `often` times or more within pieces of texts,
    and for each language a row with an empty phrase, words 0 and the number of its words.

    Three passes over the texts: words, then pairs of frequent words, then longer phrases of frequent pairs, as no phrase
    comes more often than a part of it. Each shard of texts is ranked by a suffix array of its own; intervals of equal
    prefixes are its counts, and the shards' counts are added by key.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    one = C.stage_table(counts(rows, 1, 1, None, often), "words")
    two = C.stage_table(counts(rows, 2, 2, make_filter(one.where("phrase <> ''")), often), "pairs")
    more = counts(rows, 3, LONGEST, make_filter(two), often)
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return C.stage_table(one.union(two).union(more).select("lang", "phrase", words.alias("words"), "f"), "phrases")


def exact(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast("decimal(38,0)")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", often: int = 30, inside: int = 80, scale: int = 2_000_000, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to LONGEST words.

    A phrase that comes a >= `often` times is cut where scale * a / (l + r), rounded down, is least, the first such cut; l
    and r are how often its two parts come, n how many words the language has. A phrase within a longer one that comes
    `inside` percent as often or more is left out. Sums and products are decimals, so nothing overflows.

    Null and empty texts hold no words; a null language is `und`; repeated rows count each time; ties are broken by a, then
    by the phrase's bytes, so ranks are unique; a table without a frequent phrase gives no rows; other columns are ignored.
    A very long text is one shard of its own, ranked in one task; no word or phrase is left out for its length.
    """
    all_ = frequent_phrases(docs, text, lang, often)
    there = all_.where("words >= 2").withColumn("w", F.split("phrase", " "))
    part = lambda k, n: F.array_join(F.slice("w", k, n), " ")
    # Every shorter phrase within a longer one, with the most that a longer one comes.
    spans = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    within = there.where("words >= 3").select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = there.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (exact(100) * exact(F.col("longer")) < exact(inside) * exact(F.col("f"))))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "w", "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("_l"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("_r"))
    known = all_.where("words >= 1")
    for side in "lr":
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(f"_{side}"), F.col("f").alias(side)), ["lang", f"_{side}"])
    cuts = cuts.withColumn("score", F.expr(f"cast(cast({scale} as decimal(10,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as long)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    slice_ = F.pmod(F.xxhash64("phrase"), F.lit(SLICES))
    first = scored.withColumn("_s", slice_).withColumn("_p", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*best))).where(F.col("_p") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    total = all_.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
