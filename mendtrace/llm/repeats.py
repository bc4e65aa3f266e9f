"""Removal of repeated byte strings by bucket-pointer refinement over sampled suffixes.

Suffixes are sampled where content says so: in every window of LENGTH bytes the leftmost q-gram with the least hash is an
anchor, so equal windows have their anchor at the same offset. The hash of the q-gram is the anchor's first bucket. Buckets
are refined on what stands at later and earlier offsets: first on the whole context in which an anchor may serve, then,
for contexts that stand alone, on ranges of offsets, and at last on single offsets; each step reads the bucket before it and leaves out what that step has decided.

Passages of words that texts share, which can be shorter than LENGTH bytes, are only told of: anchors on the line of words
give the buckets, equal contexts settle most texts, and windows are compared for what these leave open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .collocations import Filter

#: Offsets that one refining range holds.
RANGE = 16
#: Words of a passage that the query tells of: over 50.
PASSAGE = 51
#: Window starts that one sliding minimum handles.
SEGMENT = 1 << 22
#: Bytes of text that one step scans; a longer single text is a step of its own.
STEP_BYTES = 1 << 18
GRAM, WHOLE, NAMES = C.Rolling(31), C.Rolling(37), C.Rolling(41)
#: Words of an anchor, bytes of text whose words one step takes, and the most bits (as a power of 2) that name open buckets.
WORD_GRAM, WORD_BYTES, FILTER_BITS = 8, 1 << 18, 26


def anchors(raw: np.ndarray, off: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """(anchor, first and last window start that it serves, hash of its q-gram, hash of its context), over all texts; raw are
    bytes, or 64-bit names of words."""
    w = length - q + 1
    n = len(raw) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = GRAM.sums(raw)
    valid = np.zeros(n, bool)
    fits = np.flatnonzero(np.diff(off) >= length)
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, off[fits], 1)
    np.add.at(step, off[fits + 1] - length + 1, -1)
    valid[:] = np.cumsum(step[:n]) > 0
    at = np.zeros(n, np.int64)
    low = np.uint64((1 << 24) - 1)
    for s in range(0, n, SEGMENT):
        e = min(s + SEGMENT, n)
        m = e - s + w - 1
        key = (sums[s + q : s + q + m] - sums[s : s + m]) * GRAM.backs[s : s + m]
        key = (C.mix(key) & ~low) | np.arange(m, dtype=np.uint64)
        full = np.full(-(-(m + 1) // w) * w, 2**64 - 1, np.uint64)
        full[:m] = key
        block = full.reshape(-1, w)
        left = np.minimum.accumulate(block, axis=1).ravel()
        right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        at[s:e] = (np.minimum(right[: e - s], left[w - 1 : w - 1 + e - s]) & low).astype(np.int64) + s
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    first[off[fits]] = True
    last = valid.copy()
    last[:-1] &= ~valid[1:] | first[1:]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    a = at[lo]
    whole = WHOLE.sums(raw)
    ctx = C.mix(WHOLE.of(whole, lo, hi + length) + (a - lo).astype(np.uint64))
    return a, lo, hi, GRAM.of(sums, a, a + q), ctx


def _scan(length: int, q: int):
    names = ["version", "more", "a", "lo", "hi", "qh", "ctx"]

    def f(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, begins = C.utf8(b.column(2))
        version, more = b.column(0), b.column(1)
        for i, j in C.chunks(begins, STEP_BYTES):
            off = begins[i : j + 1] - begins[i]
            a, lo, hi, qh, ctx = anchors(data[begins[i] : begins[j]], off, length, q)
            doc = np.searchsorted(off, lo, "right") - 1
            row = pa.array(doc + i)
            base = off[doc]
            yield pa.RecordBatch.from_arrays([version.take(row), more.take(row), *(pa.array((x - base).astype(np.int32)) for x in (a, lo, hi)), pa.array(qh.view(np.int64)), pa.array(ctx.view(np.int64))], names)

    return C.per_batch(f)


def _contexts(length: int):
    """Bytes around the wanted anchors, widened to whole ranges of offsets where the text allows."""

    def f(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            raw = (text or "").encode()
            for x in wanted:
                a, lo, hi = x["a"], x["lo"], x["hi"]
                begin = max(0, a - ((a - lo) // RANGE * RANGE + RANGE - 1))
                end = min(len(raw), a - (a - hi) // RANGE * RANGE + length)
                out.append((x["qh"], x["ctx"], a - begin, a - hi, a - lo, raw[begin:end]))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["qh", "ctx", "left", "d0", "d1", "bytes"])

    return C.per_batch(f)


def _ranges(length: int):
    """Per context and range of offsets: hashes of what all its windows share, and of all that they cover."""

    def f(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, begins = _raw(b.column("bytes"))
        sums = WHOLE.sums(data)
        d0, d1, left = (b.column(c).to_numpy().astype(np.int64) for c in ("d0", "d1", "left"))
        k0, k1 = d0 // RANGE, d1 // RANGE
        n = k1 - k0 + 1
        row = np.repeat(np.arange(len(n)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + k0[row]
        anchor = begins[row] + left[row]
        core = WHOLE.of(sums, anchor - RANGE * k, anchor - RANGE * k - RANGE + 1 + length)
        s, e = anchor - RANGE * k - RANGE + 1, anchor - RANGE * k + length
        there = (s >= begins[row]) & (e <= begins[row + 1])
        pos = WHOLE.of(sums, np.where(there, s, 0), np.where(there, e, 0))
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([b.column("qh").take(take), b.column("ctx").take(take), pa.array(k.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(pos.view(np.int64), mask=~there)], ["qh", "ctx", "k", "core", "pos"])

    return C.per_batch(f)


def _singles(length: int):
    """Per wanted range of a context: the hash of the window at each offset."""

    def f(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, begins = _raw(b.column("bytes"))
        sums = WHOLE.sums(data)
        d0, d1, left = (b.column(c).to_numpy().astype(np.int64) for c in ("d0", "d1", "left"))
        ks = [np.asarray(x, np.int64) for x in b.column("ks").to_pylist()]
        n = np.array([len(x) for x in ks])
        row = np.repeat(np.repeat(np.arange(len(n)), n), RANGE)
        d = (np.concatenate(ks)[:, None] * RANGE + np.arange(RANGE)).ravel()
        ok = (d >= d0[row]) & (d <= d1[row])
        row, d = row[ok], d[ok]
        s = begins[row] + left[row] - d
        key = WHOLE.of(sums, s, s + length)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([b.column("qh").take(take), b.column("ctx").take(take), pa.array(d.astype(np.int32)), pa.array(key.view(np.int64))], ["qh", "ctx", "d", "key"])

    return C.per_batch(f)


def _raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = col.cast(pa.large_binary())
    begins = np.frombuffer(col.buffers()[1], "<i8", len(col) + 1, col.offset * 8)
    return np.frombuffer(col.buffers()[2], np.uint8)[begins[0] : begins[-1]], begins - begins[0]


def _cut(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    n_bytes, removed, runs, kept, said = [], [], [], [], []
    for text, spans in zip(b.column(1).to_pylist(), b.column(2), strict=True):
        raw = (text or "").encode()
        merged: list[list[int]] = []
        if spans.is_valid:
            flat = spans.values.flatten()
            f, t = flat[0].to_numpy().astype(np.int64), flat[1].to_numpy().astype(np.int64)
            order = np.lexsort((t, f))
            for x, y in zip(f[order].tolist(), t[order].tolist(), strict=True):
                if merged and x <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], y)
                else:
                    merged.append([x, y])
        digest, at = hashlib.sha256(), 0
        for x, y in merged:
            digest.update(raw[at:x])
            at = y
        digest.update(raw[at:])
        n_bytes.append(len(raw))
        removed.append(sum(y - x for x, y in merged))
        runs.append(len(merged))
        kept.append(digest.hexdigest())
        said.append(",".join(f"{x}:{y}" for x, y in merged))
    yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (n_bytes, removed, runs)), pa.array(kept, pa.string()), pa.array(said, pa.string()), b.column(3)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "version"])


def repeat_spans(src: DataFrame, length: int = 400, q: int = 144) -> DataFrame:
    """(version, more, spans) for texts with repeated strings; src has version and more, which name a text, and text.

    Rows of one name are the same text; each row counts as an occurrence.
    """
    seen = C.stage_table(src.select("version", "more", "text").mapInArrow(_scan(length, q), "version long, more int, a int, lo int, hi int, qh long, ctx long"), "anchors")
    # Sums by bucket are staged, so that joins with them have an exchange of their own, of which Spark splits hot buckets.
    bucket = seen.groupBy("qh").agg(F.count("*").alias("n"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1")).where("n > 1")
    bucket = C.stage_table(bucket.select("qh", (F.col("c0") == F.col("c1")).alias("same")), "buckets")
    met = C.stage_table(C.join_small(seen, bucket, ["qh"], "inner"), "met")
    plain = met.where("same").select("version", "more", F.col("lo").alias("f"), (F.col("hi") + length).alias("t"))

    mixed = met.where("not same")
    ctxs = mixed.groupBy("qh", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("version", "more", "a", "lo", "hi")).alias("at"))
    ctxs = C.stage_table(ctxs.select("qh", "ctx", "n", "at.*"), "contexts")
    asked = ctxs.groupBy("version", "more").agg(F.collect_list(F.struct("qh", "ctx", "a", "lo", "hi")).alias("wanted"))
    texts = src.select("version", "more", "text").join(asked.hint("shuffle_hash"), ["version", "more"])
    around = C.stage_table(texts.select("text", "wanted").mapInArrow(_contexts(length), "qh long, ctx long, left int, d0 int, d1 int, bytes binary"), "around")

    # A bucket's contexts differ, so more than one of them meet where the least is not the greatest.
    ranges = C.stage_table(around.mapInArrow(_ranges(length), "qh long, ctx long, k int, core long, pos long"), "ranges")
    alone = F.coalesce("pos", "ctx")
    fine = ranges.groupBy("qh", "k", "core", alone.alias("p"), F.col("pos").isNull().alias("cut")).agg(F.min("ctx").alias("ctx"), F.max("ctx").alias("c1"))
    fine = C.stage_table(fine.withColumn("met", F.col("ctx") < F.col("c1")), "fine")
    core = fine.groupBy("qh", "k", "core").agg(F.min("ctx").alias("c0"), F.max("c1").alias("c1"), F.max(~F.col("met")).alias("open")).where("c0 < c1 and open").select("qh", "k", "core")
    wanted = fine.join(core, ["qh", "k", "core"]).groupBy("qh", "ctx").agg(F.collect_set("k").alias("ks"))
    windows = around.join(wanted, ["qh", "ctx"]).select("qh", "ctx", "left", "d0", "d1", "ks", "bytes")
    windows = C.stage_table(windows.mapInArrow(_singles(length), "qh long, ctx long, d int, key long"), "windows")
    twice = windows.groupBy("qh", "d", "key").agg(F.min("ctx").alias("c0"), F.max("ctx").alias("c1")).where("c0 < c1").select("qh", "d", "key")

    def span(f: Column, t: Column) -> Column:
        return F.struct(f.cast("int").alias("f"), t.cast("int").alias("t"))

    by_single = windows.join(twice, ["qh", "d", "key"]).select("qh", "ctx", span(-F.col("d"), length - F.col("d")).alias("s"))
    shared = fine.where("met and not cut").select("qh", "k", "core", F.col("p").alias("pos"))
    by_range = ranges.join(shared, ["qh", "k", "core", "pos"]).select("qh", "ctx", span(-RANGE * F.col("k") - RANGE + 1, length - RANGE * F.col("k")).alias("s"))
    by_ctx = ctxs.where("n > 1").select("qh", "ctx", span(F.col("lo") - F.col("a"), F.col("hi") - F.col("a") + length).alias("s"))
    told = C.stage_table(by_ctx.union(by_range).union(by_single).groupBy("qh", "ctx").agg(F.collect_set("s").alias("ss")), "told")
    # A range reaches beyond its context, where this occurrence may differ or end; windows there are another anchor's.
    refined = mixed.join(told, ["qh", "ctx"]).select("version", "more", "a", "lo", "hi", F.explode("ss").alias("s"))
    refined = refined.select("version", "more", F.greatest("lo", F.col("a") + F.col("s.f")).alias("f"), F.least(F.col("hi") + length, F.col("a") + F.col("s.t")).alias("t"))
    return plain.union(refined).groupBy("version", "more").agg(F.collect_set(span(F.col("f"), F.col("t"))).alias("spans"))


def _words(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A few texts at a time, from column 1: the first of them, their words' names, and how many words precede each text."""
    data, begins = C.utf8(b.column(1))
    for i, j in C.chunks(begins, WORD_BYTES):
        raw, off = data[begins[i] : begins[j]], begins[i : j + 1] - begins[i]
        s, e = C.word_bounds(raw, off)
        ends = np.zeros(len(s) + 1, np.int64)
        np.cumsum(e - s, out=ends[1:])
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(raw[~C.SPACE[raw]])]).dictionary_encode()
        each, at = C.utf8(found.dictionary)
        yield i, NAMES.of(NAMES.sums(each), at[:-1], at[1:])[found.indices.to_numpy()], np.searchsorted(s, off)


def _word_anchors(words: int):
    def f(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, line, off in _words(b):
            _, lo, _, qh, ctx = anchors(line, off, words, WORD_GRAM)
            doc = np.searchsorted(off, lo, "right") - 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc + i)), pa.array(lo == off[doc]), pa.array(qh.view(np.int64)), pa.array(ctx.view(np.int64))], ["version", "head", "qh", "ctx"])

    return C.per_batch(f)


def _word_windows(words: int, held):
    def f(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = held.value
        for i, line, off in _words(b):
            _, lo, hi, qh, _ = anchors(line, off, words, WORD_GRAM)
            want = known.has(qh)
            lo, n = lo[want], (hi - lo + 1)[want]
            start = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
            key = WHOLE.of(WHOLE.sums(line), start, start + words)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.searchsorted(off, start, "right") - 1 + i)), pa.array(key.view(np.int64))], ["version", "key"])

    return C.per_batch(f)


def _filter(rows: DataFrame) -> Filter:
    """A filter of bounded size for the staged hashes qh; where it is full, more passes and is compared in vain."""
    bits = min(FILTER_BITS, max(10, (16 * rows.count()).bit_length()))
    probe = F.explode(F.array(*(F.shiftrightunsigned("qh", k).bitwiseAND(F.lit((1 << bits) - 1)) for k in (0, 19, 38)))).alias("p")
    got = rows.select(probe).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return Filter(words, bits)


def passage_sharers(src: DataFrame, words: int) -> DataFrame:
    """(version) of the texts with a run of `words` words that stands in another text too; src has version and text.

    Words are runs without ASCII white space and are compared as they are, by 64-bit hashes. Rows of one name are the same
    text in several rows and so share all of it.
    """
    seen = C.stage_table(src.select("version", "text").mapInArrow(_word_anchors(words), "version long, head boolean, qh long, ctx long"), "word-anchors")
    ends = [F.min("version").alias("v0"), F.max("version").alias("v1")]
    ctxs = C.stage_table(seen.groupBy("qh", "ctx").agg(*ends), "word-contexts")
    same = C.stage_table(ctxs.where("v0 < v1").select("qh", "ctx"), "same-contexts")
    twins = seen.where("head").groupBy("version").agg(F.count("*").alias("n")).where("n > 1").select("version")
    first = C.stage_table(C.join_small(seen, same, ["qh", "ctx"], "left_semi").select("version").union(twins).distinct(), "sharers")
    # Texts without an equal context: their buckets that another text is in, with all texts' windows there.
    met = C.stage_table(ctxs.groupBy("qh").agg(F.min("v0").alias("v0"), F.max("v1").alias("v1")).where("v0 < v1").select("qh"), "met-buckets")
    left = C.join_small(ctxs.where("v0 = v1").select("qh", F.col("v0").alias("version")), met, ["qh"], "left_semi")
    left = C.stage_table(C.join_small(left, first, ["version"], "left_anti").select("qh").distinct(), "open-buckets")
    held = src.sparkSession.sparkContext.broadcast(_filter(left))
    windows = C.stage_table(src.select("version", "text").mapInArrow(_word_windows(words, held), "version long, key long"), "word-windows")
    both = C.stage_table(windows.groupBy("key").agg(*ends).where("v0 < v1").select("key"), "shared-windows")
    return C.stage_table(C.join_small(windows, both, ["key"], "left_semi").select("version").union(first).distinct(), "all-sharers")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, with_spans: bool = False, passage: int | None = None) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that starts anywhere else too; one row per input row.

    Returns (key, n_bytes, n_removed, n_spans, kept_sha256) and, if asked for, spans: the removed runs as start:end in
    bytes, joined by commas, and with passage the column shares_passage: 1 if a run of so many words of the text stands in
    another row's text too, else 0; nothing is removed for it. Strings never cross texts and are judged on the input;
    overlapping occurrences count. Null texts are empty; null keys stay; repeated rows repeat each other and so lose all
    that is long enough; other columns are ignored; no rows give none. Very long texts are judged whole. Hot buckets: counts are pre-aggregated, equal contexts are refined
    once, and no step lists pairs.
    """
    name = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).withColumn("version", F.xxhash64("text", "id")).withColumn("more", F.hash("id", "text"))
    spans = repeat_spans(name, length, q=max(1, length * 36 // 100))
    kind = docs.schema[key].dataType.simpleString()
    out = name.join(spans.hint("shuffle_hash"), ["version", "more"], "left").select("id", "text", "spans", "version")
    out = out.mapInArrow(C.per_batch(_cut), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string, version long").withColumnRenamed("id", key)
    if passage is not None:
        out = C.join_small(out, passage_sharers(name, passage).withColumn("told", F.lit(1)), ["version"], "left").withColumn("shares_passage", F.coalesce("told", F.lit(0))).drop("told")
    return out.drop("version") if with_spans else out.drop("version", "spans")


def op8(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_spans=True, passage=PASSAGE)
