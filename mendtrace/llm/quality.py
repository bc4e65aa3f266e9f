"""Quality classifier: an additive model of boosted lookup tables, one per feature and one per chosen pair."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Labelled rows that the model is fitted on at most, taken in the order of a hash of their key.
FIT_ROWS = 20_000
BINS, ROUNDS, PAIRS, RATE = 32, 150, 6, 0.1
FEATURES = ("log_bytes", "letters", "capitals", "digits", "symbols", "blanks", "pipes", "marks", "word_bytes", "stops", "lines", "commas", "short_words", "new_words", "symbol_ends", "new_lines")
#: Byte classes: other, lower, capital, digit, blank, newline, full stop, comma, pipe, ! or ?, further symbols.
CLASS = np.zeros(256, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 1, 2, 3, 1
CLASS[[9, 11, 12, 13, 32]], CLASS[10], CLASS[46], CLASS[44], CLASS[124] = 4, 5, 6, 7, 8
CLASS[[33, 63]] = 9
CLASS[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 126]] = 10
HASH = C.Rolling(23)


def features(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text."""
    out = []
    for a, b in C.chunks(begins):
        off = begins[a : b + 1] - begins[a]
        raw = data[begins[a] : begins[b]]
        n = b - a
        size = np.diff(off)
        cls = CLASS[raw]
        c = np.bincount(np.repeat(np.arange(n), size) * 11 + cls, minlength=11 * n).reshape(n, 11).astype(float)
        s, e = C.word_bounds(raw, off)
        at = np.searchsorted(s, off)
        words = np.diff(at)
        doc = np.repeat(np.arange(n), words)
        sums = HASH.sums(raw)
        h = HASH.of(sums, s, e)
        line = np.flatnonzero(np.concatenate([raw == 10, [False]])) + 1
        starts = np.unique(np.concatenate([off[:-1][size > 0], line[line < len(raw)]])) if len(raw) else np.zeros(0, np.int64)
        ends = np.minimum(np.append(starts[1:], len(raw)), off[np.searchsorted(off, starts, "right")]) if len(starts) else starts
        lh, lat = HASH.of(sums, starts, ends), np.searchsorted(starts, off)
        new_words = np.array([len(np.unique(h[x:y])) for x, y in zip(at[:-1], at[1:], strict=True)], float)
        new_lines = np.array([len(np.unique(lh[x:y])) for x, y in zip(lat[:-1], lat[1:], strict=True)], float)
        short = np.bincount(doc, weights=(e - s <= 3), minlength=n)
        tail = np.bincount(doc, weights=cls[e - 1] >= 8, minlength=n) if len(e) else np.zeros(n)
        b1, w1, l1 = np.maximum(size, 1), np.maximum(words, 1), np.maximum(np.diff(lat), 1)
        letters = c[:, 1] + c[:, 2]
        out.append(
            np.column_stack([np.log1p(size), letters / b1, c[:, 2] / np.maximum(letters, 1), c[:, 3] / b1, c[:, 10] / b1, (c[:, 4] + c[:, 5]) / b1, c[:, 8] / w1, c[:, 9] / w1, letters / w1, c[:, 6] / w1, c[:, 5] / w1, c[:, 7] / w1, short / w1, new_words / w1, tail / w1, new_lines / l1])
        )
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over ordered bins: its step for each bin."""
    out = np.zeros(len(g))

    def gain(lo: int, hi: int) -> tuple[float, int]:
        cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        score = cg**2 / (ch + 1) + (cg[-1] - cg) ** 2 / (ch[-1] - ch + 1)
        k = int(np.argmax(score))
        return score[k] - cg[-1] ** 2 / (ch[-1] + 1), lo + k + 1

    def grow(lo: int, hi: int, depth: int) -> None:
        if depth and hi - lo > 1:
            better, cut = gain(lo, hi)
            if better > 1e-9 and lo < cut < hi:
                grow(lo, cut, depth - 1)
                grow(cut, hi, depth - 1)
                return
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1)

    grow(0, len(g), 2)
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut into four by one cut on each axis: its gain, and the step for each cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    score = np.zeros(g.shape)
    for pg, ph in ((cg, ch), (cg[:, -1:] - cg, ch[:, -1:] - ch), (cg[-1:] - cg, ch[-1:] - ch), (tg - cg[:, -1:] - cg[-1:] + cg, th - ch[:, -1:] - ch[-1:] + ch)):
        score = score + pg**2 / (ph + 1)
    i, j = np.unravel_index(int(np.argmax(score)), score.shape)
    out = np.zeros(g.shape)
    for x in (slice(0, i + 1), slice(i + 1, None)):
        for y in (slice(0, j + 1), slice(j + 1, None)):
            out[x, y] = g[x, y].sum() / (h[x, y].sum() + 1)
    return float(score[i, j] - tg**2 / (th + 1)), out


@dataclass
class Additive:
    """Lookup tables; a score is a sum of one entry of each."""

    cuts: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    single: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = self.base + sum(t[b[f]] for f, t in enumerate(self.single)) + sum((t[b[i], b[j]] for i, j, t in self.pairs), np.zeros(len(x)))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Boost feature after feature in turn, then the pairs whose cut into four explains most of what is left."""
    m = Additive()
    rate = min(max(y.mean() if len(y) else 0.5, 0.01), 0.99)
    m.base = float(np.log(rate / (1 - rate)))
    m.cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0) for f in range(len(FEATURES))]
    m.single = [np.zeros(len(c) + 1) for c in m.cuts]
    if len(np.unique(y)) < 2:
        return m
    b, z = m.bins(x), np.full(len(y), m.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, t in enumerate(m.single):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b[f], g, len(t)), np.bincount(b[f], h, len(t)))
            t += step
            z += step[b[f]]
    g, h = slopes()

    def grid(i: int, j: int, w: np.ndarray) -> np.ndarray:
        k, n = len(m.single[i]), len(m.single[j])
        return np.bincount(b[i] * n + b[j], w, k * n).reshape(k, n)

    ranked = sorted(((_quarters(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(len(FEATURES)) for j in range(i)), reverse=True)
    m.pairs = [(i, j, np.zeros((len(m.single[i]), len(m.single[j])))) for _, i, j in ranked[:PAIRS]]
    for _ in range(ROUNDS // 3):
        for i, j, t in m.pairs:
            g, h = slopes()
            step = RATE * _quarters(grid(i, j, g), grid(i, j, h))[1]
            t += step
            z += step[b[i], b[j]]
    return m


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(key, held_out, score, predicted) for each row of docs.

    The model learns from at most `fit_rows` labelled rows (a documented bound; those with the least hash of their key)
    whose crc32(key) modulo `folds` is not 0. Only the text enters a score. Null and empty texts have features of 0; a
    missing or one-valued label gives every row the base rate; several labels of a key count as their larger one; null
    keys are scored, not held out; repeated rows stay; other columns are ignored; no rows give none. Very long texts are
    measured whole. Texts are read once and not shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()

    def measure(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = features(*C.utf8(b.column(1)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.astype(np.float32).ravel()))
        yield pa.RecordBatch.from_arrays([b.column(0), lists], ["id", "x"])

    held = F.coalesce(F.crc32(F.col("id").cast("string")) % folds == 0, F.lit(False))
    rows = C.stage_table(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(C.per_batch(measure), f"id {kind}, x array<float>"), "features")
    known = labels.select(F.col(key).alias("id"), F.col(label).alias("y")).where("y is not null").groupBy("id").agg(F.max("y").alias("y"))
    # Labels are drawn first: those of the least hash that have a row, by ids alone; then only their rows' features are read.
    ids = docs.select(F.col(key).alias("id")).where(F.col("id").isNotNull() & ~held)
    drawn = ids.join(known.where("id is not null"), "id").orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    drawn = C.stage_table(drawn.distinct(), "drawn")
    known = rows.join(F.broadcast(drawn), "id").orderBy(F.xxhash64("id"), "id", "x").limit(fit_rows).select("x", "y").toPandas()
    model = fit(np.stack(known["x"]).astype(float) if len(known) else np.zeros((0, len(FEATURES))), known["y"].to_numpy(float))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                p = model(np.stack(b["x"]).astype(float))
                yield pd.DataFrame({"id": b["id"], "held_out": b["held_out"], "score": p, "predicted": (p >= threshold).astype(np.int32)})

    return rows.withColumn("held_out", held).mapInPandas(score, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", key)


def op6(spark, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
