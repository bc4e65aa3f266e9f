"""Language ID: blended-spectrum n-gram presence kernels, Nystroem landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Sampled training rows of a language at most, and of all (20 a language at least); landmarks, at least and for each language; cells that n-grams of 1 to
#: GRAMS bytes fall in.
FIT_PER_LANG, FIT_ROWS, LANDMARKS, LANDMARKS_PER_LANG, CELL_BITS, GRAMS = 600, 40_000, 96, 4, 13, 3
#: Texts that one step holds cells of.
STEP = 512
RIDGE = 1e-2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def steps(begins: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts with a bounded number of bytes and of rows."""
    for i, j in C.chunks(begins):
        yield from ((a, min(a + STEP, j)) for a in range(i, j, STEP))


def presence(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each text, which cells its n-grams fall in."""
    n = len(off) - 1
    out = np.zeros((n, 1 << CELL_BITS), bool)
    low = LOWER[raw].astype(np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(off))
    code = np.zeros(len(low), np.uint32)
    for k in range(1, GRAMS + 1):
        m = len(low) - k + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint32(8)) | low[k - 1 :]
        cell = ((code + np.uint32(k << 24)) * np.uint32(2654435761)) >> np.uint32(32 - CELL_BITS)
        inside = doc[:m] == doc[k - 1 :]
        out[doc[:m][inside], cell[inside]] = True
    return out


@dataclass
class Languages:
    names: list[str]
    marks: np.ndarray  # cells x landmarks, scaled to length one
    weights: np.ndarray  # landmarks x languages

    def __call__(self, p: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(p.sum(1), 1)).astype(np.float32)
        return ((p.astype(np.float32) @ self.marks) / size[:, None]) @ self.weights


def fit(bits: np.ndarray, lang: list[str]) -> Languages:
    """Landmarks are taken from the languages in turn; ridge regression on Nystroem features, targets +1 and -1. Rows of
    `bits` are packed and unpacked a step at a time."""
    names = sorted(set(lang))
    place = {x: k for k, x in enumerate(names)}
    y = np.array([place[x] for x in lang])
    turn = np.zeros(len(y), np.int64)
    for k in range(len(names)):
        turn[y == k] = np.arange((y == k).sum())
    chosen = np.lexsort((y, turn))[: max(LANDMARKS, LANDMARKS_PER_LANG * len(names))]

    def unit(rows: np.ndarray) -> np.ndarray:
        p = np.unpackbits(rows, axis=1).astype(float)
        return p / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1))

    marks = np.concatenate([unit(bits[chosen[i : i + STEP]]).astype(np.float32) for i in range(0, len(chosen), STEP)]).T
    value, vector = np.linalg.eigh(marks.T.astype(float) @ marks)
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    share = 1 / np.bincount(y)[y]
    left, right = RIDGE * np.eye(len(chosen)), np.zeros((len(chosen), len(names)))
    for i in range(0, len(y), STEP):
        z, part = unit(bits[i : i + STEP]) @ marks @ root, slice(i, i + STEP)
        left += z.T * share[part] @ z
        right += z.T * share[part] @ np.where(y[part, None] == np.arange(len(names)), 1.0, -1.0)
    return Languages(names, marks, (root @ np.linalg.solve(left, right)).astype(np.float32))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, held_out, lang_pred, score) for each row, with the columns `keep` carried along.

    Learns from at most FIT_PER_LANG rows of each language, or as many as make FIT_ROWS if there are many languages, 20 at
    least (documented bounds of the sample; those with the least hash of their key)
    among rows with a language whose crc32(key) modulo `folds` is not 0; no language is left out, and each has landmarks.
    Training rows come to the driver as bits of n-grams, one kilobyte each. Only the text enters a prediction.
    A null text or one without a letter is `und` with score 0; without any training row every text is. Null keys are
    predicted and not learnt from; repeated rows stay; other columns are ignored; no rows give none. All n-grams of very
    long texts count. Texts are not shuffled.
    """
    held = F.coalesce(F.crc32(F.col(key).cast("string")) % folds == 0, F.lit(False))
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held)
    # The draw below which a language's FIT_PER_LANG rows lie: from a histogram of draws, so few more rows are sorted.
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 20))
    bins = known.groupBy(F.col(lang).alias("of"), F.shiftright(draw, 4).alias("bin")).agg(F.count("*").alias("n"))
    bins = C.stage_table(bins, "bins")
    most = max(20, min(FIT_PER_LANG, FIT_ROWS // max(1, bins.select("of").distinct().count())))
    ahead = F.sum("n").over(Window.partitionBy("of").orderBy("bin")) - F.col("n")
    last = C.stage_table(bins.withColumn("ahead", ahead).where(F.col("ahead") < most).groupBy("of").agg(F.max("bin").alias("last")), "draws")

    def pack(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, begins = C.utf8(b.column(2))
        bits = [x.tobytes() for i, j in steps(begins) for x in np.packbits(presence(data[begins[i] : begins[j]], begins[i : j + 1] - begins[i]), axis=1)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.binary())], ["draw", "lang", "bits"])

    rows = C.join_small(known.withColumn("of", F.col(lang)).select("of", key, text, F.shiftright(draw, 4).alias("bin")), last, ["of"], "inner").where("bin <= last")
    place = F.row_number().over(Window.partitionBy("of").orderBy(F.xxhash64(key), key, F.xxhash64(text)))
    rows = rows.withColumn("place", place).where(F.col("place") <= most).select(F.xxhash64(key).alias("draw"), F.col("of").alias("lang"), F.col(text).alias("text"))
    rows = rows.mapInArrow(C.per_batch(pack), "draw long, lang string, bits binary").orderBy("draw", "lang", "bits").toPandas()
    model = fit(np.stack([np.frombuffer(x, np.uint8) for x in rows["bits"]]), list(rows["lang"])) if len(rows) else None

    def predict(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, begins = C.utf8(b.column(2))
        pred, score = [], []
        for i, j in steps(begins):
            raw, off = data[begins[i] : begins[j]], begins[i : j + 1] - begins[i]
            z = model(presence(raw, off)) if model else np.zeros((j - i, 1))
            plain = np.concatenate([[0], np.cumsum(LETTER[raw])])[off]
            best = z.argmax(1)
            for k in range(j - i):
                if model and (plain[k + 1] > plain[k] or re.search(r"[^\W\d_]", b.column(2)[i + k].as_py() or "")):
                    pred.append(model.names[best[k]])
                    score.append(float(np.clip((z[k, best[k]] + 1) / 2, 0, 1)))
                else:
                    pred.append("und")
                    score.append(0.0)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), *(b.column(3 + k) for k in range(len(keep)))], schema=None, names=["id", "held_out", "lang_pred", "score", *(f"keep{k}" for k in range(len(keep)))])

    src = docs.select(F.col(key).alias("id"), held.alias("held_out"), F.col(text).alias("text"), *(F.col(c).alias(f"keep{k}") for k, c in enumerate(keep)))
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (key, *keep)}
    more = "".join(f", keep{k} {kinds[c]}" for k, c in enumerate(keep))
    out = src.mapInArrow(C.per_batch(predict), f"id {kinds[key]}, held_out boolean, lang_pred string, score double{more}")
    return out.withColumnsRenamed({"id": key, **{f"keep{k}": c for k, c in enumerate(keep)}})


def op7(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
