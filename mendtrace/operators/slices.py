"""Viterbi decoding of long runs in slices: each slice is a transfer matrix, a scan over slices joins them, and each slice's
path follows from what enters it and where it ends. A task holds slices of a bounded number of rows, never a run."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.core import IDX, KEY
from ..sources.staging import staged, with_small


def forward(scores: np.ndarray, begins: np.ndarray, sizes: np.ndarray, change: np.ndarray, start: np.ndarray | float, follows: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(back pointers of each row, best scores at each piece's end). A piece that follows goes on from the best scores
    `enter` of the row before it, and its first row's pointers name states of that row; others begin with `start`."""
    order = np.argsort(-sizes, kind="stable")
    at, size = begins[order], sizes[order]
    back = np.zeros(scores.shape, np.int8)
    best = scores[at] + start
    go = np.flatnonzero(follows[order])
    if len(go):
        through = enter[order[go]][:, :, None] + change
        back[at[go]] = through.argmax(1)
        best[go] = scores[at[go]] + through.max(1)
    for i in range(1, int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -i, "left"))
        through = best[:m, :, None] + change
        back[at[:m] + i] = from_ = through.argmax(1)
        best[:m] = scores[at[:m] + i] + np.take_along_axis(through, from_[:, None, :], 1)[:, 0]
    out = np.empty_like(best)
    out[order] = best
    return back, out


def trace(back: np.ndarray, begins: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(path of all pieces' rows, state of the row before each piece), from the states at the pieces' ends."""
    order = np.argsort(-sizes, kind="stable")
    first, size, at = begins[order], sizes[order], ends[order].copy()
    path = np.zeros(len(back), np.int64)
    path[first + size - 1] = at
    for i in range(int(size[0]) - 1 if len(size) else 0, 0, -1):
        m = int(np.searchsorted(-size, -i, "left"))
        at[:m] = back[first[:m] + i, at[:m]]
        path[first[:m] + i - 1] = at[:m]
    before = np.empty(len(at), np.int64)
    before[order] = back[first, at]
    return path, before


@dataclass
class Pieces:
    """The pieces of runs in a batch of slices; places count rows within runs only."""

    scores: np.ndarray
    there: np.ndarray  # for each row of the batch: is it in a run
    begins: np.ndarray
    sizes: np.ndarray
    slice_: np.ndarray  # of each piece
    follows: np.ndarray  # the piece goes on from the slice before
    last: np.ndarray  # the piece reaches its slice's end
    rows: np.ndarray  # rows of each slice


def pieces(col: pa.ListArray, scores: str, to_scores: Callable[[np.ndarray], np.ndarray] | None) -> Pieces:
    cut = col.offsets.to_numpy().astype(np.int64) - col.offsets[0].as_py()
    flat = col.flatten()
    there, first = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("_in", "_begin"))
    s = flat.field(scores).filter(flat.field("_in")).flatten().to_numpy(zero_copy_only=False)
    s = s.reshape(int(there.sum()), -1) if there.any() else np.zeros((0, 1))
    s = to_scores(s) if to_scores and len(s) else s
    head, tail = np.zeros(len(there), bool), np.zeros(len(there), bool)
    head[cut[:-1][np.diff(cut) > 0]] = True
    tail[cut[1:][np.diff(cut) > 0] - 1] = True
    gap = np.append(True, ~there[:-1]) if len(there) else there
    opens = np.flatnonzero(there & (first | head | gap))
    place = np.cumsum(there) - 1
    begins = place[opens]
    sizes = np.diff(np.append(begins, len(s)))
    of = np.searchsorted(cut, opens, "right") - 1
    ends = np.flatnonzero(there)[begins + sizes - 1] if len(opens) else opens
    return Pieces(s, there, begins, sizes, of, (head & ~first)[opens], tail[ends], np.diff(cut))


def scan(src: DataFrame, f: Callable[[Iterator[dict]], Iterator[dict]], schema: str, key: Sequence[str], forth: bool = True) -> DataFrame:
    """(key, _slice, schema): f over the rows of src, one small row for each slice, in the order of each series or against it."""
    whole = T.StructType([*(src.schema[c] for c in (*key, "_slice")), *T.StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for r in f(r for b in batches for r in b.to_pylist()):
            out.append(r)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_pylist(out, to_arrow_schema(whole))
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, to_arrow_schema(whole))

    order = F.col("_slice").asc() if forth else F.col("_slice").desc()
    return src.repartition(*key).sortWithinPartitions(*key, order).mapInArrow(run, whole)


def decode_slices(df: DataFrame, scores: str, begins: Column, inside: Column, change: np.ndarray, start: np.ndarray | float, out: str, slice_rows: int, key: Sequence[str] = KEY, idx: str = IDX, to_scores: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """As states.decode_runs(), with runs of any length: series are cut into slices of `slice_rows` numbers of `idx`.

    Three passes over the slices, which are staged once: their matrices (best scores from each state before a slice to each
    at its end), their back pointers under the scores that enter them (which states lead to which), and their paths. Between
    them one row for each slice, of a few numbers, is scanned in the order of a series, forward and then backward. Ties go
    to the first state as in a single pass; scores that enter are sums in another order, so they can differ in last digits.
    A series without rows in a run, null keys and slices without rows are fine; idx must not be NULL.
    """
    change, k, by = np.asarray(change, np.float64), len(change), [*key, "_slice"]
    df = df.withColumns({"_begin": begins, "_in": inside, "_slice": F.floor(F.col(idx) / slice_rows)})
    columns = [c for c in df.columns if c not in by]
    rows = F.array_sort(F.collect_list(F.struct(idx, *(c for c in columns if c != idx))))
    packed = staged(df.groupBy(*by).agg(rows.alias("_rows")), "slices")
    few = packed.select(*by, F.transform("_rows", lambda r: F.struct(r[scores].alias(scores), r["_begin"].alias("_begin"), r["_in"].alias("_in"))).alias("_rows"))
    names = T.StructType([f for f in packed.schema.fields if f.name in by])

    def mapped(src: DataFrame, f: Callable[[pa.RecordBatch, Pieces], dict], schema: str) -> DataFrame:
        return src.mapInArrow(_each(by, f, scores, to_scores), T.StructType([*names.fields, *T.StructType.fromDDL(schema).fields]))

    def matrices(b: pa.RecordBatch, p: Pieces) -> dict:
        through, leaves = [None] * b.num_rows, [None] * b.num_rows
        whole = np.flatnonzero(p.follows & p.last)
        sides = np.full((len(whole), k, k), -np.inf)
        for i in range(k):
            enter = np.full((len(whole), k), -np.inf)
            enter[:, i] = 0
            sides[:, i] = forward(p.scores, p.begins[whole], p.sizes[whole], change, start, np.ones(len(whole), bool), enter)[1]
        tail = np.flatnonzero(p.last & ~p.follows)
        exits = forward(p.scores, p.begins[tail], p.sizes[tail], change, start, np.zeros(len(tail), bool), np.zeros((len(tail), k)))[1]
        for at, x in zip(p.slice_[whole], sides, strict=True):
            through[at] = x.ravel()
        for at, x in zip(p.slice_[tail], exits, strict=True):
            leaves[at] = x
        return {"through": pa.array(through, pa.list_(pa.float64())), "leaves": pa.array(leaves, pa.list_(pa.float64()))}

    def entering(rows: Iterator[dict]) -> Iterator[dict]:
        held, v = None, None
        for r in rows:
            if (now := tuple(r[c] for c in key)) != held:
                held, v = now, None
            yield {c: r[c] for c in by} | {"enter": v}
            if r["through"] is None:
                v = r["leaves"]
            elif v is not None:
                v = (np.array(v)[:, None] + np.array(r["through"]).reshape(k, k)).max(0).tolist()

    def entered(b: pa.RecordBatch) -> np.ndarray:
        return np.array([x if x is not None else [0.0] * k for x in b["enter"].to_pylist()]).reshape(-1, k)

    def pointers(b: pa.RecordBatch, p: Pieces) -> dict:
        follows, whole, last = np.zeros(b.num_rows, bool), np.zeros(b.num_rows, bool), np.full(b.num_rows, -1)
        befores = [None] * b.num_rows
        enter = entered(b)
        ends = np.flatnonzero(p.last | p.follows)
        begins, sizes, of = p.begins[ends], p.sizes[ends], p.slice_[ends]
        back, best = forward(p.scores, begins, sizes, change, start, p.follows[ends], enter[of])
        last[of[p.last[ends]]] = best[p.last[ends]].argmax(1)
        goes = np.flatnonzero(p.follows[ends])
        follows[of[goes]], whole[of[goes]] = True, p.last[ends][goes]
        # For each state at the piece's end the state before it; where the run ends within the slice, its end is known.
        led = np.stack([trace(back, begins[goes], sizes[goes], np.full(len(goes), j))[1] for j in range(k)], 1)
        known = best[goes].argmax(1)
        for at, x, w, j in zip(of[goes], led, p.last[ends][goes], known, strict=True):
            befores[at] = x if w else x[j : j + 1]
        return {"follows": follows, "whole": whole, "before": pa.array(befores, pa.list_(pa.int32())), "last": last.astype(np.int32)}

    def leaving(rows: Iterator[dict]) -> Iterator[dict]:
        held, after, end = None, None, -1
        for r in rows:  # from the last slice of a series to its first
            if (now := tuple(r[c] for c in key)) != held:
                held, after = now, None
            if after is not None and after["follows"]:
                end = after["before"][end if after["whole"] else 0]
            else:
                end = r["last"]
            after = r
            yield {c: r[c] for c in by} | {"end": end}

    def paths(b: pa.RecordBatch, p: Pieces) -> dict:
        back, best = forward(p.scores, p.begins, p.sizes, change, start, p.follows, entered(b)[p.slice_])
        end = np.where(p.last, b["end"].to_numpy(zero_copy_only=False)[p.slice_], best.argmax(1)).astype(np.int64)
        path = np.zeros(len(p.there), np.int32)
        path[p.there] = trace(back, p.begins, p.sizes, end)[0]
        return {"_rows": b["_rows"], "_path": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(p.rows)), pa.int32()), pa.array(path, mask=~p.there))}

    enter = scan(mapped(few, matrices, "through array<double>, leaves array<double>"), entering, "enter array<double>", key)
    enter = staged(enter, "entering")
    found = staged(mapped(with_small(few, enter, by), pointers, "follows boolean, whole boolean, before array<int>, last int"), "pointers")
    both = with_small(enter, scan(found, leaving, "end int", key, forth=False), by)
    whole = with_small(packed, both, by)
    kind = packed.schema["_rows"].dataType
    done = whole.mapInArrow(_each(by, paths, scores, to_scores), T.StructType([*names.fields, T.StructField("_rows", kind), T.StructField("_path", T.ArrayType(T.IntegerType()))]))
    done = done.select(*key, F.posexplode("_rows").alias("_at", "_row"), "_path").select(*key, "_row.*", F.get("_path", F.col("_at")).alias(out))
    return done.select(*(c for c in df.columns if c not in ("_begin", "_in", "_slice")), out)


def _each(by: list[str], f: Callable, scores: str, to_scores: Callable | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch({c: b[c] for c in by} | f(b, pieces(b["_rows"], scores, to_scores)))

    return run
