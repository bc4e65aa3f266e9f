"""N-gram Jaccard self-join by universe partitions.

Shingle sets are compared exactly, but only where a pigeonhole argument lets two sets be similar: the hash universe
is cut into segments, and two sets whose symmetric difference is at most H agree in one of H + 1 segments, or differ by
one element in a segment that counts twice. Sizes fall into geometric bands; scheme k serves pairs within band k and
between bands k and k + 1, so every set takes part in two schemes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import exp, floor, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WORDS = C.Rolling(11)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Weight of a chance agreement against one signature row in the cost of a segment with t elements.
CHANCE = 2000.0
#: Segments in a group, of which all subsets but one segment are indexed; more of them cost more rows than they save.
PIECES = (3, 4)
#: Bytes of text that are cut into shingles at once.
SHINGLED = 1 << 19
#: Sets that one verifying step holds of one cluster on each side.
BLOCK = 256


@lru_cache(maxsize=100_000)
def band(size: int, percent: int) -> int:
    """The band of a size: bands start at b, then at floor(b * 100 / percent) + 1."""
    k, start = 0, 1
    while (after := start * 100 // percent + 1) <= size:
        k, start = k + 1, after
    return k


@lru_cache(maxsize=10_000)
def scheme(k: int, percent: int) -> tuple[int, int, int, int, int]:
    """(equal segments, one-deletion segments, groups, segments in a group, spare) of scheme k at the least modelled cost.

    Equal segments serve where hardly more of them are weak (fewer than two elements) than are spare. Else segments are
    indexed in subsets: a group of p segments with one difference at most agrees in p - 1 of them, so it counts twice, and
    what a subset holds is larger than what a segment alone would hold. Small sets, where more than a quarter of the groups
    would have to be spare, use one-deletion neighbourhoods only.
    """
    starts = [1]
    while len(starts) < k + 3:
        starts.append(starts[-1] * 100 // percent + 1)
    low, most = starts[k], (starts[k + 1] - 1) + (starts[k + 2] - 1)
    units = floor(most * (100 - percent) / (100 + percent)) + 1
    if units == 1:
        return 0, 0, 0, 0, 0  # only equal sets can be similar
    best = None
    for q in range(0, min(units // 2, 4) + 1):
        m = max(units - 2 * q, 0)
        t = low / (m + q)
        cost = m * (1 + CHANCE * exp(-t)) + q * (1 + t) * (1 + CHANCE * exp(-t))
        if best is None or cost < best[0]:
            best = cost, m, q
    _, m, q = best
    spare = 1 + m // 24 if m >= 8 else 0
    t = low / (m + spare + q)
    if (m + q) * exp(-t) * (1 + t) <= max(spare, 0.5):
        return m + spare, q, 0, 0, spare
    least, best = (units - 1) // 2 + 1, None
    for pieces in (*PIECES, 0):  # 0: one-deletion neighbourhoods of whole groups, for sets too small for subsets
        for spare in range(least + 1):  # as few as leave two deviations of room for groups with an empty subset
            t = low / (least + spare)
            content = t * (pieces - 1) / pieces if pieces else t - 1
            empty = (least + spare) * (pieces * exp(-content) if pieces else exp(-t) * (1 + t))
            if empty + 2 * sqrt(empty) <= spare + 0.5:
                break
        cost = (least + spare) * (pieces or 1 + t) * (1 + CHANCE * exp(-content))
        if 4 * spare <= least and pieces and (best is None or cost < best[0]) or not pieces and best is None:
            best = cost, pieces, spare
    _, pieces, spare = best
    return (0, 0, least + spare, pieces, spare) if pieces else (0, least + spare, 0, 0, spare)


def tag(k: int, i: np.ndarray) -> np.ndarray:
    return C.mix(np.uint64((k * 0x9E3779B97F4A7C15 + 1) % 2**64) + i.astype(np.uint64))


def signatures(h: np.ndarray, percent: int) -> np.ndarray:
    """Keys under which a set of sorted 64-bit hashes meets every set that can be similar to it and differs from it."""
    own, out = band(len(h), percent), []
    g = C.mix(h + np.uint64(0x51ED270B))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(g, out=sums[1:])
    for k in (own - 1, own):
        if k < 0:
            continue
        m, q, r, pieces, spare = scheme(k, percent)
        n = r * pieces if r else m + q
        if not n:
            continue
        cuts = (np.arange(1, n, dtype=np.float64) * (2.0**64 / n)).astype(np.uint64)
        at = np.concatenate([[0], np.searchsorted(h, cuts), [len(h)]])
        lo, hi = at[:-1], at[1:]
        t, s = tag(k, np.arange(n)), sums[hi] - sums[lo]
        if r:  # each subset is a group without one of its segments
            held = (hi - lo).reshape(r, pieces)
            held = held.sum(1, keepdims=True) - held
            subset = s.reshape(r, pieces).sum(1, keepdims=True, dtype=np.uint64) - s.reshape(r, pieces) + t.reshape(r, pieces)
            # Of the spare + 1 groups or more in which a similar set agrees, one is not among the spare poorest. The poorest
            # subset of the next is the least to index: of two sets, the one with the higher such least finds the other.
            out.append(C.mix(subset[held >= np.partition(held.min(1), spare)[spare]]))
            continue
        if not m:  # as above; the poorest that a segment can share is itself without one element
            held = hi - lo
            least = np.partition(np.maximum(held - 1, 0), spare)[spare]
            out.append(C.mix(s[held >= least] + t[held >= least]))
            for i in np.flatnonzero((held > 0) & (held - 1 >= least)):
                out.append(C.mix(s[i] - g[lo[i] : hi[i]] + t[i]))
            continue
        weak = hi[:m] - lo[:m] < 2
        keep = np.ones(n, bool)
        if weak.sum() <= spare:  # a similar set agrees in spare + 1 segments, so in one that is not weak
            keep[:m] = ~weak
        out.append(C.mix(s[keep] + t[keep]))
        for i in range(m, n):
            out.append(C.mix(s[i] - g[lo[i] : hi[i]] + t[i]))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


def shingle_sets(data: np.ndarray, begins: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; fewer words than a shingle make one, none make an empty set."""
    for a, b in C.chunks(begins, SHINGLED):
        off = begins[a : b + 1] - begins[a]
        raw = LOWER[data[begins[a] : begins[b]]]
        s, e = C.word_bounds(raw, off)
        w = WORDS.of(WORDS.sums(raw), s, e)
        mult = [np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 2**64)) for j in range(words)]
        n = max(len(w) - words + 1, 0)
        grams = C.mix(sum((w[j : n + j] * mult[j] for j in range(words)), np.zeros(n, np.uint64)))
        first = np.searchsorted(s, off)
        for i in range(b - a):
            x, y = first[i], first[i + 1]
            if y - x >= words:
                yield np.unique(grams[x : y - words + 1])
            elif y > x:
                yield C.mix(sum((w[x + j : x + j + 1] * mult[j] for j in range(y - x)), np.full(1, y - x, np.uint64)))
            else:
                yield np.zeros(0, np.uint64)


def node_of(h: np.ndarray) -> int:
    """One number for a set; equal sets have equal numbers."""
    return int(C.mix(np.array([C.mix(h ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64)).view(np.int64)[0])


def stars(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of entries (signature, node): each signature with its least node, and (signature, node, least node) of the others."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[new], node[new]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    low = node[first][np.cumsum(first) - 1]
    return sig[first], node[first], sig[~first], node[~first], low[~first]


#: Signatures and nodes travel without their last 16 bits; what falls together so is only compared once more.
SHORT = ~0xFFFF
#: Signatures that a scanning step holds before it sends them.
FLUSH = 300_000
#: Bytes of text whose signatures make one part; they are about three times as many bytes, joined in one task.
PART_BYTES = 4 << 20
#: Bytes of a part's signatures that are sorted at once; a larger part is sorted in slices of its signatures.
SORTED = 16 << 20
#: Rows of a bucket in one packed value.
PACKED = 20_000


def pack(*cols: np.ndarray) -> np.ndarray:
    """Rows of six bytes a column: the first 48 bits of each 64-bit column."""
    return np.column_stack([c.astype("<i8").view("<u2").reshape(-1, 4)[:, 1:] for c in cols])


def unpack(raw: bytes, cols: int = 2) -> tuple[np.ndarray, ...]:
    words = np.frombuffer(raw, "<u2").reshape(-1, cols, 3)
    out = np.zeros((len(words), cols, 4), "<u2")
    out[:, :, 1:] = words
    both = out.reshape(-1, 4 * cols).view("<i8")
    return tuple(both[:, k] for k in range(cols))


SHIPPED = ("kind", "p", "id", "n", "a", "entries")


def _rows(id_type: pa.DataType, kind: str, p, ids=None, n=None, a=None, entries=None) -> pa.RecordBatch:
    size = len(p)
    cols = ((ids, id_type), (n, pa.int64()), (a, pa.int64()), (entries, pa.binary()))
    out = [pa.array([kind] * size), pa.array(p, pa.int32())]
    out += [pa.nulls(size, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in cols]
    return pa.RecordBatch.from_arrays(out, list(SHIPPED))


def _bucket_rows(id_type: pa.DataType, parts: int, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (signature, node, least node) of one step, packed (kind b)."""
    for i in range(0, len(cols[0]), PACKED):
        some = pack(*(c[i : i + PACKED] for c in cols))
        yield _rows(id_type, "b", [int(cols[0][i] >> 16) % parts], entries=[some.tobytes()])


def part_of(sig: np.ndarray, parts: int) -> np.ndarray:
    return (sig.view(np.uint64) >> np.uint64(16)) % np.uint64(parts)


def _scan(words: int, percent: int, parts: int, turn: int = 0, turns: int = 1):
    """Documents (kind d), nodes that meet within a step (kind b), and the step's signatures, packed by part (kind s). Of
    several turns each sends the signatures of its share of the parts, and the first one the documents."""

    def f(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, begins = C.utf8(b.column(1))
        kind, own = b.schema.field(0).type, set()
        done, n, node, sigs, held = 0, [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            size = len(n)
            if not turn:
                yield _rows(kind, "d", (done + np.arange(size)) % parts, b.column(0).slice(done, size), n, node)
            which = np.repeat(np.arange(size), [len(x) for x in sigs])
            if not len(which):
                return
            short = np.array([x or 0 for x in node], np.int64) & SHORT
            sig, low, *met = stars(np.concatenate(sigs) & SHORT, short[which])
            yield from _bucket_rows(kind, parts, *met)
            p = part_of(sig, parts)
            order = np.argsort(p, kind="stable")
            p, both = p[order].astype(np.int32), pack(sig[order], low[order])
            cut = np.append(np.flatnonzero(np.diff(p, prepend=-1)), len(p))
            yield _rows(kind, "s", p[cut[:-1]], entries=[both[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)])

        for h in shingle_sets(data, begins, words):
            n.append(len(h))
            node.append(node_of(h) if len(h) else None)
            mine = signatures(h, percent) if len(h) and node[-1] not in own else np.zeros(0, np.int64)
            sigs.append(mine[part_of(mine, parts) % np.uint64(turns) == turn] if turns > 1 else mine)
            own.add(node[-1])
            held += len(sigs[-1])
            if held >= FLUSH:
                yield from flush()
                done, n, node, sigs, held = done + len(n), [], [], [], 0
        if n:
            yield from flush()

    return C.per_batch(f)


def _meet(parts: int):
    """Joins the steps' signatures part by part (rows come sorted by part) and passes on what else there is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        part, kind = None, pa.int64()

        def flush() -> Iterator[pa.RecordBatch]:
            slices = -(-sum(map(len, held)) // SORTED)
            for k in range(slices):
                mine = []
                for raw in held:
                    sig, low = unpack(raw)
                    # Within a part, signatures differ in what is left of them beyond the part's number.
                    some = (sig.view(np.uint64) >> np.uint64(16)) // np.uint64(parts) % np.uint64(slices) == k if slices > 1 else slice(None)
                    mine.append((sig[some], low[some]))
                _, _, *met = stars(*(np.concatenate(x) for x in zip(*mine, strict=True)))
                yield from _bucket_rows(kind, parts, *met)
            held.clear()

        for b in batches:
            kind = b.schema.field(2).type
            mine = pc.equal(b.column(0), "s")
            rest = b.filter(pc.invert(mine))
            if rest.num_rows:
                yield rest
            for p, raw in zip(b.column(1).filter(mine).to_pylist(), b.column(5).filter(mine), strict=True):
                if p != part:
                    yield from flush()
                    part = p
                held.append(raw.as_py())
        yield from flush()

    return run


def _unpacked(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for raw in b.column(0):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in unpack(raw.as_py(), 3)], ["sig", "u", "v"])


def _sets(words: int):
    def f(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, begins = C.utf8(b.column(0))
        node, raw = [], []
        for h in shingle_sets(data, begins, words):
            node.append(node_of(h) if len(h) else None)
            raw.append(h.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(raw, pa.binary())], ["node", "grams"])

    return C.per_batch(f)


def links(rows: list[np.ndarray], label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets of different labels."""
    n = len(rows)
    size = np.array([len(r) for r in rows], np.int64)
    _, token, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    often = count[token] > 1
    token, owner = (np.cumsum(count > 1) - 1)[token[often]], owner[often]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    both = np.zeros((n, n), np.int64)
    width = max(1, 1_000_000 // max(n, 1))
    for c in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        x, y = np.searchsorted(token, [c, c + width])
        m = np.zeros((n, width), np.float32)
        m[owner[x:y], token[x:y] - c] = 1
        both += (m @ m.T).astype(np.int64)
    near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    near &= label[:, None] != label[None, :]
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    out = []
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        if (p := find(int(i))) != (q := find(int(j))):
            root[q] = p
            out.append((int(i), int(j)))
    return out


def _with_hubs(percent: int):
    """Links of the sets of each group with its hub."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, g in pdf.groupby(["hub", "salt"], sort=False):
            is_hub = g["is_hub"].to_numpy(bool)
            node, rows = g["node"].to_numpy(), [np.frombuffer(x, np.uint64) for x in g["grams"]]
            others = np.flatnonzero(~is_hub)
            if not len(others):
                continue
            size = np.array([len(rows[i]) for i in others])
            every = np.concatenate([rows[i] for i in others])
            for h in np.flatnonzero(is_hub):
                at = np.minimum(np.searchsorted(rows[h], every), len(rows[h]) - 1)
                both = np.add.reduceat((rows[h][at] == every).astype(np.int64), np.cumsum(size) - size)
                near = (100 * both >= percent * (size + len(rows[h]) - both)) & (node[others] != node[h])
                a += node[others[near]].tolist()
                b += [node[h]] * int(near.sum())
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return f


def _across(percent: int):
    """Links of sets with different labels within each pair of blocks."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(["group", "i", "j"], sort=False):
            g = g.drop_duplicates("node")
            if g["label"].nunique() > 1:
                node, rows = g["node"].to_numpy(), [np.frombuffer(x, np.uint64) for x in g["grams"]]
                out += [(node[a], node[b]) for a, b in links(rows, g["label"].to_numpy(), percent)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return f


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, part_bytes: int = PART_BYTES, turns: int = 1) -> DataFrame:
    """Classes of texts linked, directly or through others, by a Jaccard similarity of percent / 100 or more.

    Words are runs of bytes without ASCII white space, A-Z lower-cased; a set holds the distinct shingles of `words` words.
    Returns (key, n_shingles, class_id): the smallest key of the class. Null and blank texts have an empty set and stay
    alone; repeated rows stay repeated; null keys never name a class unless a class has no other; other columns are ignored.

    Sets that share a signature are one bucket. Each step of a scan, then each part of the signatures, compares a bucket's
    sets with its least one only, which settles hot groups in as many comparisons as there are sets. Buckets whose sets
    are not all linked by then are compared in pairs of blocks, each set outside the largest class with all others, over many
    tasks; a task returns a spanning forest. Without documents there are no rows; a very long text is cut into shingles alone. Buckets that hang together are compared as one group if that sends fewer rows,
    else one by one, so chance agreements don't add up. Equal sets collapse before anything is compared. With several `turns`
    the texts are scanned as often, and each turn shuffles its share of the signatures only; the result is the same.
    """
    src = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    # One shuffle of signatures, packed: each step of a scan sends one entry per signature at most, so no signature is hot.
    # Parts follow the data, so a task's memory does not grow with it, whatever the number of shuffle partitions.
    parts = max(32, -(-src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // part_bytes))
    shipped = f"kind string, p int, id {src.schema['id'].dataType.simpleString()}, n long, a long, entries binary"

    def joined(turn: int) -> DataFrame:
        sent = src.mapInArrow(_scan(words, percent, parts, turn, turns), shipped)
        return C.stage_table(sent.repartition("p").sortWithinPartitions("p").mapInArrow(_meet(parts), shipped).drop("p"), "sets")

    met = reduce(DataFrame.union, [joined(k) for k in range(turns)])
    base = met.where("kind = 'd'").select("id", F.col("n").alias("n_shingles"), F.col("a").alias("node"))
    nodes = C.stage_table(base.where("node is not null").groupBy("node").agg(F.min("id").alias("id")), "nodes")
    buckets = met.where("kind = 'b'").select("entries").mapInArrow(C.per_batch(_unpacked), "sig long, u long, v long")
    edges = C.stage_table(buckets.select("u", "v").distinct(), "edges")
    wanted = edges.select("u").union(edges.select("v")).distinct().withColumnRenamed("u", "short")
    wanted = C.stage_table(nodes.withColumn("short", F.col("node").bitwiseAND(F.lit(SHORT))).join(wanted, "short"), "wanted")

    def sets_of(some: DataFrame) -> DataFrame:
        """(node, grams), read again from the texts of some nodes (node, id)."""
        texts = C.join_small(src, some.where("id is not null").select("id").distinct(), ["id"], "left_semi").select("text")
        texts = texts.union(src.where("id is null").select("text")) if some.where("id is null").limit(1).count() else texts
        return texts.mapInArrow(_sets(words), "node long, grams binary")

    # Each set with its buckets' least sets; a hub of many is compared in several tasks.
    hubs = C.stage_table(edges.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "hubs")
    salt = F.when(F.col("n").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("u"), F.ceil(F.col("n") / BLOCK)))
    placed = C.join_small(edges, hubs, ["v"], "left").select(F.col("v").alias("hub"), salt.alias("salt"), F.col("u").alias("short"), F.lit(False).alias("is_hub"))
    placed = placed.union(placed.select("hub", "salt").distinct().select("hub", "salt", F.col("hub").alias("short"), F.lit(True).alias("is_hub")))
    placed = C.stage_table(placed.join(wanted.select("short", "node"), "short").drop("short"), "placed")
    tasks = max(64, placed.count() // 64)
    compared = sets_of(wanted).join(placed, "node").withColumn("part", F.pmod(F.xxhash64("hub", "salt"), F.lit(tasks)))
    linked = C.stage_table(compared.groupBy("part").applyInPandas(_with_hubs(percent), "a long, b long"), "links")
    label = C.components(linked, "a", "b")

    # Buckets of three or more sets that are not all linked: sets outside the largest class against all.
    known = C.stage_table(wanted.join(label, "node", "left").select("short", "node", "id", F.coalesce("label", "node").alias("label")), "labels")
    lab = C.stage_table(known.select("short", "label").distinct(), "short-labels")
    apart = C.join_small(C.join_small(edges, lab.toDF("u", "lu"), ["u"], "inner"), lab.toDF("v", "lv"), ["v"], "inner").where("lu <> lv").select("u", "v", F.lit(1).alias("apart")).distinct()
    apart = C.stage_table(apart, "apart")
    sigs = C.join_small(buckets, apart, ["u", "v"], "left").groupBy("sig").agg(F.count("*").alias("n"), F.max("apart").alias("apart")).where("n > 1 and apart = 1").select("sig")
    sigs = C.stage_table(sigs, "open-signatures")
    mine = C.stage_table(C.join_small(buckets, sigs, ["sig"], "left_semi"), "open")
    known = C.join_small(known, C.components(mine.select("u", "v"), "u", "v").toDF("short", "cluster"), ["short"], "inner")
    mine = mine.select("sig", F.explode(F.array("u", "v")).alias("short")).distinct()
    mine = C.stage_table(C.join_small(mine, known, ["short"], "inner").select("sig", "node", "label", "id", "cluster"), "members")
    blocks = lambda n: F.ceil(n / BLOCK).cast("long")
    of_group = F.sum("n").alias("n"), F.max("n").alias("top_n"), F.max_by("label", F.struct("n", "label")).alias("top")

    def plan() -> list[Column]:
        """Blocks of the sets outside the largest class and of all sets, and how many rows their pairs send."""
        few, every = blocks(F.col("n") - F.col("top_n")), blocks(F.col("n"))
        cost = F.when(every > 1, F.col("n") * few + (F.col("n") - F.col("top_n")) * every).otherwise(F.col("n"))
        return [few.alias("few"), every.alias("all"), cost.alias("cost")]

    size = mine.groupBy("sig", "label").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("cluster").alias("cluster"))
    size = size.groupBy("sig").agg(F.min("cluster").alias("cluster"), F.bit_xor("x").alias("x"), *of_group).where("n > top_n")
    size = C.stage_table(size.groupBy("cluster", "n", "x").agg(F.min(F.struct("sig", "top", *plan())).alias("s")).select("cluster", "s.*"), "sizes")  # equal buckets count once
    # Buckets that hang together mostly have the same sets: all of them are one group where that sends fewer rows.
    whole = mine.select("cluster", "node", "label").distinct().groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(*of_group)
    whole = whole.select("cluster", "top", *plan()).join(size.groupBy("cluster").agg(F.sum("cost").alias("apart")), "cluster")
    whole = C.stage_table(whole.withColumn("at_once", F.col("cost") <= F.col("apart")), "clusters")
    if size.limit(1).count():
        once = C.join_small(mine.select("cluster", "node", "label", "id").distinct(), whole.where("at_once").drop("cost", "apart", "at_once"), ["cluster"], "inner").withColumn("group", F.xxhash64(F.lit(1), "cluster"))
        size = C.join_small(size, whole.where("not at_once").select("cluster"), ["cluster"], "left_semi")
        by_bucket = C.join_small(mine.select("sig", "node", "label", "id"), size.drop("cluster", "cost"), ["sig"], "inner").withColumn("group", F.xxhash64(F.lit(2), "sig"))
        cols = ("group", "node", "label", "id", "top", "few", "all")
        mine = once.select(*cols).union(by_bucket.select(*cols))
        one = lambda n: F.pmod(F.xxhash64("node"), n)
        every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        as_all = mine.select("group", "node", "label", "id", F.explode(every(F.col("few"))).alias("i"), one(F.col("all")).alias("j"))
        as_few = mine.where((F.col("label") != F.col("top")) & (F.col("all") > 1)).select("group", "node", "label", "id", one(F.col("few")).alias("i"), F.explode(every(F.col("all"))).alias("j"))
        grid = C.stage_table(as_all.union(as_few), "grid")
        tasks = max(64, grid.count() // 64)
        rows = sets_of(grid.select("node", "id").distinct()).join(grid.drop("id"), "node").withColumn("part", F.pmod(F.xxhash64("group", "i", "j"), F.lit(tasks)))
        more = C.stage_table(rows.groupBy("part").applyInPandas(_across(percent), "a long, b long"), "links")
        if more.limit(1).count():
            label = C.components(linked.union(more), "a", "b")

    named = nodes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("id").alias("class_id"))
    named = named.join(least, "label").select("node", "class_id")
    out = base.join(named, "node", "left")
    return out.select(F.col("id").alias(key), "n_shingles", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_classes(docs, words=3, percent=90).withColumnRenamed("class_id", "component_id")
