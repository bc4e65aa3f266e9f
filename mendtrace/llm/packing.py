"""Best-two-fit packing of token pieces into sequences of a fixed capacity."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Words whose ids a Python worker remembers; beyond it, it starts anew.
REMEMBERED = 700_000
#: Pieces that one packing task gets.
GROUP = 32_768


class WordTokenizer:
    """ids of word_bpe_49k.json, word by word: its ids don't depend on what lies beyond a blank, and words come again.

    Only texts within Latin-1 are lower-cased and cut at blanks here, and only words of letters with full stops or
    commas behind them are cut further; anything else goes to the tokenizer as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.known: dict[str, bytes] = {}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}
        self.shown = {c: "".join(shown[b] for b in chr(c).encode()) for c in range(128, 256)}

    @staticmethod
    def _raw(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _new(self, chunk: str) -> bytes:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        word = chunk.rstrip(".,")
        if word.isalpha():
            if (raw := known.get(word)) is None:
                raw = known[word] = self._raw([t.id for t in self.model.tokenize(word.translate(self.shown))])
            if word == chunk:
                return raw
            tail = chunk[len(word) :]
            if (more := known.get(tail)) is None:
                more = known[tail] = self._raw(self.whole.encode(tail, add_special_tokens=False).ids)
            return raw + more
        raw = self._raw(self.whole.encode(chunk, add_special_tokens=False).ids)
        if len(chunk) < 64:
            known[chunk] = raw
        return raw

    def __call__(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._raw(self.whole.encode(text, add_special_tokens=False).ids)
        known, new = self.known, self._new
        return b"".join([known.get(w) or new(w) for w in text.lower().replace("\n", " ").split(" ") if w])


_tokenizers: dict[str, WordTokenizer] = {}


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizers.get(path) or _tokenizers.setdefault(path, WordTokenizer(path))
        deal = TaskContext.get().partitionId() * 104_729
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    out.append((key, k, at // 4, len(part) // 4, zlib.crc32(part), deal))
                    deal += 1
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "piece", "start", "length", "ids_crc32", "deal"])

    return run


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length. A bin takes the largest piece that fits, again and again; then, while room is left,
    its smallest piece gives way to the two unpacked pieces that fill the room it leaves best, if they fill more."""
    order = np.argsort(lengths, kind="stable")
    stacks: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        stacks.setdefault(int(lengths[i]), []).append(i)
    keys, count = sorted(stacks), np.zeros(capacity + 1, np.int64)
    for x, s in stacks.items():
        count[x] = len(s)
    bins, offsets, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0

    def take(x: int) -> int:
        count[x] -= 1
        if not count[x]:
            del keys[bisect_right(keys, x) - 1]
        return stacks[x].pop()

    while keys:
        held: list[tuple[int, int]] = []
        gap = capacity
        while gap and keys and (at := bisect_right(keys, gap)):
            x = keys[at - 1]
            held.append((x, take(x)))
            gap -= x
        while gap and len(keys) and held:
            small = min(held)
            room = gap + small[0]
            have = np.flatnonzero(count[: room + 1])
            if not len(have):
                break
            other = np.minimum(np.searchsorted(have, room - have, "right") - 1, np.arange(len(have)))
            other -= (other == np.arange(len(have))) & (count[have] < 2)
            total = np.where(other >= 0, have + have[np.maximum(other, 0)], 0)
            best = int(np.argmax(total))
            if total[best] <= small[0]:
                break
            held.remove(small)
            a, b = int(have[best]), int(have[other[best]])
            held += [(a, take(a)), (b, take(b))]
            if not count[small[0]]:
                insort(keys, small[0])
            count[small[0]] += 1
            stacks[small[0]].append(small[1])
            gap = room - a - b
        at = 0
        for x, i in held:
            bins[i], offsets[i] = n, at
            at += x
        n += 1
    return bins, offsets


def best_fit_pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack every text's ids, an end id behind each, into as few sequences of at most `capacity` ids as it can.

    Only longer texts are cut, at multiples of the capacity. Returns (key, piece, start, length, ids_crc32, sequence_id,
    offset). Null and empty texts are the end id alone; null keys and repeated rows are packed like others; other columns
    are ignored; no rows give none. A very long text becomes as many pieces as it needs. The pieces' lengths are staged, then dealt evenly over groups of about GROUP pieces, each packed in one
    task; a group leaves one sequence unfilled at most, one in many thousands.
    """
    kind = docs.schema[key].dataType.simpleString()
    pieces = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(_pieces(tokenizer, capacity, end_id), f"id {kind}, piece int, start long, length long, ids_crc32 long, deal long")
    pieces = C.stage_table(pieces, "pieces")
    groups = max(1, -(-pieces.count() // GROUP))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = best_two_fit(pdf["length"].to_numpy(), capacity)
        return pdf.drop(columns="deal").assign(sequence_id=bins + pdf["part"] * 2**32, offset=offsets).drop(columns="part")

    out = pieces.withColumn("part", F.pmod("deal", F.lit(groups))).groupBy("part").applyInPandas(pack, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", key)


def op4(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
