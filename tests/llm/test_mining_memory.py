"""Shards of phrases are spelt out in blocks: the same counts, and a bounded memory of the task."""

import collections
import tracemalloc

import numpy as np
import pyarrow as pa

from mendtrace.llm import collocations


def counted(raw, langs, off):
    out = collections.Counter()
    for b in collocations.shard_counts(langs, raw, off, 3, 4, collocations.Filter(np.full(1 << 6, 2**64 - 1, np.uint64), 12)):
        for phrase, n in zip(b["phrase"].to_pylist(), b["n"].to_pylist(), strict=True):
            out[phrase] += n
    return out


def test_phrases_are_spelt_out_in_blocks(monkeypatch):
    r = np.random.default_rng(3)
    text = " ".join(f"w{x}" for x in r.integers(0, 400, 3000)).encode()
    shard = np.frombuffer(text, np.uint8), pa.array(["en"]), np.array([0, len(text)])
    words = text.decode().split()
    want = collections.Counter(" ".join(words[i : i + n]) for n in (3, 4) for i in range(len(words) - n + 1))
    assert counted(*shard) == want
    monkeypatch.setattr(collocations, "SPELT", 7)
    assert counted(*shard) == want


def test_a_shard_takes_bounded_memory():
    """A full shard of distinct phrases of long words took 101 bytes for each byte of text before, and takes 49."""
    r = np.random.default_rng(4)
    text = " ".join(f"longer{x}word" for x in r.integers(0, 10**6, 60_000)).encode()
    known = collocations.Filter(np.full(1 << 6, 2**64 - 1, np.uint64), 12)
    collocations.HASH.sums(np.zeros(len(text), np.uint8))
    tracemalloc.start()
    n = sum(b.num_rows for b in collocations.shard_counts(pa.array(["en"]), np.frombuffer(text, np.uint8), np.array([0, len(text)]), 3, 4, known))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2 * 60_000 - 5
    assert peak < 60 * len(text)
