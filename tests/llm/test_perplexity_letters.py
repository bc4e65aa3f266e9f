"""The perplexity model tells all letters apart: against dictionaries, with n-grams broadcast and joined, and in the query."""

import collections
import math

import numpy as np
import pytest

from mendtrace.llm import perplexity


def plain(rows):
    """Log perplexities by letter and word end, all letters told apart."""
    out = {}
    for lang in {x[2] for x in rows}:
        grams = lambda t: [tuple(s[i - 3 : i + 1]) for w in t.split() for s in [[None] * 3 + list(w) + [None]] for i in range(3, len(s))]
        mine = [(i, grams(t)) for i, t, g in rows if g == lang]
        c = {4: collections.Counter(g for _, gs in mine for g in gs)}
        for k in (3, 2, 1):
            c[k] = collections.Counter(g[1:] for g in c[k + 1])
        p = {(): 1 / len(c[1])}
        for k in (1, 2, 3, 4):
            t = [sum(v == i for v in c[k].values()) for i in range(1, 5)]
            d = [0.5, 1.0, 1.5]
            if all(t):
                e = [i - (i + 1) * t[0] / (t[0] + 2 * t[1]) * t[i] / t[i - 1] for i in (1, 2, 3)]
                d = e if all(0 < v <= i for i, v in enumerate(e, 1)) else d
            total, off = collections.Counter(), collections.Counter()
            for g, v in c[k].items():
                total[g[:-1]] += v
                off[g[:-1]] += d[min(v, 3) - 1]
            p |= {g: max(v - d[min(v, 3) - 1], 0) / total[g[:-1]] + off[g[:-1]] / total[g[:-1]] * p[g[1:]] for g, v in c[k].items()}
        out |= {i: -sum(math.log(p[g]) for g in gs) / len(gs) for i, gs in mine}
    return out


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(11)
    many = [chr(0x4E00 + i) for i in range(150)] + [chr(0x1F600 + i) for i in range(20)]
    vocab = ["".join(r.choice(many, r.integers(2, 6))) for _ in range(120)]
    out = [(i, " ".join(r.choice(vocab, 40)), ["zh", "ja"][i % 2]) for i in range(60)]
    common = "etaoinshrdlucmfwypvbgkjqxzETAOINSHRDLUCMFWYPVBGKJQXZ0123456789"
    known, other = [chr(0x5000 + i) for i in range(100)], [chr(0x6000 + i) for i in range(400)]
    out += [(100 + i, " ".join(common[j:] + common[:j] for j in range(40)) + " " + " ".join("".join(known[k : k + 5]) for k in range(0, 100, 5)), "xx") for i in range(8)]
    # The usual letters beyond the 62, and as many that stand nowhere else.
    return [*out, (200, " ".join("".join(known[k : k + 5]) for k in range(0, 100, 5)), "xx"), (201, " ".join("".join(other[k : k + 5]) for k in range(0, 100, 5)), "xx")]


def test_all_letters_are_told_apart(spark, rows, monkeypatch):
    docs, want = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), plain(rows)
    for most, step in ((4_000_000, 2 << 20), (400, 2 << 20), (0, 3000)):  # all broadcast, frequent ones, none
        monkeypatch.setattr(perplexity, "MODEL_ROWS", most)
        monkeypatch.setattr(perplexity, "STEP_BYTES", step)
        got = {r["doc_id"]: r["log_perplexity"] for r in perplexity.rules(docs, told=None).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in want)


def test_the_query_tells_rare_letters_apart(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in perplexity.op13(spark, str(tmp_path)).collect()}
    want = plain(rows)
    assert len(got) == len(rows) and all(abs(got[i]["log_perplexity"] - want[i]) < 1e-5 for i in want)
    assert want[201] > want[200] + 0.2  # equal while all letters beyond 62 were one
