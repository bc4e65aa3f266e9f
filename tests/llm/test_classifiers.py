"""The quality and language models against plain versions: texts as bytes in loops, cuts by trying all, kernels by sets."""

import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mendtrace.llm import language, quality

SAMPLES = ["", " ", "\n", "a\n", "\n\nb", "One, two. Three!?", "x|y | z|| #", "Ab\tAB\x0bab ab", "é ß $ü€", "line\nline\nline\n", "A" * 70_000, "to be or not to be\nto be", "12 34 12", "a\x00b \x7f", "end|", "end!", "#!"]


def joined(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])


def plain_features(text):
    raw = text.encode()
    words, lines = re.findall(rb"[^ \t-\r]+", raw), re.findall(rb"[^\n]*\n|[^\n]+", raw)
    n, w = max(1, len(raw)), max(1, len(words))
    of = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    low, capitals = sum(97 <= c <= 122 or c > 127 for c in raw), sum(65 <= c <= 90 for c in raw)
    symbols, loud = b"#$%&*+<=>@\\^_`~", b"!?"
    letters = low + capitals
    return [
        math.log1p(len(raw)), letters / n, capitals / max(1, letters), sum(48 <= c <= 57 for c in raw) / n, of(symbols) / n, of(b" \t\n\x0b\x0c\r") / n,
        of(b"|") / w, of(loud) / w, letters / w, of(b".") / w, of(b"\n") / w, of(b",") / w, sum(len(x) <= 3 for x in words) / w, len(set(words)) / w,
        sum(x[-1] in symbols + loud + b"|" for x in words) / w, len(set(lines)) / max(1, len(lines)),
    ]


def test_features():
    for texts in (SAMPLES, SAMPLES[::-1], [""], ["", ""], []):
        got = quality.features(*joined(texts))
        assert got.shape == (len(texts), len(quality.FEATURES))
        assert got == pytest.approx(np.array([plain_features(t) for t in texts]).reshape(got.shape))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB9 .,|!#\né", max_size=12), max_size=6))
def test_features_of_any_texts(texts):
    got = quality.features(*joined(texts))
    assert got == pytest.approx(np.array([plain_features(t) for t in texts]).reshape(got.shape))


def worth(g, h):
    return sum(g) ** 2 / (sum(h) + 1)


def plain_tree(g, h):
    """Depth two: the first best cut of the whole, then of each side; a cut must gain."""

    def grow(lo, hi, depth):
        best, at = 1e-9, None
        for k in range(lo + 1, hi) if depth else ():
            gain = worth(g[lo:k], h[lo:k]) + worth(g[k:hi], h[k:hi]) - worth(g[lo:hi], h[lo:hi])
            if gain > best + 1e-12:
                best, at = gain, k
        if at is None:
            return [sum(g[lo:hi]) / (sum(h[lo:hi]) + 1)] * (hi - lo)
        return grow(lo, at, depth - 1) + grow(at, hi, depth - 1)

    return np.array(grow(0, len(g), 2))


def plain_quarters(g, h):
    """The best pair of cuts, one on each axis; a cut may lie behind the last bin."""
    best, found = -1.0, None
    for i in range(1, g.shape[0] + 1):
        for j in range(1, g.shape[1] + 1):
            cells = [(slice(*a), slice(*b)) for a in ((0, i), (i, None)) for b in ((0, j), (j, None))]
            gain = sum(g[c].sum() ** 2 / (h[c].sum() + 1) for c in cells)
            if gain > best + 1e-12:
                best, found = gain, cells
    out = np.zeros(g.shape)
    for c in found:
        out[c] = g[c].sum() / (h[c].sum() + 1)
    return best - worth(g.ravel(), h.ravel()), out


def test_steps():
    r = np.random.default_rng(5)
    for _ in range(60):
        g, h = r.normal(size=r.integers(1, 12)), r.random(12)
        assert quality._tree(g, h[: len(g)]) == pytest.approx(plain_tree(g, h[: len(g)]))
        g = r.normal(size=r.integers(1, 7, 2))
        h = r.random(g.shape)
        for a, b in zip(quality._quarters(g, h), plain_quarters(g, h), strict=True):
            assert a == pytest.approx(b)


def test_whole_model(monkeypatch):
    """Boosting in turn, row by row; pairs are those that explain most of what single features leave."""
    for name, v in (("ROUNDS", 6), ("PAIRS", 2), ("BINS", 5)):
        monkeypatch.setattr(quality, name, v)
    r = np.random.default_rng(8)
    k, n = len(quality.FEATURES), 80
    x = r.normal(size=(n, k))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.2) | (x[:, 5] > 1)).astype(float)
    got = quality.fit(x, y)
    cuts = [sorted(set(np.quantile(x[:, f], [0.2, 0.4, 0.6, 0.8]))) for f in range(k)]
    bins = [[sum(c <= row[f] for c in cuts[f]) for f in range(k)] for row in x]
    base = math.log(y.mean() / (1 - y.mean()))
    single, pairs = [[0.0] * (len(c) + 1) for c in cuts], {}
    z = lambda row: base + sum(single[f][row[f]] for f in range(k)) + sum(t[row[i], row[j]] for (i, j), t in pairs.items())

    def sums(shape, place):
        g, h = np.zeros(shape), np.zeros(shape)
        for row, want in zip(bins, y, strict=True):
            p = 1 / (1 + math.exp(-z(row)))
            g[place(row)] += want - p
            h[place(row)] += p * (1 - p)
        return g, h

    for _ in range(6):
        for f in range(k):
            step = plain_tree(*sums(len(single[f]), lambda row, f=f: row[f]))
            single[f] = [a + quality.RATE * b for a, b in zip(single[f], step, strict=True)]
    of = lambda i, j: sums((len(single[i]), len(single[j])), lambda row: (row[i], row[j]))
    best = sorted(((plain_quarters(*of(i, j))[0], i, j) for i in range(k) for j in range(i)), reverse=True)[:2]
    pairs = {(i, j): np.zeros((len(single[i]), len(single[j]))) for _, i, j in best}
    for _ in range(2):
        for i, j in list(pairs):
            pairs[i, j] = pairs[i, j] + quality.RATE * plain_quarters(*of(i, j))[1]
    assert [(i, j) for i, j, _ in got.pairs] == list(pairs)
    for a, b in zip(got.single, single, strict=True):
        assert a == pytest.approx(np.array(b))
    assert got(x) == pytest.approx([1 / (1 + math.exp(-z(row))) for row in bins])


def cells(text):
    """Places of all strings of one to three bytes, capitals of ASCII as small letters."""
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    found = {raw[i : i + k] for k in range(1, language.GRAMS + 1) for i in range(len(raw) - k + 1)}
    return {((int.from_bytes(s, "big") + (len(s) << 24)) * 2654435761 % 2**32) >> (32 - language.CELL_BITS) for s in found}


def test_presence():
    for texts in (SAMPLES, [""], ["", "ab", "", "c"]):
        got = language.presence(*joined(texts))
        assert [set(np.flatnonzero(row)) for row in got] == [cells(t) for t in texts]


def test_language_by_sets(spark):
    """With no more learnt rows than landmarks the model is kernel ridge regression on all of them: kernels by sets, weights
    by one solution; a row counts as one part of its language."""
    r = np.random.default_rng(3)
    letters = {"aa": "abcde", "bb": "cdefgh", "cc": "aeßüz"}
    rows = [(i, "".join(r.choice(list(letters[g] + "  "), 30)), g) for i, g in enumerate(np.repeat(sorted(letters), [50, 30, 12]).tolist())]
    rows = [*rows, (500, None, "aa"), (501, "12 3", "bb"), (502, "Abc DE", None), (503, "x" * 50_000, None)]
    learnt = [(cells(t), g) for i, t, g in rows if t is not None and g is not None and zlib.crc32(str(i).encode()) % 5]
    assert len(learnt) <= language.LANDMARKS and {g for _, g in learnt} == set(letters)
    kernel = lambda a, b: len(a & b) / math.sqrt(max(1, len(a)) * max(1, len(b)))
    K = np.array([[kernel(a, b) for b, _ in learnt] for a, _ in learnt])
    value, vector = np.linalg.eigh(K)
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    names, of = sorted(letters), [g for _, g in learnt]
    share = np.array([1 / of.count(g) for g in of])
    Z, Y = K @ root, np.where(np.array(of)[:, None] == np.array(names), 1.0, -1.0)
    W = np.linalg.solve(Z.T @ (share[:, None] * Z) + language.RIDGE * np.eye(len(of)), Z.T @ (share[:, None] * Y))
    got = language.identify(spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text", "lang"]), "doc_id long, text string, lang string")).toPandas().set_index("doc_id")
    assert len(got) == len(rows)
    for i, text, _ in rows:
        said = got.loc[i]
        assert said.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        if text is None or not re.search(r"[^\W\d_]", text):
            assert said.lang_pred == "und" and said.score == 0
            continue
        z = np.array([kernel(cells(text), c) for c, _ in learnt]) @ root @ W
        top = np.sort(z)
        assert said.score == pytest.approx(min(max((z.max() + 1) / 2, 0), 1), abs=2e-3)
        if top[-1] - top[-2] > 0.01:
            assert said.lang_pred == names[int(z.argmax())]
