"""Pieces of a step of the perplexity rules: counts against plain Python, distinct words once a step, and no sort of all words."""

import collections
import re

import numpy as np
import pytest

from mendtrace.llm import perplexity

TEXTS = ["", "a b\na b\r\na b\n\na b", "one two three four five " * 3 + "six", "é# ñ$\n\né# ñ$\n", "\n\n", "x", " one two three four five", "Ünü 漢字 <|>\nÜnü 漢字 <|>"] * 40 + ["many words in a row " * 50]


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {k for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), len(lines) - len(set(lines)), len(again)


def step(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@pytest.mark.parametrize("piece", [1, 40, 1 << 18])
def test_pieces_make_no_difference(monkeypatch, piece):
    monkeypatch.setattr(perplexity, "PIECE_BYTES", piece)
    raw, off = step(TEXTS)
    lang = np.arange(len(TEXTS)) % 3 // 2
    w = perplexity.words_of(lang, raw, off)
    got = perplexity.text_rules(w, raw, off)
    assert list(zip(*(got[c.split()[0]].tolist() for c in perplexity.COUNTS.split(", ")))) == [plain(t) for t in TEXTS]
    assert len(w.size) == len({(lang[i], v) for i, t in enumerate(TEXTS) for v in t.split()})
    _, hi, lo, back, told = perplexity.codes(w, None)
    grams = collections.Counter(zip(hi[back].tolist(), lo[back].tolist(), w.lang[told].tolist()))
    assert len(hi) == len(grams) and len(back) == len(told) == int((w.size + 1).sum())


@pytest.mark.parametrize("texts", [[], [""], ["", " \n "]])
def test_no_words(monkeypatch, texts):
    monkeypatch.setattr(perplexity, "PIECE_BYTES", 1)
    raw, off = step(texts)
    w = perplexity.words_of(np.zeros(len(texts), np.int64), raw, off)
    assert not len(w.size) and all(x.tolist() == [0] * len(texts) for x in perplexity.text_rules(w, raw, off).values())


def test_no_sort_of_all_words(monkeypatch):
    raw, off = step(TEXTS)
    sizes, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, *a, **k: (sizes.append(len(x)), unique(x, *a, **k))[1])
    w = perplexity.words_of(np.zeros(len(TEXTS), np.int64), raw, off)
    perplexity.codes(w, None)
    perplexity.text_rules(w, raw, off)
    assert max(sizes) < len(w.doc)  # lines only; before, words, windows and letters
