"""Texts that share a passage of words with another row: against brute force, below 400 bytes, and as a column of the query."""

import collections

import numpy as np
import pytest

from mendtrace.llm import repeats


def plain(rows, words):
    """For each row whether a run of so many of its words stands in another row."""
    runs = [{tuple(w[i : i + words]) for i in range(len(w) - words + 1)} for w in ((t or "").split() for _, t in rows)]
    rows_of = collections.Counter(r for x in runs for r in x)
    return [int(any(rows_of[r] > 1 for r in x)) for x in runs]


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(21)
    vocab = ["".join(r.choice(list("abcdefgé"), r.integers(1, 6))) for _ in range(300)]
    prose = lambda n: r.choice(vocab, n).tolist()
    line, out = prose(12), []
    for n in (10, 11, 20, 50, 51, 51, 52, 60, 90, 120):
        shared = prose(n)
        for _ in range(3):
            out.append(prose(int(r.integers(0, 90))) + shared + prose(int(r.integers(0, 90))))
    for _ in range(40):  # a very common line, and near copies with edits
        out.append(prose(40) + line + prose(40))
    base = prose(260)
    for i in range(120):
        at = set(r.integers(0, 260, i % 9).tolist())
        out.append([f"new{i}" if k in at else w for k, w in enumerate(base)][r.integers(0, 60) : 260 - int(r.integers(0, 60))])
    out += [base, base, base[:50], base[:51], prose(30) * 6, [], ["one"]]
    texts = [" \n".join(x) if i % 3 else "  ".join(x) for i, x in enumerate(out)]
    return [*enumerate(texts), (900, None), (901, "é " * 80), (901, "é " * 80), (902, "z " * 20), (902, "z " * 20), (None, "one two")]


@pytest.mark.parametrize(("words", "step"), [(51, 1 << 19), (51, 700), (12, 1 << 19)])
def test_passages_against_brute_force(spark, monkeypatch, rows, words, step):
    monkeypatch.setattr(repeats, "WORD_BYTES", step)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = repeats.remove_repeats(docs, passage=words).collect()
    assert sorted((-1 if x["doc_id"] is None else x["doc_id"], x["shares_passage"]) for x in got) == sorted((-1 if i is None else i, v) for (i, _), v in zip(rows, plain(rows, words), strict=True))


def test_a_full_filter_changes_nothing(spark, monkeypatch, rows):
    monkeypatch.setattr(repeats, "FILTER_BITS", 6)
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), passage=51).collect()
    assert sum(x["shares_passage"] for x in got) == sum(plain(rows, 51))


def test_the_query_tells_of_passages_under_400_bytes(spark, tmp_path):
    shared = " ".join(f"w{i:03}" for i in range(60))  # 299 bytes, so nothing is removed
    rows = [(1, "a b c " + shared + " d"), (2, "e " + shared + " f g"), (3, " ".join(f"x{i}" for i in range(200))), (4, shared[:240])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = repeats.op8(spark, str(tmp_path)).collect()
    assert sorted((x["doc_id"], x["n_removed"], x["shares_passage"]) for x in got) == [(1, 0, 1), (2, 0, 1), (3, 0, 0), (4, 0, 0)]
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), passage=51).count() == 0
