"""Texts of about a megabyte, whole to the last byte, and tables without rows."""

import hashlib

import numpy as np
import pytest

from mendtrace.llm import chat_tree, language, packing, pii, quality, repeats, secrets

R = np.random.default_rng(4)
LONG = " ".join("".join(w) for w in R.choice(list("ghijklmnopqrstuvw"), (110_000, 8)))
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG + " token: Zz9Zz9Zz9", "en"), (2, LONG[::-1] + " mail é a.b@c.de", None), (3, "short words", "en")]
    return spark.createDataFrame(rows, SCHEMA)


def test_secrets_and_personal_data_at_the_end(docs):
    end = len(LONG)
    found = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    assert [found[i].n_assign for i in (1, 2, 3)] == [1, 0, 0] and found[1].spans == f"assign:{end + 1}:{end + 17}"
    found = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    assert [found[i].n_email for i in (1, 2, 3)] == [0, 1, 0] and found[2].spans == f"email:{end + 8}:{end + 16}"


def test_repeats_at_both_ends(spark):
    text = LONG[:5_000] + "|" + LONG[5_000:] + "#" + LONG[:5_000]
    got = repeats.remove_repeats(spark.createDataFrame([(1, text), (2, LONG[::-1])], "doc_id long, text string")).toPandas().set_index("doc_id")
    kept = "|" + LONG[5_000:] + "#"
    assert list(got.loc[1, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]]) == [len(text), 10_000, 2, hashlib.sha256(kept.encode()).hexdigest()]
    assert got.loc[2, "n_removed"] == 0


def test_models_read_the_last_words(spark, docs):
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert quality.score_quality(docs, labels).where("score between 0 and 1").count() == 3
    said = {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}
    assert said == {1: "en", 2: "en", 3: "en"}
    digits = spark.createDataFrame([(1, "1 " * 500_000 + "é", "x"), (2, "1 " * 500_000, "x")], SCHEMA)
    assert {r.doc_id: r.lang_pred for r in language.identify(digits).collect()} == {1: "x", 2: "und"}


def test_packing_cuts_at_the_capacity(docs):
    import public_tokenizers

    got = packing.best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json")).toPandas().sort_values(["doc_id", "piece"])
    for _, one in got.groupby("doc_id"):
        assert list(one.piece) == list(range(len(one))) and list(one.start) == [2048 * p for p in one.piece] and (one.length[:-1] == 2048).all()
    assert (got.doc_id == 1).sum() > 100 and got.groupby("sequence_id").length.sum().max() <= 2048


def test_conversations(spark):
    turns = [(1, 0, "user", LONG), (1, 1, "assistant", LONG[::-1]), (2, 0, "user", LONG), (2, 1, "assistant", "no")] + [(3, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(400)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv: r for r in chat_tree.read_back(*chat_tree.build_tree(df)).collect()}
    for c in (1, 2, 3):
        mine = [(role, text) for conv, _, role, text in turns if conv == c]
        assert got[c].n_turns == len(mine) and got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256("".join(b for a, b in mine if a == "assistant").encode()).hexdigest()
    assert [x.count() for x in chat_tree.build_tree(df.limit(0))] == [0, 0, 0] and chat_tree.read_back(*chat_tree.build_tree(df.limit(0))).count() == 0
