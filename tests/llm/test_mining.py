"""Phrase mining, resampling and perplexity rules against brute force, and their edge cases."""

import collections
import re

import numpy as np

from mendtrace.llm import collocations, decontaminate, jaccard_join, mih, perplexity, resample

DOCS = "doc_id long, text string, lang string, f long, phrase string, n long, w string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2, "w") for r in rows], DOCS).repartition(3)


def plain_collocations(rows, often, inside, scale, top):
    f, total = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for n in range(1, 5):
                f.update((lang or "und", tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= often}
    out = collections.defaultdict(list)
    for (lang, p), a in cand.items():
        longer = [b for (l2, q), b in cand.items() if l2 == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= inside * a for b in longer):
            continue
        score, k = min((scale * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), a, f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), a, le, r, total[lang], -s) for lang, xs in out.items() for i, (s, _, p, a, le, r) in enumerate(sorted(xs)[:top])}


def test_collocations_against_brute_force(spark, monkeypatch):
    r = np.random.default_rng(5)
    words = ["the", "of", "Éa", "ÉA", "new", "york", "CITY", "a-b", "\x00x", "café\x0bau"]
    rows = [(i, "".join(str(w) + str(s) for w, s in zip(r.choice(words, 60, p=[0.2, 0.2, 0.1, 0.1, 0.1, 0.1, 0.1, 0.04, 0.03, 0.03]), r.choice([" ", " ", " ", "\t ", ". ", "\n"], 60))), [None, "en", "fr", "und"][i % 4]) for i in range(60)]
    rows += [(None, None, None), (1, "", "en"), (2, " .. ,", "en"), (3, "New York City " * 400, "en"), (3, "New York City " * 400, "en"), (4, "alone", "xx"), (5, "z" * 70_000 + " the of", "en")]
    for top in (2000, 7):
        want = plain_collocations(rows, 5, 80, 2_000_000, top)
        got = {tuple(x) for x in collocations.collocations(frame(spark, rows), often=5, top=top).collect()}
        assert got == want and len(want) > (0 if top == 7 else 60)
    monkeypatch.setattr(collocations, "SHARD_BYTES", 700)  # small shards, and a filter so full that it tells nothing apart
    monkeypatch.setattr(collocations, "FILTER_BITS", (6, 6))
    assert {tuple(x) for x in collocations.collocations(frame(spark, rows), often=5, top=7).collect()} == want


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, [(1, "a b", "en")]).limit(0)).count() == 0
    assert collocations.collocations(frame(spark, [(1, "a b", "en"), (2, None, None), (3, "", None)])).count() == 0


def test_collocation_sums_pass_64_bits(spark):
    big = spark.createDataFrame([("en", "", 0, 2**62), ("en", "a", 1, 2**61), ("en", "b", 1, 2**61), ("en", "a b", 2, 2**60)], "lang string, phrase string, words int, f long")
    real, collocations.frequent_phrases = collocations.frequent_phrases, lambda *a: big
    try:
        row = collocations.collocations(None).first()
    finally:
        collocations.frequent_phrases = real
    assert (row["a"], row["l"], row["r"], row["n"], row["score"]) == (2**60, 2**61, 2**61, 2**62, 500_000)


def test_resampling_of_edge_cases(spark):
    import hashlib
    import math
    import zlib

    words = [f"w{i}" for i in range(30)] + ["É", "ñandú", "日本"]
    r = np.random.default_rng(3)
    rows = [(i // 2 if i % 7 else None, " ".join(r.choice(words, r.integers(0, 60))).upper() if i % 5 else " --".join(r.choice(words, 30)), "en") for i in range(120)]
    rows += [(500, None, None), (501, "", "en"), (502, "...", "en"), (503, "w1 " * 50_000, "en")]
    target = [(1, "W1 w2 w3, w1!", "x"), (2, None, None), (3, "other ñandú", "x")]
    feats = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    of = lambda w: zlib.crc32(w.encode()) % 10000
    s, t = collections.Counter(of(w) for x in rows for w in feats(x[1])), collections.Counter(of(w) for x in target for w in feats(x[1]))
    ns, nt = sum(s.values()), sum(t.values())
    want = []
    for i, text, _ in rows:
        f = feats(text)
        weight = sum(math.floor(1000 * math.log((t[of(w)] + 1) * (ns + 10000) / ((s[of(w)] + 1) * (nt + 10000)))) for w in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    drawn = sorted((w for w in want if w[1] >= 20), key=lambda w: (-w[3], w[0] is None, w[0]))
    for k, w in enumerate(drawn[: 10 * len(drawn) // 100]):
        w[4] = k + 1
    key = lambda x: tuple((v is None, v) for v in x)
    got = sorted(map(tuple, resample.resample(frame(spark, rows), frame(spark, target)).collect()), key=key)
    assert got == sorted(map(tuple, want), key=key) and sum(w[4] is not None for w in want) > 5
    nothing = frame(spark, rows).limit(0)
    assert resample.resample(nothing, frame(spark, target)).count() == 0
    assert resample.resample(frame(spark, rows), nothing).where("weight <> 0").count() > 0


def test_resampling_splits_buckets(spark, monkeypatch):
    rows = [(i, f"the w{i % 9} " * 30, "en") for i in range(80)]
    want = {tuple(r) for r in resample.resample(frame(spark, rows), frame(spark, rows[:3])).collect()}
    monkeypatch.setattr(resample, "BLOCK_BYTES", 300)
    monkeypatch.setattr(resample, "SPLIT_BLOCKS", 7)
    assert {tuple(r) for r in resample.resample(frame(spark, rows), frame(spark, rows[:3])).collect()} == want


def plain_model(rows):
    """Log perplexities by letter, from dictionaries of tuples."""
    import math

    out = {}
    for lang in {x[2] or "und" for x in rows}:
        mine = [x for x in rows if (x[2] or "und") == lang]
        words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
        letters = collections.Counter(c for x in mine for w in words(x[1]) for c in w)
        top = {c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], ord(x[0])))[:62]}
        grams = lambda w: [tuple(s[i - 3 : i + 1]) for s in [["end"] * 3 + [c if c in top else "other" for c in w] + ["end"]] for i in range(3, len(s))]
        c = {4: collections.Counter(g for x in mine for w in words(x[1]) for g in grams(w))}
        for k in (3, 2, 1):
            c[k] = collections.Counter(g[1:] for g in c[k + 1])
        disc, ctx = {}, {k: collections.defaultdict(lambda: [0, 0.0]) for k in c}
        for k in c:
            t = [sum(v == i for v in c[k].values()) for i in range(1, 5)]
            d = [0.5, 1.0, 1.5]
            if all(t):
                y = t[0] / (t[0] + 2 * t[1])
                e = [i - (i + 1) * y * t[i] / t[i - 1] for i in (1, 2, 3)]
                d = e if all(0 < v <= i for i, v in enumerate(e, 1)) else d
            disc[k] = d
            for g, v in c[k].items():
                ctx[k][g[:-1]][0] += v
                ctx[k][g[:-1]][1] += d[min(v, 3) - 1]

        def p(g):
            if not g:
                return 1 / 64
            total, off = ctx[len(g)].get(g[:-1], (0, 0))
            if not total:
                return p(g[1:])
            v = c[len(g)].get(g, 0)
            return (max(v - disc[len(g)][min(v, 3) - 1], 0) if v else 0) / total + off / total * p(g[1:])

        for i, text, _ in mine:
            g = [x for w in words(text) for x in grams(w)]
            out[i] = -sum(math.log(p(x)) for x in g) / len(g) if g else None
    return out


def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {k for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), len(lines) - len(set(lines)), len(again)


def test_perplexity_rules_against_brute_force(spark, monkeypatch):
    r = np.random.default_rng(9)
    abc = list("etaoinshrdlucmfwypv") + [chr(0x4E00 + i) for i in range(60)]
    word = lambda n=19: "".join(r.choice(abc[:n], r.integers(1, 9)))
    vocab = [word() for _ in range(60)] + [word(79) for _ in range(20)]
    rows = [(i, "".join(str(w) + str(s) for w, s in zip(r.choice(vocab, 80), r.choice([" ", " ", "\n", "\t", ". ", " #"], 80))), [None, "en", "zz"][i % 3]) for i in range(50)]
    rows += [(100, None, None), (101, "", "en"), (102, " \n ", "only"), (103, "a b\na b\r\na b\n\na b", "en"), (104, "one two three four five " * 3 + "six", "en"), (105, "x" * 70_000, "en"), (106, "$%& <|>* " * 30, "en"), (107, "Q9 " + rows[1][1], "en"), (108, "zqj xkq wvz qqq zzz jjj kkk vvv xxx yyy www zqz qzq kjk", "en"), (109, "solo " * 3, "uno")]
    rows += [(110, rows[2][1], "en"), (110, rows[2][1], "en")]
    want = plain_model(rows)
    for step in (2 << 20, 900):
        monkeypatch.setattr(perplexity, "STEP_BYTES", step)
        monkeypatch.setattr(perplexity, "MODEL_ROWS", 4_000_000 if step > 900 else 10)  # a part for each language
        got = perplexity.rules(frame(spark, rows)).collect()
        assert len(got) == len(rows)
        text = {i: t for i, t, _ in rows}
        for x in got:
            i = x["doc_id"]
            assert tuple(x[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_counts(text[i]), i
            assert (x["log_perplexity"] is None) == (want[i] is None) and (want[i] is None or abs(x["log_perplexity"] - want[i]) < 1e-5), i
            assert x["base_failed"] == (x["n_words"] < 10 or 100 * x["n_repeat_words"] > 20 * x["n_words"])
            inside = x["low"] is None or x["log_perplexity"] is None or x["low"] - 2 / (sum(len(w) + 1 for w in (text[i] or "").split())) ** 0.5 <= x["log_perplexity"] <= x["high"] + 2 / (sum(len(w) + 1 for w in (text[i] or "").split())) ** 0.5
            assert x["kept"] == (not x["base_failed"] and inside), i
        kept = {x["doc_id"] for x in got if x["kept"]}
        assert 108 not in kept and set(range(45)) <= kept
    assert perplexity.rules(frame(spark, rows).limit(0)).count() == 0
    assert {(x["doc_id"], x["kept"]) for x in perplexity.rules(frame(spark, [(None, None, None), (1, "", "en")])).collect()} == {(None, False), (1, False)}


def leaks(spark, items, texts):
    got = decontaminate.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    return {(r["doc_id"], r["item_id"], r["kind"]) for r in got.collect()}


def test_copies_behind_any_lead_in(spark):
    items = ["What is the capital of Peru", "What is the capital city of northern Peru", "Compute 12 + 45 + 67", "Tom buys 3 pens. Each pen costs 2 dollars. Sara buys 4 pads. Each pad costs 5 dollars. Who pays more?", "Paris and Rome", "Name Anna Smith 1 2 3 4 5 6 7 8"]
    leads = ["he asked us ", "He asked Peter ", "the, ", "x. ", "said: ", "line\n", "été ", "12 ", "John and Mary Ann ", "(", "THE END OF IT "]
    texts = [lead + item + tail for item in items for lead in leads for tail in (" and so on", ", Bob.", " Bob said no")] + items
    want = {(i, i // (3 * len(leads)), "exact") for i in range(len(texts) - len(items)) if i // (3 * len(leads)) != 4}
    want |= {(len(texts) - len(items) + i, i, "exact") for i in range(len(items))}
    got = leaks(spark, items, texts)
    assert {x[:2] for x in got} >= {x[:2] for x in want}
    assert not {x for x in got if x[1] == 4 and x[0] < len(texts) - len(items)}  # three words are looked for as whole texts only


def test_copies_with_other_names(spark):
    word = "{0} buys {2} pens. Each pen costs {3} dollars. {1} buys {4} pads. Each pad costs {5} dollars. Who pays more?"
    run = "{0} ran {1} miles along the old river road before the heavy rain began to fall in the evening"
    items = [word.format("Tom", "Sara", 3, 2, 4, 5), run.format("James", 5)]
    texts = [word.format("Jim", "Ann", 7, 9, 8, 6), word.format("Jim", "Ann", 3, 2, 4, 5), "he said " + word.format("Jim", "Ann Lee", 7, 9, 8, 6), run.format("Peter", 5), run.format("James", 5), run.format("James", 6), word.format("Jim", "Jim", 7, 9, 8, 6), "Nobody buys pens here. The pads are free, and rain fell."]
    assert leaks(spark, items, texts) == {(0, 0, "reparameterised"), (1, 0, "reparameterised"), (2, 0, "reparameterised"), (3, 1, "reparameterised"), (4, 1, "exact"), (5, 1, "reparameterised")}


def test_jaccard_join_with_few_and_many_parts(spark, monkeypatch):
    r = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choice(words, 80)) for _ in range(30)]
    rows = [(i, base[i % 30] + f" {'x' if i % 2 else 'y'} z" * (i % 3), "en") for i in range(200)] + [(None, None, "en"), (201, base[0] * 40, "en")]
    key = lambda x: tuple((v is None, v) for v in x)
    every = []
    for part_bytes, at_once in ((1 << 30, 16 << 20), (60, 16 << 20), (1 << 30, 5000)):
        monkeypatch.setattr(jaccard_join, "SORTED", at_once)
        every.append(sorted(map(tuple, jaccard_join.jaccard_classes(frame(spark, rows), part_bytes=part_bytes).collect()), key=key))
    assert every[0] == every[1] == every[2] and len({x[2] for x in every[0]}) < 60


def test_vectors_of_several_lengths(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=8 if i % 3 else 5)]) for i in range(120)] + [(200, [1.0]), (220, None), (240, [0.0, 0.0]), (260, [1.0, float("nan")])]
    got = collections.defaultdict(dict)
    for x in mih.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=200).collect():
        got[x["query_id"]][x["vec_id"]] = x["score"]
    v = {i: x for i, x in rows if i < 120}
    want = {q: {i: float(np.dot(v[q], x)) for i, x in v.items() if i != q and len(x) == len(v[q])} for q in v if q % 20 == 0}
    assert {q: set(x) for q, x in got.items()} == {q: set(x) for q, x in want.items()}
    assert all(abs(got[q][i] - s) < 1e-9 for q in want for i, s in want[q].items())
