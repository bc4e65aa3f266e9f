"""Quality rules: counts of a text, and a modified Kneser-Ney model of its language's letters with bands of perplexity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: A symbol of the model has so many bits: 0 stands for a word's end (and three times before its start), a code point plus 1
#: for a letter, OTHER for letters that are not told apart. An n-gram of ORDER symbols is two longs, hi and lo, of two each.
BITS, ORDER = 21, 4
ONE, OTHER = (1 << BITS) - 1, 0x110001
#: Letters of a language that are told apart where not all are.
LETTERS = 62
#: N-grams that are broadcast at most, the most frequent ones; texts meet the others by a join.
MODEL_ROWS = 4_000_000
#: Parts of a natural log in which logs are added over shuffled rows, so that their order makes no difference.
UNIT = 1 << 30
#: Bytes of text whose distinct words one step counts or scores; a longer single text is a step of its own.
STEP_BYTES = 4 << 20
#: Bytes of a step that are looked at together, so that what is computed for each byte or place stays in a core's cache.
PIECE_BYTES = 1 << 18
#: A band reaches from the median WIDTH times as far as the quartile on either side, and SHORT / sqrt(letters) further, as
#: short texts scatter more.
WIDTH, SHORT = 3.0, 2.0
#: Perplexities are put in order in steps of so many parts of a natural log.
PARTS = 10_000
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass
class Words:
    """The words of a few texts: each distinct word of each language once, and where the words stand."""

    of: np.ndarray  # for each place its distinct word
    doc: np.ndarray  # for each place its text, in order
    start: np.ndarray  # for each place its first byte
    letters: np.ndarray  # code points of the distinct words, one word behind another
    size: np.ndarray  # letters in each
    lang: np.ndarray  # language of each
    ids: np.ndarray  # for each place a number of the word, whatever the language


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, in order of their first places, and which of them each place has; by hashing, without a sort."""
    got = pa.array(x).dictionary_encode()
    return got.dictionary.to_numpy(), got.indices.to_numpy().astype(np.int64)


def words_of(lang: np.ndarray, raw: np.ndarray, off: np.ndarray) -> Words:
    found, docs, starts = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, y in C.chunks(off, PIECE_BYTES):
        part, begins = raw[off[x] : off[y]], off[x : y + 1] - off[x]
        s, e = C.word_bounds(part, begins)
        ends = np.zeros(len(s) + 1, np.int64)
        np.cumsum(e - s, out=ends[1:])
        found.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(part[~C.SPACE[part]])]))
        docs.append(np.repeat(np.arange(x, y), np.diff(np.searchsorted(s, begins))))
        starts.append(s + off[x])
    told = pa.chunked_array(found, pa.large_binary()).dictionary_encode()
    told = told.combine_chunks() if len(told) else pa.array([], pa.large_binary()).dictionary_encode()
    doc, ids, many = np.concatenate(docs), told.indices.to_numpy().astype(np.int64), max(1, len(told.dictionary))
    key, of = distinct(lang[doc] * many + ids)
    data, begins = C.utf8(told.dictionary.take(pa.array(key % many)))
    letters = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return Words(of, doc, np.concatenate(starts), letters, np.diff(heads[begins]), key // many, ids)


def codes(w: Words, alphabets: list[np.ndarray] | None) -> tuple[np.ndarray, ...]:
    """(language, hi, lo) of the distinct n-grams, and for each letter and each end of a distinct word the n-gram that it ends
    and the word it is of. alphabets: each language's letters that are told apart, in order; None: all are."""
    of = np.repeat(np.arange(len(w.size)), w.size)
    symbol = w.letters.astype(np.int64) + 1
    for k in np.unique(w.lang) if alphabets is not None else ():
        mine = np.flatnonzero(w.lang[of] == k)
        symbol[mine[~np.isin(w.letters[mine], alphabets[k])]] = OTHER
    begin = np.cumsum(w.size + ORDER) - w.size - 1  # each word has ORDER - 1 marks before it and one behind it
    line = np.zeros(int((w.size + ORDER).sum()), np.int64)
    line[begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(w.size) - w.size, w.size)] = symbol
    told = np.repeat(np.arange(len(w.size)), w.size + 1)
    at = begin[told] + np.arange(len(told)) - np.repeat(np.cumsum(w.size + 1) - w.size - 1, w.size + 1)
    pairs, of_pair = distinct((line[:-1] << BITS) | line[1:])
    lang, n = w.lang[told], len(pairs)
    key, back = distinct((lang * n + of_pair[at - 3]) * n + of_pair[at - 1])
    return key // (n * n), pairs[key // n % n], pairs[key % n], back, told


def steps(b: pa.RecordBatch) -> Iterator[tuple[int, int, pa.DictionaryArray, np.ndarray, np.ndarray]]:
    """A few texts at a time: their range, their languages, their bytes and where each begins."""
    data, begins = C.utf8(b["text"])
    for x, y in C.chunks(begins, STEP_BYTES):
        yield x, y, b["lang"].slice(x, y - x).dictionary_encode(), data[begins[x] : begins[y]], begins[x : y + 1] - begins[x]


def alphabets(rows: DataFrame, told: int) -> dict[str, np.ndarray]:
    """Each language's `told` most frequent code points in words, ties to the smaller, in order."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, _, lang, raw, off in steps(b):
            w = words_of(lang.indices.to_numpy().astype(np.int64), raw, off)
            times = np.bincount(w.of, minlength=len(w.size))
            of = np.repeat(np.arange(len(w.size)), w.size)
            key, back = np.unique((w.lang[of] << 21) | w.letters, return_inverse=True)
            yield pa.record_batch({"lang": lang.dictionary.take(pa.array(key >> 21)).cast(pa.string()), "letter": (key & 0x1FFFFF).astype(np.int64), "n": np.bincount(back, times[of], len(key)).astype(np.int64)})

    got = rows.mapInArrow(C.per_batch(run), "lang string, letter long, n long").groupBy("lang", "letter").agg(F.sum("n").alias("n"))
    # At most one row for each language and code point; the first of a language are few.
    first = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "letter"))), 1, told)
    return {r["lang"]: np.array(sorted(x["letter"] for x in r["a"]), np.uint32) for r in got.groupBy("lang").agg(first.alias("a")).collect()}


def ngram_counts(rows: DataFrame, letters: dict[str, np.ndarray] | None) -> DataFrame:
    """(lang, hi, lo, n): how often each n-gram of ORDER symbols comes in all texts."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, _, lang, raw, off in steps(b):
            w = words_of(lang.indices.to_numpy().astype(np.int64), raw, off)
            if len(w.size):
                of, hi, lo, back, told = codes(w, told_apart(lang, letters))
                n = np.bincount(back, np.bincount(w.of, minlength=len(w.size))[told], len(hi)).astype(np.int64)
                yield pa.record_batch({"lang": lang.dictionary.take(pa.array(of)).cast(pa.string()), "hi": hi, "lo": lo, "n": n})

    return rows.mapInArrow(C.per_batch(run), "lang string, hi long, lo long, n long").groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n"))


def told_apart(lang: pa.DictionaryArray, letters: dict[str, np.ndarray] | None) -> list[np.ndarray] | None:
    return None if letters is None else [letters.get(x.as_py(), np.zeros(0, np.uint32)) for x in lang.dictionary]


def last(k: int) -> list[Column]:
    """hi and lo of an n-gram's last k symbols."""
    return [F.col(c).bitwiseAND(F.lit((1 << (BITS * min(2, max(0, n)))) - 1)).alias(c) for c, n in (("hi", k - 2), ("lo", k))]


def kneser_ney(counts: DataFrame, symbols: int | None) -> DataFrame:
    """(lang, hi, lo, n, log_p) from (lang, hi, lo, n): the interpolated modified Kneser-Ney model, as the log probability of
    each n-gram's last symbol. symbols: how many a language has; None: those that it uses.

    Lower orders count distinct symbols to the left. The three discounts of an order come from its counts of counts; where
    these are too few (one is 0, or a discount is out of its range) they are 0.5, 1 and 1.5. No n-gram is looked up that the
    model does not hold, as it counts all words of the texts that it scores.
    """
    orders = [C.stage_table(counts, f"counts-{ORDER}")]
    for k in range(ORDER - 1, 0, -1):
        orders.insert(0, C.stage_table(orders[0].groupBy("lang", *last(k)).agg(F.count("*").alias("n")), f"counts-{k}"))
    below = None
    for k, c in enumerate(orders, 1):
        t = c.groupBy("lang").agg(F.count("*").alias("used"), *(F.count(F.when(F.col("n") == i, 1)).cast("double").alias(f"t{i}") for i in range(1, 5)))
        y = F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2"))
        d = [i - (i + 1) * y * F.try_divide(F.col(f"t{i + 1}"), F.col(f"t{i}")) for i in (1, 2, 3)]
        fine = reduce(lambda a, b: a & b, [F.coalesce((F.col("t4") > 0) & (x > 0) & (x <= i), F.lit(False)) for i, x in enumerate(d, 1)])
        t = C.stage_table(t.select("lang", "used", *(F.when(fine, x).otherwise(i / 2).alias(f"d{i}") for i, x in enumerate(d, 1))), f"discounts-{k}")
        c = C.join_small(c, t, ["lang"], "inner").withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        # The context: all symbols but the last.
        c = c.withColumn("chi", F.shiftright("hi", BITS)).withColumn("clo", F.shiftleft(F.col("hi").bitwiseAND(F.lit(ONE)), BITS).bitwiseOR(F.shiftright("lo", BITS)))
        held = c.groupBy("lang", "chi", "clo").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("weight"))
        c = c.join(held, ["lang", "chi", "clo"]).select("lang", "hi", "lo", "n", "d", "total", "weight", "used")
        if below is None:
            c = c.withColumn("q", 1 / F.col("used") if symbols is None else F.lit(1 / symbols))
        else:
            hi, lo = last(k - 1)
            c = c.withColumn("thi", hi).withColumn("tlo", lo).join(below.select("lang", F.col("hi").alias("thi"), F.col("lo").alias("tlo"), F.col("p").alias("q")), ["lang", "thi", "tlo"])
        p = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("q")
        below = C.stage_table(c.select("lang", "hi", "lo", "n", p.alias("p")), f"probabilities-{k}")
    return below.select("lang", "hi", "lo", "n", F.log("p").cast("float").alias("log_p"))


@dataclass
class Model:
    """Logs of frequent n-grams: sorted keys of the pairs of symbols of each language, and of pairs of those."""

    names: list[str]
    pairs: np.ndarray
    keys: np.ndarray
    values: np.ndarray
    place: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.place = {x: i for i, x in enumerate(self.names)}

    def look(self, lang: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether n-grams are held, and their logs; a language without a number has -1 and holds none."""
        there, key = lang >= 0, np.zeros(len(lang), np.int64)
        if not len(self.keys):
            return np.zeros(len(lang), bool), np.zeros(len(lang))
        for half in (hi, lo):
            want = pair_keys(np.maximum(lang, 0), half)
            at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
            there = there & (self.pairs[at] == want)
            key = key * len(self.pairs) + at
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there &= self.keys[at] == key
        return there, np.where(there, self.values[at], 0.0)


def pair_keys(lang: np.ndarray, pair: np.ndarray) -> np.ndarray:
    return (lang.astype(np.uint64) << np.uint64(2 * BITS)) | pair.astype(np.uint64)


def read_model(rows: DataFrame) -> tuple[Model, int]:
    """The n-grams that come so often or oftener that they are MODEL_ROWS at most, and how often that is: a power of two, 1 if
    they are all. As the others come less often, none of them is hot."""
    digits = {r["d"]: r["c"] for r in rows.groupBy(F.length(F.bin("n")).alias("d")).agg(F.count("*").alias("c")).collect()}
    often, held = 1 << max(digits, default=0), 0
    for d in range(max(digits, default=0), 0, -1):
        held += digits.get(d, 0)
        if held > MODEL_ROWS:
            break
        often = 1 << (d - 1)
    first = rows.where(F.col("n") >= often)
    names = sorted(r["lang"] for r in first.select("lang").distinct().collect())
    numbers = rows.sparkSession.createDataFrame([(x, i) for i, x in enumerate(names)], "lang string, number int")
    got = first.join(F.broadcast(numbers), "lang").select("number", "hi", "lo", "log_p").toArrow()
    lang, hi, lo, values = (got[c].to_numpy() for c in ("number", "hi", "lo", "log_p"))
    left, right = pair_keys(lang, hi), pair_keys(lang, lo)
    pairs = np.unique(np.concatenate([left, right]))
    keys = np.searchsorted(pairs, left) * len(pairs) + np.searchsorted(pairs, right)
    order = np.argsort(keys)
    return Model(names, pairs, keys[order], values[order]), often


def repeated_lines(raw: np.ndarray, off: np.ndarray, words: np.ndarray) -> np.ndarray:
    """How many lines with a word each text has that equal an earlier one; words are the places where words begin."""
    n = len(off) - 1
    # Each line begins with a text or behind a line feed.
    feed = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], feed[feed + 1 < len(raw)] + 1]))
    ends = np.append(starts[1:], len(raw))
    ends = ends - (raw[ends - 1] == 10) if len(starts) else ends[:0]
    doc = np.searchsorted(off, starts, "right") - 1
    full = np.searchsorted(words, ends) > np.searchsorted(words, starts)
    want = np.flatnonzero(full & (np.bincount(doc[full], minlength=n) > 1)[doc])
    if not len(want):
        return np.zeros(n, np.int64)
    # Every other string is a line; between them stand line feeds and nothing.
    cut = np.append(np.stack([starts, ends], axis=1).ravel(), len(raw))
    lines = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(raw))])
    ids = lines.take(pa.array(2 * want)).dictionary_encode().indices.to_numpy().astype(np.int64)
    doc = doc[want]
    return np.bincount(doc, minlength=n) - np.bincount(distinct(doc * len(want) + ids)[0] // len(want), minlength=n)


def in_repeats(doc: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each word stands in a window of five words that its text repeats; windows are compared by 64-bit sums."""
    m = len(ids)
    if m < 5:
        return np.zeros(m, bool)
    win = C.mix(doc[: m - 4] + 7)
    each = C.mix(ids + 1)
    for k in range(5):
        win += each[k : m - 4 + k] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64)
    inside = np.flatnonzero(doc[: m - 4] == doc[4:])
    _, of = distinct(win[inside])
    at = inside[(np.bincount(of) > 1)[of]]
    edge = np.zeros(m + 1, np.int64)
    edge[at] += 1
    edge[at + 5] -= 1
    return np.cumsum(edge[:-1]) > 0


def text_rules(w: Words, raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text."""
    n = len(off) - 1
    symbols, lines, again = ([np.zeros(0, np.int64)] for _ in range(3))
    for x, y in C.chunks(off, PIECE_BYTES):
        part, begins = raw[off[x] : off[y]], off[x : y + 1] - off[x]
        i, j = np.searchsorted(w.start, [off[x], off[y]])
        symbols.append(np.diff(np.searchsorted(np.flatnonzero(SYMBOL[part]), begins)))
        lines.append(repeated_lines(part, begins, w.start[i:j] - off[x]))
        again.append(np.bincount(w.doc[i:j] - x, in_repeats(w.doc[i:j], w.ids[i:j]), y - x).astype(np.int64))
    return {
        "n_words": np.bincount(w.doc, minlength=n),
        "word_chars": np.bincount(w.doc, w.size[w.of], n).astype(np.int64),
        "n_symbols": np.concatenate(symbols),
        "n_dup_lines": np.concatenate(lines),
        "n_repeat_words": np.concatenate(again),
    }


def tails(w: Words, missed: np.ndarray, back: np.ndarray, told: np.ndarray, hi: np.ndarray, lo: np.ndarray, n: int) -> pa.Array:
    """For each of n texts the missed n-grams and how often they come in it."""
    names = ["hi", "lo", "times"]
    if not missed.any():
        none = pa.array([], pa.int64())
        return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.StructArray.from_arrays([none] * 3, names))
    bad = missed[back]
    grams, each = back[bad], np.bincount(told[bad], minlength=len(w.size))
    key, times = np.unique(w.doc * len(w.size) + w.of, return_counts=True)
    doc, word = key // max(1, len(w.size)), key % max(1, len(w.size))
    begin, size = (np.cumsum(each) - each)[word], each[word]
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin, size)
    key, of = np.unique(np.repeat(doc, size) * max(1, len(hi)) + grams[at], return_inverse=True)
    times = np.bincount(of, np.repeat(times, size), len(key)).astype(np.int64)
    doc, gram = key // max(1, len(hi)), key % max(1, len(hi))
    ends = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(hi[gram]), pa.array(lo[gram]), pa.array(times)], names))


def scored(rows: DataFrame, model: Model, letters: dict[str, np.ndarray] | None) -> DataFrame:
    """rows (key, lang, text) as (key, lang, COUNTS, letters, log_p, tail): each text's counts, the sum of log probabilities
    over its letters and word ends as far as the model holds them, and the n-grams that it does not hold."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = held.value
        for x, y, lang, raw, off in steps(b):
            w = words_of(lang.indices.to_numpy().astype(np.int64), raw, off)
            out = {"key": b["key"].slice(x, y - x), "lang": lang.cast(pa.string())} | text_rules(w, raw, off)
            count = np.bincount(w.doc, (w.size + 1)[w.of], y - x).astype(np.int64)
            number = np.array([model.place.get(v.as_py(), -1) for v in lang.dictionary])
            of, hi, lo, back, told = codes(w, told_apart(lang, letters)) if len(w.size) else [np.zeros(0, np.int64)] * 5
            there, p = model.look(number[of], hi, lo)
            total = np.bincount(w.doc, np.bincount(told, p[back], len(w.size))[w.of], y - x)
            tail = tails(w, ~there, back, told, hi, lo, y - x)
            yield pa.record_batch(out | {"letters": count, "log_p": pa.array(total, mask=count == 0), "tail": tail})

    return rows.mapInArrow(C.per_batch(run), f"key {rows.schema['key'].dataType.simpleString()}, lang string, {COUNTS}, letters long, log_p double, tail array<struct<hi: long, lo: long, times: long>>")


def with_tails(got: DataFrame, model: DataFrame) -> DataFrame:
    """got, staged and with a number for each row, with its texts' tails added to log_p; model has the rarer n-grams."""
    each = got.select("row", "lang", F.explode("tail").alias("t")).select("row", "lang", "t.*")
    part = F.col("times") * F.round(F.col("log_p").cast("double") * UNIT).cast("long")
    sums = each.join(model, ["lang", "hi", "lo"]).groupBy("row").agg((F.sum(part.cast("decimal(38,0)")).cast("double") / UNIT).alias("rest"))
    return got.join(sums, "row", "left").withColumn("log_p", F.col("log_p") + F.coalesce("rest", F.lit(0.0))).drop("rest")


def bands(scores: DataFrame, width: float) -> DataFrame:
    """(lang, low, high): each language's band of log perplexities, from a histogram of all of them in steps of 1 / PARTS."""
    bins = scores.groupBy("lang", F.round(F.col("log_perplexity") * PARTS).cast("long").alias("v")).agg(F.count("*").alias("n"))
    q = bins.groupBy("lang").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q"))
    a, b, c = (F.col("q")[i] for i in range(3))
    return q.select("lang", ((b - width * (b - a) - 1) / PARTS).alias("low"), ((b + width * (c - b) + 1) / PARTS).alias("high"))


def rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", width: float = WIDTH, short: float = SHORT, told: int | None = LETTERS) -> DataFrame:
    """(key, lang, COUNTS, base_failed, log_perplexity, low, high, kept) for each document.

    base_failed: under 10 words, or over 20 percent of the words in windows of five words that the text repeats. Others are
    kept if their perplexity by letter and word end lies within the band of their language. The model of a language counts
    the letters of all words of all its texts, whatever their length; bands are those of all texts that have not failed.
    told: how many of a language's letters, the most frequent, are told apart, others being one symbol; None: all are.

    Null and empty texts have no words, NULL for a perplexity, and fail; a null language is `und`, with a model and a band of
    its own; null keys and repeated rows are judged like others; a language of one text keeps it, as its band is that
    text's; no documents give no rows; other columns are ignored. A very long text is a step of its own.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    letters = None if told is None else alphabets(rows, told)
    model = kneser_ney(ngram_counts(rows, letters), None if told is None else told + 2)
    first, often = read_model(model)
    n = F.col("n_words")
    got = scored(rows, first, letters).withColumn("base_failed", (n < 10) | (100 * F.col("n_repeat_words") > 20 * n))
    got = C.stage_table(got.withColumn("row", F.monotonically_increasing_id()), "scored")
    if often > 1:
        got = C.stage_table(with_tails(got, model.where(F.col("n") < often)).drop("tail"), "whole")
    got = got.withColumn("log_perplexity", F.when(F.col("letters") > 0, -F.col("log_p") / F.col("letters")))
    band = C.stage_table(bands(got.where(~F.col("base_failed")), width), "bands")
    got = C.join_small(got, band, ["lang"], "left")
    further = short / F.sqrt(F.greatest("letters", F.lit(1)))
    inside = F.col("log_perplexity").between(F.col("low") - further, F.col("high") + further)
    return got.select(F.col("key").alias(key), "lang", *(c.split()[0] for c in COUNTS.split(", ")), "base_failed", "log_perplexity", "low", "high", (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), told=None).drop("lang", "low", "high")
