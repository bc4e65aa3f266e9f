"""Benchmark decontamination by template canonicalisation, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

# What becomes a typed slot. Signs 1-3 mark numbers, names and units; the value stays behind the sign, its
# parts (a number's digit groups, the words of a run of names) held together by sign 4.
POINT = r"(?<=[0-9])[.,:/](?=[0-9])"
NUMBER = r"([0-9]+(?:\x{04}[0-9]+)*)"
# Capitalised words that are no names wherever they stand.
PLAIN = (
    "A An And Are As At Because But By Calculate Can Compute Could Did Do Does During Each Every Explain Find For From Given Has Have He Her His How I If In Is It Its "
    "Let My No Not Now Of On One Or Our She Show So Solve Some State Suppose That The Their Then There These They This Those To Was We What When Where Which While Who Whose Why Will With Write Yes You Your"
)
#: Any other capitalised word is a name, whatever stands before it, so an item is typed alike wherever it is copied to.
CAPITAL = rf"(?!(?:{PLAIN.replace(' ', '|')})\b)[A-Z][A-Za-z'-]"
NAME = rf"(?<![\p{{L}}'-])({CAPITAL}++(?:\x20{CAPITAL}++)*+)"
NAME_GAP = rf"(\x{{02}}[A-Za-z\x{{04}}]+|(?!^)\G[A-Za-z\x{{04}}]+)(?:\x20(?={CAPITAL})|['-](?!s\b)(?=[A-Za-z]))"
UNIT = r"(\x{01}[0-9\x{04}]+\s*-?)(km|cm|mm|kg|mg|ml|mph|hours?|minutes?|seconds?|days?|weeks?|years?|miles?|metres?|meters?|dollars?|euros?|percent)\b"
CUT = r"[\x20\x09-\x0D!-/:-@\[-`{-~]+"
#: Cuts at slots' signs and digits too, so every word between slots is a piece.
PLAIN_CUT = r"[\x01-\x04\x20\x09-\x0D!-@\[-`{-~]+"
DIGITS_CUT = r"[^0-9]+"
#: Tokens in a window, and the share of an item's windows that a document must hold.
WINDOW, COVER = 8, 0.5
#: Tokens of a window that must not be slots; an item without such a window is found only with its own values.
LITERAL = 5
#: Tokens of the shortest item that is looked for within longer texts.
SHORTEST = 4


def tokens(text: Column) -> Column:
    """Lower-case tokens of the canonical text; a slot keeps its value behind its sign."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x01-\x04]", " ")
    t = F.regexp_replace(F.regexp_replace(t, NAME, " \x02$1"), NAME_GAP, "$1\x04")
    t = F.regexp_replace(t, POINT, "\x04")
    t = F.regexp_replace(t, NUMBER, " \x01$1 ")
    t = F.regexp_replace(t, UNIT, "$1 \x03$2")
    return F.filter(F.split(F.lower(t), CUT), lambda x: x != "")


def plain_tokens(text: Column) -> Column:
    """Lower-case tokens without any slots: a copy has them whatever stands around it."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x01-\x04]", " "), CUT), lambda x: x != "")


def is_slot(x: Column) -> Column:
    return x < "\x04"


def typed(x: Column) -> Column:
    """The token, or its sign alone if it is a slot."""
    return F.when(is_slot(x), F.substring(x, 1, 1)).otherwise(x)


def windows(toks: Column, width: int, values: bool = False) -> Column:
    """Hashes of all windows of `width` typed tokens (a power of two); all tokens make one if there are fewer.

    With `values`, slots are hashed with what they hold; these hashes never equal the others."""
    n = F.size(toks)
    one = (lambda x: F.concat(F.lit("="), x)) if values else typed
    h = F.transform(toks, lambda x: F.xxhash64(one(x)))
    step = 1
    while step < width:
        h = F.zip_with(h, F.slice(h, F.lit(step + 1), F.greatest(n - step, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        step *= 2
    short = F.when(n > 0, F.array(F.xxhash64(F.transform(toks, one)))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n >= width, F.slice(h, F.lit(1), F.greatest(n - (width - 1), F.lit(0)))).otherwise(short)


def slid(toks: Column, width: Column | int) -> Column:
    """Hashes of all runs of `width` tokens with their values, for items shorter than a window."""
    runs = F.transform(F.sequence(F.lit(1), F.size(toks) - (width - 1)), lambda i: F.xxhash64(F.lit(width), F.slice(toks, i, F.lit(width))))
    return F.when(F.size(toks) >= width, runs).otherwise(F.array().cast("array<bigint>"))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", width: int = WINDOW, cover: float = COVER) -> DataFrame:
    """(key, item, n_windows, n_found, kind) for documents that hold a benchmark item, also one with other slot values.

    Numbers, names and units become typed placeholders; windows of `width` placeholders and words are joined by hash. A
    pair counts if at least `cover` of the item's windows stand in the document, and if slots are consistent in one of the
    alignments that hold so many windows (or, if none does, most of them): within these windows equal values in the item
    stand for equal values in the document and the other way round. kind is `exact` if the values are the item's own, else
    `reparameterised`. Windows with fewer than LITERAL plain words say too little without their values: an item that has
    only such windows is looked up by windows with values. Items with names and short ones are also looked up by windows of
    plain words, so a copy is found whatever stands before it; kind is `exact` where only these are found. Items of fewer than `width` tokens are compared with whole
    documents, and if they have SHORTEST tokens, also with their values anywhere in a document. Items or documents without
    tokens never match; null items and null keys can be reported as such; repeated rows are reported once per key and item;
    other columns are ignored; without documents or items there are no rows. Very long texts are looked through whole.

    The benchmark's anchors and windows are broadcast only if their counted rows are within a bound, else both sides are
    shuffled. A first pass over all texts looks for the anchors; windows are made only where enough of them stand.
    """
    items = benchmark.select(F.col(item).alias("item"), tokens(F.col(text)).alias("toks"), plain_tokens(F.col(text)).alias("plain")).where(F.size("toks") > 0)
    items = C.stage_table(items.dropDuplicates(), "items")
    part = F.slice("toks", F.col("at") + 1, F.lit(width))
    words = F.filter(part, lambda x: ~is_slot(x))
    enough = F.size(words) >= F.least(F.lit(LITERAL), F.size("toks"))
    longest = lambda x: F.array_max(F.transform(x, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    loose = items.select("item", "toks", F.posexplode(windows(F.col("toks"), width)).alias("at", "h")).where(enough).select("item", "at", "h", longest(words).alias("anchor"))
    # Items of which no window has enough plain words are looked up with the values of their slots.
    rest = items.join(loose.select(F.col("item").alias("l_item")).distinct(), F.col("item").eqNullSafe(F.col("l_item")), "left_anti")
    rest = rest.select("item", "toks", F.posexplode(windows(F.col("toks"), width, True)).alias("at", "h"))
    pieces = lambda t, cuts: F.flatten(F.array(*(F.split(t, c) for c in cuts)))
    short = items.where(F.size("toks").between(SHORTEST, width - 1)).select("item", "toks", F.posexplode(F.array(F.xxhash64(F.size("toks"), "toks"))).alias("at", "h"))
    short_widths = sorted(r[0] for r in short.select(F.size("toks")).distinct().collect())  # a few numbers below `width`
    rest = rest.union(short)
    dense = C.stage_table(rest.select("item", "at", "h", longest(pieces(F.array_join(part, " "), (PLAIN_CUT, DIGITS_CUT))).alias("anchor")), "dense")
    any_dense = dense.limit(1).count() > 0
    grid = C.stage_table(loose.union(dense), "windows")
    # A name that other names stand before is one slot with them, and a copy may have other capitals, so items with names and
    # short ones are looked up as plain words too.
    n_plain = F.size("plain")
    own = F.when(n_plain.between(SHORTEST, width - 1), slid(F.col("plain"), n_plain)).otherwise(windows(F.col("plain"), width, True))
    copies = items.where((n_plain < width) | F.exists("toks", lambda x: x.startswith("\x02"))).select("item", "plain", F.posexplode(own).alias("at", "h"))
    stretch = F.array_join(F.slice("plain", F.col("at") + 1, F.lit(width)), " ")
    in_words, in_digits = (longest(F.split(stretch, c)) for c in (PLAIN_CUT, DIGITS_CUT))
    copies = copies.select("item", n_plain.alias("n"), "h", F.when(in_words != "", in_words).otherwise(in_digits).alias("anchor"), (in_words == "").alias("digits"))
    copies = C.stage_table(copies, "copies")
    copy_widths = sorted(r[0] for r in copies.where(F.col("n").between(SHORTEST, width - 1)).select("n").distinct().collect())  # a few numbers below `width`
    by_digits = any_dense or copies.where("digits").limit(1).count() > 0
    copy_need = copies.groupBy(F.col("item").alias("t_item")).agg(F.count_distinct("h").alias("n_windows"))
    copy_need = C.stage_table(copy_need.withColumn("need", F.ceil(F.col("n_windows") * cover)), "copy-total")
    kinds = lambda toks: [windows(toks, width), *([windows(toks, width, True)] if any_dense else []), *(slid(toks, w) for w in short_widths)]
    total = grid.groupBy(F.col("item").alias("t_item")).agg(F.count_distinct("h").alias("n_windows"))
    total = C.stage_table(total.withColumn("need", F.ceil(F.col("n_windows") * cover)), "total")
    hashes = C.stage_table(grid.select("h", "item").distinct(), "hashes")

    # A window needs its anchor, its longest word: only documents whose words are anchors of enough windows are looked at.
    def anchors(windows: DataFrame, need: DataFrame, way: int) -> DataFrame:
        per = windows.groupBy("item", F.xxhash64("anchor").alias("a")).agg(F.count_distinct("h").alias("w"))
        return per.join(need, F.col("item").eqNullSafe(F.col("t_item"))).select("a", "item", F.lit(way).alias("way"), "w", "need")

    marks = C.stage_table(anchors(grid, total, 0).union(anchors(copies, copy_need, 1)), "marks")
    src = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("version"))
    said = src.select("id", "version", F.explode(F.array_distinct(pieces(F.lower("text"), (PLAIN_CUT, DIGITS_CUT)[: 1 + by_digits]))).alias("word")).select("id", "version", F.xxhash64("word").alias("a"))
    likely = C.join_small(said, marks, ["a"], "inner").groupBy("id", "version", "item", "way", "need", "a").agg(F.min("w").alias("w"))
    likely = C.stage_table(likely.groupBy("id", "version", "item", "way", "need").agg(F.sum("w").alias("w")).where("w >= need").select("id", "version").distinct(), "likely")
    # From here on equal texts, which share a version, are looked at once.
    few = C.join_small(src.select("version", "text"), likely.select("version").distinct(), ["version"], "left_semi").groupBy("version").agg(F.first("text").alias("text"))
    again = C.stage_table(few.select("version", tokens(F.col("text")).alias("toks"), plain_tokens(F.col("text")).alias("plain")), "again")

    said = again.select("version", F.explode(F.concat(*kinds(F.col("toks")))).alias("h"))
    found = C.join_small(said, hashes, ["h"], "inner").groupBy("version", "item").agg(F.count_distinct("h").alias("n_found"))
    found = C.stage_table(found.join(total, F.col("item").eqNullSafe(F.col("t_item"))).where("n_found >= need").drop("t_item"), "found")

    plain = F.concat(windows(F.col("plain"), width, True), *(slid(F.col("plain"), w) for w in copy_widths))
    held = again.select("version", F.explode(plain).alias("h"))
    held = C.join_small(held, C.stage_table(copies.select("h", "item").distinct(), "copy-hashes"), ["h"], "inner").groupBy("version", "item").agg(F.count_distinct("h").alias("n_found"))
    held = held.join(copy_need, F.col("item").eqNullSafe(F.col("t_item"))).where("n_found >= need").select("version", "item", "n_windows", "n_found", F.lit("exact").alias("kind"))

    # Alignments and slots of the texts that are left.
    again = C.stage_table(C.join_small(again.drop("plain"), found.select("version").distinct(), ["version"], "left_semi"), "near")
    places = [again.select("version", F.posexplode(c).alias("place", "h")) for c in kinds(F.col("toks"))]
    places = reduce(DataFrame.union, places).join(grid, "h")
    shifts = places.groupBy("version", "item", (F.col("place") - F.col("at")).alias("shift")).agg(F.count("*").alias("held"))
    kept = found.select(F.col("version").alias("k_version"), F.col("item").alias("k_item"), "need")
    shifts = shifts.join(kept, (F.col("version") == F.col("k_version")) & F.col("item").eqNullSafe(F.col("k_item"))).select("version", "item", "shift", "held", "need")
    shifts = C.stage_table(shifts, "shifts")
    top = shifts.groupBy(F.col("version").alias("k_version"), F.col("item").alias("k_item")).agg(F.max("held").alias("most_held"))
    best = shifts.join(top, (F.col("version") == F.col("k_version")) & F.col("item").eqNullSafe(F.col("k_item"))).where(F.col("held") >= F.least("need", "most_held")).select("version", "item", "shift")
    # Only slots within windows that match there, few plain words or not: beyond an edit the alignment is out of step.
    aims = items.select(F.col("item").alias("h_item"), windows(F.col("toks"), width).alias("item_h"))
    best = best.join(aims, F.col("item").eqNullSafe(F.col("h_item"))).join(again.select("version", windows(F.col("toks"), width).alias("text_h")), "version")
    ats = F.filter(F.sequence(F.lit(0), F.size("item_h") - 1), lambda a: F.get("item_h", a) == F.get("text_h", a + F.col("shift")))
    best = C.stage_table(best.select("version", "item", "shift", ats.alias("ats")), "best")
    covered = F.exists("ats", lambda a: (F.col("at") >= a) & (F.col("at") < a + width))
    mine = items.select(F.col("item").alias("m_item"), F.posexplode("toks").alias("at", "own")).where(is_slot(F.col("own")))
    pairs = best.join(mine, F.col("item").eqNullSafe(F.col("m_item"))).where(covered).select("version", "item", "shift", (F.col("at") + F.col("shift")).alias("place"), "own")
    theirs = again.select(F.col("version").alias("v"), F.posexplode("toks").alias("p", "other")).where(is_slot(F.col("other")))
    pairs = pairs.join(theirs, (F.col("version") == F.col("v")) & (F.col("place") == F.col("p"))).select("version", "item", "shift", "own", "other")
    one_way = pairs.groupBy("version", "item", "shift", "own").agg(F.count_distinct("other").alias("n"), F.max(F.col("own") != F.col("other")).alias("changed"))
    back = pairs.groupBy("version", "item", "shift", "other").agg(F.count_distinct("own").alias("n"), F.lit(False).alias("changed"))
    slots = one_way.drop("own").union(back.drop("other")).groupBy("version", "item", "shift").agg(F.max("n").alias("most"), F.max("changed").alias("changed"))
    slots = slots.select(*(F.col(c).alias(f"s_{c}") for c in ("version", "item", "shift")), "most", "changed")
    same = (F.col("version") == F.col("s_version")) & F.col("item").eqNullSafe(F.col("s_item")) & (F.col("shift") == F.col("s_shift"))
    kind = F.when(F.coalesce("changed", F.lit(False)), "reparameterised").otherwise("exact")
    good = best.join(slots, same, "left").where(F.coalesce("most", F.lit(1)) == 1).groupBy("version", "item").agg(F.min(kind).alias("kind"))
    counts = found.select(F.col("version").alias("k_version"), F.col("item").alias("k_item"), "n_windows", "n_found")
    good = good.join(counts, (F.col("version") == F.col("k_version")) & F.col("item").eqNullSafe(F.col("k_item")))
    good = good.select("version", "item", "n_windows", "n_found", "kind").withColumn("typed", F.lit(True)).union(held.withColumn("typed", F.lit(False)))
    # Where both ways find a pair, the slots tell its kind.
    good = good.groupBy("version", "item").agg(F.max(F.struct("typed", "n_windows", "n_found", "kind")).alias("g")).select("version", "item", "g.n_windows", "g.n_found", "g.kind")
    out = good.join(likely, "version").groupBy("id", "item").agg(F.max("n_windows").alias("n_windows"), F.max("n_found").alias("n_found"), F.min("kind").alias("kind"))
    return out.withColumnsRenamed({"id": key, "item": item})


def op3(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
