"""Chat formatting with a prefix tree: turns that conversations share from their start are emitted once, depth-first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

# The template's marks, and the strings that texts may not hold as they are.
OPEN, MID, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = r"(<|\[)(\||/?s>|/?INST\]|<SYS>|</SYS>)"


def escape(c: Column) -> Column:
    """~ becomes ~0, and ~1 parts the first sign of a control string from the rest; unescape() is its inverse."""
    return F.regexp_replace(F.regexp_replace(c, "~", "~0"), CONTROL, "$1~1$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "~1", ""), "~0", "~")


def build_tree(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, segments, leaves) of the prefix forest of all conversations.

    nodes: one row per distinct run of first turns: tree, segment, depth, formatted (its turn under the template), start and
    end (place in its tree's sequence, code points), position (position id of its first code point: the length of what
    stands before it in its conversation), loss (interval under the loss mask within formatted, or null). segments: one
    row per distinct conversation, which emits the turns that none before it has: segment, tree, start, end and ancestors
    (intervals of the turns before its own that each of its tokens attends to, besides its own earlier ones). leaves:
    (conv, segment of that name's conversation, n_turns).

    Prefixes are named by chained digests, so equal ones meet however many conversations share them. Conversations sorted
    by their chains come in depth-first order, and each emits what lies beyond the prefix it shares with the one before.
    Places are sums over range partitions, so that a tree that holds most of the input spans many tasks; they come from
    digests and lengths alone, and texts meet their places once, at the end. Turns are ordered
    by turn, role, text; null texts and roles are empty; rows with a null conversation form one; repeated rows are turns of
    their own; other columns are ignored. No turns give no rows in any of the three. A very long turn is one row of nodes,
    whole; a very long conversation is many rows.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    convs = turns.select(F.col(conv).alias("conv"), one.alias("t")).groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    digest = lambda was, t: F.substring(F.sha2(F.concat_ws("\n", was, F.length(t["role"]).cast("string"), t["role"], t["text"]), 256), 1, 32)
    chain = F.aggregate("ts", F.array(F.lit("")), lambda acc, t: F.array_append(acc, digest(F.element_at(acc, -1), t)))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MID))
    long_ = lambda c: c.cast("long")
    framed = F.transform("ts", lambda t: F.struct(t["role"].alias("role"), F.length(head(t)).alias("head"), F.concat(head(t), escape(t["text"]), F.lit(CLOSE)).alias("formatted")))
    loss = lambda x: F.when(x["role"] == learn, F.struct(x["head"].alias("from"), (F.length(x["formatted"]) - len(CLOSE)).alias("to")))
    shown = F.transform(framed, lambda x: F.struct(x["formatted"].alias("formatted"), loss(x).alias("loss")))
    convs = convs.select("conv", F.slice(chain, 2, 1 << 30).alias("chain"), shown.alias("shown")).withColumn("n", F.monotonically_increasing_id())
    convs = C.stage_table(convs.withColumn("segment", F.element_at("chain", -1)).withColumn("sizes", F.transform("shown", lambda x: long_(F.length(x["formatted"])))), "convs")
    leaves = convs.select("conv", "segment", F.size("sizes").alias("n_turns"))

    # Depth-first order of distinct conversations in range partitions; a partition's first row looks at the last row before it.
    spread = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = convs.groupBy("segment").agg(F.min("n").alias("n"), F.first("chain").alias("chain"), F.first("sizes").alias("sizes"))
    rows = C.stage_table(rows.repartitionByRange(spread, "chain").withColumn("slice", F.spark_partition_id()), "sorted")
    tails = rows.groupBy("slice").agg(F.max("chain").alias("tail")).select("slice", F.lag("tail").over(Window.orderBy("slice")).alias("before"))
    in_slice = Window.partitionBy("slice").orderBy("chain")
    rows = rows.withColumn("i", F.row_number().over(in_slice)).withColumn("was", F.lag("chain").over(in_slice)).join(tails, "slice")
    shared = F.size(F.array_intersect("chain", F.coalesce("was", "before", F.array().cast("array<string>"))))
    rows = rows.withColumn("shared", shared).withColumn("tree", F.element_at("chain", 1)).withColumn("fresh", F.slice("sizes", F.col("shared") + 1, F.size("sizes") - F.col("shared")))
    size = F.aggregate("fresh", long_(F.lit(0)), lambda n, x: n + x)
    rows = C.stage_table(rows.withColumn("size", size).select("segment", "n", "slice", "i", "tree", "chain", "shared", "fresh", "size"), "rows")
    held = rows.groupBy("slice", "tree").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("tree").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("slice", "tree", F.coalesce(F.sum("held").over(earlier), long_(F.lit(0))).alias("base"))
    within = Window.partitionBy("slice", "tree").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(within), long_(F.lit(0)))).join(held, ["slice", "tree"])
    rows = rows.withColumn("start", F.col("base") + F.col("ahead")).drop("slice", "i", "base", "ahead")

    placed = rows.select("segment", "n", "tree", "shared", "chain", F.col("start").alias("from"), F.posexplode("fresh").alias("k", "length"))
    so_far = F.sum("length").over(Window.partitionBy("segment").orderBy("k"))
    depth = F.col("shared") + F.col("k")
    placed = placed.select("segment", "n", "tree", depth.alias("depth"), F.element_at("chain", depth + 1).alias("node"), "length", (F.col("from") + so_far).alias("end"))
    placed = C.stage_table(placed.withColumn("start", F.col("end") - F.col("length")).drop("length"), "placed")

    # Ancestors: one row per conversation and shared turn, never more than there are turns.
    ups = rows.where("shared > 0").select("segment", F.explode(F.slice("chain", F.lit(1), F.col("shared"))).alias("node"))
    ups = ups.join(placed.select("node", "depth", "start", "end"), "node")
    ups = ups.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("depth", "start", "end"))).alias("above"))
    none = F.from_json(F.lit("[]"), "array<struct<start:bigint,end:bigint>>")
    above = F.coalesce(F.transform("above", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), none)
    segments = rows.select("segment", "tree", "start", (F.col("start") + F.col("size")).alias("end")).join(ups, "segment", "left").withColumn("ancestors", above).drop("above")
    segments = C.stage_table(segments, "segments")
    first = segments.select("segment", F.col("start").alias("s0"), F.aggregate("ancestors", long_(F.lit(0)), lambda n, x: n + x["end"] - x["start"]).alias("p0"))

    # Places of a conversation's own turns meet its texts; as many places are held as turns are counted.
    place = F.struct("depth", "start", "end", (F.col("p0") + F.col("start") - F.col("s0")).alias("position"))
    places = placed.join(first, "segment").groupBy("n", "segment", "tree").agg(F.collect_list(place).alias("places"))
    places = F.broadcast(places) if placed.count() <= C.BROADCAST_ROWS // 4 else places.hint("shuffle_hash")
    both = convs.select("n", "shown").join(places, "n")
    both = both.select("tree", "segment", F.explode(F.transform("places", lambda p: F.struct(p.alias("p"), F.element_at(F.col("shown"), p["depth"] + 1).alias("t")))).alias("x"))
    nodes = both.select("tree", "segment", "x.p.depth", "x.t.formatted", "x.p.start", "x.p.end", "x.p.position", "x.t.loss")
    return nodes, segments, leaves


def read_back(nodes: DataFrame, segments: DataFrame, leaves: DataFrame) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from the tree's output alone.

    Each distinct conversation is read once: its ancestor intervals name the turns that it attends to, and these and its
    own are put together in order of position.
    """
    seen = segments.select(F.col("segment").alias("leaf"), "tree", F.explode("ancestors").alias("p")).select("leaf", "tree", "p.start", "p.end")
    seen = seen.join(nodes.select("tree", "start", "end", "position", "formatted", "loss"), ["tree", "start", "end"]).select("leaf", "position", "formatted", "loss")
    own = nodes.select(F.col("segment").alias("leaf"), "position", "formatted", "loss")
    parts = seen.union(own).groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("position", "formatted", "loss"))).alias("ps"))
    role = lambda p: unescape(F.substring_index(F.substr(p["formatted"], F.lit(len(OPEN) + 1)), MID, 1))
    body = lambda p: unescape(F.regexp_extract(p["formatted"], rf"(?s){MID.replace('|', '[|]')}(.*){CLOSE.replace('|', '[|]')}\z", 1))
    masked = lambda p: unescape(F.substr(p["formatted"], p["loss"]["from"] + 1, p["loss"]["to"] - p["loss"]["from"]))
    said = F.array_join(F.transform("ps", lambda p: F.concat(role(p), F.lit("\n"), body(p), F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("ps", lambda p: p["loss"].isNotNull()), masked), "")
    total = F.aggregate("ps", F.lit(0).cast("long"), lambda n, p: n + F.length(p["formatted"]))
    parts = parts.select(F.col("leaf").alias("segment"), F.sha2(said, 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), total.alias("formatted_chars"))
    return leaves.join(parts, "segment").select("conv", F.col("n_turns").cast("long").alias("n_turns"), "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op1(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("x")).select("x.*")
    nodes, segments, leaves = build_tree(turns.union(more))
    return read_back(C.stage_table(nodes, "tree"), segments, leaves).withColumnRenamed("conv", "conv_id")
