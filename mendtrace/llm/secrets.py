"""Secret scans with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

# Kind, pattern, least length of the value, group of the value. Base kinds first, in the order of ties.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"AKIA[A-Z0-9]{16,}", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),
)
# Parts that are weak alone: a name of an account, a place to connect to, a value that may be a secret.
WEAK = (
    ("user", r"""((?i:username|user_id|login|client_id|account_id|access_id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", 3, 2),
    ("endpoint", r"""(?:[a-z][a-z0-9+]{1,15}://[A-Za-z0-9.-]+(?::[0-9]+)?|(?i:hostname|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[A-Za-z]{2,})""", 4, 0),
    ("weak", r"""((?i:passphrase|pwd|credential|auth_key|private_key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=!@#$%^&*-]{4,})""", 4, 2),
)
KINDS = tuple(k for k, *_ in BASE + WEAK)
#: Code points between two parts of one credential at most.
REACH = 200


def _matches(text: Column, number: int, pattern: str, least: int, group: int) -> Column:
    """Leftmost non-overlapping matches: (kind's number, place among them, text before, length, long enough?)."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = (lambda x: F.regexp_extract(x, pattern, group)) if group else (lambda x: x)
    rows = F.transform(
        F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap")),
        lambda x: F.struct(F.lit(number).alias("kind"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), (F.length(value(x["hit"])) >= least).alias("kept")),
    )
    rows = F.transform(rows, lambda x, i: F.struct(x["kind"].alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["kept"].alias("kept")))
    none = F.from_json(F.lit("[]"), "array<struct<kind:int,i:int,gap:int,size:int,kept:boolean>>")
    return F.when(text.rlike(pattern), rows).otherwise(none)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """Spans of secrets in whole texts, one row per input row.

    Base kinds (assign, access, hex) are reported wherever their match is long enough. User names, endpoints and weak
    values are reported only where complementary parts lie within `reach` code points: a weak value needs an access
    identifier, user name or endpoint; a user name or endpoint needs a secret. This interval join looks from each part at
    the nearest complementary part on either side (running maxima of ends, and of starts from the end backwards), so no
    pairs are made and a text costs as much as it has matches.

    Returns (key, n_assign, n_access, n_hex, base_sha256, spans). Null texts count as empty; null keys and repeated rows
    stay; other columns are ignored; no rows give none. Very long texts are searched whole. Only places of matches are shuffled, never texts.
    """
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = F.concat(*(_matches(F.col("text"), k, p, n, g) for k, (_, p, n, g) in enumerate(BASE + WEAK)))
    # Places are staged before they are grouped, so a row's number never changes under a task that runs again.
    parts = C.stage_table(src.select("row", "id", F.explode_outer(found).alias("m")).select("row", "id", "m.*"), "matches")
    by_kind = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(by_kind)).withColumn("start", F.col("end") - F.col("size"))

    kept = F.coalesce(F.col("kept"), F.lit(False))
    kind = F.col("kind")
    order = ("start", "kind", "end")
    before = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)

    def near(*kinds: str) -> Column:
        is_one = kept & kind.isin([KINDS.index(k) for k in kinds])
        left, right = F.max(F.when(is_one, F.col("end"))).over(before), F.min(F.when(is_one, F.col("start"))).over(after)
        return F.coalesce(F.col("start") - left <= reach, F.lit(False)) | F.coalesce(right - F.col("end") <= reach, F.lit(False))

    base = kept & (kind < len(BASE))
    covered = F.coalesce(F.max(F.when(base, F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(base, F.col("start"))).over(after) < F.col("end"), F.lit(False))
    needs = F.when(kind < len(BASE), True).when(kind == KINDS.index("weak"), near("access", "user", "endpoint")).otherwise(near("assign", "hex", "weak"))
    parts = parts.withColumn("said", kept & needs & ((kind < len(BASE)) | ~covered))

    names = F.array(*(F.lit(k) for k in KINDS))
    one = F.when(F.col("said"), F.struct("start", "kind", "end"))
    rows = parts.groupBy("row", "id").agg(*(F.sum(F.when(base & (kind == k), 1).otherwise(0)).cast("long").alias(f"n_{BASE[k][0]}") for k in range(len(BASE))), F.array_sort(F.collect_list(one)).alias("all"))

    def text_of(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    return rows.select(F.col("id").alias(key), *(f"n_{b[0]}" for b in BASE), F.sha2(text_of(F.filter("all", lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"), text_of(F.col("all")).alias("spans"))


def op2(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
