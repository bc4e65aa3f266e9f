"""Personal data by anchor expansion: Aho-Corasick finds anchors, local parsers expand and validate the spans around them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds in the order of ties, and the local grammars.
KINDS = ("email", "ip", "card", "phone", "login", "account")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"://([^\s/@:]+:[^\s/@]+)@[A-Za-z0-9.-]+")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
CUES = ("iban", "account", "acct", "passport", "ssn")
ACCOUNT = re.compile(r"(?:\x20?(?:no|number|nr|id))?\.?\x20*[:#=]\x20*([A-Za-z0-9](?:[A-Za-z0-9]|[\x20-](?=[A-Z0-9]*[0-9])){4,40}[A-Za-z0-9])", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def iban(value: str) -> bool:
    v = re.sub(r"[\x20-]", "", value).upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", v)) and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    for c, kind in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        a.add_word(c, (kind, len(c)))
    for cue in CUES:
        for c in {cue, cue.capitalize(), cue.upper()}:
            a.add_word(c, ("iban" if cue == "iban" else "cue", len(c)))
    a.make_automaton()
    return a


def spans(text: str, anchors) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) in code points, by start, then kind.

    For each kind a parser starts at its leftmost anchor that no earlier match of the kind covers, as a search from left
    to right does; a match that fails its check is dropped and covers its text all the same.
    """
    out: list[tuple[int, int, int]] = []
    email = ip = card = phone = 0
    for end, (kind, n) in anchors.iter(text):
        at = end - n + 1
        if kind == "digit":
            if at >= ip and (at == ip or text[at - 1] not in DIGITS) and (m := IP.match(text, at)):
                ip = m.end()
                if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
                    out.append((at, 1, ip))
            if at >= card and (m := CARD.match(text, at)):
                card = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, 2, card))
        elif kind == "at":
            start = at
            while start > email and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email = m.end()
                out.append((start, 0, email))
        elif kind == "plus":
            if at >= phone and (m := PHONE.match(text, at)):
                phone = m.end()
                if 10 <= sum(c in DIGITS for c in m[0]) <= 15:
                    out.append((at, 3, phone))
        elif kind == "scheme":
            if m := LOGIN.match(text, at):
                start = at
                while start and text[start - 1] in SCHEME:
                    start -= 1
                if start < at:
                    out.append((start, 4, m.end()))
        elif (m := ACCOUNT.match(text, end + 1)) and sum(c in DIGITS for c in m[1]) >= 6 and (kind == "cue" or iban(m[1])):
            out.append((m.start(1), 5, m.end(1)))
    return sorted(set(out))


def _find(b: pa.RecordBatch, anchors) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(len(KINDS) + 2)]
    for x in b.column(1):
        found = spans(x.as_py() or "", anchors)
        for k in range(len(KINDS)):
            cols[k].append(sum(1 for f in found if f[1] == k))
        said = [f"{KINDS[k]}:{s}:{e}" for s, k, e in found]
        cols[-2].append(hashlib.sha256(",".join(t for t, f in zip(said, found, strict=True) if f[1] < 4).encode()).hexdigest())
        cols[-1].append(",".join(said))
    kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of emails, IP addresses, cards and phones, of URLs that hold a login, and of accounts behind a cue.

    Returns (key, a count n_<kind> for each of KINDS, base_sha256 over the first four kinds, spans), one row per input
    row: null texts count as empty, null keys and repeated rows stay, other columns are ignored, no rows give none. Very long texts are
    searched whole. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for b in batches:
            yield _find(b, anchors)

    kind = docs.schema[key].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, {counts}, base_sha256 string, spans string").withColumnRenamed("id", key)


def op9(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
