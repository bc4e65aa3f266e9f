"""SQL of the operators' queries that SQL can express, for engines that check them."""

from __future__ import annotations

import re

from .chat_tree import CLOSE, CONTROL, MID, OPEN
from .secrets import BASE, KINDS, REACH, WEAK

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Links are all pairs that share a shingle, components the least document reached over links.
JACCARD = rf"""WITH RECURSIVE dd AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT r, doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' '] ELSE []::VARCHAR[] END AS s FROM dd),
one AS (SELECT r, unnest(s) AS g FROM sh),
many AS (SELECT g FROM one GROUP BY g HAVING count(*) > 1),
hot AS (SELECT one.r, one.g FROM one JOIN many USING (g)),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM hot AS a JOIN hot AS b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN sh AS x ON x.r = a JOIN sh AS y ON y.r = b WHERE 100 * n >= 90 * (len(x.s) + len(y.s) - n)),
reach AS (SELECT r AS a, r AS b FROM sh UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT sh.doc_id, CAST(len(sh.s) AS BIGINT) AS n_shingles, m.component_id FROM sh JOIN (SELECT reach.a AS r, min(y.doc_id) AS component_id FROM reach JOIN sh AS y ON y.r = reach.b GROUP BY reach.a) AS m USING (r)"""


#: All phrases counted one by one, then cut, compared with longer ones and ranked.
COLLOCATIONS = rf"""WITH pc AS (SELECT lang, row_number() OVER () AS k, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents) AS x),
pl AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pc),
ph AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM pl, (SELECT unnest([1, 2, 3, 4]) AS m) AS ms WHERE i + m - 1 <= len(w)),
ff AS (SELECT lang, m, phrase, CAST(count(*) AS HUGEINT) AS f FROM ph GROUP BY ALL),
nn AS (SELECT lang, sum(f) AS n FROM ff WHERE m = 1 GROUP BY lang),
ca AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM ff WHERE m >= 2 AND f >= 30),
ins AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, w, a, m, s, unnest(range(1, m - s + 2)) AS i FROM ca, (SELECT unnest([2, 3]) AS s) AS ss WHERE s < m) AS x GROUP BY ALL),
ke AS (SELECT ca.* FROM ca LEFT JOIN ins USING (lang, phrase) WHERE ins.longer IS NULL OR 100 * ins.longer < 80 * a),
cu AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:m], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM ke) AS x),
sc AS (SELECT cu.lang, cu.phrase, a, k, x.f AS l, y.f AS r, (2000000 * a) // (x.f + y.f) AS score FROM cu JOIN ff AS x ON x.lang = cu.lang AND x.phrase = lp JOIN ff AS y ON y.lang = cu.lang AND y.phrase = rp),
lo AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ra AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lo)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ra JOIN nn USING (lang) WHERE rank <= 2000"""


#: Words counted one by one; their checksums by the usual table of 256 values, made by its rule.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESAMPLE = rf"""WITH RECURSIVE tab AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce([b] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b) AS x) AS y),
src AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
wd AS (SELECT r, unnest(regexp_extract_all(translate(body, '{UPPER}', '{UPPER.lower()}'), '{WORD}')) AS w FROM src),
wt AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}')) AS w FROM benchmark),
hx AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM wd UNION SELECT w FROM wt) AS u),
cr AS (SELECT w, xor(list_reduce([4294967295] || list_transform(range(0, length(x) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1), lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) + 1 AS INTEGER)])), 4294967295) % 10000 AS bucket FROM hx, tab),
sb AS (SELECT bucket, count(*) AS s FROM wd JOIN cr USING (w) GROUP BY bucket),
tb AS (SELECT bucket, count(*) AS t FROM wt JOIN cr USING (w) GROUP BY bucket),
ga AS (SELECT bucket, floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (CAST((SELECT count(*) FROM wd) AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST((SELECT count(*) FROM wt) AS DOUBLE) + 10000)))) AS g FROM sb LEFT JOIN tb USING (bucket)),
we AS (SELECT r, count(*) AS n, sum(g) AS v FROM wd JOIN cr USING (w) JOIN ga USING (bucket) GROUP BY r),
sc AS (SELECT r, doc_id, coalesce(n, 0) AS n, CAST(coalesce(v, 0) AS BIGINT) AS v, CAST(coalesce(v, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM src LEFT JOIN we USING (r)),
ra AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS k, count(*) OVER () AS many FROM sc WHERE n >= 20)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, v AS weight, score, CAST(CASE WHEN k <= 10 * many // 100 THEN k END AS BIGINT) AS rank FROM sc LEFT JOIN ra USING (r)"""


def cases(pattern: str) -> str:
    """The pattern with letters of either case spelt out, so that only A-Z fold."""
    return re.sub(r"\(\?i:([^()]*)\)", lambda m: "(?:" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in m[1]) + ")", pattern)


def secrets_sql() -> str:
    """Matches by kind, placed by running lengths, then linked by the nearest parts on both sides."""
    kinds = []
    for k, (_, pattern, least, group) in enumerate(BASE + WEAK):
        p = cases(pattern).replace("'", "''")
        value = f"regexp_extract(hit, '{p}', {group})" if group else "hit"
        kinds.append(f"SELECT r, {k} AS kind, i, length(gap) AS gap, length(hit) AS size, length({value}) >= {least} AS kept FROM (SELECT r, i, hits[i] AS hit, gaps[i] AS gap FROM (SELECT r, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT r, regexp_extract_all(body, '{p}') AS hits, string_split_regex(body, '{p}') AS gaps FROM dd) AS x) AS y) AS z")
    order = '(PARTITION BY r ORDER BY f, kind, t ROWS BETWEEN '
    before, after = order + "UNBOUNDED PRECEDING AND 1 PRECEDING)", order + "1 FOLLOWING AND UNBOUNDED FOLLOWING)"

    def near(*names: str) -> str:
        one = f"kept AND kind IN ({', '.join(str(KINDS.index(n)) for n in names)})"
        return f"(coalesce(f - max(CASE WHEN {one} THEN t END) OVER {before} <= {REACH}, FALSE) OR coalesce(min(CASE WHEN {one} THEN f END) OVER {after} - t <= {REACH}, FALSE))"

    base = f"kept AND kind < {len(BASE)}"
    covered = f"(coalesce(max(CASE WHEN {base} THEN t END) OVER {before} > f, FALSE) OR coalesce(min(CASE WHEN {base} THEN f END) OVER {after} < t, FALSE))"
    needs = f"CASE WHEN kind < {len(BASE)} THEN TRUE WHEN kind = {KINDS.index('weak')} THEN {near('access', 'user', 'endpoint')} ELSE {near('assign', 'hex', 'weak')} END"
    name = f"{list(KINDS)!r}[kind + 1] || ':' || f || ':' || t"
    agg = lambda when: f"coalesce(string_agg(CASE WHEN {when} THEN {name} END, ',' ORDER BY f, kind, t), '')"
    counts = ", ".join(f"CAST(count(CASE WHEN said AND kind = {k} THEN 1 END) AS BIGINT) AS n_{b[0]}" for k, b in enumerate(BASE))
    return f"""WITH dd AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
mm AS ({' UNION ALL '.join(kinds)}),
pp AS (SELECT r, kind, kept, t - size AS f, t FROM (SELECT *, sum(gap + size) OVER (PARTITION BY r, kind ORDER BY i) AS t FROM mm) AS x),
ss AS (SELECT *, kept AND ({needs}) AND (kind < {len(BASE)} OR NOT {covered}) AS said FROM pp)
SELECT dd.doc_id, {counts}, sha256({agg(f'said AND kind < {len(BASE)}')}) AS base_sha256, {agg('said')} AS spans FROM dd LEFT JOIN ss USING (r) GROUP BY dd.r, dd.doc_id"""


_escaped = lambda c: f"length(regexp_replace(replace({c}, '~', '~0'), '{CONTROL}', '\\1~1\\2', 'g'))"
_turns = "ORDER BY turn NULLS FIRST, role, body"
#: Conversations put together turn by turn, without a tree.
CHAT = f"""WITH tt AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
  UNION ALL SELECT -1, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]')) AS v)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' {_turns})) AS turns_sha256, CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(body) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN body END, '' {_turns}), '')) AS loss_sha256, CAST(sum({len(OPEN + MID + CLOSE)} + {_escaped('role')} + {_escaped('body')}) AS BIGINT) AS formatted_chars FROM tt GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_prefix_tree": CHAT, "op2_credential_linking": secrets_sql(), "op5_jaccard_join": JACCARD, "op11_phrase_collocations": COLLOCATIONS, "op12_importance_resampling": RESAMPLE}
