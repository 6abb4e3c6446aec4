"""DuckDB SQL for the operators whose results SQL can express, from their contracts rather than their methods."""

from __future__ import annotations

from tessera.llm import debruijn, line_dedup, quality, secret_scan, suffixes

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _warc() -> str:
    bit = " + ".join(f"CAST(substr(bits, 5 * i + {k + 1}, 1) AS INTEGER) * {16 >> k}" for k in range(5))
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, CAST(CAST(unhex(sha1(body)) AS BIT) AS VARCHAR) AS bits FROM p),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('{ALPHABET}234567', 1 + {bit}, 1)), '') AS payload_digest FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM m"""


def _quality() -> str:
    q = quality
    ratio = {r: f"CAST({top} AS DOUBLE) / greatest({bottom}, 1)" for r, (top, bottom, *_) in q.RATIOS.items()}
    long = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS ratio, {x} AS x FROM c WHERE NOT base_failed" for r, x in ratio.items())
    least = "CASE ratio " + " ".join(f"WHEN '{r}' THEN {x[2]}" for r, x in q.RATIOS.items()) + " END"
    both = [r for r, x in q.RATIOS.items() if x[3]]
    levels = []
    for level, keys in (("own", ["lang", "source"]), ("language", ["lang"]), ("whole", [])):
        by = "".join(f"{k}, " for k in keys)
        levels.append(f"""
{level}_n AS (SELECT {by}ratio, bucket, sum(n) AS n FROM sketch GROUP BY ALL),
{level}_r AS (SELECT *, sum(n) OVER (PARTITION BY {by}ratio) AS total, sum(n) OVER (PARTITION BY {by}ratio ORDER BY bucket) AS upto, CASE WHEN bucket = {q.ZERO_BUCKET} THEN 0.0::DOUBLE ELSE pow({q.GAMMA}::DOUBLE, bucket) * {2 / (q.GAMMA + 1)!r}::DOUBLE END AS v FROM {level}_n),
{level}_q AS (SELECT {by}ratio, min(CASE WHEN upto >= 0.25 * total THEN v END) AS a, min(CASE WHEN upto >= 0.75 * total THEN v END) AS z, max(total) AS total FROM {level}_r GROUP BY ALL),
{level}_c AS (SELECT {by}ratio, z + greatest({q.SPREAD} * (z - a), {least}) AS high, a - greatest({q.SPREAD} * (z - a), {least}) AS low, total FROM {level}_q)""")
    return rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (SELECT doc_id, array_to_string(words[i : i + {q.WINDOW - 1}], ' ') AS win, i FROM (SELECT doc_id, words, unnest(range(1, len(words) - {q.WINDOW - 2})) AS i FROM w)),
t AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
r AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest(range(i, i + {q.WINDOW})) AS spot FROM t) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(lines) AS line FROM w) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
c0 AS (SELECT doc_id, lang, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
 length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
 length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks, len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_stutters, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(r.n, 0) AS n_repeat_words
 FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
c AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.REPEAT_PERCENT} * n_words AS base_failed FROM c0),
x AS ({long}),
sketch AS (SELECT lang, source, ratio, CASE WHEN x <= 0 THEN {q.ZERO_BUCKET} ELSE CAST(ceil(ln(x) / ln({q.GAMMA}::DOUBLE)) AS INTEGER) END AS bucket, count(*) AS n FROM x GROUP BY ALL),{",".join(levels)},
cuts AS (SELECT o.lang, o.source, o.ratio, {", ".join(f"CASE WHEN o.total >= {q.MIN_DOCS} THEN o.{x} WHEN l.total >= {q.MIN_DOCS} THEN l.{x} ELSE a.{x} END AS {x}" for x in ("high", "low"))} FROM own_c o JOIN language_c l ON o.ratio = l.ratio AND o.lang IS NOT DISTINCT FROM l.lang JOIN whole_c a ON o.ratio = a.ratio),
wide AS (SELECT lang, source, {", ".join(f"max(CASE WHEN ratio = '{r}' THEN {x} END) AS {x}_{r}" for r in ratio for x in ("high", "low"))} FROM cuts GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join([f"coalesce({x} > high_{r}, false)" for r, x in ratio.items()] + [f"coalesce({ratio[r]} < low_{r}, false)" for r in both])}) AS kept
FROM c LEFT JOIN wide ON c.lang IS NOT DISTINCT FROM wide.lang AND c.source IS NOT DISTINCT FROM wide.source"""


def _secrets() -> str:
    parts = []
    for rank, r in enumerate(secret_scan.RULES):
        p = _quoted(r.pattern)
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, {r.least} AS least, unnest(list_zip(regexp_split_to_array(text, {p})[1 : len(regexp_extract_all(text, {p}, 0))], regexp_extract_all(text, {p}, 0), regexp_extract_all(text, {p}, {r.group}))) AS m, unnest(range(len(regexp_extract_all(text, {p}, 0)))) AS pos FROM t""")
    joined = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank){}, '')"
    base = f" FILTER (rank < {len(secret_scan.BASE)})"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(parts)}),
s AS (SELECT *, CAST(sum(length(m[1]) + length(m[2])) OVER (PARTITION BY doc_id, rank ORDER BY pos) AS BIGINT) AS stop FROM f),
h AS (SELECT doc_id, rank, kind, stop - length(m[2]) AS start, stop FROM s WHERE length(m[3]) >= least)
SELECT t.doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE)}, sha256({joined.format(base)}) AS base_sha256, {joined.format("")} AS spans
FROM t LEFT JOIN h ON t.doc_id = h.doc_id GROUP BY t.doc_id"""


def _bytes() -> str:
    n = suffixes.WINDOW
    return f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * n}) AS s FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - {n - 1})) AS i FROM t)),
g AS (SELECT doc_id, i FROM w QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
r AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {n} THEN 1 ELSE 0 END AS cut FROM g),
u AS (SELECT doc_id, i, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
s AS (SELECT doc_id, min(i) AS a, max(i) + {n} AS z FROM u GROUP BY doc_id, run),
k AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_, a AS to_, z - a AS gone, z FROM s),
a AS (SELECT doc_id, sum(gone) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * from_ + 1, 2 * (to_ - from_)), '' ORDER BY from_) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM k JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM t LEFT JOIN a USING (doc_id)"""


def _words() -> str:
    n = debruijn.WINDOW
    return rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i : i + {n - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM t)),
g AS (SELECT doc_id, i FROM k QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS i FROM g),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t),
j AS (SELECT p.doc_id, count(*) AS n_words, count(x.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p.i) FILTER (x.i IS NULL), '') AS kept FROM p LEFT JOIN x ON p.doc_id = x.doc_id AND p.i = x.i GROUP BY p.doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN j USING (doc_id)"""


def _lines() -> str:
    return rf"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
p AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM t),
k AS (SELECT *, translate(regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g'), '{ALPHABET}', '{ALPHABET.lower()}') AS key FROM p),
h AS (SELECT key, min(doc_id) AS first, count(DISTINCT doc_id) AS n FROM k WHERE length(key) >= {line_dedup.MIN_CODE_POINTS} GROUP BY key),
d AS (SELECT k.*, coalesce(h.n >= 2 AND k.doc_id <> first, false) AS gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id"""


ORACLE_SQL: dict[str, str] = {
    "op1_warc": _warc(),
    "op2_sharding": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
    "op3_quality_rules": _quality(),
    "op5_secret_scan": _secrets(),
    "op6_suffix_array": _bytes(),
    "op8_debruijn": _words(),
    "op10_line_dedup": _lines(),
}
