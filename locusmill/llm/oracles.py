"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .license_scan import BASE, K, TEMPLATES

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACE = r"[^\x20\x09-\x0D]+"


def _template_rows() -> str:
    rows = []
    for n, (phrase, label, base) in enumerate([(*x, "true") for x in BASE] + [(*x, "false") for x in TEMPLATES]):
        w = phrase.split()
        rows += [f"({n}, '{label}', {base}, {len(w) - K + 1}, {i}, '{w[i]}', '{w[i + 1]}')" for i in range(len(w) - K + 1)]
    return ", ".join(rows)


LICENSES = f"""
WITH t(template, label, base, need, tpos, w0, w1) AS (VALUES {_template_rows()}),
d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, w[i] AS w0, w[i + 1] AS w1 FROM d, unnest(range(1, len(w))) u(i)),
h AS (SELECT doc_id, template, label, base, need, pos, tpos, pos - tpos AS diag FROM g JOIN t USING (w0, w1)),
s AS (SELECT DISTINCT doc_id, template, diag AS start FROM h),
m AS (SELECT h.*, start FROM s JOIN h USING (doc_id, template) WHERE diag BETWEEN start AND start + CASE WHEN base THEN 0 ELSE greatest(2, need // 4) END),
o AS (SELECT *, coalesce(max(tpos) OVER (PARTITION BY doc_id, template, start ORDER BY pos, tpos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM m),
band AS (SELECT doc_id, template, label, base, need, start, count(*) FILTER (tpos > before) AS votes FROM o GROUP BY ALL),
k AS (SELECT *, votes / need::DOUBLE AS share, base AND votes = need AS ok_base, (base AND votes = need) OR (NOT base AND votes / need::DOUBLE >= 0.75) AS ok FROM band),
a AS (SELECT doc_id, count(*) FILTER (ok_base) AS n_base, min(start) FILTER (ok_base) AS first_word, max(start) FILTER (ok_base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (ok_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (ok) AS labels, max(share) FILTER (ok OR NOT base) AS score FROM k GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN a USING (doc_id)
"""

MIX = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_SPACE}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s),
k AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k FROM w),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER p, 0) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS DOUBLE) AS level FROM k WINDOW p AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT arg_min(level, k) AS level FROM l WHERE level * w <= 3 * source_size),
t AS (SELECT source, source_size, coalesce(least(o.level * w, 3.0::DOUBLE * source_size), 3.0::DOUBLE * source_size) AS target FROM l, o),
r AS (SELECT d.doc_id, size, source_size, target, least(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END, 3.0) AS rate, CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS UBIGINT) / 4503599627370496.0::DOUBLE AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

WINDOWS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM benchmark),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, array_to_string(w[p:p + 9], ' ') AS win, least(10, len(w)) AS size FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(p) WHERE len(w) > 0),
place AS (SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS win FROM (SELECT * FROM d, (SELECT DISTINCT size FROM win)) x, unnest(range(1, len(w) - size + 2)) u(p)),
occ AS (SELECT doc_id, p, size, item FROM place JOIN win USING (win, size)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM occ, unnest(range(p, p + size)) u(q) GROUP BY 1),
who AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM occ GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN who USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_SPACE}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) u(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY 1) USING (doc_id)
"""

REPEATS = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, p, b[p:p + 199] AS s FROM d, unnest(range(1, octet_length(b) - 198)) u(p)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY s) AS c FROM w) WHERE c > 1),
i AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS fresh FROM r),
j AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM i),
g AS (SELECT doc_id, k, min(p) AS a, max(p) + 199 AS e FROM j GROUP BY 1, 2),
kept AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS x, a - 1 AS y FROM g UNION ALL SELECT doc_id, max(e) + 1, NULL FROM g GROUP BY 1),
t AS (SELECT doc_id, unhex(string_agg(hex(b[x:coalesce(y, octet_length(b))]), '' ORDER BY x)) AS rest FROM kept JOIN d USING (doc_id) WHERE x <= coalesce(y, octet_length(b)) GROUP BY 1),
n AS (SELECT doc_id, CAST(sum(e - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM g GROUP BY 1)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN n_spans IS NULL THEN b ELSE coalesce(rest, ''::BLOB) END) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT r, p, count(*) OVER (PARTITION BY r, w[p], w[p + 1], w[p + 2]) AS times FROM d, unnest(range(1, len(w) - 1)) u(p)),
c AS (SELECT r, count(DISTINCT q) AS n FROM g, unnest(range(p, p + 3)) u(q) WHERE times > 1 GROUP BY 1),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS shouted, length(regexp_replace(t, '[^a-z]', '', 'g')) AS small, length(regexp_replace(t, '[^!?]', '', 'g')) AS marks FROM d LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars NOT BETWEEN 2 * n_words AND 15 * n_words OR shouted > small OR 10 * marks > 3 * n_words) AS kept FROM b
"""


def _crc_table() -> list[int]:
    """The table of the reflected polynomial EDB88320."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        out.append(c)
    return out


VARIANTS = f"""
WITH RECURSIVE x AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
o AS (SELECT doc_id, run, count(*) AS n FROM x GROUP BY ALL),
k AS (SELECT *, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END))), lambda a, b: xor(a >> 8, ({_crc_table()}::BIGINT[])[xor(a, b) % 256 + 1])) AS crc FROM o),
h AS (SELECT *, xor(crc, 4294967295::BIGINT) AS h FROM k),
v AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1 HAVING sum(n) >= 5 AND length(word) >= 6),
c AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM v, unnest(range(0, length(word))) u(i)),
p AS (SELECT a.word, b.word AS near, b.n FROM c a JOIN c b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM c JOIN v ON v.word = c.rest UNION SELECT v.word, c.word, c.n FROM c JOIN v ON v.word = c.rest),
q AS (SELECT word, count(*) AS n_near, min((-n, near)) AS best FROM p GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 5 * v.n THEN best[2] END AS form, CASE WHEN -best[1] >= 5 * v.n THEN -best[1] END AS form_n FROM v LEFT JOIN q USING (word)),
t AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.next)
SELECT f.word, f.form, t.at AS root, n, n_near, form_n FROM f JOIN t USING (word) WHERE t.next IS NULL
"""

ORACLES = {
    "op1_suffix_columns": REPEATS, "op4_license_diagonals": LICENSES, "op5_mix_sources": MIX, "op9_benchmark_windows": WINDOWS, "op10_ngram_jaccard": JACCARD,
    "op11_quality_cascade": QUALITY, "op13_spelling_variants": VARIANTS,
}
