"""DuckDB SQL for those of the ten queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

#: The counts, the base rules, and the cross-document line frequency, over whole texts. A line counts once for each different document: documents whose sets of
#: normalised lines are equal are copies.
OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce('h' || source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws FROM d),
grams AS (SELECT row, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT row, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
repeated AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM repeated, (SELECT unnest([0, 1, 2]) AS k) GROUP BY row),
raw AS (SELECT row, host, unnest(string_split(t, chr(10))) AS line FROM d),
said AS (SELECT * FROM raw WHERE regexp_matches(line, '{WORD}')),
dup AS (SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines FROM said GROUP BY row),
hashed AS (SELECT row, host, len(regexp_extract_all(line, '{WORD}')) AS n,
  ('0x' || left(md5(regexp_replace(translate(array_to_string(regexp_extract_all(line, '{WORD}'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g')), 15))::BIGINT AS h FROM said),
lines AS (SELECT row, host, h, sum(n) AS n FROM hashed GROUP BY ALL),
whole AS (SELECT row, string_agg(h::VARCHAR, ' ' ORDER BY h) AS whole FROM lines GROUP BY row),
times AS (SELECT host, h, count(DISTINCT whole) AS times FROM lines JOIN whole USING (row) GROUP BY host, h),
hosts AS (SELECT host, count(*) AS documents FROM d GROUP BY host),
over AS (SELECT host, h FROM times JOIN hosts USING (host) WHERE times > 10 AND times * 100 > documents),
gone AS (SELECT row, sum(n) AS n_over FROM lines JOIN over USING (host, h) GROUP BY row),
every AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_over, 0) AS n_over
  FROM w LEFT JOIN dup USING (row) LEFT JOIN covered USING (row) LEFT JOIN gone USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ((n_words - n_over) * 100 < n_words * 30) AS kept
FROM every
"""

#: All pairs of vectors, and what is reachable over them.
OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, e, list_max(list_transform(e, lambda x: abs(x))) AS top FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT vec_id, list_transform(e, lambda x: x / top) AS e FROM ok),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM s),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u) AND CASE WHEN len(a.u) = len(b.u) THEN list_dot_product(a.u, b.u) >= 0.9 END),
reach AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT l.b, r.c FROM reach r JOIN l ON r.a = l.a),
n AS (SELECT a, count(*)::BIGINT AS n FROM l GROUP BY a),
c AS (SELECT a, min(c)::BIGINT AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

#: Every window as its words; a word goes that one covers which is there twice.
OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
g AS (SELECT row, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS g FROM (SELECT row, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
r AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT row, unnest(range(i, i + 35)) AS i FROM r),
w AS (SELECT row, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
k AS (SELECT row, string_agg(w, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (row, i) GROUP BY row),
n AS (SELECT row, count(*)::BIGINT AS n FROM gone GROUP BY row)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN n USING (row) LEFT JOIN k USING (row)
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '-' || md5(coalesce(text, '')))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
l AS (SELECT *, coalesce(sum(source_size) OVER (fall ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
  (sum(weight) OVER (fall ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open_weight, (sum(source_size) OVER ())::BIGINT AS total
  FROM s WINDOW fall AS (ORDER BY source_size::DOUBLE / weight, encode(source) NULLS LAST)),
c AS (SELECT *, (3 * total - 4 * before) AS rest, (3 * total - 4 * before) * weight >= 4 * source_size * open_weight AS capped FROM l),
o AS (SELECT rest, open_weight FROM c WHERE NOT capped ORDER BY source_size::DOUBLE / weight, before LIMIT 1),
t AS (SELECT c.source, source_size, CASE WHEN capped THEN (4 * source_size)::DOUBLE / 2 ELSE (o.rest * weight)::DOUBLE / (2 * o.open_weight)::DOUBLE END AS target FROM c LEFT JOIN o ON true),
p AS (SELECT d.doc_id, d.size, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - start)))::BIGINT AS taken FROM p
"""


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def _luhn(v: str) -> str:
    d = _digits(v)
    worth = f"CASE WHEN i % 2 = 1 THEN substr({d}, len({d}) - i + 1, 1)::INT ELSE (substr({d}, len({d}) - i + 1, 1)::INT * 2 // 10) + (substr({d}, len({d}) - i + 1, 1)::INT * 2 % 10) END"
    return f"list_sum(list_transform(range(1, len({d}) + 1), lambda i: {worth})) % 10 = 0"


def _mod97(v: str) -> str:
    bare = f"regexp_replace({v}, '[^0-9A-Z]', '', 'g')"
    values = f"list_transform(string_split(substr({bare}, 5) || left({bare}, 4), ''), lambda c: coalesce(try_cast(c AS INT), ascii(c) - 55))"
    return f"list_reduce(list_concat([0], {values}), lambda a, x: (CASE WHEN x > 9 THEN a * 100 + x ELSE a * 10 + x END) % 97) = 1"


def _kind(name: str, order: int, pattern: str, check: str, before: str = "", after: str = "", context: str = "") -> str:
    """Spans (row, o, kind, a, b) of a kind. RE2 has no look-around: what may not stand before a span is matched with it and cut off, what may not
    stand after it is tested."""
    led = f"(?:^|{before})(?:{pattern})" if before else pattern
    body = f"regexp_replace(v, '^{before}', '')" if before else "v"
    near = f"AND regexp_matches(substr(t, greatest(a - 50, 0) + 1, (a - greatest(a - 50, 0))::INT) || ' ' || substr(t, b + 1, 50), '(?i)\\b(?:{context})\\b')" if context else ""
    follow = f"AND NOT regexp_matches(substr(t, b + 1, 2), '^{after}')" if after else ""
    return f"""{name}_m AS (SELECT row, t, regexp_extract_all(t, '{led}') AS ms, string_split_regex(t, '{led}') AS ps FROM d WHERE regexp_matches(t, '{led}')),
{name}_u AS (SELECT row, t, unnest(ms) AS v, unnest(list_slice(ps, 1, len(ms))) AS p, unnest(range(len(ms))) AS i FROM {name}_m),
{name}_e AS (SELECT row, t, {body} AS v, (sum(length(p) + length(v)) OVER (PARTITION BY row ORDER BY i))::BIGINT AS b FROM {name}_u),
{name}_s AS (SELECT row, {order} AS o, '{name}' AS kind, a, b FROM (SELECT *, b - length(v) AS a FROM {name}_e) WHERE ({check}) {follow} {near})"""


_PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"
_KINDS = (
    ("email", 1, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", 2, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", rf"regexp_full_match(v, '{_PART}(\.{_PART}){{3}}')"),
    ("card", 3, r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN len({_digits('v')}) BETWEEN 16 AND 19 THEN {_luhn('v')} ELSE false END"),
    ("phone", 4, r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_digits('v')}) BETWEEN 8 AND 15"),
    ("iban", 5, r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{1,4}){3,8}", f"CASE WHEN len(replace(v, ' ', '')) BETWEEN 15 AND 34 THEN {_mod97('v')} ELSE false END", "[^A-Za-z0-9]", "[A-Za-z0-9]"),
    ("short_card", 6, r"[0-9](?:[\x20-]?[0-9]){12,14}", _luhn("v"), "[^0-9]", r"[\x20-]?[0-9]", "card|amex|credit|debit"),
    ("ssn", 7, "[0-9]{3}-[0-9]{2}-[0-9]{4}", "true", "[^0-9-]", "[0-9-]", "ssn|social security"),
    ("local_phone", 8, r"(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}", "true", "[^0-9+(-]", "[0-9-]", "phone|tel|call|fax|mobile"),
    ("access_key", 9, "AKIA[0-9A-Z]{16}", "true", "[^A-Z0-9]", "[A-Z0-9]"),
)

#: All kinds of spans, by kind, then place.
OP10 = (
    "WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),\n"
    + ",\n".join(_kind(*k) for k in _KINDS)
    + ",\ns AS ("
    + " UNION ALL ".join(f"SELECT * FROM {k[0]}_s" for k in _KINDS)
    + """),
g AS (SELECT row, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY o, a) FILTER (o < 5) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY o, a) AS spans FROM s GROUP BY row)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (row)"""
)
