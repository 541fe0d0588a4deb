"""SQL for DuckDB of those queries of this package that SQL can express."""

from __future__ import annotations

from .chat import CONTROL
from .quality import LEAST_WORDS, MOST_REPEATED, RULES, STOP_WORDS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE gone.p IS NULL) AS kept, count(gone.p) AS n FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p GROUP BY x.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
_KEPT = " AND ".join([f"coalesce({n} >= {a}, true)" for n, a, _ in RULES if a is not None] + [f"coalesce({n} <= {b}, true)" for n, _, b in RULES if b is not None])

OP2 = rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  length(regexp_replace(array_to_string(ws, ''), '\P{{L}}', '', 'g')) AS letters, len(ls) AS lines, len(list_filter(ws, lambda x: x IN ({_STOPS}))) AS stops, len(list_filter(ls, lambda x: ends_with(rtrim(x), '...') OR ends_with(rtrim(x), '…'))) AS dots, len(list_filter(ls, lambda x: substr(ltrim(x), 1, 1) IN ('-', '*', '•'))) AS bullets FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
q AS (SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(n_words, 0) AS symbol_ratio, letters / nullif(word_chars, 0) AS letter_ratio, stops / nullif(n_words, 0) AS stop_ratio, n_dup_lines / nullif(lines, 0) AS dup_line_ratio, dots / nullif(lines, 0) AS ellipsis_line_ratio, bullets / nullif(lines, 0) AS bullet_line_ratio,
  n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {_KEPT} AS kept FROM q"""


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text).replace("'", "''")


_RISKY = "|".join([*(_quoted(c) for c in sorted(CONTROL, key=len, reverse=True)), r"\\"])

OP6 = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, 12 + length(role) + len(regexp_extract_all(role, '{_RISKY}')) + len(regexp_extract_all(role, '\n')) + 1 + length(text) + len(regexp_extract_all(text, '{_RISKY}')) + 11 AS chars FROM c),
s AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS said, string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn) AS loss, sum(chars)::BIGINT AS formatted_chars FROM n GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM s"""

_BENCH = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8 = f"""WITH b AS (SELECT item_id::VARCHAR AS item, {_BENCH} AS ws FROM benchmark),
pat AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS g FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, {_BENCH} AS ws FROM documents), sizes AS (SELECT DISTINCT n FROM pat),
x AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
f AS (SELECT x.doc_id, x.n, i, item FROM x JOIN pat ON pat.g = x.g AND pat.n = x.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM f)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM f) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, h.n IS NOT NULL AS contaminated FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

_URL = r"'^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::\d*)?(/[^?#]*)?'"


def op9(entries, captures: int, segment: str) -> str:
    values = ", ".join(f"('{kind}', '{key}', '{action}', TIMESTAMP '{day}')" for kind, key, action, day in entries)
    return f"""WITH o AS (SELECT key, min(page_id) AS p FROM (SELECT page_id, regexp_extract(lower(url), '{segment}', 1) AS key FROM pages WHERE page_id % 5 = 0) WHERE key <> '' GROUP BY key),
e AS (SELECT * FROM (VALUES {values}) v(kind, key, action, day) UNION ALL SELECT 'prefix', key, 'add', TIMESTAMP '2024-01-01' + to_days(CAST(p * 7 % 366 AS INTEGER)) FROM o UNION ALL SELECT 'prefix', key, 'remove', TIMESTAMP '2024-01-01' + to_days(CAST(p * 7 % 366 + 60 AS INTEGER)) FROM o WHERE p % 2 = 0),
n AS (SELECT kind, key, day, max(action) AS action FROM e GROUP BY kind, key, day),
c AS (SELECT * FROM n QUALIFY action <> coalesce(lag(action) OVER (PARTITION BY kind, key ORDER BY day), 'remove')),
iv AS (SELECT kind, key, day AS valid_from, action, lead(day) OVER (PARTITION BY kind, key ORDER BY day) AS valid_to FROM c),
p AS (SELECT page_id * {captures} + c AS page_id, page_id AS own, url, TIMESTAMP '2024-01-01' + to_days(CAST((page_id + c * 131) % 366 AS INTEGER)) AS at, lower(regexp_extract(trim(url), {_URL}, 1)) AS host, list_filter(string_split(lower(regexp_extract(trim(url), {_URL}, 2)), '/'), lambda x: x <> '') AS steps FROM pages, (SELECT unnest(range(0, {captures})) AS c)),
k AS (SELECT page_id, 'domain' AS kind, array_to_string(l[i + 1:], '.') AS key FROM (SELECT page_id, string_split(host, '.') AS l, unnest(range(0, greatest(len(string_split(host, '.')) - 2, 0) + 1)) AS i FROM p)
  UNION ALL SELECT page_id, 'prefix', CASE WHEN i = 0 THEN host ELSE host || '/' || array_to_string(steps[1:i], '/') END FROM (SELECT page_id, host, steps, unnest(range(0, len(steps) + 1)) AS i FROM p)),
a AS (SELECT p.page_id, iv.kind, iv.key, iv.valid_from, row_number() OVER (PARTITION BY p.page_id ORDER BY iv.valid_from, iv.kind, iv.key) AS n FROM p JOIN k ON k.page_id = p.page_id JOIN iv ON iv.kind = k.kind AND iv.key = k.key AND iv.action = 'add' AND iv.valid_from <= p.at AND (iv.valid_to IS NULL OR p.at < iv.valid_to))
SELECT p.own AS page_id, p.url, strftime(p.at, '%Y-%m-%d') AS fetched_on, a.page_id IS NOT NULL AS blocked, a.kind AS list_kind, a.key AS list_key, strftime(a.valid_from, '%Y-%m-%d') AS listed_since FROM p LEFT JOIN a ON a.page_id = p.page_id AND a.n = 1"""

OP11 = r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents),
g AS (SELECT text, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.text) AS text_sha256 FROM t JOIN g ON g.text = t.text"""

#: CRC-32 of a decimal number: the table of bytes, and the sum over digits.
_CRC_TABLE = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)))"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"

OP12 = f"""WITH {_CRC_TABLE},
o AS (SELECT doc_id, {_WORDS} AS ws, {_CRC} AS h FROM documents, crc),
g AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS planted, (h // 10) % greatest(len(ws), 1) AS a, (h // 10) % 8 AS more FROM o),
w AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % (1 + (n - a) // (3 + more)) + 1] END) ELSE ws END AS ws FROM g),
x AS (SELECT doc_id, n, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM w),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM x JOIN x y ON y.doc_id = x.doc_id AND y.word = x.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM m) GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
l AS (SELECT doc_id, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE gone.i IS NULL) AS kept FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id)
SELECT w.doc_id, coalesce(l.n, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period, (b.length * 1000 // b.period)::BIGINT AS exponent_milli, sha256(coalesce(l.runs, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN b ON b.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id"""


def op13(fanout: int = 8, most: int = 8) -> str:
    """For up to ``fanout ** most`` leaves a key: each level of the tree is a table of runs, for all leaves below."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join([*map(part, ('doc_id', 'source', 'lang', 'n_chars')), part(text)])})"
    left, right = f"left(run, 64 * (p.place % {fanout})::BIGINT)", f"substr(run, 64 * (p.place % {fanout})::BIGINT + 65)"
    steps = []

    def levels(name: str, table: str, to: str) -> None:
        """CTEs of nodes (key, pos, n, node) level by level, and of the rows of ``to`` with h, proof and place."""
        for k in range(most):
            below = table if k == 0 else f"{name}{k}"
            steps.append(f"{name}r{k} AS (SELECT key, pos // {fanout} AS pos, n, string_agg(node, '' ORDER BY pos) AS run FROM {below} GROUP BY key, pos // {fanout}, n)")
            steps.append(f"{name}{k + 1} AS (SELECT key, pos, (n + {fanout - 1}) // {fanout} AS n, CASE WHEN n > 1 THEN sha256(run) ELSE run END AS node FROM {name}r{k})")
            before = to if k == 0 else f"{name}p{k}"
            steps.append(f"{name}p{k + 1} AS (SELECT p.* EXCLUDE (h, proof, place), CASE WHEN n > 1 THEN sha256({left} || p.h || {right}) ELSE p.h END AS h, CASE WHEN n > 1 THEN p.proof || {left} || {right} ELSE p.proof END AS proof, p.place // {fanout} AS place FROM {before} p JOIN {name}r{k} r ON r.key = p.key AND r.pos = p.place // {fanout})")

    levels("a", "t", "p")
    steps.append(f"s AS (SELECT '' AS key, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n, node, key AS own FROM a{most})")
    steps.append(f"q AS (SELECT p.* EXCLUDE (key, place), s.node AS subroot, s.key, s.pos AS place FROM ap{most} p JOIN s ON s.own = p.key)")
    levels("b", "s", "q")
    return f"""WITH {_CRC_TABLE},
d AS (SELECT doc_id, coalesce(':' || lang, '-') AS key, {leaf('text')} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other FROM documents, crc),
t AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n, leaf AS node, doc_id, other FROM d),
p AS (SELECT doc_id, node AS leaf, coalesce(other, node) AS h, '' AS proof, key, pos AS place FROM t),
{", ".join(steps)}
SELECT doc_id, leaf, subroot, r.node AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = r.node AS verified FROM bp{most}, b{most} r"""
