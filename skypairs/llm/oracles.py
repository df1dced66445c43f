"""DuckDB SQL for the queries that SQL can express, by brute force over all windows."""

from __future__ import annotations

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_CAPITALS}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words('text')} AS w FROM benchmark),
win AS (SELECT item, list_slice(w, s, s + 9) AS ws FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(ws) AS n FROM win),
found AS (SELECT r, s, n, item FROM
    (SELECT r, s, n, list_slice(w, s, s + n - 1) AS ws FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(s)) AS x JOIN win USING (ws)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM found, unnest(range(s, s + n)) AS u(p) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM found WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""

REPEATS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, k, s, list_slice(w, s, s + 12) AS ws FROM d, unnest(range(1, len(w) - 11)) AS u(s)),
least AS (SELECT ws, min(k) AS first FROM win GROUP BY ws),
gone AS (SELECT DISTINCT r, p FROM win JOIN least USING (ws), unnest(range(s, s + 13)) AS u(p) WHERE k > first),
kept AS (SELECT r, p, w[p] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d) AS x ANTI JOIN gone USING (r, p)),
texts AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM kept GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN texts USING (r)"""

#: Every phrase of one to four words is listed and counted.
COLLOCATIONS = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(ps) AS x FROM d) AS q),
totals AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
ph AS MATERIALIZED (SELECT lang, ws, count(*) AS f FROM
    (SELECT lang, list_slice(w, s, s + k - 1) AS ws FROM p, (VALUES (1), (2), (3), (4)) AS ks(k), unnest(range(1, len(w) - k + 2)) AS u(s)) AS x
    GROUP BY lang, ws HAVING count(*) >= 30),
cuts AS (SELECT c.lang, c.ws, c.f AS a, k, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * c.f // (x.f + y.f) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM ph) AS c
    JOIN ph AS x ON x.lang = c.lang AND x.ws = list_slice(c.ws, 1, k)
    JOIN ph AS y ON y.lang = c.lang AND y.ws = list_slice(c.ws, k + 1, len(c.ws))),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
inner_of AS (SELECT lang, list_slice(ws, s, s + k - 1) AS ws, max(f) AS longer
    FROM ph, (VALUES (2), (3)) AS ks(k), unnest(range(1, len(ws) - k + 2)) AS u(s) WHERE k < len(ws) GROUP BY ALL),
kept AS (SELECT b.* FROM best AS b LEFT JOIN inner_of AS o ON o.lang = b.lang AND o.ws = b.ws
    WHERE o.longer IS NULL OR 100::HUGEINT * o.longer < 80::HUGEINT * b.a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
    CAST(n AS BIGINT) AS n, score FROM (SELECT *, array_to_string(ws, ' ') AS phrase FROM kept) AS k JOIN totals USING (lang)) AS z WHERE rank <= 2000"""


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", "n_chars", text])) + ")"


#: Bit by bit, the reflected polynomial of CRC-32; the bits of a text's bytes, lowest first.
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[(ord(c) >> b) & 1 FOR b IN range(8)] FOR c IN "
        "string_split(CAST(doc_id AS VARCHAR), '')])), lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)")

#: All levels of all sources as one table of nodes, then all levels above the sources; each leaf joined to the runs on its way.
MANIFEST = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source, {_leaf('text')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC} % 5 = 0 THEN {_leaf(f"translate(text, '{_CAPITALS}', '{_SMALL}')")} END AS other FROM documents),
l AS MATERIALIZED (SELECT *, coalesce(other, leaf) AS shown, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS p FROM d),
up(s, lev, p, node, n) AS (
    SELECT s, 0, p, leaf, count(*) OVER (PARTITION BY s) FROM l
    UNION ALL SELECT s, lev + 1, p // 16, sha256(string_agg(node, '' ORDER BY p)), (n + 15) // 16 FROM up WHERE n > 1 GROUP BY s, lev, p // 16, n),
inner_nodes AS MATERIALIZED (SELECT * FROM up),
subroots AS MATERIALIZED (SELECT s, lev AS height, node AS subroot FROM inner_nodes WHERE n = 1),
top(lev, p, node, n) AS (
    SELECT 0, s, subroot, count(*) OVER () FROM subroots
    UNION ALL SELECT lev + 1, p // 16, sha256(string_agg(node, '' ORDER BY p)), (n + 15) // 16 FROM top WHERE n > 1 GROUP BY lev, p // 16, n),
outer_nodes AS MATERIALIZED (SELECT * FROM top),
sides AS MATERIALIZED (
    SELECT s, 0 AS stage, lev, p, n, coalesce(string_agg(node, '' ORDER BY p) OVER (PARTITION BY s, lev, p // 16 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
      coalesce(string_agg(node, '' ORDER BY p) OVER (PARTITION BY s, lev, p // 16 ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM inner_nodes
    UNION ALL SELECT NULL, 1, lev, p, n, coalesce(string_agg(node, '' ORDER BY p) OVER (PARTITION BY lev, p // 16 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
      coalesce(string_agg(node, '' ORDER BY p) OVER (PARTITION BY lev, p // 16 ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') FROM outer_nodes),
way AS MATERIALIZED (
    SELECT r, lev AS step, a, b FROM l JOIN sides ON sides.s = l.s AND stage = 0 AND sides.p = l.p // CAST(pow(16, lev) AS BIGINT) WHERE n > 1
    UNION ALL SELECT r, height + lev, a, b FROM l JOIN subroots USING (s) JOIN sides ON stage = 1 AND sides.p = l.s // CAST(pow(16, lev) AS BIGINT) WHERE n > 1),
proofs AS (SELECT r, sha256(string_agg(a || b, '' ORDER BY step)) AS proof FROM way GROUP BY r),
fold(r, step, node) AS (SELECT r, 0, shown FROM l UNION ALL
    SELECT f.r, f.step + 1, sha256(w.a || f.node || w.b) FROM fold AS f JOIN way AS w ON w.r = f.r AND w.step = f.step),
folded AS (SELECT r, arg_max(node, step) AS folded_root FROM fold GROUP BY r)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN subroots USING (s) JOIN folded USING (r) LEFT JOIN proofs USING (r), (SELECT node AS root FROM outer_nodes WHERE n = 1)"""
