"""SQL of corpus queries that takes more than a few lines."""

from __future__ import annotations


def paid(state: str, cost: str | int, edits: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edits}'}}"


def structure_sql() -> str:
    """Conversation repair, row by row: the least (cost, edits) of each state, z (nothing yet), s, u, a."""
    none = "{'c': 1000000000, 'a': ''}"
    # Rows that may be inserted before a row, or at the end.
    open_u = f"least(u, {paid('z', 2, 'I')}, {paid('s', 2, 'I')}, {paid('a', 2, 'I')})"
    closed = f"least(a, {paid('cu', 2, 'I')})"

    def before(kind: str, states: tuple[str, ...], state: str) -> str:
        kept = [f"CASE WHEN gone THEN {none} ELSE {paid(x, f'open + CASE WHEN initial = {kind!r} THEN 0 ELSE 2 END', '')} END" for x in states]
        best = kept[0] if len(kept) == 1 else f"least({', '.join(kept)})"
        return f"least({paid(state, 3, 'D')}, {{'c': ({best}).c, 'a': ({best}).a || CASE WHEN initial = {kind!r} THEN 'K' ELSE 'R' END}})"

    system = f"least({paid('s', 3, 'D')}, CASE WHEN gone OR initial <> 's' THEN {none} ELSE {paid('z', 'open', 'K')} END)"
    return rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), crc AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(name) + 1), lambda i: ord(name[i])::UBIGINT)), lambda c, b:
    list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))), 4294967295::UBIGINT) % 20 AS kind
  FROM k
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM crc WHERE kind <> 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM d
), f AS (
  SELECT *, role[1] AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS unended, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS previous FROM n
), o AS (
  SELECT *, blank OR again AS gone, (unended AND NOT blank AND NOT again)::INTEGER AS open FROM f
), r AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': ''}} AS z, {none} AS s, {none} AS u, {none} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, {paid('z', 3, 'D')}, {system}, {before('u', ('z', 's', 'ca'), 'cu')}, {before('a', ('cu',), 'ca')}
  FROM (SELECT *, {closed} AS ca FROM (SELECT r.conv_id, o.i, z, s, u, a, initial, gone, open, {open_u} AS cu FROM r JOIN o ON o.conv_id IS NOT DISTINCT FROM r.conv_id AND o.i = r.i + 1))
), e AS (
  SELECT conv_id, least(z, {closed}) AS best FROM (SELECT *, {open_u} AS cu FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1))
), l AS (
  SELECT conv_id, best.a[p] AS edit, p, sum(CASE WHEN best.a[p] <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS i
  FROM (SELECT conv_id, best, unnest(range(1, length(best.a) + 1)) AS p FROM e)
), m AS (
  SELECT l.conv_id, l.p, l.edit, o.role, o.text, sum(CASE WHEN edit = 'D' OR edit = 'K' AND o.initial = 's' THEN 0 ELSE 1 END) OVER (PARTITION BY l.conv_id ORDER BY l.p) AS turns
  FROM l LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM l.conv_id AND o.i = l.i AND l.edit <> 'I'
), t AS (
  SELECT conv_id, string_agg((CASE WHEN edit = 'K' THEN role WHEN turns % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS text
  FROM m WHERE edit <> 'D' GROUP BY conv_id
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
    sum(open)::BIGINT AS truncated, count(*) FILTER (WHERE previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM o GROUP BY conv_id
)
SELECT e.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
  coalesce(c.illegal, 0)::BIGINT AS illegal, e.best.c::BIGINT AS cost, e.best.a AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM e LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

COLLOCATIONS = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g AS (
  SELECT lang, n, array_to_string(ws[i:i + n - 1], ' ') AS phrase FROM (SELECT lang, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS n))
), f AS MATERIALIZED (
  SELECT lang, phrase, n, count(*) AS f FROM g GROUP BY ALL
), c AS MATERIALIZED (
  SELECT lang, phrase, n, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE n >= 2 AND f >= 10
), cut AS (
  SELECT lang, phrase, n, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, n)) AS k FROM c)
), k AS (
  SELECT cut.*, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM cut JOIN f AS l ON l.lang = cut.lang AND l.phrase = cut.head JOIN f AS r ON r.lang = cut.lang AND r.phrase = cut.rest
), b AS (
  SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE n = 3) GROUP BY ALL
), t AS (
  SELECT b.* FROM b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a
)
SELECT t.lang, row_number() OVER (PARTITION BY t.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, s.n::BIGINT AS n, score::BIGINT AS score
FROM t JOIN (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang) s ON s.lang = t.lang QUALIFY rank <= 2000
"""
