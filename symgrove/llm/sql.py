"""Longer SQL counterparts, put together from parts."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """Unsigned crc32 of ASCII text, bit by bit."""
    byte = "list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda crc, b: {byte}), 4294967295)"


def _leaf(text: str) -> str:
    fields = [f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')"
              for f in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


# Nodes of all levels of all trees; tree NULL-safe by number, the tree of trees is number -1.
OP11_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf('text')} AS leaf,
         CASE WHEN {_crc32('doc_id::VARCHAR')} % 3 = 0
              THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
              ELSE {_leaf('text')} END AS changed,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, place, leaf AS node, n FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), (n + 7) // 8
  FROM nodes WHERE n > 1 GROUP BY tree, level, place // 8, n),
subroots AS (SELECT tree, max(level) AS height, arg_max(node, level) AS subroot FROM nodes GROUP BY tree),
upper AS (
  SELECT 0 AS level, tree AS place, subroot AS node, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL
  SELECT level + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), (n + 7) // 8
  FROM upper WHERE n > 1 GROUP BY level, place // 8, n),
steps AS (
  SELECT tree, level, place, node, n FROM nodes WHERE n > 1
  UNION ALL
  SELECT s.tree, s.height + u.level, u.place, u.node, u.n
  FROM (SELECT DISTINCT tree, height FROM subroots) s, upper u WHERE u.n > 1),
paths AS (
  SELECT tree, place, level, tree AS in_tree, place // pow(8, level)::BIGINT AS at
  FROM placed JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) USING (tree)
  UNION ALL
  SELECT p.tree, p.place, s.height + u.level, p.tree, p.tree // pow(8, u.level)::BIGINT
  FROM placed p JOIN subroots s USING (tree), (SELECT DISTINCT level FROM upper WHERE n > 1) u),
runs AS (
  SELECT p.tree, p.place, p.level,
         coalesce(string_agg(s.node, '' ORDER BY s.place) FILTER (s.place < p.at), '') AS before,
         coalesce(string_agg(s.node, '' ORDER BY s.place) FILTER (s.place > p.at), '') AS after
  FROM paths p JOIN steps s ON s.tree = p.tree AND s.level = p.level AND s.place // 8 = p.at // 8
  GROUP BY p.tree, p.place, p.level),
proofs AS (
  SELECT tree, place, string_agg(before || after, '' ORDER BY level) AS siblings,
         list([before, after] ORDER BY level) AS sides FROM runs GROUP BY tree, place)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256,
       list_reduce(list_prepend([changed, ''], coalesce(sides, [])),
                   lambda now, side: [sha256(side[1] || now[1] || side[2]), ''])[1] AS folded_root,
       folded_root = root AS verified
FROM placed JOIN subroots USING (tree) LEFT JOIN proofs USING (tree, place),
     (SELECT arg_max(node, level) AS root FROM upper)
"""


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, s.b FROM reached r JOIN steps s ON s.a = r.other)
SELECT doc_id, any_value(len(s)) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reached JOIN sets USING (doc_id) GROUP BY doc_id
"""


def _add(state: str, cost: int, edit: str) -> str:
    """A state is its cost in eight digits and its audit, so the least text is the least state."""
    return f"(lpad((substr({state}, 1, 8)::INTEGER + {cost})::VARCHAR, 8, '0') || substr({state}, 9) || '{edit}')"


_NOTHING, _SYSTEM, _USER, _ASSISTANT = "v[1]", "v[2]", "v[3]", "v[4]"
_TO_USER = [_NOTHING, _SYSTEM, _ASSISTANT]
# Insertions before a row: at most two pay.
_CLOSED = (f"list_transform([v], lambda v: [v[1], v[2], least({_USER}, "
           + ", ".join(_add(s, 5, "I") for s in _TO_USER) + "), "
           + f"least({_ASSISTANT}, {_add(_USER, 5, 'I')}, " + ", ".join(_add(s, 10, "II") for s in _TO_USER) + ")])[1]")


def _edited() -> str:
    """States after a row r = [initial, must go, extra cost] of text values."""
    stay, extra = "r[2] = 'n'", "r[3]::INTEGER"

    def paid(state: str, cost: str, edit: str) -> str:
        return (f"(lpad((substr({state}, 1, 8)::INTEGER + {cost})::VARCHAR, 8, '0') || substr({state}, 9) || '{edit}')")

    def reached(state: str, initial: str, sources: list[str], reroled: bool) -> str:
        options = [paid(state, "2", "D")]
        for source in sources:
            options.append(f"CASE WHEN {stay} AND r[1] = '{initial}' THEN {paid(source, extra, 'K')} END")
            if reroled:
                options.append(f"CASE WHEN {stay} THEN {paid(source, f'1 + {extra}', 'R')} END")
        return f"least({', '.join(options)})"

    return (f"[{paid(_NOTHING, '2', 'D')}, {reached(_SYSTEM, 's', [_NOTHING], False)}, "
            f"{reached(_USER, 'u', _TO_USER, True)}, {reached(_ASSISTANT, 'a', [_USER], True)}]")


_FOLDED = (f"list_reduce(list_prepend(['00000000', NULL, NULL, NULL], rows), lambda w, r: "
           f"list_transform([w], lambda v: list_transform([{_CLOSED}], lambda v: {_edited()})[1])[1])")
_WORD = r"[^\x20\x09-\x0D]"

OP13_SQL = rf"""
WITH kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE kind <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS previous FROM damaged),
faults AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '{_WORD}') AS blank,
         NOT blank AND place > min(place) OVER (PARTITION BY conv_id, role, text) AS duplicate,
         NOT blank AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM ordered),
grouped AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (cut AND NOT duplicate) AS truncated,
         count(*) FILTER (place > 1 AND left(previous, 1) || initial NOT IN ('su', 'ua', 'au')) AS illegal,
         list([initial, CASE WHEN blank OR duplicate THEN 'y' ELSE 'n' END, CASE WHEN cut THEN '5' ELSE '0' END]
              ORDER BY place) AS rows,
         list([role, text] ORDER BY place) AS said
  FROM faults GROUP BY conv_id),
solved AS (
  SELECT *, list_transform([{_FOLDED}], lambda v: least(v[1], list_transform([{_CLOSED}], lambda w: w[4])[1]))[1] AS best
  FROM grouped),
lines AS (
  SELECT conv_id, list_reduce(
    list_prepend(['', '1', '', ''], list_transform(string_split(substr(best, 9), ''), lambda e: [e, '', '', ''])),
    lambda now, e: CASE WHEN e[1] = 'D' THEN [now[1], (now[2]::INTEGER + 1)::VARCHAR, now[3], '']
      ELSE [CASE WHEN e[1] = 'K' THEN left(said[now[2]::INTEGER][1], 1) WHEN now[1] = 'u' THEN 'a' ELSE 'u' END,
            CASE WHEN e[1] = 'I' THEN now[2] ELSE (now[2]::INTEGER + 1)::VARCHAR END,
            now[3] || CASE WHEN now[1] = '' THEN '' ELSE chr(10) END
              || CASE WHEN e[1] = 'K' THEN said[now[2]::INTEGER][1] WHEN now[1] = 'u' THEN 'assistant' ELSE 'user' END
              || ':' || CASE WHEN e[1] = 'I' THEN '' ELSE said[now[2]::INTEGER][2] END, ''] END)[3] AS repaired
  FROM solved)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(substr(best, 1, 8)::BIGINT, 0) AS cost, coalesce(substr(best, 9), '') AS audit,
       sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM c.conv_id
"""
