"""op13: damage and repair of all conversations."""

from __future__ import annotations

from hybridq.llm.conversation_repair import damage, repair_report
from hybridq.llm.registry import query, table

#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a.  (from, to, role) of a user's or an assistant's turn.
_MOVES = [(0, 2, "user"), (1, 2, "user"), (3, 2, "user"), (2, 3, "assistant")]
#: CRC-32, bit by bit, of the bytes of an ASCII text.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, n: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""
_inserts = [(s, s, 0, "[]::VARCHAR[]") for s in range(4)]
_inserts += [(a, b, 3, f"['{r}']") for a, b, r in _MOVES]
_inserts += [(a, c, 6, f"['{r}', '{q}']") for a, b, r in _MOVES for b2, c, q in _MOVES if b == b2]
_VALUES = ", ".join(f"({a}, {b}, {cost}, '{'I' * (cost // 3)}', {roles})" for a, b, cost, roles in _inserts)
_NEXT = ", ".join(f"({a}, {b}, '{r}')" for a, b, r in _MOVES)
_ADD = "list_concat(out, list_transform(roles, lambda x: x || ':'))"

SQL = rf"""
WITH RECURSIVE ins(f, t, more, letters, roles) AS (VALUES {_VALUES}),
nxt(f, t, role) AS (VALUES {_NEXT}),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, {_CRC} % 20 AS fate FROM c),
d AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM h
), g AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
o AS (
  SELECT g.g, d.turn, d.role, d.text, row_number() OVER (PARTITION BY g.g ORDER BY turn NULLS FIRST, sha256(len(role) || ':' || role || text), copy) AS i
  FROM d JOIN g ON d.conv_id IS NOT DISTINCT FROM g.conv_id
), m AS (
  SELECT *, substr(role, 1, 1) AS who, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY g ORDER BY i) AS before
  FROM o
), n AS (
  SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || who NOT IN ('su', 'ua', 'au')) AS illegal
  FROM m GROUP BY g
), edit AS (
  SELECT g, i, s.s AS f, s.s AS t, 4 AS more, 'D' AS letter, NULL AS said FROM m, range(4) s(s)
  UNION ALL SELECT g, i, x.f, x.t, 3 + CASE fault WHEN 't' THEN 3 ELSE 0 END, 'R', x.role || ':' || text FROM m, nxt x WHERE fault IN ('', 't')
  UNION ALL SELECT g, i, x.f, x.t, CASE fault WHEN 't' THEN 3 ELSE 0 END, 'K', m.role || ':' || text FROM m, nxt x WHERE fault IN ('', 't') AND who = x.role[1]
  UNION ALL SELECT g, i, 0, 1, CASE fault WHEN 't' THEN 3 ELSE 0 END, 'K', m.role || ':' || text FROM m WHERE fault IN ('', 't') AND who = 's'
), path(g, i, best) AS (
  SELECT g, 0::BIGINT, struct_pack(s := 0, cost := 0, audit := '', out := []::VARCHAR[]) FROM g
  UNION ALL
  SELECT g, i, unnest(list(best)) FROM (
    SELECT p.g, e.i, min(struct_pack(s := e.t, cost := p.best.cost + ins.more + e.more, audit := p.best.audit || ins.letters || e.letter,
      out := list_concat(list_concat(p.best.out, list_transform(ins.roles, lambda x: x || ':')), CASE WHEN e.said IS NULL THEN [] ELSE [e.said] END))) AS best
    FROM path p JOIN ins ON ins.f = p.best.s JOIN edit e ON e.g = p.g AND e.i = p.i + 1 AND e.f = ins.t GROUP BY p.g, e.i, e.t
  ) GROUP BY g, i
), fin AS (
  SELECT p.g, min(struct_pack(cost := p.best.cost + ins.more, audit := p.best.audit || ins.letters,
    out := list_concat(p.best.out, list_transform(ins.roles, lambda x: x || ':')))) AS z
  FROM path p LEFT JOIN n ON n.g = p.g JOIN ins ON ins.f = p.best.s AND ins.t IN (0, 3) WHERE p.i = coalesce(n.n, 0) GROUP BY p.g
)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, z.cost::BIGINT AS cost, z.audit AS audit, sha256(array_to_string(z.out, chr(10))) AS repaired_sha256
FROM g JOIN fin ON g.g = fin.g LEFT JOIN n ON n.g = g.g
"""


@query("op13_run_length_repair", SQL)
def op13(spark, sf_dir):
    return repair_report(damage(table(spark, sf_dir, "conversations")))
