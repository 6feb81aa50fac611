"""op12: the best documents of every benchmark item."""

from __future__ import annotations

from hybridq.llm.registry import query, table
from hybridq.llm.reversed_search import reversed_search

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT count(*) AS nd, sum(len(terms))::BIGINT AS nt FROM d WHERE len(terms) > 0),
i AS (SELECT row_number() OVER () AS no, item_id, {_TERMS} AS terms FROM benchmark),
p AS (SELECT no, item_id, term, count(*) AS times FROM (SELECT no, item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM t, s WHERE term IN (SELECT term FROM p) GROUP BY term
), f AS (
  SELECT no, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nd) // nt)))))::BIGINT AS score
  FROM p JOIN t USING (term) JOIN w USING (term), s GROUP BY ALL
), k AS (
  SELECT *, row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM f WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
"""


@query("op12_reversed_search", SQL)
def op12(spark, sf_dir):
    return reversed_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
