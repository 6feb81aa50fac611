"""op9: components of near copies among all documents."""

from __future__ import annotations

from hybridq.llm.jaccard_join import jaccard_components
from hybridq.llm.registry import query, table

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 75 * (a.size + b.size - shared)
), r AS (
  SELECT doc_id AS start, doc_id AS reached FROM documents UNION SELECT r.start, l.y FROM r JOIN l ON l.x = r.reached
)
SELECT d.doc_id, coalesce(n.size, 0) AS n_shingles, min(r.reached) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.start = d.doc_id GROUP BY d.doc_id, n.size
"""


@query("op9_ngram_jaccard_join", SQL)
def op9(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
