"""op8: license scan of all documents."""

from __future__ import annotations

from hybridq.llm.license_markup import BASE_PHRASES, scan_licenses
from hybridq.llm.registry import query, table

#: The templates as patterns over words that are each followed by one space.
PATTERNS = {
    "mit-notice": "released under the (terms of the )?mit license ",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of ([^ ]+ ){1,6}and associated documentation files ",
    "apache-2.0-notice": "licensed under the apache license (version )?2 0 ",
    "gpl-3.0-notice": "[a-z]+ is licensed under the gnu general public license (version )?3 ",
    "gpl-or-later-notice": "under the terms of the gnu general public license as published by the free software foundation either version [23] of the license or (at your option )?any later version ",
    "cc-by-nc-notice": "licensed under (the )?cc by nc [1-4] [05] ",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted (subject to the limitations in the disclaimer below )?provided that the following conditions are met ",
}
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _found(label: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches(line, '(^| ){pattern}') THEN '{label}' END"


def _places(phrase: str) -> str:
    words = phrase.split()
    same = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(words, 1))
    return f"list_filter(range(0, greatest(len(words) - {len(words) - 1}, 0)), lambda i: {same})"


_BASE = ", ".join(f"CASE WHEN len({_places(p)}) > 0 THEN '{label}' END" for p, label in BASE_PHRASES.items())
_ALL = ", ".join([_BASE, *[_found(k, v) for k, v in PATTERNS.items()]])
_JOIN = "array_to_string(list_sort(list_filter([{}], lambda x: x IS NOT NULL)), ',')"
SQL = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), l AS (
  SELECT doc_id, words, concat(array_to_string(words, ' '), ' ') AS line, list_concat(list_concat({", ".join([_places(p) for p in BASE_PHRASES][:2])}), {[_places(p) for p in BASE_PHRASES][2]}) AS places FROM w
), s AS (
  SELECT doc_id, len(words) AS n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
    {_JOIN.format(_BASE)} AS base_labels, {_JOIN.format(_ALL)} AS labels FROM l
)
SELECT *, CASE WHEN labels <> base_labels THEN 1.0 WHEN n_base > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM s
"""


@query("op8_license_templates", SQL)
def op8(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))
