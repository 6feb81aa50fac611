"""op11: main text of all pages."""

from __future__ import annotations

from hybridq.llm.page_difference import main_text
from hybridq.llm.registry import query, table

#: Pages of the given tables have one article without other elements than these, and few character references.
_REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
_TEXT = r"regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g')"
for _from, _to in _REFERENCES:
    _TEXT = f"replace({_TEXT}, '{_from}', '{_to}')"

SQL = rf"""
SELECT page_id, url, text, len(text) AS n_chars
FROM (SELECT page_id, url, trim(regexp_replace({_TEXT}, '\s+', ' ', 'g')) AS text FROM pages)
"""


@query("op11_page_differencing", SQL)
def op11(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
