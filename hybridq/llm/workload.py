"""The registered queries of the training-data operators."""

from __future__ import annotations


def all_llm_queries() -> None:
    """Import every query module, which registers its queries."""
    from hybridq.llm import q_conversations, q_dedup, q_jaccard, q_license, q_neighbours, q_pages, q_pieces, q_quality, q_search, q_substrings, q_tokens, q_warc  # noqa: F401
