"""The registered workload: one query per operator, over the given tables."""


def all_queries() -> None:
    """Import every query module, which registers its queries."""
    from hybridq.workload import q_text, q_sources, q_understanding, q_search, q_requests, q_catalog, q_conversations, q_answers, q_streams  # noqa: F401, I001
