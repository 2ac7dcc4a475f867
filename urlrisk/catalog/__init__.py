"""Registered queries over the given tables."""


def load():
    """All registered queries by name."""
    import importlib
    for module in ("url_queries", "osint_queries", "text_queries", "score_queries", "corpus_queries", "history_queries", "dataset_queries", "model_queries",
                   "stream_queries"):
        importlib.import_module(f"{__name__}.{module}")
    from .registry import QUERIES
    return QUERIES
