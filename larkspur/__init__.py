"""Document corpora on Spark: preparation, search and evaluation."""

from importlib import import_module

_WHERE = {
    "Config": "config", "Request": "search", "Hybrid": "search", "MultiQuery": "search", "Hyde": "search", "phase_evidence": "search", "evaluate": "search", "with_chunks": "search",
    "Runtime": "factory", "build_runtime": "factory", "build_embedder": "factory", "build_vectors": "factory", "build_keywords": "factory", "build_reranker": "factory", "build_chat": "factory", "default_search": "factory", "clear_default": "factory",
    "TableStore": "stores", "TableVectors": "stores", "TableKeywords": "stores", "VectorService": "stores", "KeywordService": "stores", "Ingestor": "stores", "bulk_load": "stores",
    "HashEmbedder": "providers", "RemoteEmbedder": "providers", "RemoteReranker": "providers", "RemoteChat": "providers", "Http": "providers",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    """Names are loaded at first use, so that workers don't import what they don't need."""
    if name in _WHERE:
        return getattr(import_module(f".{_WHERE[name]}", __name__), name)
    raise AttributeError(name)
