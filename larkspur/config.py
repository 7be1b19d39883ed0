"""Configuration of embedding, stores, search and reranking."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Mapping
from dataclasses import dataclass

from . import env

#: For a field the variables that set it, the first that is set counts.
_EMBEDDING_KEY, _RERANK_KEY = ("RAG_EMBEDDING_API_KEY", "LITELLM_API_KEY", "LLM_API_KEY"), ("RAG_RERANK_API_KEY", "LITELLM_API_KEY", "LLM_API_KEY")
_NAMES = {
    "embedding_endpoint": ("RAG_EMBEDDING_ENDPOINT", "LITELLM_EMBEDDING_ENDPOINT", "OLLAMA_EMBEDDING_URL"), "embedding_api_key": _EMBEDDING_KEY,
    "embedding_auth_header": ("RAG_EMBEDDING_AUTH_HEADER", "LITELLM_AUTH_HEADER"), "rerank_endpoint": ("RAG_RERANK_ENDPOINT", "LITELLM_RERANK_ENDPOINT"),
    "rerank_api_key": _RERANK_KEY, "rerank_auth_header": ("RAG_RERANK_AUTH_HEADER", "LITELLM_AUTH_HEADER"), "rerank_score_weight": ("RAG_RERANK_SCORE_WEIGHT",), "retrieval_score_weight": ("RAG_RETRIEVAL_SCORE_WEIGHT",),
    "http_retries": ("RAG_HTTP_RETRIES",), "http_retry_delay": ("RAG_HTTP_RETRY_DELAY",), "vector_url": ("QDRANT_URL",), "vector_path": ("QDRANT_PATH",), "vector_api_key": ("QDRANT_API_KEY",),
    "vector_collection": ("QDRANT_COLLECTION",), "vector_name": ("QDRANT_VECTOR_NAME",), "chat_model": ("RAG_CHAT_MODEL", "LITELLM_MODEL"), "chat_endpoint": ("RAG_CHAT_ENDPOINT",), "chat_api_key": ("RAG_CHAT_API_KEY", "LITELLM_API_KEY", "LLM_API_KEY"),
}


def endpoint(base: str | None, path: str) -> str | None:
    """The address of a service below a base address."""
    return f"{base.rstrip('/')}/{path.lstrip('/')}" if base else None


@dataclass(frozen=True)
class Config:
    enabled: bool = False
    embedding_provider: str = "hash"
    embedding_model: str = "hash"
    embedding_endpoint: str | None = None
    embedding_api_key: str | None = None
    embedding_auth_header: str = "Authorization"
    embedding_batch_size: int = 16
    embedding_timeout: float = 120.0
    embedding_use_fp16: bool = True
    hash_embedding_dimensions: int = 64
    vector_provider: str = "auto"
    vector_url: str | None = None
    vector_path: str | None = None
    vector_api_key: str | None = None
    vector_collection: str = "chunks"
    vector_name: str = "dense"
    keyword_provider: str = "local"
    keyword_url: str | None = None
    keyword_index: str = "chunks"
    keyword_analyzer: str = "ik_max_word"
    keyword_search_analyzer: str = "ik_smart"
    keyword_username: str | None = None
    keyword_password: str | None = None
    keyword_api_key: str | None = None
    keyword_timeout: float = 10.0
    rerank_provider: str = "identity"
    rerank_model: str = "rerank"
    rerank_endpoint: str | None = None
    rerank_api_key: str | None = None
    rerank_auth_header: str = "Authorization"
    rerank_timeout: float = 120.0
    rerank_score_weight: float = 0.65
    retrieval_score_weight: float = 0.35
    chat_model: str | None = None
    chat_endpoint: str | None = None
    chat_api_key: str | None = None
    http_retries: int = 4
    http_retry_delay: float = 1.0
    vector_top_k: int = 100
    bm25_top_k: int = 100
    fusion_top_k: int = 60
    rerank_top_k: int = 60
    final_top_k: int = 8
    fusion_method: str = "rrf"
    vector_weight: float = 1.0
    bm25_weight: float = 1.0

    @classmethod
    def from_env(cls, source: Mapping[str, str] | None = None) -> Config:
        """Values of the environment, after a .env file was read, or of a mapping; values that don't
        fit a field's type leave its default."""
        if source is None:
            env.load_env()
            source = os.environ
        found = {}
        for field in dataclasses.fields(cls):
            name = next((n for n in _NAMES.get(field.name, ("RAG_" + field.name.upper(),)) if source.get(n)), None)
            if name is None:
                continue
            kind = type(field.default)
            found[field.name] = env.flag(name, field.default, source) if kind is bool else env.number(name, field.default, source) if kind in (int, float) else source[name]
        base = source.get("LITELLM_BASE_URL")
        for field, path in (("rerank_endpoint", "rerank"), ("chat_endpoint", "chat/completions")):
            if base and field not in found:
                found[field] = endpoint(base, path)
        return cls(**found)

    def with_(self, **changes) -> Config:
        return dataclasses.replace(self, **changes)
