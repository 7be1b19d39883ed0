"""Embedders, stores, rerankers and searches from a configuration."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import SparkSession

from .config import Config
from .providers import CrossEncoder, Embedder, HashEmbedder, Http, LocalEmbedder, RemoteChat, RemoteEmbedder, RemoteReranker, Transport, ollama
from .scratch import scratch_path
from .search import Hybrid
from .stores import Ingestor, KeywordService, TableKeywords, TableStore, TableVectors, VectorService


def _name(provider: str | None) -> str:
    return (provider or "").strip().lower().replace("-", "_")


def _header(provider: str, header: str) -> str:
    return "x-litellm-api-key" if provider == "litellm" and header == "Authorization" else header


def _http(config: Config, timeout: float, transport: Transport | None) -> Transport:
    return transport or Http(timeout, config.http_retries, config.http_retry_delay)


def build_embedder(config: Config, transport: Transport | None = None) -> Embedder:
    provider, http = _name(config.embedding_provider), _http(config, config.embedding_timeout, transport)
    if provider in ("hash", "test", "local_hash"):
        return HashEmbedder(config.hash_embedding_dimensions)
    if provider in ("bge", "bge_m3", "flagembedding"):
        return LocalEmbedder(config.embedding_model, config.embedding_use_fp16)
    if provider in ("ollama", "ollama_bge", "ollama_bge_m3"):
        return ollama(config.embedding_model, config.embedding_endpoint, batch=config.embedding_batch_size, transport=http)
    if provider in ("litellm", "openai", "openai_compatible"):
        return RemoteEmbedder(config.embedding_model, config.embedding_endpoint or "", config.embedding_api_key, _header(provider, config.embedding_auth_header), config.embedding_batch_size, http)
    raise ValueError(f"no such embedding provider: {config.embedding_provider}")


def build_vectors(config: Config, spark: SparkSession, transport: Transport | None = None) -> TableVectors | VectorService:
    """auto is a service where an address is given, else a table: at vector_path, or for this application."""
    provider = _name(config.vector_provider)
    if provider == "auto":
        provider = "qdrant" if config.vector_url else "memory"
    if provider in ("memory", "in_memory", "local"):
        return TableVectors(TableStore(spark, config.vector_path or scratch_path(spark, "vectors")))
    if provider == "qdrant":
        if not config.vector_url:
            raise RuntimeError("a vector service needs an address")
        return VectorService(config.vector_url, config.vector_collection, config.vector_name, config.vector_api_key, _http(config, config.embedding_timeout, transport))
    raise ValueError(f"no such vector provider: {config.vector_provider}")


def build_keywords(config: Config, spark: SparkSession, transport: Transport | None = None) -> TableKeywords | KeywordService:
    provider = _name(config.keyword_provider)
    if provider in ("local", "bm25", "memory"):
        return TableKeywords(TableStore(spark, scratch_path(spark, "keywords")))
    if provider in ("elasticsearch", "es", "opensearch", "ik"):
        if not config.keyword_url:
            raise RuntimeError("a keyword service needs an address")
        http = _http(config, config.keyword_timeout, transport)
        return KeywordService(config.keyword_url, config.keyword_index, config.keyword_analyzer, config.keyword_search_analyzer, config.keyword_username, config.keyword_password, config.keyword_api_key, http)
    raise ValueError(f"no such keyword provider: {config.keyword_provider}")


def build_reranker(config: Config, transport: Transport | None = None):
    provider = _name(config.rerank_provider)
    if provider in ("identity", "none", "disabled"):
        return "identity"
    if provider == "lexical":
        return "lexical"
    if provider in ("bge", "bge_m3", "flagembedding"):
        return CrossEncoder(config.rerank_model)
    if provider in ("litellm", "openai", "openai_compatible", "openai_compatible_rerank", "qwen"):
        return RemoteReranker(config.rerank_model, config.rerank_endpoint or "", config.rerank_api_key, _header(provider, config.rerank_auth_header), _http(config, config.rerank_timeout, transport))
    raise ValueError(f"no such rerank provider: {config.rerank_provider}")


def build_chat(config: Config, transport: Transport | None = None) -> RemoteChat:
    if not config.chat_model or not config.chat_endpoint:
        raise RuntimeError("a language model needs a name and an endpoint")
    return RemoteChat(config.chat_model, config.chat_endpoint, config.chat_api_key, transport=_http(config, 120.0, transport))


@dataclass(frozen=True)
class Runtime:
    config: Config
    embedder: Embedder
    vectors: TableVectors | VectorService
    keywords: TableKeywords | KeywordService
    ingestor: Ingestor
    search: Hybrid


def build_runtime(spark: SparkSession, config: Config | None = None, transport: Transport | None = None) -> Runtime:
    config = config or Config.from_env()
    embedder, vectors, keywords = build_embedder(config, transport), build_vectors(config, spark, transport), build_keywords(config, spark, transport)
    rerank = build_reranker(config, transport)
    search = Hybrid(embedder, vectors, keywords, rerank, config, blend=not isinstance(rerank, CrossEncoder))
    return Runtime(config, embedder, vectors, keywords, Ingestor(embedder, vectors, keywords), search)


@lru_cache(maxsize=1)
def default_search(spark: SparkSession) -> Hybrid:
    """The search of the environment's configuration, built once."""
    return build_runtime(spark).search


def clear_default() -> None:
    default_search.cache_clear()
