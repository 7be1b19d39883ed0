"""Embedding, reranking and language models behind one interface, services through a transport.

A transport is a function (method, url, headers, body) -> parsed JSON, so that tests need no network.
Clients hold plain settings only and are sent to the tasks that use them: embed_column and
rerank_scores call them once for each Arrow batch.
"""

from __future__ import annotations

import json
import math
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.dense import _embed, with_hash_vectors

Transport = Callable[[str, str, dict, object], object]
_RETRIED = (429, 500, 502, 503, 504)


class Embedder(Protocol):
    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def scores(self, query: str, texts: list[str]) -> dict[int, float]: ...


class Chat(Protocol):
    def complete(self, system: str | None, prompt: str) -> str: ...


@dataclass(frozen=True)
class Http:
    """JSON over HTTP. Statuses of overload and lost connections are tried again, after a pause that
    grows with the number of attempts."""

    timeout: float = 120.0
    attempts: int = 4
    delay: float = 1.0
    opener: Callable = urllib.request.urlopen
    sleep: Callable = time.sleep

    def __call__(self, method: str, url: str, headers: dict, body: object) -> object:
        data = None if body is None else json.dumps(body, ensure_ascii=False).encode()
        for attempt in range(1, max(1, self.attempts) + 1):
            last = attempt >= self.attempts
            try:
                with self.opener(urllib.request.Request(url, data, {"Content-Type": "application/json", "Accept": "application/json", **headers}, method=method), timeout=self.timeout) as answer:
                    return json.loads(answer.read().decode())
            except urllib.error.HTTPError as e:
                if e.code not in _RETRIED or last:
                    raise RuntimeError(f"{method} {url}: HTTP {e.code}: {e.read().decode(errors='replace')}") from e
            except OSError as e:
                if last:
                    raise RuntimeError(f"{method} {url}: {e}") from e
            self.sleep(max(0.0, self.delay) * attempt)
        raise AssertionError("unreachable")


def auth(key: str | None, header: str = "Authorization") -> dict[str, str]:
    """A bearer token, or the bare key under a header of another name."""
    return {} if not key else {"Authorization": f"Bearer {key}"} if header.lower() == "authorization" else {header: key}


def vectors_of(answer: object) -> list[list[float]]:
    """Vectors in any of the usual shapes of answers, numbered ones in order."""
    if isinstance(answer, dict):
        if isinstance(answer.get("embeddings"), list):
            return [[float(x) for x in v] for v in answer["embeddings"]]
        if isinstance(answer.get("data"), list):
            return [[float(x) for x in r["embedding"]] for r in sorted(answer["data"], key=lambda r: int(r.get("index", 0)))]
        if isinstance(answer.get("embedding"), list):
            return [[float(x) for x in answer["embedding"]]]
    raise RuntimeError("the answer holds no embeddings")


@dataclass(frozen=True)
class HashEmbedder:
    """Signed hashes of tokens; needs no service."""

    dimensions: int = 64
    model: str = "hash"

    def embed(self, texts: list[str]) -> list[list[float]]:
        tokens = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
        batch = pa.record_batch([pa.array(range(len(texts))), pa.array(tokens, pa.list_(pa.string()))], names=["id", "tokens"])
        return [v for b in _embed(self.dimensions)(iter([batch])) for v in b.column("vector").to_pylist()]


@dataclass(frozen=True)
class RemoteEmbedder:
    """An OpenAI-compatible service of embeddings."""

    model: str
    url: str
    key: str | None = None
    header: str = "Authorization"
    batch: int = 16
    transport: Transport = field(default_factory=Http)

    def __post_init__(self):
        if not self.url:
            raise RuntimeError("an embedding service needs an endpoint")

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for s in range(0, len(texts), max(1, self.batch)):
            out += vectors_of(self.transport("POST", self.url, auth(self.key, self.header), {"model": self.model, "input": texts[s : s + max(1, self.batch)]}))
        if len(out) != len(texts):
            raise RuntimeError(f"{len(texts)} texts, but {len(out)} vectors")
        return out


def ollama(model: str = "bge-m3", url: str | None = None, **more) -> RemoteEmbedder:
    """A local Ollama service, at OLLAMA_HOST unless an address is given."""
    host = os.environ.get("OLLAMA_HOST", "127.0.0.1:11434").strip().rstrip("/")
    return RemoteEmbedder(model, url or (host if "://" in host else f"http://{host}") + "/api/embed", **more)


@dataclass
class LocalEmbedder:
    """A BGE-M3 model in the worker, loaded at first use."""

    model: str
    fp16: bool = True

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not hasattr(self, "_loaded"):
            try:
                from FlagEmbedding import BGEM3FlagModel
            except ImportError:
                raise RuntimeError("local embeddings need the package FlagEmbedding") from None
            self._loaded = BGEM3FlagModel(self.model, use_fp16=self.fp16)
        return [list(map(float, v)) for v in self._loaded.encode(texts, return_dense=True)["dense_vecs"]]


def rerank_rows(answer: object) -> dict[int, float]:
    """Place of a text and its score, from any of the usual shapes; the first of equal places counts."""
    rows = answer
    if isinstance(answer, dict):
        rows = next((answer[k] for k in ("results", "data", "rankings") if answer.get(k)), [])
    if not isinstance(rows, list):
        raise RuntimeError("the answer holds no list of results")
    out: dict[int, float] = {}

    def first(row: dict, names: tuple[str, ...], kind, default):
        value = next((row[n] for n in names if n in row), default)
        try:
            return kind(value)
        except (TypeError, ValueError):
            return kind(default)

    for n, row in enumerate(rows):
        if isinstance(row, dict):
            place = first(row, ("index", "document_index", "doc_index"), int, n)
            out.setdefault(place, first(row, ("relevance_score", "score", "rank_score", "similarity", "relevance"), float, len(rows) - n))
    if not out:
        raise RuntimeError("the answer holds no results")
    return out


@dataclass(frozen=True)
class RemoteReranker:
    model: str
    url: str
    key: str | None = None
    header: str = "Authorization"
    transport: Transport = field(default_factory=Http)

    def __post_init__(self):
        if not self.url:
            raise RuntimeError("a reranking service needs an endpoint")

    def scores(self, query: str, texts: list[str]) -> dict[int, float]:
        body = {"model": self.model, "query": query, "documents": texts, "top_n": max(1, len(texts)), "return_documents": False}
        return {i: s for i, s in rerank_rows(self.transport("POST", self.url, auth(self.key, self.header), body)).items() if 0 <= i < len(texts)}


@dataclass
class CrossEncoder:
    """A sequence classifier in the worker, loaded at first use. A transport for tests: `load` gives a
    function from pairs to logits."""

    model: str
    batch: int = 16
    longest: int = 512
    load: Callable | None = None

    def _loader(self):
        try:
            import torch
            from transformers import AutoModelForSequenceClassification, AutoTokenizer
        except ImportError:
            raise RuntimeError("a local reranker needs the packages torch and transformers") from None
        local = os.path.exists(os.path.expanduser(self.model))
        tokenizer, model = (c.from_pretrained(self.model, local_files_only=local) for c in (AutoTokenizer, AutoModelForSequenceClassification))

        def logits(pairs):
            with torch.no_grad():
                return model.eval()(**tokenizer(pairs, padding=True, truncation=True, max_length=self.longest, return_tensors="pt")).logits.reshape(-1).tolist()

        return logits

    def scores(self, query: str, texts: list[str]) -> dict[int, float]:
        if not hasattr(self, "_logits"):
            self._logits = (self.load or self._loader)()
        pairs = [[query, t] for t in texts]
        found = [x for s in range(0, len(pairs), self.batch) for x in self._logits(pairs[s : s + self.batch])]
        return {i: 1 / (1 + math.exp(-x)) for i, x in enumerate(found)}


@dataclass(frozen=True)
class RemoteChat:
    model: str
    url: str
    key: str | None = None
    header: str = "Authorization"
    most_tokens: int = 900
    temperature: float = 0.0
    transport: Transport = field(default_factory=Http)

    def complete(self, system: str | None, prompt: str) -> str:
        said = [{"role": "system", "content": system}] if system else []
        body = {"model": self.model, "temperature": self.temperature, "max_tokens": self.most_tokens, "messages": [*said, {"role": "user", "content": prompt}]}
        answer = self.transport("POST", self.url, auth(self.key, self.header), body)
        return (answer["choices"][0]["message"].get("content") or "").strip()


# --- on columns -----------------------------------------------------------------------------------


def embed_column(texts: DataFrame, id_col: str, text_col: str, model: Embedder) -> DataFrame:
    """(id, vector) of every row; a null text counts as empty."""
    return with_vectors(texts.select(id_col, text_col), text_col, model).select(id_col, "vector")


def with_vectors(rows: DataFrame, text_col: str, model: Embedder) -> DataFrame:
    """rows with a column vector, each made where its row lies."""
    if type(model) is HashEmbedder:
        return with_hash_vectors(rows, text_col, model.dimensions)
    own = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = model.embed([t or "" for t in b.column(text_col).to_pylist()]) if b.num_rows else []
            yield pa.record_batch([*b.columns, pa.array(found, pa.list_(pa.float64()))], names=[*own, "vector"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))]))


def rerank_scores(results: DataFrame, queries: DataFrame, chunks: DataFrame, model: Reranker) -> DataFrame:
    """query_id, chunk_id, rerank_score: a query with its texts is one call; texts that the model leaves
    out have no row. A query's candidates are as many as were asked for, so that a row holds them."""
    texts = results.join(chunks.select("chunk_id", "content"), "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "content"))).alias("found"))
    id_kind, chunk_kind = (df.schema[c].dataType.simpleString() for df, c in ((results, "query_id"), (results, "chunk_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for row in b.to_pylist():
                for i, score in model.scores(row["query"] or "", [x["content"] or "" for x in row["found"]]).items():
                    out.append((row["query_id"], row["found"][i]["chunk_id"], float(score)))
            kinds = [b.schema.field("query_id").type, b.schema.field("found").type.value_type.field("chunk_id").type, pa.float64()]
            yield pa.record_batch([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=["query_id", "chunk_id", "rerank_score"])

    return texts.join(queries.select("query_id", "query"), "query_id").mapInArrow(run, f"query_id {id_kind}, chunk_id {chunk_kind}, rerank_score double")


def model_rerank(results: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Results in order of the model's score, which takes the place of the old one."""
    from .operators.lexical import top

    found = results.join(scores, ["query_id", "chunk_id"]).withColumnRenamed("rank", "_old")
    named = found.withColumns({"score": F.col("rerank_score"), "source": F.concat("source", F.lit("+rerank"))}).drop("rerank_score")
    return top(named, k, F.round("score", 9).desc(), F.col("_old")).drop("_old")


REWRITE = "Write {n} search queries for a technical library that ask the following in other words, from other sides, or in other languages. One query a line, nothing else.\n\n{query}"
HYPOTHESIS = "Write a paragraph of 100 to 200 words, formal and technical, as a document that answers the query would have it. Don't say that it is made up."
GROUNDED = "Answer from the numbered sources alone and cite them as [n]. If they don't hold the answer, say: insufficient information."


def rewritten(query: str, answer: str) -> list[str]:
    """The query, then the lines of an answer, without numbering and quotes, each once."""
    lines = (re.sub(r"^[\d.\-\s]+|[\d.\-\s]+$", "", x.strip().strip("\"'")) for x in answer.splitlines())
    return list(dict.fromkeys([query, *filter(None, lines)]))


def _mapped(rows: DataFrame, columns: list[str], kind: str, f: Callable) -> DataFrame:
    arrow = pa.list_(pa.string()) if kind == "array<string>" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [f(*x) for x in zip(*(b.column(c).to_pylist() for c in columns))]
            yield pa.record_batch([b.column(0), pa.array(made, arrow)], names=["query_id", "made"])

    return rows.select("query_id", *columns).mapInArrow(run, f"query_id {rows.schema['query_id'].dataType.simpleString()}, made {kind}")


def model_variants(queries: DataFrame, chat: Chat, n: int = 4) -> DataFrame:
    """query_id, place, variant: the query and what the model makes of it."""
    made = _mapped(queries, ["query"], "array<string>", lambda q: rewritten(q or "", chat.complete(None, REWRITE.format(n=n, query=q))))
    return made.select("query_id", F.posexplode("made").alias("place", "variant"))


def model_hypotheses(queries: DataFrame, chat: Chat) -> DataFrame:
    """query_id, query: a text that might answer the query; the query itself where the model is silent."""
    return _mapped(queries, ["query"], "string", lambda q: chat.complete(HYPOTHESIS, q or "") or q).withColumnRenamed("made", "query")


def grounded_answers(queries: DataFrame, results: DataFrame, chat: Chat) -> DataFrame:
    """query_id, answer from the results' contents, with results: query_id, rank, content, citation."""
    listed = results.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "citation", "content"))), lambda x: F.concat_ws("\n", x["citation"], x["content"])).alias("sources"))
    asked = queries.join(listed, "query_id", "left").withColumn("sources", F.array_join(F.coalesce("sources", F.array().cast("array<string>")), "\n\n"))
    return _mapped(asked, ["query", "sources"], "string", lambda q, s: chat.complete(GROUNDED, f"{q}\n\n{s}")).withColumnRenamed("made", "answer")


def smoke(base: str, key: str | None = None, models: dict[str, str] | None = None, transport: Transport | None = None) -> dict[str, str]:
    """One small call for each service below an address: "ok", or what went wrong."""
    from .config import endpoint

    transport, models, head = transport or Http(), models or {}, auth(key)
    calls = {
        "models": ("GET", "models", None), "chat": ("POST", "chat/completions", {"model": models.get("chat"), "messages": [{"role": "user", "content": "ping"}], "max_tokens": 8}),
        "embedding": ("POST", "embeddings", {"model": models.get("embedding"), "input": ["ping"]}), "rerank": ("POST", "rerank", {"model": models.get("rerank"), "query": "ping", "documents": ["ping", "pong"]}),
    }
    out = {}
    for name, (method, path, body) in calls.items():
        try:
            transport(method, endpoint(base, path), head, body)
            out[name] = "ok"
        except Exception as e:  # each service is reported, the others are still called
            out[name] = str(e)
    return out
