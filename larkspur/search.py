"""Hybrid, multi-query and hypothetical-document search of whole sets of queries, and phase evidence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .config import Config
from .operators import expand
from .operators.fusion import RRF_K, blended_rerank, identity_rerank, lexical_rerank, rrf
from .providers import Chat, Embedder, Reranker, embed_column, model_hypotheses, model_rerank, model_variants, rerank_scores
from .scratch import materialise
from .stores import where


class Search(Protocol):
    def search(self, queries: DataFrame, request: Request | None = None) -> DataFrame: ...


@dataclass(frozen=True)
class Request:
    """How much to take at each step, None or 0 for the configured value, and a filter: metadata that
    has to be equal or one of a list, or any condition on the chunks' columns."""

    vector_top_k: int | None = None
    bm25_top_k: int | None = None
    fusion_top_k: int | None = None
    rerank_top_k: int | None = None
    final_top_k: int | None = None
    metadata: dict | None = None
    condition: Column | None = None

    def sized(self, config: Config) -> dict[str, int]:
        names = ("vector_top_k", "bm25_top_k", "fusion_top_k", "rerank_top_k", "final_top_k")
        return {n: getattr(self, n) or getattr(config, n) for n in names}

    def where(self) -> Column | None:
        own = where(self.metadata)
        return own if self.condition is None else self.condition if own is None else own & self.condition


@dataclass(frozen=True)
class Hybrid:
    """Vector and keyword search, fused by reciprocal ranks, cut and reranked. Stores search a table of
    queries at once; rerank is "identity", "lexical" or a model, blend for a model's scores to be
    blended with those of retrieval."""

    embedder: Embedder
    vectors: object
    keywords: object
    rerank: str | Reranker = "identity"
    config: Config = Config()
    blend: bool = True

    def _found(self, queries: DataFrame, request: Request) -> list[DataFrame]:
        size = request.sized(self.config)
        wanted = request.where() if not hasattr(self.vectors, "transport") else request.metadata
        dense = self.vectors.search(embed_column(queries, "query_id", "query", self.embedder), size["vector_top_k"], wanted)
        wanted = request.where() if not hasattr(self.keywords, "transport") else request.metadata
        return [dense, self.keywords.search(queries, size["bm25_top_k"], wanted)]

    def chunks(self) -> DataFrame:
        return self.keywords.store.read()

    def search(self, queries: DataFrame, request: Request | None = None) -> DataFrame:
        """query_id, chunk_id, score, source, rank for queries: query_id, query."""
        request = request or Request()
        size = request.sized(self.config)
        fused = rrf(self._found(queries, request), size["fusion_top_k"], weights=[self.config.vector_weight, self.config.bm25_weight])
        candidates, k = fused.where(F.col("rank") <= size["rerank_top_k"]), size["final_top_k"]
        if self.rerank == "identity":
            return identity_rerank(candidates, k)
        if self.rerank == "lexical":
            return lexical_rerank(candidates, queries, self.chunks(), k)
        scores = rerank_scores(candidates, queries, self.chunks(), self.rerank)
        if not self.blend:
            return model_rerank(candidates, scores, k)
        return blended_rerank(candidates, scores, k, (self.config.rerank_score_weight, self.config.retrieval_score_weight))


def fuse_variants(found: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Results of variants (query_id, variant, chunk_id, rank, source) fused by query. A query whose
    variants but one found nothing keeps that one's results as they are."""
    fused = found.groupBy("query_id", "chunk_id").agg(
        F.sum(1 / (rrf_k + F.col("rank"))).alias("fused"), F.min(F.struct("variant", "rank", "score")).alias("at"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("source", r"\+"))))), "+").alias("source"),
    )
    sizes = found.groupBy("query_id", "variant").agg(F.count("*").alias("n"))
    per = sizes.groupBy("query_id").agg(F.count("*").alias("sets"), F.min(F.struct("variant", "n"))["n"].alias("first"))
    joined = fused.join(per, "query_id").withColumn("score", F.when(F.col("sets") == 1, F.col("at.score")).otherwise(F.col("fused")))
    order = F.when(F.col("sets") == 1, F.col("at.rank").cast("double")).otherwise(-F.round("fused", 12))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "at", "chunk_id"))
    most = F.when(F.col("sets") == 1, F.col("first")).otherwise(F.greatest(F.lit(k), F.col("first")))
    return joined.withColumn("rank", place).where(F.col("rank") <= most).select("query_id", "chunk_id", "score", "source", "rank")


@dataclass(frozen=True)
class MultiQuery:
    """Searches all variants of all queries in one plan and fuses them by query. rewrite is an
    expression of variants over a query, or a language model."""

    of: Search
    rewrite: Callable[[Column], Column] | Chat = expand.synonym_variants
    rrf_k: int = RRF_K

    def search(self, queries: DataFrame, request: Request | None = None) -> DataFrame:
        rows = model_variants(queries, self.rewrite) if hasattr(self.rewrite, "complete") else expand.variants(queries, self.rewrite(F.col("query")))
        kind = queries.schema["query_id"].dataType
        keyed = rows.select(F.concat_ws("\x1f", F.col("query_id").cast("string"), "place").alias("query_id"), F.col("variant").alias("query"))
        if hasattr(self.of, "vectors"):  # stores take numbers as ids of queries
            keyed = rows.select(F.xxhash64("query_id", "place").alias("query_id"), F.col("variant").alias("query"))
            back = rows.select(F.xxhash64("query_id", "place").alias("key"), "query_id", F.col("place").alias("variant"))
            found = self.of.search(keyed, request).withColumnRenamed("query_id", "key").join(back, "key")
        else:
            parts = F.split("query_id", "\x1f")
            found = self.of.search(keyed, request).withColumns({"variant": parts[1].cast("int"), "query_id": parts[0].cast(kind)})
        return fuse_variants(found, (request or Request()).final_top_k or 20, self.rrf_k)


@dataclass(frozen=True)
class Hyde:
    """Vector search with a text that might answer, keyword search with the query, fused. No filter is
    passed on. generate is an expression over a query, or a language model."""

    of: Search
    generate: Callable[[Column], Column] | Chat = expand.hypothetical
    rrf_k: int = RRF_K
    weights: tuple[float, float] = (1.0, 1.0)

    def search(self, queries: DataFrame, request: Request | None = None) -> DataFrame:
        plain = replace(request or Request(), metadata=None, condition=None)
        made = model_hypotheses(queries, self.generate) if hasattr(self.generate, "complete") else queries.withColumn("query", self.generate(F.col("query")))
        by_text = materialise(self.of.search(made, replace(plain, bm25_top_k=1)).withColumn("source", F.concat("source", F.lit("+hyde"))), "by-text")
        by_word = materialise(self.of.search(queries, replace(plain, vector_top_k=1)), "by-word")
        sizes = by_text.groupBy("query_id").count().unionByName(by_word.groupBy("query_id").count()).groupBy("query_id").agg(F.max("count").alias("most"))
        fused = rrf([by_text, by_word], None, self.rrf_k, list(self.weights))
        return fused.join(sizes, "query_id").where(F.col("rank") <= F.col("most")).drop("most")


def with_chunks(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results with their chunks' columns, a citation and a preview of 360 characters."""
    joined = results.join(chunks, "chunk_id")
    meta = lambda k: F.try_element_at("metadata", F.lit(k)) if "metadata" in chunks.columns else F.lit(None).cast("string")
    source = F.col("source_path") if "source_path" in chunks.columns else F.lit("")
    named = expand.citation(source, meta("section"), meta("section_title"), meta("page_start"), meta("page_end"), F.col("chunk_id"), F.col("rank"))
    return joined.withColumns({"citation": named, "preview": F.substring(F.regexp_replace("content", r"\s+", " "), 1, 360)})


def routed_condition(query: str | Column) -> Column:
    """What a query's names of files or standards ask of the metadata title and standard_id: true
    without any."""
    q = F.lit(query) if isinstance(query, str) else query
    titles, standards = expand.routed_titles(q), expand.routed_standards(q)
    own = lambda k: F.try_element_at("metadata", F.lit(k))
    by_title = (F.size(titles) == 0) | F.coalesce(F.array_contains(titles, own("title")), F.lit(False))
    return by_title & ((F.size(standards) == 0) | F.coalesce(F.array_contains(standards, own("standard_id")), F.lit(False)))


def phase_query(phase: str, title: str, required: list[str], inputs: dict) -> str:
    """What a phase of work asks for, as a text to search with."""
    given = ", ".join(sorted(inputs)) or "no provided inputs"
    return "\n".join([f"{phase} {title}", "required_inputs: " + ", ".join(required), f"provided_inputs: {given}"])


def phase_evidence(spark: SparkSession, phase: str, title: str, required: list[str], inputs: dict, metadata: dict | None = None, of: Hybrid | None = None, config: Config | None = None) -> list[dict]:
    """Cited evidence for a phase, at most final_top_k rows; none if search isn't enabled and no
    searcher is given."""
    config = config or Config.from_env()
    if of is None:
        if not config.enabled:
            return []
        from .factory import default_search

        of = default_search(spark)
    asked = spark.createDataFrame([(0, phase_query(phase, title, required, inputs))], "query_id long, query string")
    sized = Request(config.vector_top_k, config.bm25_top_k, config.fusion_top_k, config.rerank_top_k, config.final_top_k, metadata)
    found = with_chunks(of.search(asked, sized), of.chunks()).drop("query_id", "preview", "vector")
    return [r.asDict(True) for r in found.orderBy("rank").collect()]


def dense_only(queries: DataFrame, embedder: Embedder, vectors, chunks: DataFrame, k: int = 10) -> DataFrame:
    """Vector search alone, with citations and previews."""
    return with_chunks(vectors.search(embed_column(queries, "query_id", "query", embedder), k), chunks)


def evaluate(of: Search, chunks: DataFrame, items: DataFrame, answers: DataFrame | None = None, depths: tuple[int, ...] = (1, 3, 5, 10), allowed: DataFrame | None = None, top_k: int = 10, overfetch: int = 200, by: str = "query_type", threshold: float = 0.55) -> tuple[DataFrame, DataFrame]:
    """(a row for each item, summary) of a search over evaluation items: query_id, query, gold,
    gold_docs, expected_answer, negative and `by`. allowed: chunk ids that results are cut to."""
    from .operators.evaluate import after_filter, score_items, summarise

    most = max(top_k, *depths)
    wide = max(most, overfetch)
    raw = of.search(items.select("query_id", "query"), Request(wide, wide, wide, wide, wide))
    held = after_filter(raw, allowed, most).join(chunks.select("chunk_id", "doc", "content"), "chunk_id")
    scored = score_items(items, held, answers, depths, threshold)
    return scored, summarise(scored, by, depths)
