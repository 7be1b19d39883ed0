"""Reciprocal rank fusion and reranking of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import rerank_tokens
from ..scratch import materialise
from .lexical import top

RRF_K, RERANK_WEIGHT, RETRIEVAL_WEIGHT = 60, 0.65, 0.35


def rrf(lists: list[DataFrame], k: int | None = None, rrf_k: int = RRF_K, weights: list[float] | None = None, key: str = "query_id") -> DataFrame:
    """query_id, chunk_id, score, source, rank. Each list: query_id, chunk_id, rank, source. A list
    with a weight of 0 or less is ignored; an id that a list has twice adds up. Equal scores go to
    the earlier list, then to the better place in it. k None keeps all."""
    weights = [1.0] * len(lists) if weights is None else weights
    if len(weights) != len(lists):
        raise ValueError("as many weights as lists are needed")
    used = [(i, d, w) for i, (d, w) in enumerate(zip(lists, weights)) if w > 0] or [(0, lists[0].limit(0), 1.0)]
    rows = reduce(
        DataFrame.unionByName,
        (d.select(key, "chunk_id", "source", (w / (rrf_k + F.col("rank"))).alias("part"), F.struct(F.lit(i).alias("list"), F.col("rank").alias("place")).alias("at")) for i, d, w in used),
    )
    fused = rows.groupBy(key, "chunk_id").agg(
        F.sum("part").alias("score"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("source", r"\+"))))), "+").alias("source"), F.min("at").alias("at")
    )
    return top(fused, k or 2**31 - 1, F.round("score", 12).desc(), F.col("at"), F.col("chunk_id"), key=key).drop("at")


def identity_rerank(results: DataFrame, k: int) -> DataFrame:
    return top(results.withColumnRenamed("rank", "_old"), k, F.col("_old"), F.col("chunk_id")).drop("_old")


def lexical_rerank(results: DataFrame, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Number of common words plus a hundredth of the score. Results are written first, so that their size
    is known and the texts needn't be shuffled to meet them."""
    words = materialise(results, "results").join(chunks.select("chunk_id", "content"), "chunk_id").join(queries, "query_id")
    common = F.size(F.array_intersect(rerank_tokens(F.col("query")), rerank_tokens(F.col("content"))))
    scored = words.select("query_id", "chunk_id", F.concat("source", F.lit("+rerank")).alias("source"), F.col("rank").alias("_old"), (common + 0.01 * F.col("score")).alias("score"))
    return top(scored, k, F.round("score", 9).desc(), F.col("_old")).drop("_old")


def _unit(column: str):
    query = Window.partitionBy("query_id")
    low, high = F.min(column).over(query), F.max(column).over(query)
    return F.when(high - low < 1e-12, F.lit(0.5)).otherwise((F.col(column) - low) / (high - low))


def blended_rerank(results: DataFrame, scores: DataFrame, k: int, weights: tuple[float, float] = (RERANK_WEIGHT, RETRIEVAL_WEIGHT)) -> DataFrame:
    """Blend of min-max scaled scores. scores: query_id, chunk_id, rerank_score; a result without
    one takes the least of its query and the last place."""
    total = sum(weights)
    w_rerank, w_retrieval = (RERANK_WEIGHT, RETRIEVAL_WEIGHT) if total <= 0 else (weights[0] / total, weights[1] / total)
    query = Window.partitionBy("query_id")
    given = results.join(scores, ["query_id", "chunk_id"], "left").withColumn(
        "remote", F.when(F.col("rerank_score").isNotNull(), F.row_number().over(query.orderBy(F.col("rerank_score").desc_nulls_last(), "rank")))
    )
    filled = given.withColumn("rerank_score", F.coalesce("rerank_score", F.min("rerank_score").over(query), F.lit(0.0)))
    scaled = filled.withColumns({"rerank_norm": _unit("rerank_score"), "retrieval_norm": _unit("score")})
    blend = w_rerank * F.col("rerank_norm") + w_retrieval * F.col("retrieval_norm")
    out = scaled.select(
        "query_id", "chunk_id", F.col("score").alias("retrieval_score"), "retrieval_norm", "rerank_score", "rerank_norm", blend.alias("score"),
        F.concat("source", F.lit("+rerank_fused")).alias("source"), F.col("remote").alias("_remote"), F.col("rank").alias("_old"),
    )
    return top(out, k, F.round("score", 9).desc(), F.round("rerank_norm", 9).desc(), F.col("_remote").asc_nulls_last(), F.col("_old")).drop("_remote", "_old")
