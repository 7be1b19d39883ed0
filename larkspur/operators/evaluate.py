"""Retrieval and answer metrics: one row for each question, then grouping sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..functions.text import content_tokens, critical_terms, is_abstention, normalize_lower, sentences

DEPTHS, SUPPORT, QUOTED_ROWS = (1, 3, 5, 10), 0.55, 1024


def _let(a: Column, b: Column, f) -> Column:
    """f(a, b) with both computed once for a row: inside a lambda they would be computed for each element."""
    return F.element_at(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda x: f(x["a"], x["b"])), 1)


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets."""
    often = lambda x, t: F.size(F.filter(x, lambda y: y == t))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, t: n + F.least(often(a, t), often(b, t)))


def coverage(expected: Column, text: Column) -> Column:
    """Share of the expected content tokens that the text has."""
    return _let(content_tokens(expected), content_tokens(text), _share)


def _share(a: Column, b: Column) -> Column:
    return F.when(F.size(a) > 0, overlap(a, b) / F.size(a)).otherwise(0.0)


def token_f1(a: Column, b: Column) -> Column:
    f1 = lambda x, y: F.when((F.size(x) > 0) & (F.size(y) > 0), 2 * overlap(x, y) / (F.size(x) + F.size(y))).otherwise(0.0)
    return _let(content_tokens(a), content_tokens(b), f1)


def sentence_support(answer: Column, evidence: Column, threshold: float = SUPPORT) -> Column:
    """For each sentence of the answer: its text, support, and whether it is supported."""

    def one(s: Column, known: Column, whole: Column) -> Column:
        score = _let(content_tokens(s), known, _share)
        sure = F.forall(critical_terms(s), lambda t: F.contains(whole, normalize_lower(t)))
        return F.struct(s.alias("sentence"), score.alias("support"), ((score >= threshold) & sure).alias("supported"))

    return _let(content_tokens(evidence), normalize_lower(evidence), lambda known, whole: F.transform(sentences(answer), lambda s: one(s, known, whole)))


def answer_metrics(rows: DataFrame, answer: str, evidence: str, threshold: float = SUPPORT) -> DataFrame:
    """rows with abstained, n_sentences, unsupported, hallucination_rate and grounded_rate. An answer
    that abstains has no unsupported sentences, one without sentences is grounded."""
    support = rows.withColumn("_s", sentence_support(F.col(answer), F.col(evidence), threshold))
    missing = F.when(is_abstention(F.col(answer)), 0).otherwise(F.size(F.filter("_s", lambda x: ~x["supported"])))
    counted = support.withColumns({"abstained": is_abstention(F.col(answer)), "n_sentences": F.size("_s"), "unsupported": missing}).drop("_s")
    rate = F.when(F.col("n_sentences") > 0, F.col("unsupported") / F.col("n_sentences")).otherwise(0.0)
    return counted.withColumn("hallucination_rate", rate).withColumn("grounded_rate", 1 - F.col("hallucination_rate"))


def retrieval_metrics(items: DataFrame, results: DataFrame, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """A row for each item. items: query_id, gold (array of ids, null or empty: none) and others;
    results: query_id, chunk_id, rank. Recall is null without gold; the reciprocal rank is 0
    without a hit."""
    found = results.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("_found"))
    kind = T.ArrayType(items.schema["gold"].dataType.elementType)
    joined = items.join(found, "query_id", "left").withColumn("_found", F.coalesce(F.col("_found").cast(kind), F.array().cast(kind)))
    gold = F.array_distinct(F.coalesce("gold", F.array().cast(kind)))
    first = F.aggregate("_found", F.struct(F.lit(0).alias("at"), F.lit(0).alias("hit")), lambda a, x: F.struct((a["at"] + 1).alias("at"), F.when((a["hit"] == 0) & F.array_contains(gold, x), a["at"] + 1).otherwise(a["hit"]).alias("hit")))["hit"]
    columns: dict[str, Column] = {"first_gold_rank": F.nullif(first, F.lit(0)), "mrr": F.when(first > 0, 1 / first).otherwise(0.0)}
    for k in depths:
        top = F.slice("_found", 1, k)
        hits = F.size(F.array_intersect(gold, top))
        columns[f"recall_{k}"] = F.when(F.size(gold) > 0, hits / F.size(gold))
        columns[f"all_hit_{k}"] = (F.size(gold) > 0) & (hits == F.size(gold))
        columns[f"precision_{k}"] = F.when(F.size(gold) > 0, F.when(F.size(top) > 0, F.size(F.filter(top, lambda x: F.array_contains(gold, x))) / F.size(top)).otherwise(0.0))
    return joined.withColumns(columns).drop("_found")


def _mixed(words: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n numbers."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i].astype(np.uint64) + np.uint64(1)
    return out


def _quoting(asked, n: int):
    """Texts with the queries that they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = asked.value
        texts = queries.to_pylist()
        split = [t.split(" ") for t in texts]
        inside = {i: w[1 : n + 1] for i, w in enumerate(split) if len(w) >= n + 2}
        short = [i for i in range(len(texts)) if i not in inside]
        known = pa.array(sorted({x for w in inside.values() for x in w}), pa.string())
        rows = list(inside)
        keys = np.array([_mixed(pc.index_in(pa.array(inside[i]), known).to_numpy(), n)[0] for i in rows], np.uint64)
        order = np.argsort(keys, kind="stable")
        keys, rows = keys[order], np.array(rows, np.int64)[order]
        for batch in batches:
            for s in range(0, batch.num_rows, QUOTED_ROWS):
                part = batch.slice(s, QUOTED_ROWS)
                content = pc.fill_null(part.column("content"), "")
                pairs = set()
                if inside:
                    lists = pc.split_pattern(content, " ")
                    word = pc.fill_null(pc.index_in(lists.flatten(), known), -1).to_numpy()
                    text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                    at = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :]) if len(text) >= n else np.zeros(0, np.int64)
                    at = at[(word[at] >= 0) & (word[at + n - 1] >= 0)]
                    key = _mixed(word, n)[at]
                    first, last = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                    for i in np.flatnonzero(last > first).tolist():
                        pairs |= {(int(text[at[i]]), q) for q in rows[first[i] : last[i]].tolist()}
                    pairs = {(d, q) for d, q in pairs if texts[q] in content[d].as_py()}
                for q in short:
                    pairs |= {(d, q) for d in np.flatnonzero(pc.match_substring(content, texts[q]).to_numpy(zero_copy_only=False)).tolist()}
                found = np.array(sorted(pairs), np.int64).reshape(-1, 2)
                yield pa.record_batch([ids.take(pa.array(found[:, 1])), part.column("chunk_id").take(pa.array(found[:, 0]))], names=["query_id", "chunk_id"])

    return run


def quoting(docs: DataFrame, queries: DataFrame, n: int = 6) -> DataFrame:
    """query_id, chunk_id of the docs (chunk_id, content) whose content holds the whole query: pairs meet
    by n words inside the query, then the text is compared. Queries of fewer words are compared with
    all docs. Queries are sent to all tasks, and texts are read where they lie; only pairs are shuffled."""
    asked = queries.select("query_id", "query").where(F.length("query") > 0).toArrow().combine_chunks()
    held = asked.column("query_id").combine_chunks(), asked.column("query").combine_chunks()
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (docs, "chunk_id"))]
    sent = docs.sparkSession.sparkContext.broadcast(held)
    return docs.select("chunk_id", "content").mapInArrow(_quoting(sent, n), f"query_id {kinds[0]}, chunk_id {kinds[1]}").distinct()


def token_coverage(items: DataFrame, results: DataFrame, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """query_id, coverage_k: share of the content tokens of expected_answer that the first k results
    hold together, counted as multisets. One pass over the results' tokens, joined with those that an
    answer asks for; 0 where the answer has none or nothing was found."""
    asked = items.select("query_id", F.explode(content_tokens(F.col("expected_answer"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("wanted"))
    held = results.select("query_id", "rank", F.explode(content_tokens(F.col("content"))).alias("token")).groupBy("query_id", "token", "rank").agg(F.count("*").alias("n"))
    each = asked.join(held, ["query_id", "token"], "left").groupBy("query_id", "token", "wanted").agg(
        *(F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in depths)
    )
    found = each.groupBy("query_id").agg(*((F.sum(F.least("wanted", f"n_{k}")) / F.sum("wanted")).alias(f"coverage_{k}") for k in depths))
    return items.select("query_id").join(found, "query_id", "left").fillna(0.0)


def score_items(items: DataFrame, results: DataFrame, answers: DataFrame | None = None, depths: tuple[int, ...] = DEPTHS, threshold: float = SUPPORT) -> DataFrame:
    """A row for each item: retrieval of its gold chunks and documents, coverage of its answer, and
    what its given answer is worth.

    items: query_id, gold (chunk ids), gold_docs (names), expected_answer, negative and others;
    results: query_id, chunk_id, rank, doc (name), content; answers: query_id, answer. Recalls are
    null without gold, all_hit is false then; coverage and comparisons with the expected answer are
    null for negative items; answer columns are null for items without an answer.
    """
    chunk = retrieval_metrics(items, results, depths)
    chunk = chunk.withColumnsRenamed({f"{old}_{k}": f"{new}_{k}" for k in depths for old, new in (("recall", "slice_recall"), ("all_hit", "slice_all_hit"), ("precision", "slice_precision"))})
    named = items.select("query_id", F.col("gold_docs").alias("gold"))
    by_doc = retrieval_metrics(named, results.select("query_id", "rank", F.col("doc").alias("chunk_id")), depths).select(
        "query_id", *(F.col(f"{old}_{k}").alias(f"{new}_{k}") for k in depths for old, new in (("recall", "doc_recall"), ("all_hit", "doc_all_hit"), ("precision", "source_precision")))
    )
    scored = chunk.join(by_doc, "query_id").join(token_coverage(items, results, depths), "query_id")
    scored = scored.withColumns({f"coverage_{k}": F.when(~F.col("negative"), F.col(f"coverage_{k}")) for k in depths})
    if answers is None:
        return scored
    evidence = results.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n").alias("evidence"))
    given = items.select("query_id", "expected_answer", "negative").join(answers.select("query_id", "answer"), "query_id").join(evidence, "query_id", "left")
    said = answer_metrics(given.withColumn("evidence", F.coalesce("evidence", F.lit(""))), "answer", "evidence", threshold)
    right = F.when(~F.col("negative"), token_f1(F.col("answer"), F.col("expected_answer"))), F.when(~F.col("negative"), coverage(F.col("expected_answer"), F.col("answer")))
    said = said.select(
        "query_id", "answer", right[0].alias("answer_token_f1"), right[1].alias("answer_expected_recall"), "abstained",
        F.when(F.col("negative"), F.col("abstained")).alias("negative_abstention_correct"), "n_sentences", "unsupported", "hallucination_rate", "grounded_rate",
    )
    return scored.join(said, "query_id", "left")


ANSWER_MEANS = ["answer_token_f1", "answer_expected_recall", "hallucination_rate", "grounded_rate", "negative_abstention_correct"]


def summarise(scored: DataFrame, by: str, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """One row over all items (null in the column `by`) and one for each value of it. Retrieval means
    are over positive items only, nulls left out; the median of first ranks leaves out items without a
    hit; answer means are over the items that have an answer."""
    positive = ~F.col("negative")
    names = [f"{m}_{k}" for k in depths for m in ("slice_recall", "slice_all_hit", "doc_recall", "doc_all_hit", "source_precision", "coverage")]
    mean = lambda m: F.avg(F.when(positive, F.col(m).cast("double"))).alias(m)
    parts = [F.count("*").alias("items"), F.count_if(positive).alias("positive_items"), F.count_if(~positive).alias("negative_items"), mean("mrr")]
    parts += [F.median(F.when(positive & (F.col("first_gold_rank") > 0), F.col("first_gold_rank"))).alias("first_gold_rank_median"), *map(mean, names)]
    if "answer" in scored.columns:
        parts += [F.count("answer").alias("answered_items"), *(F.avg(F.col(m).cast("double")).alias(m) for m in ANSWER_MEANS)]
    return scored.groupingSets([[], [F.col(by)]], F.col(by)).agg(*parts)


def summary(rows: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Means over all rows that aren't negative (null in the column `by`) and for each value of it."""
    positive = ~F.col("negative")
    parts = [F.count("*").alias("items"), F.count_if(positive).alias("positive_items"), *(F.avg(F.when(positive, F.col(m).cast("double"))).alias(m) for m in metrics)]
    return rows.groupingSets([[], [F.col(by)]], F.col(by)).agg(*parts)


def after_filter(results: DataFrame, allowed: DataFrame | None, k: int) -> DataFrame:
    """Results among the allowed ids (all if None), each once, ranked anew."""
    kept = results if allowed is None else results.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
    first = kept.groupBy("query_id", "chunk_id").agg(F.min_by(F.struct(*(c for c in results.columns if c not in ("query_id", "chunk_id"))), "rank").alias("r")).select("query_id", "chunk_id", "r.*")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id"))
    return first.withColumn("rank", place).where(F.col("rank") <= k)


def balanced_pick(records: DataFrame, group: str, order: list[str], count: int) -> DataFrame:
    """Rows taken from the groups in turn. A limit, as it is a sampler; no more rows of a group than that
    are shuffled."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return records.withColumn("turn", place).where(F.col("turn") <= count).orderBy("turn", group, *order).limit(count)


def best_record(title: str, content: str, word: str) -> Column:
    """Score of a record for a word: 10 for each time in the title, 1 for each in the content."""
    often = lambda c: (F.length(c) - F.length(F.replace(F.lower(c), F.lit(word.lower()), F.lit("")))) / len(word)
    return 10 * often(F.col(title)) + often(F.col(content))
