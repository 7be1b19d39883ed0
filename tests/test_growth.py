"""Steps whose cost is to grow no faster than their input."""

import math

import numpy as np
import pytest

from larkspur import providers, stores
from larkspur.operators import dense, evaluate, lexical
from larkspur.plans import contract


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_scores_texts_where_they_lie(spark, monkeypatch):
    docs = [(i, f"common word{i % 7} " + "common " * (i % 3) + f"rare{i}") for i in range(300)] + [(300, "common extra"), (300, "word1 common common")]
    chunks = spark.createDataFrame(docs, "chunk_id long, content string")
    asked = spark.createDataFrame([(1, "common rare7 rare7"), (2, "word1 word2"), (3, None), (4, "nothing")], "query_id long, query string")
    texts: dict[int, list[str]] = {}
    for i, t in docs:
        texts[i] = texts.get(i, []) + t.split()
    lengths = {i: max(len(t.split()) for j, t in docs if j == i) for i in texts}
    mean = sum(len(t.split()) for _, t in docs) / len(docs)

    def expected(query, k):
        scores = {}
        for i, words in texts.items():
            for t in query.split():
                if tf := words.count(t):
                    df = sum(t in w for w in texts.values())
                    scores[i] = scores.get(i, 0) + math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * lengths[i] / mean))
        return sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]

    whole = lexical.bm25(chunks, asked, 5)
    assert not any(x in plan(whole) for x in ("Join", "Aggregate", "Generate"))  # only the best of a task are shuffled
    monkeypatch.setattr(lexical, "QUERY_ROWS", 1)
    monkeypatch.setattr(lexical, "DENSE", 1)
    monkeypatch.setattr(lexical, "MOST", 3)
    for found in (whole, lexical.bm25(chunks, asked, 5)):
        rows = sorted(found.collect(), key=lambda r: (r.query_id, r["rank"]))
        wanted = [(q, i, s) for q, text in ((1, "common rare7 rare7"), (2, "word1 word2")) for i, s in expected(text, 5)]
        assert [(r.query_id, r.chunk_id) for r in rows] == [w[:2] for w in wanted]
        assert [r.score for r in rows] == pytest.approx([w[2] for w in wanted])
    pairs = spark.createDataFrame([(1, 7), (2, 300), (2, 7)], "query_id long, chunk_id long")
    some = lexical.bm25(chunks, asked, 9, among=pairs).collect()
    assert {(r.query_id, r.chunk_id): round(r.score, 9) for r in some} == {(q, i): round(dict(expected(t, 999))[i], 9) for q, i, t in ((1, 7, "common rare7 rare7"), (2, 300, "word1 word2"))}


def test_cosine_keeps_the_best_while_vectors_pass(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (500, 6)).astype(float)  # many equal scores
    v[7], v[9, 2] = 0, np.nan
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, None)], "chunk_id long, vector array<double>").repartition(3)
    asked = rows.withColumnRenamed("chunk_id", "query_id")
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    with np.errstate(invalid="ignore"):
        u = np.where(norm == 0, 0, v / np.where(norm == 0, 1, norm))
    monkeypatch.setattr(dense, "AT_ONCE", 50)
    score = u @ u.T
    wanted = {}
    for i in range(500):
        order = sorted((j for j in range(500) if j != i and score[i, j] == score[i, j]), key=lambda j: (-round(score[i, j], 9), j))
        wanted |= {(i, n): j for n, j in enumerate(order[:4], 1)}
    for most in (1 << 20, 100):  # queries that are sent to all tasks, and such that meet blocks
        monkeypatch.setattr(dense, "SENT_BYTES", most)
        monkeypatch.setattr(dense, "BLOCK", 100)
        found = dense.cosine_top_k(rows, asked, 4, exclude_self=True)
        assert {(r.query_id, r["rank"]): r.chunk_id for r in found.collect()} == wanted
    best = dense._Nearest(np.arange(500), u[:, :2], 3, True)
    for s in range(0, 500, 100):
        best.add(np.arange(s, s + 100), u[s : s + 100, :2])
    assert sum(b.num_rows for b in best.rows()) <= 3 * 500  # not k a query and block


class Counted:
    """An embedder that notes each text it is given."""

    def __init__(self, path):
        self.path = str(path)

    def embed(self, texts):
        with open(self.path, "a") as out:
            out.writelines(t + "\n" for t in texts)
        return [[float(len(t)), 1.0] for t in texts]


def test_stores_shuffle_ids_and_embed_a_text_once(spark, tmp_path):
    vectors, keywords = (stores.TableStore(spark, f"{tmp_path}/{n}") for n in "vk")
    model = Counted(tmp_path / "given")
    rows = spark.createDataFrame([("a", "one", 1), ("a", "three", 3), ("a", "two", 2), ("b", "four", None), (None, "five", 1), ("c", " ", 1)], "chunk_id string, content string, seq int")
    assert stores.Ingestor(model, stores.TableVectors(vectors), stores.TableKeywords(keywords)).chunks(rows) == 5
    wanted = {("a", "three"), ("b", "four"), (None, "five")}
    assert {(r.chunk_id, r.content) for r in keywords.read().collect()} == wanted
    assert {(r.chunk_id, r.content, r.vector[0]) for r in vectors.read().collect()} == {(i, t, len(t)) for i, t in wanted}
    assert sorted(open(model.path).read().split()) == ["five", "four", "three"]
    assert not any(x in plan(keywords.read()) for x in ("Join", "Exchange"))
    hashed = {r.chunk_id: r.vector for r in providers.with_vectors(rows, "content", providers.HashEmbedder(8)).where("content IN ('two', 'four', ' ')").collect()}
    assert {i: providers.HashEmbedder(8).embed([t])[0] for i, t in (("a", "two"), ("b", "four"), ("c", " "))} == hashed


def test_quoting_reads_texts_where_they_lie(spark):
    texts = ["a b c d e f g h i", "x a b c d e f g h", "a b c d e f g x", "aa b c d e f g hh", "short one", None, "", "b c d e f g b c d e f g h"]
    docs = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    asked = [(1, "a b c d e f g h"), (2, "b c d e f g h"), (3, "t o"), (4, None), (5, ""), (6, "a b c d e f g h"), (7, "c d e f g b c d e f g h")]
    found = evaluate.quoting(docs, spark.createDataFrame(asked, "query_id long, query string"))
    assert sorted((r.query_id, r.chunk_id) for r in found.collect()) == sorted((q, i) for q, a in asked if a for i, t in enumerate(texts) if t and a in t)
    assert "Join" not in plan(found)


def test_picks_shuffle_few_rows(spark):
    rows = spark.createDataFrame([(i, "fghij"[i % 5], i % 50) for i in range(500)], "id long, pdf string, seq int")
    few = evaluate.balanced_pick(rows, "pdf", ["seq", "id"], 7)
    assert "WindowGroupLimit" in plan(few)
    assert [(r.turn, r.pdf) for r in few.orderBy("turn", "pdf").collect()] == [(1, p) for p in "fghij"] + [(2, p) for p in "fg"]


def test_question_texts_are_normalised_once(spark, tmp_path):
    text = "The  table shall hold 5 V. " * 20
    spark.createDataFrame([(1, text, "en", "src", 9), (2, None, "en", "src", 0), (3, " \n ", "en", "src", 3)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = contract.question_signals(spark, str(tmp_path))
    assert plan(found).count("regexp_replace") <= 3  # content, label's none, excerpt
    row, = found.collect()
    assert (row.record_id, row.requirement, row.method, row.common, row.parameter, row.good_title) == (1, True, False, False, True, False) and len(row.excerpt) == 320
