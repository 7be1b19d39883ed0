"""The library's own operators on small fixtures, against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators import catalog, chunking, clauses, dense, evaluate, expand, fusion, lexical
from larkspur.sources import readers


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, "A.b-c ünï 热控制 x热", tx.bm25_tokens) == ["a.b-c", "n", "热", "控", "制", "x", "热", "热控", "控制", "制热"]
    assert one(spark, " a　b\n c ", tx.normalize_space) == "a b c"
    assert one(spark, "a \t b\r\n\n\n\nc ", tx.normalize_text) == "a b\n\nc"
    assert one(spark, "![i](u) [w](v)<br/>x &amp;lt; <b>y</b>", tx.clean_markup) == "i w\nx &lt; y"
    assert one(spark, "a\x0cb\r\nc\n", tx.lines) == ["a", "b", "c"]
    assert one(spark, '["a", " b "]', tx.as_list) == ["a", "b"] and one(spark, "a| b;;c", tx.as_list) == ["a", "b", "c"]
    assert one(spark, "One two. Is it? 3.5 kg.", tx.sentences) == ["One two.", "3.5 kg."]
    assert one(spark, None, tx.bm25_tokens) == []


def test_trigrams_of_characters(spark):
    grams = one(spark, "卫星热控方案", lambda t: tx.bm25_tokens(t, 3))
    assert {"卫星", "热控", "方案", "卫星热", "星热控", "热控方", "控方案"} <= set(grams)
    assert not {"卫星热", "控方案"} & set(one(spark, "卫星热控方案", tx.bm25_tokens))
    docs = spark.createDataFrame([(1, "航天器采用温度控制系统确保设备正常工作"), (2, "thermal control design")], "chunk_id long, content string")
    asked = spark.createDataFrame([(1, "温度控制方法")], "query_id long, query string")
    two, three = (lexical.bm25(docs, asked, 5, ngrams=n).collect() for n in (2, 3))
    assert [r.chunk_id for r in two] == [r.chunk_id for r in three] == [1] and three[0].score > two[0].score


def test_bm25_matches_plain_python(spark):
    texts = {1: "alpha beta beta", 2: "beta gamma", 3: "delta", 4: None}
    docs = spark.createDataFrame(list(texts.items()), "chunk_id long, content string")
    found = lexical.bm25(docs, spark.createDataFrame([(9, "beta beta alpha")], "query_id long, query string"), 5).collect()
    tokens = {k: (v or "").split() for k, v in texts.items()}
    mean = sum(map(len, tokens.values())) / 4

    def score(t):
        out = 0.0
        for q in ("beta", "beta", "alpha"):
            n, tf = sum(q in x for x in tokens.values()), t.count(q)
            out += math.log(1 + (4 - n + 0.5) / (n + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean))
        return out

    assert [(r.chunk_id, round(r.score, 9)) for r in found] == [(i, round(score(tokens[i]), 9)) for i in (1, 2)]


def test_fusion_and_rerank(spark):
    layout = "query_id long, chunk_id long, rank int, source string"
    a = spark.createDataFrame([(1, 10, 1, "vector"), (1, 11, 2, "vector")], layout)
    b = spark.createDataFrame([(1, 11, 1, "bm25"), (1, 12, 2, "bm25")], layout)
    fused = fusion.rrf([a, b])
    assert [(r.chunk_id, r.source) for r in fused.orderBy("rank").collect()] == [(11, "bm25+vector"), (10, "vector"), (12, "bm25")]
    assert [r.chunk_id for r in fusion.rrf([a, b], weights=[0, 1]).orderBy("rank").collect()] == [11, 12]
    with pytest.raises(ValueError):
        fusion.rrf([a], weights=[1, 2])
    given = spark.createDataFrame([(1, 12, 0.9)], "query_id long, chunk_id long, rerank_score double")
    assert fusion.blended_rerank(fused, given, 3).count() == 3


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0, 0.0]), (4, None)], "chunk_id long, vector array<double>")
    found = dense.cosine_top_k(v, v.withColumnRenamed("chunk_id", "query_id"), 2, exclude_self=True).collect()
    assert {(r.query_id, r["rank"]): r.chunk_id for r in found}[1, 1] == 2
    e = dense.hash_embedding(spark.createDataFrame([(1, "a b"), (2, None)], "id long, t string"), "id", "t").collect()
    assert sum(x * x for x in e[0].vector) == pytest.approx(1) and set(e[1].vector) == {0.0}


def test_chunks_and_packing(spark):
    text = "x" * 2000
    assert [len(c) for c in one(spark, text, chunking.windows)] == [900, 900, 440]
    with pytest.raises(ValueError):
        chunking.windows(F.lit("x"), 10, 10)

    def plain(text, most):
        out, current = ([text], "") if len(text) <= most else ([], "")
        for p in [] if out else [x.strip() for x in text.split("\n\n") if x.strip()]:
            if len(p) > most:
                free = most - len(current) - 2
                if current and free > 120:
                    out.append(f"{current}\n\n{p[:free]}")
                    p = p[free:]
                elif current:
                    out.append(current)
                current = ""
                out += [p[i : i + most] for i in range(0, len(p), most)]
            elif current and len(current) + len(p) + 2 > most:
                out.append(current)
                current = p
            else:
                current = f"{current}\n\n{p}" if current else p
        return out + [current] if current else out

    for sizes in ([100, 200, 1200, 50], [390, 900], [150, 100, 400, 90]):
        text = "\n\n".join(chr(97 + i) * n for i, n in enumerate(sizes))
        assert one(spark, text, lambda t: chunking.pack_paragraphs(t, 400)) == plain(text, 400)


def test_catalogue(spark, tmp_path):
    rules = catalog.Policy(standards=["std"], articles=["art"], publishers=["eng"])
    for name in ("std/a.pdf", "art/eng/b.md", "art/x/c.md", "art/d.png", "e.xlsx", "f.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    found = {r.relative_path: (r.action, r.reason, r.parse_route) for r in catalog.scan(spark, str(tmp_path), rules).collect()}
    assert found["std/a.pdf"] == ("include", "strong_evidence", "pdf_text_first")
    assert found["art/eng/b.md"][1] == "article_auxiliary" and found["art/x/c.md"][0] == "defer"
    assert found["art/d.png"][1] == "image_reference_only" and found["e.xlsx"][1] == "metadata_spreadsheet" and found["f.py"][1] == "tooling_file"


def test_expansion_and_citation(spark):
    assert one(spark, "Test data", expand.synonym_variants)[:2] == ["Test data", "Test data trial"]
    assert one(spark, "alpha and beta, c", expand.subquery_variants) == ["alpha and beta, c", "alpha", "beta"]
    assert len(one(spark, "", expand.hypothetical)) >= 200
    assert one(spark, "see ECSS-E-ST-10C", expand.routed_standards) == ["ECSS-E-ST-10C"]
    cite = lambda t: expand.citation(t, F.lit("5.2"), F.lit("Stage"), F.lit(12), F.lit(13), F.lit("r1"), F.lit(1))
    assert one(spark, "dir/X.pdf", cite) == "[1] X.pdf, section 5.2 Stage, pp.12-13, chunk_id=r1"


def test_metrics(spark):
    items = spark.createDataFrame([(1, [10, 11]), (2, None)], "query_id long, gold array<long>")
    results = spark.createDataFrame([(1, 9, 1), (1, 10, 2)], "query_id long, chunk_id long, rank int")
    rows = {r.query_id: r for r in evaluate.retrieval_metrics(items, results).collect()}
    assert (rows[1].mrr, rows[1].recall_1, rows[1].recall_3, rows[1].precision_3, rows[1].all_hit_3) == (0.5, 0.0, 0.5, 0.5, False)
    assert rows[2].recall_1 is None and rows[2].mrr == 0.0 and rows[2].all_hit_1 is False


def test_clauses(spark):
    pages = [(7, 1, "1 Scope\nThis part sets the limits of the work and also\nthe tools used for it.\n2 Normative references\nNothing is cited here."), (7, 2, "3 Terms\nA term is a mean-\ning.\n4.2 Thermal test\nThe unit shall survive."), (8, 1, "Just text.")]
    found = clauses.extract_clauses(spark.createDataFrame(pages, "doc_id long, page int, text string")).orderBy("doc_id", "part").collect()
    assert [(r.doc_id, r.kind, r.section) for r in found] == [(7, "clause", "1"), (7, "clause", "2"), (7, "clause", "3"), (7, "clause", "4.2"), (8, "page", None)]
    assert found[2].content == "A term is a meaning."


def test_readers(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnope\n')
    found = sorted((r.path[-10:], r.line, r.error) for r in readers.json_line_files(spark, str(tmp_path)).collect())
    assert [(p[-8:], n, e) for p, n, e in found] == [("ad.jsonl", 2, "invalid_jsonl"), ("od.jsonl", 1, None), ("od.jsonl", 3, None)]
    assert readers.decode_bytes("热".encode("gb18030")) == "热"
    assert readers.parse_env("export A='x y'\n#B=1\nC=2 # d\nD=\"q # r\"\nnone\n=x") == {"A": "x y", "C": "2", "D": "q # r"}
