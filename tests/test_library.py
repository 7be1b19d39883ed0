"""Scan, preparation, stores, search, providers, evaluation, questions and settings, end to end on small fixtures."""

import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

import larkspur
from larkspur import cli, env, factory, providers, scratch, search, stores
from larkspur.config import Config
from larkspur.operators import catalog, clauses, evaluate, manifest, prepare, questions
from larkspur.sources import readers
from larkspur.streaming import ingest

# --- scan and preparation ------------------------------------------------------------------------

RULES = catalog.Policy(standards=["std"], lessons=["lessons.jsonl"], wikis=["wiki"], articles=["art"], publishers=["eng"], deferred={"books": "later"})
MARKDOWN = '---\ntitle: "Front"\n---\n# One\n\nFirst &amp; [link](u).\n\n# Two\n\nSecond.'
LESSON = {"Lesson Number": 7, "Subject": "Valves", "Abstract": "They leak.", "Driving Event": "None", "source_id": "s", "Other": 1}


@pytest.fixture()
def library(tmp_path):
    files = {
        "wiki/a.md": MARKDOWN, "art/eng/b.md": "no heading here", "art/x/c.md": "text", "art/eng/p.jpg": "x", "books/d.txt": "x", "wiki/empty.md": "  \n",
        "lessons.jsonl": json.dumps(LESSON) + "\n\n" + json.dumps({"Subject": "T", "n": [1]}) + "\n", "std/blank.jsonl": '{"Lesson Number": 1}', "std/bad.jsonl": '{"a": 1}\nnope\n', "std/none.jsonl": "\n", "std/doc.json": '{"title": "J", "b": [1, 2]}', "std/ECSS-E-ST-10C.pdf": "pdf",
    }
    for name, text in files.items():
        (tmp_path / "lib" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "lib" / name).write_text(text)
    return tmp_path


def pages_of(raw):
    """Stands in for a PDF library."""
    return [(1, "1 Scope\nThis part sets the limits.\n2 Normative references\nNothing is cited."), (2, "3 Terms\nA term is a mean-\ning.\n4.2 Thermal test\nThe unit shall survive.")]


def test_scan_writes_manifest_and_summaries(spark, library):
    out = manifest.scan(spark, manifest.ScanOptions(f"{library}/lib", f"{library}/out", RULES, hash_mode="content"))
    assert out["files"] == 12 and out["actions"] == {"defer": 2, "exclude": 1, "include": 9}
    rows = {r.relative_path: r for r in manifest.read(spark, f"{library}/out/manifest.jsonl").collect()}
    assert rows["wiki/a.md"].reason == "wiki_auxiliary" and rows["lessons.jsonl"].reason == "lesson_evidence" and rows["books/d.txt"].reason == "later"
    assert rows["wiki/a.md"].hash.startswith("sha1:") and rows["wiki/a.md"].source_path == f"{library}/lib/wiki/a.md"
    summary = json.loads((library / "out/scan_summary.json").read_text())
    assert summary["totals"]["files"] == 12 and {d["top_level"] for d in summary["directories"]} == {"wiki", "art", "books", "lessons.jsonl", "std"}
    assert "| include | 9 |" in (library / "out/scan_summary.md").read_text()
    chosen = manifest.select(manifest.read(spark, f"{library}/out/manifest.jsonl"), limit=2)
    assert [r.relative_path for r in chosen.collect()] == ["art/eng/b.md", "lessons.jsonl"]
    (library / "bad.jsonl").write_text("{}\n\nnope\n")
    with pytest.raises(Exception):
        manifest.read(spark, f"{library}/bad.jsonl").collect()


@pytest.mark.parametrize("mode", ["page", "clause"])
def test_prepare(spark, library, mode):
    manifest.scan(spark, manifest.ScanOptions(f"{library}/lib", f"{library}/out", RULES))
    routes = ("markdown", "jsonl_records", "pdf_text_first", "json_document")
    report = prepare.prepare(spark, prepare.PrepareOptions(f"{library}/out/manifest.jsonl", f"{library}/out", routes=routes, pdf_chunk_mode=mode), pages_of)
    assert report["selected_files"] == 9 and report["failures"] == {"empty_content": 1, "empty_jsonl": 1, "empty_record": 1, "invalid_jsonl": 1} and report["parsed_files"] == 5
    corpus = prepare.read_corpus(spark, f"{library}/out/corpus.jsonl")
    rows = corpus.collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.source_record or 0, r.page or 0, r.section or "", r.part_index)):
        by.setdefault(r.relative_path, []).append(r)
    assert [(r.title, r.content, r.part_index) for r in by["wiki/a.md"]] == [("Front", "# One\n\nFirst & link.", 1), ("Front", "# Two\n\nSecond.", 2)]
    assert by["art/eng/b.md"][0].title == "b" and by["art/eng/b.md"][0].authority_level == "auxiliary"
    assert by["lessons.jsonl"][0].content == "## Subject\nValves\n\n## Abstract\nThey leak." and by["lessons.jsonl"][0].metadata["source_id"] == "s"
    assert [r.source_record for r in by["lessons.jsonl"]] == [1, 3] and by["lessons.jsonl"][1].title == "T"
    assert json.loads(by["std/doc.json"][0].content) == {"title": "J", "b": [1, 2]}
    pdf = by["std/ECSS-E-ST-10C.pdf"]
    if mode == "clause":
        assert [(r.section, r.section_title, r.page_start) for r in pdf] == [("1", "Scope", 1), ("2", "Normative references", 1), ("3", "Terms", 2), ("4.2", "Thermal test", 2)]
        assert pdf[2].content == "3 Terms\n\nA term is a meaning." and pdf[0].record_kind == "standard_clause"
    else:
        assert [(r.page, r.record_kind) for r in pdf] == [(1, "pdf_page"), (2, "pdf_page")]
    assert pdf[0].standard_id == "ECSS-E-ST-10C" and len({r.record_id for r in rows}) == len(rows)
    chunks = prepare.corpus_chunks(corpus)
    assert chunks.where("doc = 'ECSS-E-ST-10C.pdf'").first().metadata["standard_id"] == "ECSS-E-ST-10C"
    allowed = spark.createDataFrame([("ECSS-E-ST-10C.pdf",)], "doc string")
    assert prepare.corpus_chunks(corpus, allowed).count() == len(pdf)
    assert prepare.corpus_chunks(corpus, allowed.limit(0), limit=2, skip=1).count() == 2


def test_pdf_files_without_a_library_or_text_are_failures(spark, library):
    files = spark.createDataFrame([("std/ECSS-E-ST-10C.pdf", "ECSS-E-ST-10C.pdf", f"{library}/lib/std/ECSS-E-ST-10C.pdf", "std", "h", "pdf_text_first", "strong_evidence"), ("a.doc", "a.doc", f"{library}/lib/wiki/a.md", "a", "h", "word_document", "x"), ("gone.md", "gone.md", f"{library}/lib/gone.md", "a", "h", "markdown", "x")], "relative_path string, name string, source_path string, top_level string, hash string, parse_route string, reason string")
    _, failures = prepare.parse_files(files, "now", pages=lambda raw: [(1, " ")])
    assert {r.relative_path: r.reason for r in failures.collect()} == {"std/ECSS-E-ST-10C.pdf": "needs_ocr_or_empty_pdf", "a.doc": "unsupported_route", "gone.md": "unexpected_error"}
    with pytest.raises(ValueError):
        prepare.parse_files(files, "now", most=0)


def test_clause_helpers():
    assert [clauses.section_level(s) for s in ("4", "4.2.1", "Annex A", "A.1")] == [1, 3, 1, 2]
    assert clauses.top_number("12.3") == 12 and clauses.top_number("A.1") is None
    assert clauses.clean_page("Head\n12\nA line that goes on and on and\nends here.", frozenset(["Head"])) == "A line that goes on and on and ends here."


def test_edges_and_contents_as_in_plain_python(spark):
    texts = ["Report ECSS-1\n12\nBody &amp; more.\nFoot—note", "Report ECSS-1\nContents\nOne .... 3\nTwo ..... 4\nThree 9\nFoot—note", "Report ECSS-1\nMore text here.\nFoot—note", "Foot—note", None, ""]
    rows = [("d", i + 1, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id string, page int, text string")
    found = {r.line for r in clauses.edge_lines(frame).collect()}
    assert found == set(clauses.repeated_edges([(p, t or "") for _, p, t in rows])) == {"Report ECSS-1", "Foot-note"}
    lines = [clauses.Line(p, x) for _, p, t in rows for x in map(clauses.clean_line, (t or "").splitlines()) if clauses.is_content(x)]
    assert {r.page for r in clauses.toc_pages(frame).collect()} == clauses.contents_pages(lines) == {2}


# --- stores and search ---------------------------------------------------------------------------

TEXTS = {"r1": "acceptance stage verification stage free of workmanship defects", "r2": "battery activation test guidance", "r3": "thermal control of the battery", "r4": " "}


@pytest.fixture()
def runtime(spark):
    found = factory.build_runtime(spark, Config(final_top_k=3))
    rows = [(k, f"d{k}", v, f"C:\\data\\{k}.pdf", {"title": k, "lang": "en" if k != "r3" else "de"}) for k, v in TEXTS.items()]
    assert found.ingestor.chunks(spark.createDataFrame(rows, "chunk_id string, doc_id string, content string, source_path string, metadata map<string,string>")) == 3
    return found


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_hybrid_search_with_filters_and_defaults(spark, runtime):
    found = runtime.search.search(ask(spark, "acceptance stage", "battery")).collect()
    assert {r.query_id: r.chunk_id for r in found if r["rank"] == 1}[0] == "r1" and len([r for r in found if r.query_id == 0]) == 3
    assert {r.chunk_id for r in runtime.search.search(ask(spark, "battery"), search.Request(metadata={"lang": "de"})).collect()} == {"r3"}
    assert {r.chunk_id for r in runtime.search.search(ask(spark, "battery"), search.Request(metadata={"lang": ["en"]})).collect()} == {"r1", "r2"}
    assert runtime.search.search(ask(spark, "battery"), search.Request(metadata={"lang": []})).count() == 0
    assert runtime.search.search(ask(spark, "battery"), search.Request(metadata={"missing": None}, final_top_k=0)).count() == 3
    assert runtime.search.search(ask(spark, "battery"), search.Request(final_top_k=1)).count() == 1
    routed = search.Request(condition=search.routed_condition("see ECSS-E-ST-10C"))
    assert runtime.search.search(ask(spark, "battery"), routed).count() == 0


def test_rerankers(spark, runtime):
    by_word = search.Hybrid(runtime.embedder, runtime.vectors, runtime.keywords, "lexical", runtime.config)
    assert by_word.search(ask(spark, "battery test guidance")).orderBy("rank").first().chunk_id == "r2"

    def transport(method, url, headers, body):
        assert (method, url, headers) == ("POST", "u", {"k": "secret"}) and body["top_n"] == len(body["documents"])
        return {"results": [{"index": i, "relevance_score": float("thermal" in d)} for i, d in enumerate(body["documents"])]}

    remote = search.Hybrid(runtime.embedder, runtime.vectors, runtime.keywords, providers.RemoteReranker("m", "u", "secret", "k", transport), runtime.config)
    first = remote.search(ask(spark, "acceptance")).orderBy("rank").collect()
    assert first[0].chunk_id in ("r1", "r3") and "rerank_fused" in first[0].source and {r.rerank_norm for r in first} == {0.0, 1.0}
    cross = search.Hybrid(runtime.embedder, runtime.vectors, runtime.keywords, providers.CrossEncoder("m", load=lambda: lambda pairs: [5.0 * ("thermal" in t) for _, t in pairs]), runtime.config, blend=False)
    best = cross.search(ask(spark, "acceptance")).orderBy("rank").first()
    assert best.chunk_id == "r3" and best.score == pytest.approx(1 / (1 + 2.718281828459045**-5))


def test_multi_query_and_hypothetical_documents(spark, runtime):
    found = search.MultiQuery(runtime.search).search(ask(spark, "battery test", "zzz")).collect()
    assert {r.query_id for r in found} == {0, 1} and {r.chunk_id for r in found if r.query_id == 0} == {"r1", "r2", "r3"}
    assert [r["rank"] for r in found if r.query_id == 0] == [1, 2, 3]
    single = {r.chunk_id: r.score for r in found if r.query_id == 1}
    assert single == {r.chunk_id: r.score for r in runtime.search.search(ask(spark, "zzz")).collect()}  # a single variant stays as it is

    def transport(method, url, headers, body):
        return {"choices": [{"message": {"content": '1. "battery"\n- thermal control\n\nbattery'}}]}

    chat = providers.RemoteChat("m", "u", transport=transport)
    assert [r.variant for r in providers.model_variants(ask(spark, "q"), chat).orderBy("place").collect()] == ["q", '"battery', "thermal control", "battery"]
    assert {r.chunk_id for r in search.MultiQuery(runtime.search, chat).search(ask(spark, "q")).collect()} == {"r1", "r2", "r3"}
    made = search.Hyde(runtime.search).search(ask(spark, "battery"), search.Request(metadata={"lang": "xx"})).collect()
    assert made and any("hyde" in r.source for r in made)  # no filter is passed on
    assert search.Hyde(runtime.search, chat).search(ask(spark, "q")).count() > 0


def test_phase_evidence(spark, runtime):
    assert search.phase_query("A", "Start", ["x", "y"], {"b": 1, "a": 2}) == "A Start\nrequired_inputs: x, y\nprovided_inputs: a, b"
    assert search.phase_query("A", "Start", [], {}).endswith("no provided inputs")
    assert search.phase_evidence(spark, "A", "t", [], {}, config=Config()) == []
    rows = search.phase_evidence(spark, "acceptance", "stage", ["battery"], {}, of=runtime.search, config=Config(final_top_k=2))
    assert len(rows) == 2 and rows[0]["citation"].startswith("[1] r") and rows[0]["rank"] == 1


def test_dense_search_and_previews(spark, runtime):
    found = search.dense_only(ask(spark, "battery test"), runtime.embedder, runtime.vectors, runtime.vectors.store.read(), 2).orderBy("rank").collect()
    assert found[0].chunk_id == "r2" and found[0].preview == TEXTS["r2"] and found[0].citation == "[1] r2.pdf, section n/a, pp.n/a, chunk_id=r2"


def test_stores_keep_the_last_version(spark, tmp_path):
    store = stores.TableStore(spark, f"{tmp_path}/s")
    store.upsert(spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 1)], "chunk_id string, content string, seq int"))
    store.upsert(spark.createDataFrame([("b", "new")], "chunk_id string, content string"))
    rows = {r.chunk_id: r.content for r in store.read().collect()}
    assert rows == {"a": "y", "b": "new"} and store.count() == 2
    store.compact()
    assert {r.chunk_id: r.content for r in store.read().collect()} == rows and len(store._versions()) == 1
    words = stores.TableKeywords(store)
    assert [r.chunk_id for r in words.search(ask(spark, "new"), 5).collect()] == ["b"]
    with pytest.raises(ValueError):
        stores.TableVectors(store).upsert(store.read(), spark.createDataFrame([("a", [1.0])], "chunk_id string, vector array<double>"))


class Recorded:
    """A transport that answers from a function and writes each call to a file, as tasks run apart."""

    def __init__(self, path, answer):
        self.path, self.answer = str(path), answer

    def __call__(self, method, url, headers, body):
        with open(self.path, "a") as out:
            out.write(json.dumps([method, url, headers, body]) + "\n")
        return self.answer(method, url, body)

    def calls(self):
        return [json.loads(x) for x in open(self.path)]


def test_vector_service(spark, tmp_path):
    def answer(method, url, body):
        return {"result": {"count": 2} if url.endswith("count") else {"points": [{"score": 0.5, "payload": {"chunk_id": "r1"}}]}}

    http = Recorded(tmp_path / "calls", answer)
    service = stores.VectorService("http://v/", "c", "dense", "key", http)
    records = spark.createDataFrame([("r1", "one"), ("r2", "two"), ("r3", " ")], "chunk_id string, content string")
    assert stores.bulk_load(records, providers.HashEmbedder(8), service, True, 1, "one") == {"read": 3, "sent": 2, "count": 2, "verified": "r1"}
    calls = http.calls()
    assert [c[0] for c in calls[:2]] == ["DELETE", "PUT"] and calls[1][3] == {"vectors": {"dense": {"size": 8, "distance": "Cosine"}}} and calls[0][2] == {"api-key": "key"}
    points = [p for c in calls if c[1].endswith("wait=true") for p in c[3]["points"]]
    assert {p["id"] for p in points} == {stores.point_id("r1"), stores.point_id("r2")} and points[0]["payload"]["content"]
    assert stores.service_filter({"a": 1, "b": ["x"], "c": []}) == {"must": [{"key": "metadata.a", "match": {"value": 1}}, {"key": "metadata.b", "match": {"any": ["x"]}}]}
    assert stores.service_filter({"c": []}) is None


def test_keyword_service(spark, tmp_path):
    def answer(method, url, body):
        if method == "GET" and url.endswith("/i"):
            raise RuntimeError("404")
        return {"hits": {"hits": [{"_source": {"chunk_id": "r2"}, "_score": 1.5}]}}

    http = Recorded(tmp_path / "calls", answer)
    service = stores.KeywordService("http://k", "i", username="u", password="p", transport=http)
    assert service.ping() and not service.exists()
    service.create()
    assert service.upsert(spark.createDataFrame([("r1", "one")], "chunk_id string, content string")) == 1
    found = service.search(ask(spark, "two"), 3, {"lang": "en", "page": [1, 2]}).first()
    assert (found.chunk_id, found.score, found["rank"], found.source) == ("r2", 1.5, 1, "bm25")
    calls = http.calls()
    assert calls[-1][3]["query"]["bool"]["must"] == [{"match": {"content": "two"}}, {"term": {"metadata.lang.keyword": "en"}}, {"terms": {"metadata.page": [1, 2]}}]
    assert calls[0][2]["Authorization"].startswith("Basic ") and any(c[0] == "PUT" and c[1].endswith("/i") and c[3]["mappings"]["properties"]["content"]["analyzer"] == "ik_max_word" for c in calls)


# --- providers -----------------------------------------------------------------------------------


def test_retries():
    tries, slept = [], []

    class Answer(io.BytesIO):
        pass

    def opener(request, timeout):
        tries.append(request.get_method())
        if len(tries) < 3:
            raise urllib.error.HTTPError(request.full_url, 503, "busy", {}, io.BytesIO(b"later"))
        return Answer(b'{"ok": 1}')

    assert providers.Http(attempts=4, delay=2.0, opener=opener, sleep=slept.append)("POST", "http://x", {}, {"a": 1}) == {"ok": 1}
    assert slept == [2.0, 4.0] and tries == ["POST"] * 3

    def refuse(request, timeout):
        tries.append("x")
        raise urllib.error.HTTPError(request.full_url, 400, "bad", {}, io.BytesIO(b"no"))

    tries.clear()
    with pytest.raises(RuntimeError, match="HTTP 400: no"):
        providers.Http(opener=refuse, sleep=slept.append)("GET", "http://x", {}, None)
    assert len(tries) == 1
    with pytest.raises(RuntimeError):
        providers.Http(attempts=2, opener=lambda r, timeout: (_ for _ in ()).throw(OSError("down")), sleep=slept.append)("GET", "http://x", {}, None)


def test_embedders(spark):
    shapes = [{"embeddings": [[1, 2]]}, {"data": [{"index": 1, "embedding": [3]}, {"index": 0, "embedding": [1]}]}, {"embedding": [1, 2]}]
    assert [providers.vectors_of(s) for s in shapes] == [[[1.0, 2.0]], [[1.0], [3.0]], [[1.0, 2.0]]]
    with pytest.raises(RuntimeError):
        providers.vectors_of({})
    sent = []

    def transport(method, url, headers, body):
        sent.append((headers, len(body["input"])))
        return {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in enumerate(body["input"])]}

    model = providers.RemoteEmbedder("m", "u", "key", batch=2, transport=transport)
    assert model.embed(["a", "bb", "ccc"]) == [[1.0], [2.0], [3.0]] and sent == [({"Authorization": "Bearer key"}, 2), ({"Authorization": "Bearer key"}, 1)]
    rows = spark.createDataFrame([("x", "abc"), ("y", None)], "id string, t string")
    assert {r.id: r.vector for r in providers.embed_column(rows, "id", "t", providers.RemoteEmbedder("m", "u", transport=lambda m, u, h, b: {"embeddings": [[float(len(t))] for t in b["input"]]})).collect()} == {"x": [3.0], "y": [0.0]}
    assert providers.ollama("m").url.endswith("/api/embed")
    with pytest.raises(RuntimeError):
        providers.RemoteEmbedder("m", "")
    with pytest.raises(RuntimeError, match="FlagEmbedding"):
        providers.LocalEmbedder("m").embed(["a"])


def test_rerank_answers():
    assert providers.rerank_rows({"results": [{"index": 1, "relevance_score": 0.5}, {"document_index": "0", "score": "0.25"}, "x", {"index": 1, "score": 9}]}) == {1: 0.5, 0: 0.25}
    assert providers.rerank_rows([{"similarity": 1}, {"index": "?", "rank_score": None}]) == {0: 1.0, 1: 1.0}
    for bad in ({"results": {}}, {"data": []}, "x"):
        with pytest.raises(RuntimeError):
            providers.rerank_rows(bad)


def test_grounded_answers_and_smoke(spark):
    seen = []

    def transport(method, url, headers, body):
        seen.append(url)
        if url.endswith("rerank"):
            raise RuntimeError("down")
        return {"choices": [{"message": {"content": body["messages"][-1]["content"].count("src")}}]} if body and "messages" in body else {}

    assert providers.smoke("http://s/v1/", "k", transport=transport) == {"models": "ok", "chat": "ok", "embedding": "ok", "rerank": "down"}
    assert seen[0] == "http://s/v1/models"
    chat = providers.RemoteChat("m", "u", transport=lambda m, u, h, b: {"choices": [{"message": {"content": " " + b["messages"][-1]["content"]}}]})
    results = spark.createDataFrame([(0, 2, "two", "[2] b"), (0, 1, "one", "[1] a")], "query_id long, rank int, content string, citation string")
    rows = {r.query_id: r.answer for r in providers.grounded_answers(ask(spark, "q", "none"), results, chat).collect()}
    assert rows == {0: "q\n\n[1] a\none\n\n[2] b\ntwo", 1: "none"}


# --- evaluation ----------------------------------------------------------------------------------


def test_evaluation_of_a_search(spark, runtime, tmp_path):
    lines = [{"id": "q1", "query_type": "def", "question": "How is acceptance stage defined?", "expected_answer": "verification stage free of workmanship defects", "expected_pdfs": ["r1.pdf"], "expected_record_ids": ["r1"]}, {"id": "q2", "query_type": "negative", "negative": True, "question": "What of gates?"}]
    (tmp_path / "items.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (tmp_path / "answers.jsonl").write_text('{"id": "q1", "answer": "no"}\n{"eval_id": "q2", "generated_answer": "Not found in the sources."}\n{"id": "q1", "answer": "Acceptance stage is a verification stage free of workmanship defects."}\n')
    raw = readers.evaluation_items(spark, f"{tmp_path}/items.jsonl")
    items = raw.select(F.col("id").alias("query_id"), F.col("question").alias("query"), F.col("expected_record_ids").alias("gold"), F.col("expected_pdfs").alias("gold_docs"), "expected_answer", "negative", "query_type")
    given = readers.answers(spark, f"{tmp_path}/answers.jsonl").withColumnRenamed("id", "query_id")
    chunks = runtime.keywords.store.read().withColumn("doc", F.regexp_extract("source_path", r"([^\\/]+)$", 1))
    scored, summary = search.evaluate(runtime.search, chunks, items, given, depths=(1, 3), top_k=3)
    whole = {r.query_type: r for r in summary.collect()}[None]
    assert (whole["items"], whole.positive_items, whole.negative_items, whole.answered_items) == (2, 1, 1, 2)
    assert whole.slice_recall_3 == whole.doc_recall_3 == whole.mrr == 1.0 and whole.hallucination_rate == 0.0 and whole.negative_abstention_correct == 1.0
    rows = {r.query_id: r for r in scored.collect()}
    assert rows["q2"].coverage_3 is None and rows["q2"].slice_recall_1 is None and rows["q2"].slice_all_hit_1 is False and rows["q1"].coverage_1 == 1.0
    allowed = spark.createDataFrame([("r2",)], "chunk_id string")
    assert {r.query_type: r for r in search.evaluate(runtime.search, chunks, items, None, (1, 3), allowed, 3)[1].collect()}[None].mrr == 0.0
    (tmp_path / "broken.jsonl").write_text('{"answer": "x"}\n')
    with pytest.raises(Exception, match="no id"):
        readers.answers(spark, f"{tmp_path}/broken.jsonl").collect()


def test_quotations(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "xa b c d e f g h"), (3, "b c"), (4, None)], "chunk_id long, content string")
    asked = spark.createDataFrame([(1, "a b c d e f g h"), (2, "b c"), (3, "")], "query_id long, query string")
    assert {(r.query_id, r.chunk_id) for r in evaluate.quoting(docs, asked).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)}


# --- questions -----------------------------------------------------------------------------------


def test_questions(spark, tmp_path):
    rows = []
    for p in ("a.pdf", "b.pdf"):
        for i in range(12):
            rows.append((f"{p}{i:02d}", "d", f"/x/{p}", f"3.{i}" if i < 6 else f"5.{i}", f"topic {i}", 1, 2, f"The unit {i} shall survive a test at 5 kg; symbols are in the table. " + "battery " * i, {"k": "v"}, i))
    corpus = spark.createDataFrame(rows, "record_id string, doc_id string, source_path string, section string, section_title string, page int, page_end int, content string, metadata map<string,string>, seq int").withColumn("page_start", F.col("page"))
    files = questions.first_files(corpus.select(F.regexp_extract("source_path", "[^/]*$", 0).alias("pdf")), 2)
    held = questions.records(corpus, files)
    plan = questions.Plan({"definition": 4, "abbreviation": 3, "clause_locator": 3, "requirement_process": 3, "parameter_table": 2, "method_explanation": 2}, (("a.pdf", "battery", "b.pdf", "topic"),), (("b.pdf", "zebra", "I need zebras."),), ("What of gates?",))
    items = questions.questions(held, plan).orderBy("id").collect()
    assert [r.id for r in items] == [f"eval_{i:03d}" for i in range(1, 21)] and [r.query_type for r in items[:4]] == ["definition"] * 4
    used = [x for r in items[:17] for x in r.expected_record_ids]
    assert len(used) == len(set(used)) and [r.expected_pdfs[0] for r in items[:4]] == ["a.pdf", "b.pdf", "a.pdf", "b.pdf"]
    assert items[17].expected_record_ids == ["a.pdf11", "b.pdf11"] and items[18].query_type == "scenario" and items[19].negative and items[19].gold_context == []
    assert len(items[0].gold_context[0].answer_span) <= 320
    questions.write(spark.createDataFrame(items), spark, f"{tmp_path}/set")
    assert "| definition | 4 |" in (tmp_path / "set.md").read_text()
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/set.csv")
    assert back.count() == 20 and back.where("id = 'eval_018'").first().expected_record_ids == "a.pdf11;b.pdf11"
    with pytest.raises(ValueError, match="wanted"):
        questions.pick(held, 100, None)
    with pytest.raises(ValueError, match="twice"):
        questions.questions(held, questions.Plan({}, (), (("a.pdf", "x", "Same?"), ("b.pdf", "x", "Same?"))))


# --- settings, command line, streaming -----------------------------------------------------------


def test_config_and_environment(tmp_path, monkeypatch):
    source = {"RAG_ENABLED": "Yes", "RAG_FINAL_TOP_K": "5", "RAG_VECTOR_WEIGHT": "x", "LITELLM_BASE_URL": "http://l/v1/", "LLM_API_KEY": "k", "OLLAMA_EMBEDDING_URL": "http://o", "QDRANT_URL": "http://q", "RAG_RERANK_SCORE_WEIGHT": "0.5"}
    c = Config.from_env(source)
    assert c.enabled and c.final_top_k == 5 and c.vector_weight == 1.0 and c.rerank_endpoint == "http://l/v1/rerank" and c.embedding_api_key == c.rerank_api_key == "k"
    assert c.embedding_endpoint == "http://o" and c.vector_url == "http://q" and c.rerank_score_weight == 0.5
    (tmp_path / ".env.example").write_text("LARK_A=1\nLARK_B=\"two\"\n")
    (tmp_path / "sub").mkdir()
    monkeypatch.chdir(tmp_path / "sub")
    monkeypatch.setenv("LARK_A", "kept")
    monkeypatch.delenv("LARK_B", raising=False)
    import os

    assert env.load_env(tmp_path / ".env") == tmp_path / ".env.example" and os.environ["LARK_A"] == "kept" and os.environ["LARK_B"] == "two"
    (tmp_path / ".env").write_text("LARK_A=2\n")
    assert env.find_env() == tmp_path / ".env" and env.load_env(override=True) and os.environ["LARK_A"] == "2"
    monkeypatch.delenv("LARK_B")
    assert env.load_env(tmp_path / "none") is None and env.number("LARK_A", 7) == 2 and env.number("LARK_X", 7) == 7 and not env.flag("LARK_X", False)


def test_factory(spark):
    made = factory.build_embedder(Config(embedding_provider="LiteLLM", embedding_endpoint="u", embedding_api_key="k"))
    assert made.header == "x-litellm-api-key" and isinstance(factory.build_embedder(Config(embedding_provider="bge-m3")), providers.LocalEmbedder)
    assert factory.build_reranker(Config(rerank_provider="none")) == "identity" and factory.build_reranker(Config(rerank_provider="qwen", rerank_endpoint="u")).header == "Authorization"
    assert isinstance(factory.build_vectors(Config(vector_url="http://q"), spark), stores.VectorService) and isinstance(factory.build_keywords(Config(keyword_provider="es", keyword_url="u"), spark), stores.KeywordService)
    for bad in (lambda: factory.build_vectors(Config(vector_provider="qdrant"), spark), lambda: factory.build_keywords(Config(keyword_provider="es"), spark), lambda: factory.build_reranker(Config(rerank_provider="litellm")), lambda: factory.build_chat(Config())):
        with pytest.raises(RuntimeError):
            bad()
    for bad in (lambda: factory.build_embedder(Config(embedding_provider="?")), lambda: factory.build_reranker(Config(rerank_provider="?")), lambda: factory.build_vectors(Config(vector_provider="?"), spark), lambda: factory.build_keywords(Config(keyword_provider="?"), spark)):
        with pytest.raises(ValueError):
            bad()
    assert factory.default_search(spark) is factory.default_search(spark)
    factory.clear_default()
    assert larkspur.Config is Config and set(larkspur.__all__) >= {"Hybrid", "MultiQuery", "Hyde", "build_runtime"}
    with pytest.raises(AttributeError):
        larkspur.nothing


def test_command_line(capsys, spark, library):
    assert cli.main([]) == 2
    capsys.readouterr()
    assert cli.main(["embed-test", "--provider", "hash"]) == 0
    assert json.loads(capsys.readouterr().out)["dimension"] == 64
    assert cli.main(["scan", "--root", f"{library}/lib", "--out", f"{library}/cli", "--rules", '{"wikis": ["wiki"]}']) == 0
    assert cli.main(["prepare", "--manifest", f"{library}/cli/manifest.jsonl", "--out", f"{library}/cli", "--routes", "markdown"]) == 0
    assert json.loads((library / "cli/parse_report.json").read_text())["selected_files"] == 2


def test_incremental_ingest(spark, tmp_path):
    row = lambda seq, text: spark.createDataFrame([("a", text, seq), ("b", "same", 1)], "chunk_id string, content string, seq int")
    for n in (1, 2):
        row(n, f"text {n}").write.mode("append").parquet(f"{tmp_path}/in")
        ingest.ingest(spark, f"{tmp_path}/in", "chunk_id string, content string, seq int", f"{tmp_path}/table", f"{tmp_path}/checkpoint").awaitTermination()
    assert {r.chunk_id: r.content for r in ingest.current(spark, f"{tmp_path}/table").collect()} == {"a": "text 2", "b": "same"}


def test_scratch_tables(spark):
    made = scratch.materialise(spark.range(3), "x")
    assert made.count() == 3 and spark.sparkContext.applicationId in made.inputFiles()[0]
