"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

import pytest

from larkspur.llm import extraction, mixing, near, packing, pii, repeats, rules, sites, tokens, topk

#: The names that operators use inside stand here as columns of the input.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, h long, label int, quality int, host string, rate double, leader long, stratum string, n_tokens string"
LONG = " ".join(f"w{i}" for i in range(60_000))
SAME = " ".join(f"same{i % 97}x{i}" for i in range(120))


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text) if text else None, 1, 2, 3, None, "x", 0.5, 9, "z", "n")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [row(1, None), row(2, ""), row(3, LONG), row(4, SAME), row(4, SAME), row(5, SAME), row(None, SAME), row(6, "one"), row(7, None, None, None), row(8, "mail ann@x.org, 10.1.2.3", None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0, "t"), (4, 0, 1, "t"), (4, 1, None, "t"), (None, 1, 0, "t"), (6, None, None, "t")], "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_repeated_spans(docs, empty):
    found = sorted((r.doc_id, r.first_word, r.n_words, r.is_first) for r in repeats.repeated_spans(docs).collect())
    assert [f[0] for f in found] == [4, 5] and [f[3] for f in found] == [True, False]
    assert all(n >= 110 for _, _, n, _ in found)
    assert repeats.repeated_spans(empty).count() == 0


def test_near_copies(docs, empty):
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in near.ngram_jaccard_join(docs).collect()) == [(4, 4, 1), (5, 4, 1)]
    assert near.ngram_jaccard_join(empty).count() == 0
    kept = near.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 2, 3, 4, 6, 7, 8)] + [(True, 0)]
    assert near.without_near_copies(empty).count() == 0


def test_near_copies_keep_columns_of_any_name_and_texts_that_share_an_id(spark):
    layout = "doc_id long, text string, key long, sid long, first string, _place int, _again int, _lost int, leader long"
    rows = [(1, SAME, 1, 2, "f", 3, 4, 5, 6), (1, LONG, 1, 2, "f", 3, 4, 5, 6), (2, SAME, 1, 2, "f", 3, 4, 5, 6), (2, SAME, 1, 2, "f", 3, 4, 5, 6)]
    kept = near.without_near_copies(spark.createDataFrame(rows, layout))
    assert kept.columns == [c.split()[0] for c in layout.split(", ")]
    assert sorted((r.doc_id, r.text == LONG) for r in kept.collect()) == [(1, False), (1, True)]


def test_quality_rules(docs, empty, labels, none):
    for d, known, n in ((docs, labels, 10), (docs, none, 10), (empty, labels, 0)):
        found = rules.quality_rules(d, known).collect()
        assert len(found) == n and all(r.keep and r.failed == "" for r in found)  # too few labels to reject
        kept = rules.passing(d, known)
        assert kept.columns == d.columns and kept.count() == n


def test_quality_posteriors(docs, empty, labels, none):
    assert sites.quality_posteriors(docs, labels).count() == 10
    assert {r.posterior for r in sites.quality_posteriors(docs, none).collect()} == {0.5}
    assert sites.quality_posteriors(empty, labels).count() == 0


def test_token_counts(docs, empty, tmp_path):
    rows = tokens.write_token_files(docs, f"file://{tmp_path}/a")
    found = tokens.separator_scan(rows).join(rows, ["file", "ordinal"]).collect()
    counted = {r.doc_id: r.n_tokens for r in tokens.with_token_counts(docs, "doc_id", "text").collect()}
    assert len(found) == 10 and all(r.closed for r in found)
    assert {r.doc_id: r.n_tokens for r in found} == counted and counted[1] == counted[2] == 0 and counted[3] > 60_000
    assert tokens.separator_scan(tokens.write_token_files(empty, f"file://{tmp_path}/b")).count() == 0


def test_packing(docs, empty):
    found = packing.pack(tokens.with_token_counts(docs, "doc_id", "text")).collect()
    assert {r.doc_id for r in found} == {None, 3, 4, 5, 6, 8} and sum(r.doc_id == 4 for r in found) >= 2
    assert packing.pack(tokens.with_token_counts(empty, "doc_id", "text")).count() == 0


def test_mixing(docs, empty, labels, none):
    assert mixing.mix(docs, labels).count() == 10
    assert mixing.mix(empty, labels).count() == 0
    clashing = docs.withColumnsRenamed({"size": "_mixed", "h": "_often", "rate": "_time"})
    assert mixing.resample(clashing, labels).columns == clashing.columns
    mixed = mixing.resample(docs, none)
    assert mixed.columns == docs.columns
    assert sum(r.doc_id is None for r in mixed.collect()) == 1
    assert mixing.resample(empty, labels).count() == 0


def test_pii(docs, empty):
    found = {r.doc_id: r.text for r in pii.find_pii(docs).collect()}
    assert found[8] == "mail [EMAIL], [IP]" and 1 not in found and 2 not in found
    masked = pii.mask_pii(docs)
    assert masked.columns == docs.columns and dict(masked.dtypes)["n_chars"] == "bigint"
    rows = {r.doc_id: r for r in masked.collect()}
    assert rows[1].text is None and rows[2].text == "" and rows[8].n_chars == len("mail [EMAIL], [IP]") and rows[3].text == LONG
    assert masked.count() == 10 and pii.find_pii(empty).count() == pii.mask_pii(empty).count() == 0


def test_top_k(spark):
    layout = "vec_id long, embedding array<float>, block int, norm double, rank int"
    rows = [(1, [1.0, 0.0], 0, 0.0, 0), (1, [1.0, 0.0], 0, 0.0, 0), (2, [1.0], 0, 0.0, 0), (3, [], 0, 0.0, 0), (4, [None, 1.0], 0, 0.0, 0), (None, [1.0], 0, 0.0, 0), (5, None, 0, 0.0, 0)]
    found = sorted((r.query_id, r["rank"], r.id, r.score) for r in topk.top_k(spark.createDataFrame(rows, layout), k=3).collect())
    assert found == [(1, 1, 2, 1.0), (1, 2, 3, 0.0), (2, 1, 1, 1.0), (2, 2, 3, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0)]
    assert topk.top_k(spark.createDataFrame([], layout)).count() == 0


def test_rows_that_share_a_page_id_keep_their_own_text(spark):
    foot = " ".join(f"f{i}" for i in range(25))
    rows = [(1, "http://a.org/1", f"<p>one</p><p>{foot}</p>"), (1, "http://a.org/1", f"<p>another text</p><p>{foot}</p>"), (2, "http://a.org/2", f"<p>two</p><p>{foot}</p>")]
    for big in (1 << 30, 10):
        found = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), big_bytes=big).collect()
        assert sorted((r.page_id, r.text) for r in found) == [(1, "another text"), (1, "one"), (2, "two")]


def test_a_very_long_page(spark):
    rows = [(1, "http://a.org/1", "<p>" + LONG + "</p>"), (2, "http://a.org/2", "<p>short</p><p>" + " ".join(LONG.split()[:30]) + "</p>")]
    found = {r.page_id: (r.n_tokens, r.n_removed) for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), big_bytes=1000).collect()}
    assert found == {1: (60_000, 30), 2: (31, 30)}


@pytest.mark.parametrize("big", [1 << 30, 200])
def test_extraction(spark, big):
    layout = "page_id long, url string, html string, host string, text string, shards int, bytes long"
    body = "<p>" + " ".join(f"t{i}" for i in range(30)) + "</p>"
    rows = [(1, "http://a.org/1", body, "q", "q", 1, 1), (2, "http://A.org/2", body, "q", "q", 1, 1), (3, None, None, "q", "q", 1, 1), (4, "no url", "", "q", "q", 1, 1), (None, "http://a.org", body, "q", "q", 1, 1), (5, "http://b.org", body, "q", "q", 1, 1), (5, "http://b.org", body, "q", "q", 1, 1)]
    found = sorted((r.page_id, r.host, len(r.text), r.n_removed) for r in extraction.extract(spark.createDataFrame(rows, layout), big_bytes=big).collect())
    size = len(extraction.visible(body))
    assert [f for f in found if f[0] < 5] == [(1, "a.org", 0, 30), (2, "a.org", 0, 30), (3, "", 0, 0), (4, "", 0, 0)]
    assert all(f == (5, "b.org", size, 0) for f in found if f[0] == 5)
    assert extraction.extract(spark.createDataFrame([], layout)).count() == 0
