"""The pipeline, stage by stage, against what the stages' operators must do to their inputs."""

import random

import corpus_pipeline
from larkspur.llm import near, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    texts = [prose(rng, 60) for _ in range(1500)] + ["### $$$ %%% &&& " * 9] * 300
    texts += [texts[0], texts[0] + " more words here"]
    texts[1] += " ann@x.org"
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(9000, None, None, None, None), (None, texts[2], "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 1500), 0) for i in range(1800)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        outs[name] = docs
        if name != "best_fit_packing":
            assert docs.schema == before.schema
    ids = lambda n: {r.doc_id for r in outs[n].collect()}
    clean = set(range(1500)) | {1800, 1801, 9000, None}
    assert ids("quality_rules") == clean
    assert ids("ngram_jaccard_join") == clean - {1800, 1801}
    assert near.ngram_jaccard_join(outs["ngram_jaccard_join"]).count() == 0
    by_id = {r.doc_id: r for r in outs["pii"].collect()}
    assert by_id[1].text.endswith(" [EMAIL]") and by_id[1].n_chars == len(by_id[1].text) and by_id[3].text == texts[3]
    assert pii.find_pii(outs["pii"]).count() == 0
    assert len(ids("mixing") & set(range(1500))) >= 1490
    packed = outs["best_fit_packing"].collect()
    assert {r.doc_id for r in packed} == ids("mixing") - {9000}
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == sorted(map(tuple, packed), key=str)
