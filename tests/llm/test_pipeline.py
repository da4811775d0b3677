import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_ngram_join import plain as linked

import corpus_pipeline
from factlog.llm import language_id, pii, pii_examples, quality
from factlog.llm.common import fold, table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_every_stage_on_its_own_input(spark, tmp_path):
    start = docs = table(spark, SF, "documents")
    inputs, outputs = [], []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        outputs.append(docs)
        if k < 4:
            assert docs.columns == start.columns
    rows = [{r.doc_id: r for r in x.collect()} for x in (start, *outputs[:4])]

    good = quality.quality_scores(inputs[0], table(spark, SF, "labels"), fold(1, 3)).where("predicted = 1").collect()
    assert set(rows[1]) == {r.doc_id for r in good} and all(rows[1][i] == rows[0][i] for i in rows[1])
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    clean = [i for i, q in labels.items() if q == 1 and i in rows[0]]
    assert sum(i in rows[1] for i in clean) >= 0.97 * len(clean)

    known = language_id.language_id(inputs[1], fold(2, 4)).where("accepted").collect()
    assert set(rows[2]) == {r.doc_id for r in known} and len(rows[2]) >= 0.98 * len(rows[1])

    want = {i for i, _, low, _ in linked([(i, r.text) for i, r in rows[2].items()]) if i == low}
    assert set(rows[3]) == want

    field = pii.train(pii_examples.examples())
    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        text = rows[3][i].text
        base = pii.base_spans(text)
        assert r.text == pii.redact(text, sorted(base + pii.added_spans([text], [base], field)[0])) and r.n_chars == len(r.text)
        assert not pii.base_spans(r.text)

    bins, words = defaultdict(list), defaultdict(int)
    for r in outputs[4].collect():
        bins[r.bin].append(r)
        words[r.doc_id] += r.n_words
    assert words == {i: len(r.text.encode().split()) for i, r in rows[4].items()}
    assert all(sum(r.n_words for r in b) <= 2048 for b in bins.values())


def test_run_on_odd_rows(spark, tmp_path):
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "the same few words again here", "en", "s", 29), (3, "the same few words again here", "en", None, 29), (4, "x" * 50000, "en", "s", 50000)]
    spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # without a letter, or of an unknown language: gone; copies: one of them; what stays is packed whole
    assert {r.doc_id for r in out} == {2, 4} and {r.doc_id: r.n_words for r in out} == {2: 6, 4: 1}


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_the_filters_take_columns_of_any_name(spark):
    names = ["quality", "y", "at", "x", "h", "n", "held_out", "accepted", "bits", "score"]
    docs = table(spark, SF, "documents").where("doc_id < 60").select("*", *[F.lit("v").alias(c) for c in names])
    plain = docs.drop(*names)
    for _, stage in corpus_pipeline.STAGES[:2]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {r.doc_id for r in stage(spark, plain, SF).collect()}


def test_a_rare_language_is_held_to_its_own_rows(spark):
    rows = [(i, f"the cat number {i % 50} sat on the mat near the old house", "en") for i in range(600)] + [(1000, "der hund lief sehr schnell zur alten katze am haus", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models, limits = language_id.learned(docs, F.lit(False), language_id.ROOM, 100, 8.0)
    assert set(limits) == {"de", "en"} and limits["de"][6] < 16 and limits["en"][6] < 16


def test_limits_come_from_all_training_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} and more of the text {i * i}", "en") for i in range(1500)], "doc_id long, text string, lang string")
    seen, identify = [], language_id.identify
    monkeypatch.setattr(language_id, "identify", lambda some, *rest: (seen.append(some.count()), identify(some, *rest))[1])
    language_id.language_id(docs, F.col("doc_id") % 3 == 0)
    assert seen[0] == 1000
