"""The language stage keeps every document that op3 gives a language."""

import corpus_pipeline
from tallyspark.llm import language_id as L
from tests.llm.test_pipeline import fixture

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Scripts without labelled rows, single words, and rare bytes.
UNUSUAL = ["Дом стоит у реки, и люди идут по улице", "Το σπίτι είναι κοντά στο ποτάμι", "房子在河边人们走在街上", "house", "ж", "Q", "ÿ", "日 1"]
NO_LETTER = ["12 34", "", "!!", None, "№ 7 €"]


def test_keeps_unlabelled_scripts_and_single_words(spark):
    rows = [(i, t, lang, "s", 0) for i, t, lang, _, _ in fixture()[0] if any(c.isalpha() for c in t)]
    more = [(1000 + i, t, None, "s", 0) for i, t in enumerate([*UNUSUAL, *NO_LETTER])]
    docs = spark.createDataFrame([*rows, *more], SCHEMA)
    kept = sorted(tuple(r) for r in corpus_pipeline.language(spark, docs, "").collect())
    assert kept == sorted([*rows, *more[: len(UNUSUAL)]])
    model = L.fit(docs)
    assert {r[0] for r in kept} == {r.doc_id for r in L.predict(docs, model).where("lang_pred != 'und'").collect()}


def test_without_labelled_rows_letters_decide(spark):
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate([*UNUSUAL, *NO_LETTER])], SCHEMA)
    assert sorted(r.text for r in corpus_pipeline.language(spark, docs, "").collect()) == sorted(UNUSUAL)
