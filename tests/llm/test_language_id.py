import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyspark.llm import language_id as L
from tallyspark.llm.common import utf8_bytes

WORDS = {"aa": "lorem ipsum dolor sit amet consectetur adipiscing", "bb": "straße über münchen gehen würde nicht schön", "cc": "año niño señor mañana corazón está también"}


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split(), int(rng.integers(1, 30)))), lang))
    return rows


def plain_bits(texts, text, order, among=None, least=1):
    """Code length by walking down from the longest context; of contexts, all, or those that ``among`` counts at least ``least`` times."""
    seen = defaultdict(Counter)
    for t in texts:
        b = t.encode()
        for i in range(len(b)):
            for k in range(min(order, i) + 1):
                seen[b[i - k : i]][b[i]] += 1
    b, total = text.encode(), 0.0
    for i in range(len(b)):
        for k in range(min(order, i), -1, -1):
            c = seen.get(b[i - k : i])
            if c is None or k and among is not None and among[b[i - k : i]] < least:
                continue
            n, d = sum(c.values()), len(c)
            if b[i] in c:
                total -= math.log2(c[b[i]] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


def test_code_lengths_equal_plain_ppm(spark):
    rows = corpus(60, 1)
    df = spark.createDataFrame([*rows, *((i + 1000, t, x) for i, t, x in rows)], "doc_id long, text string, lang string")
    model = L.fit(df, per_language=10**6)
    tests = ["lorem über niño", "x", "", "amet amet señor €"]
    data, ends = utf8_bytes(pa.array(tests))
    got = model.code_lengths(data, ends)
    for i, lang in enumerate(model.languages):
        texts = [t for _, t, x in rows if x == lang] * 2
        for j, t in enumerate(tests):
            assert abs(got[j, i] - plain_bits(texts, t, 3)) < 1e-2


def test_held_out_accuracy_and_edges(spark):
    df = spark.createDataFrame(corpus(900, 2), "doc_id long, text string, lang string")
    model = L.fit(df.where(~L.held_out(F.col("doc_id"))), per_language=100)
    got = L.predict(df, model).join(df, "doc_id").where(L.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.98 and all(0 <= r.score <= 1 for r in got)
    edge = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "12 :!", 0), (None, "straße", 0), (5, "über " * 100_000, 0), (5, "日", 0)], "doc_id long, text string, score int")
    by = [(r.doc_id, r.lang_pred) for r in L.predict(edge, model).collect()]
    assert by[:5] == [(1, "und"), (2, "und"), (3, "und"), (None, "bb"), (5, "bb")] and by[5][1] != "und"


def test_a_language_of_short_texts_is_learned(spark):
    rows = [(i, "abc", "zz") for i in range(200)] + [(1000 + i, t, x) for i, t, x in corpus(60, 4)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb", "cc", "zz"]
    docs = spark.createDataFrame([(1, "abc"), (2, "a"), (3, "über")], "doc_id long, text string")
    assert [r.lang_pred for r in L.predict(docs, model).collect()] == ["zz", "zz", "bb"]


def test_every_context_counts_even_if_met_once(spark):
    rows = corpus(120, 5)
    df = spark.createDataFrame([*rows, (7000, "qqfxgz", "dd")], "doc_id long, text string, lang string")
    texts = [*rows, (7000, "qqfxgz", "dd")]
    counts = Counter(t.encode()[i - k : i] for _, t, _ in texts for k in range(1, 4) for i in range(k, len(t.encode())))
    tests = ["amet über corazón", "zzz qqq", "señor", "qqfxgz", "fxgz"]
    for least in (1, 2):
        model = L.fit(df, floor=least)
        assert len(model.child) + len(model.parent) == 1 + sum(n >= least for n in counts.values())
        got = model.code_lengths(*utf8_bytes(pa.array(tests)))
        for i, lang in enumerate(model.languages):
            for j, t in enumerate(tests):
                assert abs(got[j, i] - plain_bits([t for _, t, x in texts if x == lang], t, 3, counts, least)) < 1e-2
    assert L.predict(spark.createDataFrame([(1, "qqfxgz")], "doc_id long, text string"), L.fit(df)).first().lang_pred == "dd"


def test_the_sample_is_bounded_whatever_the_ids(spark):
    rows = [(None, f"text number {i}", "aa") for i in range(900)] + [(5, f"other text {i}", "bb") for i in range(700)] + [(6, "one text many times", "cc")] * 800 + [(i, f"few {i}", "dd") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.sample(df, per_language=50).collect()
    n = Counter(r.lang for r in got)
    assert n == {"aa": 50, "bb": 50, "cc": 1, "dd": 40} and len({(r.lang, r.text) for r in got}) == len(got)
    assert sorted(got) == sorted(L.sample(df.repartition(7), per_language=50).collect())


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "hello", None)], "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert L.predict(docs, model).first().lang_pred == "und"
    assert L.predict(docs.limit(0), model).count() == 0


def test_long_texts_in_parts(spark):
    rows = corpus(120, 6)
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    data, ends = utf8_bytes(pa.array([t for _, t, _ in rows] + ["", "x", ""]))
    whole = model.code_lengths(data, ends)
    for most in (1, 2, 7, 100):
        assert np.allclose(model.code_lengths(data, ends, most), whole, atol=1e-3)
