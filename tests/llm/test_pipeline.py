import random
import re
import struct

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_jaccard_join import plain
from tests.llm.test_secret_scan import brute as secret_spans


def fixture(seed=3):
    rng = random.Random(seed)
    words = {"en": "the house and river stone window green never walking under bright people".split(), "de": "das haus und fluss stein fenster grün niemals gehen unter straße leute".split()}
    words = {k: [*v, *(v[i % 12] + v[i // 12] for i in range(144))] for k, v in words.items()}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    bench = [(i, say("en", 25)) for i in range(5)]
    rows = []
    for i in range(150):
        lang = rng.choice(["en", "de"])
        kind = i % 10
        text = say(lang, rng.randint(5, 200))
        if kind == 1:
            text = rng.choice(rows)[1]
        elif kind == 2 and rows:
            w = rng.choice(rows)[1].split() or ["x"]
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 3:
            text += f" {rng.choice(bench)[1].upper()}! " + say(lang, 9)
        elif kind == 4:
            text += f" password = hunter{i}22 and deadbeef{i:016x}abcd " + say(lang, 20)
        elif kind == 5 and i % 20 == 5:
            text = rng.choice(["12 34", "", "!!"])
        rows.append((i, text, lang, "s", len(text)))
    return rows, bench


def expected(rows, bench):
    kept = [r for r in rows if any(c.isalpha() for c in r[1])]
    sets = {r[0]: plain(r[1], 5) for r in kept}
    comp = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for i in sets:
            for j in sets:
                if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                    moved = True
                    comp[i] = comp[j] = min(comp[i], comp[j])
    kept = [r for r in kept if comp[r[0]] == r[0]]
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    kept = [r for r in kept if not any(norm(b) in norm(r[1]) for _, b in bench)]
    out = {}
    for r in kept:
        spans = [[a, b] for a, _, _, b in secret_spans(r[1])]
        merged = []
        for a, b in spans:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        text = r[1]
        for a, b in reversed(merged):
            text = text[:a] + "[secret]" + text[b:]
        out[r[0]] = text
    return out


def test_equals_plain_version(spark, tmp_path):
    rows, bench = fixture()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = expected(rows, bench)
    pieces: dict = {}
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.start):
        pieces.setdefault(r.doc_id, []).extend(struct.unpack(f"<{r.length}I", r.ids))
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {i: whole.encode(t, add_special_tokens=False).ids + [2] for i, t in want.items()} == pieces
    assert any("[secret]" in t for t in want.values()) and len(want) < 120


def test_stages_keep_columns_and_nulls(spark, tmp_path):
    spark.createDataFrame([(0, "the quick brown fox jumps over the lazy dog " * 3)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, None, None, None, None, "x"), (None, "hello token=abcdefgh", "en", "s", 20, "x"), (None, "hello token=abcdefgh", "en", "s", 20, "x"), (2, "one two", "en", None, 7, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "spans"], name
    got = sorted((r.doc_id or 0, r.text, r.n_chars) for r in docs.collect())
    assert got == [(0, "hello [secret]", 14), (0, "hello [secret]", 14), (2, "one two", 7)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "secrets", "packing"]


def test_columns_with_names_of_the_stages_own(spark, tmp_path):
    spark.createDataFrame([(0, "the quick brown fox jumps over the lazy dog " * 3)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["id", "_id", "n", "blob", "SPANS", "new", "piece", "component_id", "token", "h"]
    rows = [(1, "hello token=abcdefgh", "en", "s", 20, *names), (3, "hello there, you", "en", "s", 16, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[5:] == names, name
    assert sorted((r.doc_id, r.text, *r[5:]) for r in docs.collect()) == [(1, "hello [secret]", *names), (3, "hello there, you", *names)]


def test_texts_that_share_an_id_stand_for_themselves(spark, tmp_path):
    item = "the quick brown fox jumps over the lazy dog " * 3
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["one house stands by the river and nobody lives in it any more", "she bought seven apples on monday from the old man down there", "trains leave the station at noon and come back late in the evening"]
    rows = [(1, texts[0], "en", "s", 1), (1, texts[1], "en", "s", 2), (1, f"so {item} it is", "en", "s", 3), (2, texts[2], "en", "s", 4), (2, texts[0], "en", "s", 5), (4, texts[1], "en", "s", 6)]
    docs = spark.createDataFrame([*rows, (1, texts[0], "en", "t", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    near = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect())
    assert near == sorted((i, t) for i, t, *_ in rows[:4])
    for _ in range(2):
        assert {tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs.repartition(5), str(tmp_path)).where(F.col("text") == texts[0]).collect()} <= {rows[0], (1, texts[0], "en", "t", 7)}
    kept = sorted((r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect())
    assert kept == sorted((i, t) for i, t, *_ in [*rows[:2], *rows[3:], (1, texts[0])])


def test_all_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names
