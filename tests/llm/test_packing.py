import struct

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyspark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_whole_text_encoding(spark):
    texts = [None, "", "Hello  World's\tit is x\x1cy", "<|endoftext|> <|ENDOFTEXT|> A", "İstanbul ΣΑΣ éa" * 50, "word " * 9000, "\n\n", "x" * 100, "don't we'll a1b22 x²³ ½ \u00a0y z\u00a0 q\x85 ªº ŉ İ ÀÉ—“q” 日本 e\u0301 K ’s ...!? _a_"]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(None, "a", "z"), (1, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    whole = Tokenizer.from_file(PATH)
    got = packing.tokenize_windows(docs, PATH, window=64).collect()
    by: dict = {}
    for r in sorted(got, key=lambda r: r.start):
        assert len(r.ids) == 4 * r.length and 1 <= r.length <= 64
        if r.doc_id is not None and r.doc_id != 1:
            by.setdefault(r.doc_id, []).extend(struct.unpack(f"<{r.length}I", r.ids))
    for i, t in enumerate(texts):
        if i != 1:
            assert by[i] == whole.encode(t or "", add_special_tokens=False).ids + [2]


def test_packing_is_gapless_and_tight(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 0, int(n)) for i, n in enumerate(rng.integers(1, 101, 500))]
    got = packing.pack_windows(spark.createDataFrame(rows, "doc_id long, start long, length long"), window=100, shards=2).toPandas()
    assert len(got) == 500
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"].to_numpy() == np.concatenate([[0], np.cumsum(g["length"])[:-1]])).all() and g["length"].sum() <= 100
    assert got["sequence_id"].nunique() <= got["length"].sum() / 100 * 1.03 + 2


def test_best_fit_matches_plain_search():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 33, 300)
    where, _ = packing.best_fit_decreasing(lengths, 32)
    rooms: list[int] = []
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms[rooms.index(min(fits))] -= n
        else:
            rooms.append(32 - n)
    assert len(rooms) == where.max() + 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    pieces = packing.tokenize_windows(docs, PATH).drop("ids")
    assert packing.pack_windows(pieces).count() == 0
    assert pytest.approx(1) == packing.shards_for(0)


def test_repeats_and_null_ids_spread_over_shards(spark):
    rows = [(7, 0, 5)] * 10_000 + [(None, 0, 3)] * 10_000
    got = packing.pack_windows(spark.createDataFrame(rows, "doc_id long, start long, length long"), window=100, per_shard=2000).toPandas()
    shard = got["sequence_id"] // 2**32
    assert shard.nunique() == 10 and got.groupby(shard).size().between(1700, 2300).all()
    assert got.groupby([shard, got["doc_id"].isna()]).size().between(800, 1200).all()
    assert not got.duplicated(["sequence_id", "offset"]).any() and len(got) == 20_000
