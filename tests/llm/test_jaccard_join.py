import random
import re

import numpy as np
import pyarrow as pa

from tallyspark.llm import jaccard_join as J
from tallyspark.llm.common import utf8_bytes
from tallyspark.llm.shingles import shingle_sets


def plain(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def classes(rows, k, t):
    sets = {i: plain(x, k) for i, x in rows}
    comp = {i: i for i in sets}
    pairs = []
    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if t[1] * both >= t[0] * (len(sets[i]) + len(sets[j]) - both):
                    pairs.append((i, j))
    moved = True
    while moved:
        moved = False
        for i, j in pairs:
            m = min(comp[i], comp[j])
            moved |= comp[i] != m or comp[j] != m
            comp[i] = comp[j] = m
    return {i: (len(sets[i]), comp[i]) for i in ids}


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéfgh") for _ in range(rng.randint(1, 5))) for _ in range(150)]
    line = " ".join(rng.choice(words) for _ in range(12))
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 5, 9])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((i, "  ".join(w).upper() if rng.random() < 0.2 else " ".join(w)))
        else:
            rows.append((i, line * rng.choice([0, 0, 1]) + "\n" + " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 40, 90, 150])))))
    return rows


def test_sets_equal_plain_sets():
    texts = ["A b\x0bC d  é\x0cf", "", "one", "one two", " \t", "x y z x y z", "É b c d", "a b c", "A B C"]
    data, ends = utf8_bytes(pa.array(texts))
    for k in (1, 3, 5):
        sets, to = shingle_sets(data, ends, k)
        assert np.diff(to).tolist() == [len(plain(t, k)) for t in texts]
    assert sets[to[7] : to[8]].tolist() == sets[to[8] : to[9]].tolist()


def test_classes_equal_brute_force(spark):
    for seed, k, t in ((1, 3, (90, 100)), (2, 5, (80, 100)), (3, 1, (60, 100))):
        rows = corpus(260, seed)
        df = spark.createDataFrame([(i, x, "n") for i, x in rows], "doc_id long, text string, node string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(df, k=k, similarity=t).collect()}
        assert got == classes(rows, k, t)


def test_longer_prefixes_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(J, "COSTS", (1, 2, 3))
    monkeypatch.setattr(J, "OFTEN", 1)
    rows = corpus(200, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(df, k=3, similarity=(90, 100)).collect()}
    assert got == classes(rows, 3, (90, 100))


def test_edges(spark):
    rows = [(5, None), (4, ""), (3, "a b c d"), (9, "A b  c d"), (9, "A b  c d"), (None, "a b c d"), (7, "x"), (6, "X"), (8, " \n"), (2, "w " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in J.near_duplicates(df, k=3, similarity=(90, 100)).collect())
    assert got == [(-1, 2, None), (2, 1, 2), (3, 2, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (8, 0, 8), (9, 2, 3), (9, 2, 3)]
    assert J.near_duplicates(df.limit(0)).count() == 0
