import hashlib
import random

import numpy as np

from tallyspark.llm import substring_dedup as S


def brute(rows, length):
    seen, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for x in range(len(b) - length + 1):
            seen.setdefault(b[x : x + length], (i, x))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for x in range(len(b) - length + 1):
            if seen[b[x : x + length]] < (i, x):
                gone[x : x + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    letters = "abé " if seed % 2 else "abcdefghij klmno"
    say = lambda k: "".join(rng.choice(letters) for _ in range(k))
    common = [say(rng.randint(15, 200)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.3:
                parts.append(rng.choice(common))
            elif kind < 0.5 and rows:
                base = rng.choice(rows)[1]
                a = rng.randrange(len(base) + 1)
                parts.append(base[a : a + rng.randint(0, 150)])
            elif kind < 0.55:
                parts.append(rng.choice(["x", "xy", "ha"]) * rng.randint(1, 120))
            else:
                parts.append(say(rng.randint(0, 80)))
        rows.append((i * 7 % 121, "".join(parts)))
    return rows


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, k int").repartition(5)
    return S.remove_repeats(df, **more).collect()


def test_equals_brute_force(spark):
    for seed, length, gram, more in ((1, 20, 8, {}), (2, 30, 12, {"phrases_at_once": 60}), (3, 20, 20, {"group_bytes": 300}), (4, 100, 32, {})):
        rows = corpus(seed)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, rows, length=length, gram=gram, **more)}
        want = brute(rows, length)
        assert got == want, [(i, got[i], want[i]) for i in want if got[i] != want[i]][:3]
        assert sum(w[1] for w in want.values()) > 0


def test_edges(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdef ghi") for _ in range(300_000))
    rows = [(1, None), (2, ""), (3, "a" * 99), (4, "a" * 100), (5, long), (6, long[:150]), (None, long[50:200]), (7, "b" * 500), (6, long[:150]), (0, long[1000:1300]), (0, long[1000:1300]), (8, long[1200:1500]), (8, long[1200:1500])]
    got = sorted((99 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in run(spark, rows))
    assert got == [(0, 300, 0, 0), (0, 300, 0, 0), (1, 0, 0, 0), (2, 0, 0, 0), (3, 99, 0, 0), (4, 100, 0, 0), (5, 300_000, 300, 1), (6, 150, 150, 1), (6, 150, 150, 1), (7, 500, 499, 1), (8, 300, 300, 1), (8, 300, 300, 1), (99, 150, 150, 1)]
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(df).count() == 0


def plain_documents(rows, length):
    """By the rule, over rows whose ids may be null or shared: only smaller ids, or the same document further ahead, are earlier."""
    key = lambda i: (1 << 63) - 1 if i is None else i
    places = {}
    for i, t in set(rows):
        b = (t or "").encode()
        for x in range(len(b) - length + 1):
            places.setdefault(b[x : x + length], []).append((key(i), t, x))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for x in range(len(b) - length + 1):
            if any(j < key(i) or (j == key(i) and u == t and y < x) for j, u, y in places[b[x : x + length]]):
                gone[x : x + length] = b"\x01" * length
        out.append((key(i), len(b), sum(gone), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def test_null_and_shared_ids(spark):
    rng = random.Random(8)
    a, b = ("".join(rng.choice("abcdefgh") for _ in range(500)) for _ in range(2))
    rows = [(1, a), (None, a), (None, b), (7, a), (7, b), (9, b), (None, b)]
    got = sorted(((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in run(spark, rows))
    assert got == plain_documents(rows, 100)
    assert [(i, n) for i, _, n, _ in got] == [(1, 0), (7, 0), (7, 500), (9, 500)] + [((1 << 63) - 1, 500)] * 3
    for seed, more in ((5, {}), (6, {"phrases_at_once": 40}), (7, {"group_bytes": 200})):
        rng = random.Random(seed)
        rows = [(rng.choice([None, i % 9, i]), t) for i, t in corpus(seed, 90)]
        got = sorted(((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in run(spark, rows, length=20, gram=8, **more))
        assert got == plain_documents(rows, 20)


def test_largest_id_comes_back(spark):
    got = run(spark, [((1 << 63) - 1, "x" * 150), (None, "y")])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in got) == [(False, (1 << 63) - 1, 149), (True, 0, 0)]


def test_suffix_ranks():
    rng = random.Random(2)
    for length in (1, 2, 3, 7, 8, 9, 20, 100):
        raw = bytes(rng.choice(b"ab") if rng.random() < 0.9 else rng.randrange(256) for _ in range(400)) * 2
        starts = np.arange(len(raw) - length + 1)
        got = S.suffix_ranks(np.frombuffer(raw, np.uint8), starts, length)
        names = sorted({raw[i : i + length] for i in starts})
        assert got.tolist() == [names.index(raw[i : i + length]) for i in starts]
