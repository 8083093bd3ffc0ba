import numpy as np

from tallyspark.llm import embedding_dedup as E
from tallyspark.llm.components import components
from tallyspark.llm.hnsw import Graph, unit


def brute(rows, least=0.93):
    ok = [(i, x, k) for i, x, k in rows if i is not None and k is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    ids = np.array([i for i, _, _ in ok])
    links = {i: 0 for i, _, _ in rows}
    comp = {i: i for i, _, _ in rows}
    near = [(a, b) for a in range(len(ok)) for b in range(a) if ok[a][2] == ok[b][2] and len(ok[a][1]) == len(ok[b][1]) and unit([ok[a][1]])[0] @ unit([ok[b][1]])[0] >= least]
    for a, b in near:
        links[ids[a]] += 1
        links[ids[b]] += 1
    moved = True
    while moved:
        moved = False
        for a, b in near:
            m = min(comp[ids[a]], comp[ids[b]])
            for x in (ids[a], ids[b]):
                moved |= comp[x] != m
                comp[x] = m
    return {i: (links[i], comp[i]) for i in links}


def data(n=900, d=16, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.4:
            base = np.array(rows[rng.integers(len(rows))][1])
            x = base + rng.normal(size=d) * rng.choice([0, 0.02, 0.09])
        else:
            x = rng.normal(size=d)
        rows.append((i, [float(v) for v in x.astype(np.float32)], int(rng.integers(3))))
    return rows


def test_equals_brute_force_over_shards(spark):
    rows = data()
    hot = rows[0][1]
    rng = np.random.default_rng(0)
    rows += [(10_000 + i, [float(v) for v in (np.array(hot) + rng.normal(size=16) * 0.01).astype(np.float32)], rows[0][2]) for i in range(150)]
    rows += [(20_000, None, 1), (20_001, [0.0] * 16, 1), (20_002, [float("nan")] + hot[1:], 0), (20_003, [None] + hot[1:], 0), (20_004, hot, None), (20_005, hot[:8], rows[0][2]), (20_006, [], 0), (-7, hot, rows[0][2]), (20_007, [2e30 * v for v in hot], rows[0][2])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, n int")
    got = {r.vec_id: r for r in E.near_duplicates(df, per_shard=150, beam=16, widest=64).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    wrong = [(i, tuple(got[i])[1:3], want[i]) for i in want if (got[i].n_links, got[i].component_id) != want[i]]
    assert len(wrong) <= 0.005 * len(rows), wrong[:5]
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_vectors_that_share_an_id_are_counted_apart(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.999, 0.04]
    rows = [(1, a), (1, b), (2, c), (3, [0.999, 0.0, 0.04]), (4, [0.998, 0.0, 0.06]), (5, [0.0, 0.0, 1.0]), (5, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, label string")
    got = sorted(tuple(r)[:4] for r in E.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False), (5, 1, 5, True), (5, 1, 5, True)]


def test_graph_recall():
    x = unit(np.random.default_rng(1).normal(size=(3000, 24)))
    ids, _ = Graph(x).search(x[:300], 80)
    truth = np.argsort(-(x[:300] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids.tolist(), truth.tolist())]) > 0.95


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(200)] + [(1000, int(x)) for x in rng.integers(2000, 2400, 300)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[b] == 1000 for a, b in edges if a == 1000) and len(got) == 201 + len({b for a, b in edges if a == 1000}) + 1
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_recall_is_measured_where_links_are_rare(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=32)], i % 2) for i in range(1200)]
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), per_shard=200, beam=8).collect()
    assert all(r.n_links == 0 and r.kept for r in got)
    assert got[0].audited_links >= 64 * 2 * 6 and got[0].audit_recall >= 0.98
