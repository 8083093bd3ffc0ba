"""Near duplicates among embeddings: navigable small-world graphs per shard.

Vectors are compared within a label (and length) only. Equal vectors are brought together first and searched once. Each label's
vectors are dealt to shards of about ``per_shard``; each shard's graph is built once and stored, and every two shards of a label
meet in one task that searches each one's graph for the other's vectors. A search widens its beam until the audit finds ``recall``
of the links: a sample of the vectors asked for, and as many made up by turning members of the shard by an angle within the
threshold, so that every meeting has true links to find, are compared with the whole shard; self matches don't count. A vector
whose beam ends within the links is searched with a wider one, and beyond ``widest`` it is compared with the whole shard.
Candidates are verified in double precision. Tasks give counts and a spanning forest of their links, not pairs, so a group of near
copies costs no quadratic output.

Null ids, null labels, null vectors, vectors without length, all zero, or with null, NaN or infinite components link with
nothing. Equal vectors link with each other. Rows with a repeated vec_id count as vectors of their own. Other columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import stored
from tallyspark.llm.components import components
from tallyspark.llm.hnsw import Graph, unit


def _pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _build(links: int, beam: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "rep"], ignore_index=True)
        vectors = np.array(rows["embedding"].to_list(), np.float64)
        graph = Graph(unit(vectors), links, beam)
        packed = {f"near{k}": x for k, x in enumerate(graph.near)} | {f"members{k}": x for k, x in enumerate(graph.members)}
        data = _pack(rep=rows["rep"].to_numpy(np.int64), n=rows["n"].to_numpy(np.int64), vectors=vectors, order=graph.order, **packed)
        return pd.DataFrame({"label": [key[0]], "dims": [key[1]], "shards": [int(rows["shards"][0])], "shard": [key[2]], "graph": [data]})

    return run


class Shard:
    def __init__(self, data: bytes) -> None:
        with np.load(io.BytesIO(data)) as f:
            self.rep, self.n, self.x = f["rep"], f["n"], unit(f["vectors"])
            self.graph = graph = Graph.__new__(Graph)
            graph.order = f["order"]
            graph.x = np.ascontiguousarray(self.x[graph.order], np.float32)
            graph.near = [f[f"near{k}"] for k in range(sum(x.startswith("near") for x in f.files))]
            graph.members = [f[f"members{k}"] for k in range(len(graph.near))]
            graph.size = len(self.x)

    def whole(self, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (query, own) of at least this similarity, by comparing with every vector."""
        found = [np.nonzero(queries[i : i + 256] @ self.x.T >= least) for i in range(0, len(queries), 256)]
        return np.concatenate([a + 256 * i for i, (a, _) in enumerate(found)] or [[]]).astype(np.int64), np.concatenate([b for _, b in found] or [[]]).astype(np.int64)

    def turned(self, count: int, least: float, rng: np.random.Generator) -> np.ndarray:
        """Some members, each turned in a random direction to a cosine between ``least`` and 1 with what it was."""
        x = self.x[rng.permutation(len(self.x))[:count]]
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        size = np.linalg.norm(away, axis=1, keepdims=True)
        away = np.where(size > 1e-9, away / np.maximum(size, 1e-9), 0.0)
        cosine = rng.uniform(least, 1.0, (len(x), 1))
        return unit(cosine * x + np.sqrt(1 - cosine**2) * away)

    def links(self, queries: np.ndarray, same: bool, least: float, beam: int, recall: float, audit: int, widest: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Pairs (query, own) of at least this similarity that the graph finds, and how many links the audit had and found.
        same: the queries are the shard's own vectors."""
        rng, n = np.random.default_rng(7), len(queries)
        asked = np.concatenate([queries, self.turned(audit, least, rng)])
        sample = np.concatenate([rng.permutation(n)[:audit], np.arange(n, len(asked))])
        a, b = self.whole(asked[sample], least)
        truth = {(i, j) for i, j in zip(sample[a].tolist(), b.tolist(), strict=True) if not (same and i == j)}
        while True:
            ask, width, pairs = np.arange(len(asked)), beam, []
            while len(ask):
                if width > widest:
                    a, b = self.whole(asked[ask], least)
                    pairs.append((ask[a], b))
                    break
                ids, sims = self.graph.search(asked[ask], width)
                r, c = np.nonzero((ids >= 0) & (sims >= least - 1e-3))
                close = np.einsum("nd,nd->n", asked[ask[r]], self.x[ids[r, c]]) >= least
                full = (sims[:, -1] >= least - 1e-3) & (ids.shape[1] < len(self.x))
                keep = close & ~full[r]
                pairs.append((ask[r[keep]], ids[r, c][keep]))
                ask, width = ask[full], 2 * width
            a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            audited = np.isin(a, sample)
            found = len(truth.intersection(zip(a[audited].tolist(), b[audited].tolist(), strict=True)))
            if beam > widest or found >= recall * len(truth):
                return a[a < n], b[a < n], len(truth), found
            beam *= 2


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = x = root.get(y, y)
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := top(x)) != (q := top(y)):
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _meet(least: float, beam: int, recall: float, audit: int, widest: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard", ignore_index=True)
        one = Shard(rows["graph"][0])
        other = one if key[2] == key[3] else Shard(rows["graph"][1])
        a, b, *audited = other.links(one.x, one is other, least, beam, recall, audit, widest)
        if one is not other:
            d, c, *more = one.links(other.x, False, least, beam, recall, audit, widest)
            audited = [x + y for x, y in zip(audited, more, strict=True)]
        else:
            c, d = b, a
        pairs = np.unique(np.concatenate([a, c]) * len(other.x) + np.concatenate([b, d]))
        a, b = pairs // len(other.x), pairs % len(other.x)
        if one is other:
            a, b = a[a != b], b[a != b]
        frames = []
        for shard, near, mine, theirs in ((one, other, a, b), (other, one, b, a))[: 1 if one is other else 2]:
            sums = np.bincount(mine, near.n[theirs], len(shard.rep)).astype(np.int64)
            frames.append(pd.DataFrame({"a": shard.rep, "b": None, "links": sums})[sums > 0])
        edges = _forest(one.rep[a], other.rep[b])
        frames.append(pd.DataFrame({"a": [x for x, _ in edges], "b": [y for _, y in edges], "links": 0}))
        frames.append(pd.DataFrame({"a": [None], "b": [None], "links": [0], "audited": [audited[0]], "found": [audited[1]]}))
        return pd.concat(frames, ignore_index=True).astype(dict.fromkeys(("a", "b", "links", "audited", "found"), "Int64"))

    return run


def near_duplicates(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.93,
    per_shard: int = 8192, links: int = 16, beam: int = 48, recall: float = 0.98, audit: int = 64, widest: int = 384,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_links, audit_recall) of every row; the last two are those of all audits."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    e = F.col("embedding")
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & F.forall(e, finite) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).cast("string").alias("label"))
    rows = rows.select("*", F.coalesce(valid, F.lit(False)).alias("valid"))
    # One row for each distinct vector, with a number of its own, since vectors can share an id.
    reps = rows.where("valid").groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    reps = reps.select("label", "embedding", F.size("embedding").alias("dims"), F.monotonically_increasing_id().alias("rep"), "first", "n", F.xxhash64("label", "embedding").alias("h"))
    reps = stored(reps, "vectors")
    shards = reps.groupBy("label", "dims").agg(F.ceil(F.count(F.lit(1)) / per_shard).cast("int").alias("shards"))
    dealt = reps.join(shards, ["label", "dims"]).withColumn("shard", F.pmod("h", "shards").cast("int"))
    graphs = dealt.groupBy("label", "dims", "shard").applyInPandas(_build(links, beam), "label string, dims int, shards int, shard int, graph binary")
    graphs = stored(graphs, "graphs")
    to = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("to")
    meet = graphs.select("label", "dims", "shard", "graph", to).select("label", "dims", "shard", "graph", F.least("shard", "to").alias("i"), F.greatest("shard", "to").alias("j"))
    found = meet.groupBy("label", "dims", "i", "j").applyInPandas(_meet(least, beam, recall, audit, widest), "a bigint, b bigint, links bigint, audited bigint, found bigint")
    found = stored(found, "links")
    audited, seen = found.where("audited is not null").agg(F.coalesce(F.sum("audited"), F.lit(0)), F.coalesce(F.sum("found"), F.lit(0))).first()

    counts = found.where("b is null and a is not null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "of")
    label_of = components(found.where("b is not null")).withColumnRenamed("node", "at")
    known = reps.join(counts, F.col("rep") == F.col("of"), "left").join(label_of, F.col("rep") == F.col("at"), "left")
    known = known.withColumn("whole", F.coalesce("component", "rep"))
    least_of = known.groupBy(F.col("whole").alias("own_whole")).agg(F.min("first").alias("component_id"))
    known = known.join(least_of, F.col("whole") == F.col("own_whole")).select(
        F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("component_id").alias("component")
    )
    hit = F.when(F.col("valid"), F.col("label")) == F.col("l")
    out = rows.join(known, hit & (F.col("embedding") == F.col("e")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.lit(audited).cast("bigint").alias("audited_links"), F.lit(seen / audited if audited else None).cast("double").alias("audit_recall"))
