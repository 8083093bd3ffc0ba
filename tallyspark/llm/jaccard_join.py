"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of word shingles. In one order of all shingles, rare ones first, two sets with Jaccard of at least t share at
least c shingles among their first n - ceil(t n) + c ones, and more the closer their sizes. Each document chooses c by the candidates
that its prefix is estimated to give: the costlier, the longer its prefix and the more shared shingles are required before two
documents are verified.

Equal sets, by 64-bit names, are one node. Then links are sought in two rounds, so that a group of n near copies costs n
comparisons, not n * n: each node is verified against a hub, the node with the most frequent prefix under most of its shingles (of near copies, the one
with the fewest changes); then, under shingles that
still join different components, the nodes outside the largest component there meet those of other components. Pairs within a
component need no more comparing, since only classes are asked for. Of the shingles of round two, two nodes must share so many that
the first shared one stands early in both their lists: only there, and only once in a run of shared ones, do they meet. All
verification is exact, on whole texts.

Before texts are fetched, pairs that cannot be similar are told by parity sketches: for each of 256 buckets a set keeps whether it
has an odd number of shingles there, so that the sketches of two sets differ in no more bits than the sets in shingles. The bound
loses no pair, and few texts have to move.

Null ids are never linked. Rows that share an id share their links. Null texts and texts without words have empty sets, which link
with nothing. Repeated rows come back as often as they occur. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, slices, stored, utf8_bytes
from tallyspark.llm.components import components
from tallyspark.llm.shingles import mix, overlap, shingle_sets

#: Slots of the table of frequencies, and how often one task must meet a shingle to count it there.
SLOTS, OFTEN = 1 << 20, 4
#: Estimated candidates from which on a document requires one more shared shingle.
COSTS = (64, 512, 4096)
_SKETCH = ["s0", "s1", "s2", "s3"]
_FIRST = f"doc_id bigint, h bigint, n bigint, node bigint, {' bigint, '.join(_SKETCH)} bigint, slot int, seen bigint"
_FIRST_NAMES = ["doc_id", "h", "n", "node", *_SKETCH, "slot", "seen"]


def _sets(part: pa.RecordBatch, column: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    data, ends = utf8_bytes(part.column(column))
    return shingle_sets(data, ends, k)


def _names(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets + np.uint64(1)))])
    return mix(sums[ends[1:]] - sums[ends[:-1]] + np.diff(ends).astype(np.uint64)).view(np.int64)


def sketches(sets: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The parity sketch of each set, in four 64-bit numbers."""
    bit, word = np.uint64(1) << (sets & np.uint64(63)), (sets >> np.uint64(6)) & np.uint64(3)
    full = np.flatnonzero(np.diff(ends))
    out = []
    for w in range(len(_SKETCH)):
        x = np.zeros(len(ends) - 1, np.uint64)
        if len(full):
            x[full] = np.bitwise_xor.reduceat(np.where(word == np.uint64(w), bit, np.uint64(0)), ends[:-1][full])
        out.append(x.view(np.int64))
    return out


def _first_pass(k: int):
    """A row for each document, and for each slot the counts of the shingles that this task met often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = [], np.zeros(SLOTS, np.int64)

        def count() -> None:
            if held:
                found, n = np.unique(np.concatenate(held), return_counts=True)
                often = n >= OFTEN
                np.add.at(seen, (found[often] >> np.uint64(44)).astype(np.int64), n[often])
                held.clear()

        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                sets, ends = _sets(part, 1, k)
                n = np.diff(ends)
                none = pa.nulls(len(n))
                own = [pa.array(x) for x in (n, _names(sets, ends), *sketches(sets, ends))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *own, none.cast(pa.int32()), none.cast(pa.int64())], _FIRST_NAMES)
                held.append(sets)
                size += len(sets)
                if size > 2_000_000:
                    count()
                    size = 0
        count()
        slot = np.flatnonzero(seen)
        none = pa.nulls(len(slot)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([none] * (len(_FIRST_NAMES) - 2) + [pa.array(slot.astype(np.int32)), pa.array(seen[slot])], _FIRST_NAMES)

    return run


def prefixes(sets: np.ndarray, ends: np.ndarray, seen: np.ndarray, t: tuple[int, int], costs: tuple[int, ...] = COSTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix shingles of all sets, how many each set has, and each set's estimated candidates, from which c follows."""
    n = np.diff(ends)
    owner = np.repeat(np.arange(len(n)), n)
    often = seen[(sets >> np.uint64(44)).astype(np.int64)]
    order = np.lexsort((sets, often, owner))
    sets, often = sets[order], often[order]
    least = -(-t[0] * n // t[1])
    rank = np.arange(len(sets)) - np.repeat(ends[:-1], n)
    base = np.repeat(n - least + 1, n)
    cost = np.bincount(owner, np.where(rank < base, often, 0), len(n)).astype(np.int64)
    c = np.minimum(1 + sum((cost >= x).astype(np.int64) for x in costs), np.maximum(least, 1))
    keep = rank < np.repeat(n - least + c, n)
    return sets[keep], np.bincount(owner[keep], minlength=len(n)), cost


def _required(n, cost, t: tuple[int, int], costs: tuple[int, ...]):
    """c, the shared shingles that a document requires, as ``prefixes`` has it."""
    return F.least(1 + sum(((cost >= x).cast("bigint") for x in costs), F.lit(0)), F.greatest(F.ceil(n * t[0] / t[1]), F.lit(1)))


def _second_pass(k: int, t: tuple[int, int], table, costs: tuple[int, ...]):
    """(token, node, n, cost) of every shingle in a prefix, once for each node and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, done = table.value, set()
        for batch in batches:
            for part in slices(batch, "text"):
                sets, ends = _sets(part, 0, k)
                node = _names(sets, ends)
                fresh = np.zeros(len(node), bool)
                for i, x in enumerate(node.tolist()):
                    if x not in done:
                        done.add(x)
                        fresh[i] = True
                fresh &= np.diff(ends) > 0
                n = np.diff(ends)
                sets = sets[np.repeat(fresh, n)]
                n, node = n[fresh], node[fresh]
                token, count, cost = prefixes(sets, np.concatenate([[0], np.cumsum(n)]), seen, t, costs)
                again = lambda x: pa.array(np.repeat(x, count).astype(np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), again(node), again(n), again(cost)], ["token", "node", "n", "cost"])

    return run


def _verifying(k: int, t: tuple[int, int]):
    """Rows come by (center, salt), the center's own text first; gives the pairs that are similar enough. Repeated rows of a
    document give their pair again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                sets, ends = _sets(part, 3, k)
                out = []
                for i, (center, salt, node) in enumerate(zip(*(part.column(j).to_pylist() for j in range(3)), strict=True)):
                    mine = sets[ends[i] : ends[i + 1]]
                    if node == center:
                        at, own = (center, salt), mine
                    elif at == (center, salt):
                        both = overlap(mine, own) if len(mine) < len(own) else overlap(own, mine)
                        if t[1] * both >= t[0] * (len(mine) + len(own) - both):
                            out.append((node, center))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, k: int, t: tuple[int, int], per_salt: int = 64) -> DataFrame:
    """The (center, member) pairs that are similar enough, as (a, b). Centers with many members are dealt to several tasks.

    Texts and what is asked of them are merged at any size: what is asked grows with the documents."""
    pairs = stored(pairs, "pairs")
    centers = pairs.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / per_salt).cast("int").alias("salts"))
    members = pairs.join(centers, "center").select("center", F.pmod(F.xxhash64("member"), "salts").cast("int").alias("salt"), F.col("member").alias("node"))
    own = centers.select("center", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("center").alias("node"))
    wanted = members.unionAll(own).join(nodes.select("node", "rep"), "node").select("center", "salt", "node", "rep.id", F.col("rep.h").alias("of"))
    wanted = stored(wanted, "wanted")
    asked = wanted.select("id", "of").distinct()
    texts = rows.withColumn("h", F.xxhash64("text")).join(asked.hint("merge"), (F.col("doc_id") == F.col("id")) & (F.col("h") == F.col("of")), "left_semi")
    texts = texts.groupBy("doc_id", "h").agg(F.any_value("text").alias("text"))  # a document that comes in several rows goes on once
    found = texts.join(wanted.hint("merge"), (F.col("doc_id") == F.col("id")) & (F.col("h") == F.col("of"))).select("center", "salt", "node", "text")
    found = found.repartition("center", "salt").sortWithinPartitions("center", "salt", (F.col("node") != F.col("center")).cast("int"))
    links = stored(found.mapInArrow(_verifying(k, t), "a bigint, b bigint"), "links")
    discard(pairs, wanted)
    return links


def _may_link(a: list, b: list, t: tuple[int, int]):
    """Whether two sets, each given by its size and sketch, may be similar enough."""
    (na, *sa), (nb, *sb) = (list(map(F.col, x)) for x in (a, b))
    differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(sa[1:], sb[1:], strict=True)), F.bit_count(sa[0].bitwiseXOR(sb[0])))
    # At a Jaccard of at least t, two sets differ in at most (1 - t) / (1 + t) of the sum of their sizes.
    return _close(na, nb, t) & (differ * (t[0] + t[1]) <= (na + nb) * (t[1] - t[0]))


def _close(a, b, t: tuple[int, int]):
    return F.least(a, b) * t[1] >= F.greatest(a, b) * t[0]


def _needed(t: tuple[int, int]):
    """How many prefix shingles x and y share at least if they are similar enough: with an overlap of at least o, prefixes of
    n - o + m shingles share m, and the prefixes at hand have n - ceil(t n) + c."""
    spare = lambda side: F.col(f"{side}_c") - F.ceil(F.col(f"{side}_n") * t[0] / t[1])
    return F.least(spare("x"), spare("y")) + F.ceil((F.col("x_n") + F.col("y_n")) * t[0] / (t[0] + t[1]))


def _ranked(rows: DataFrame, t: tuple[int, int], before: int = 4) -> DataFrame:
    """Rows (token, node, n, c, of, largest) of which a node can still meet another under their token.

    rank: the token's place among the ``held`` ones of its node, those in fewest rows first; before: the tokens just ahead of it.
    If two nodes must share m of them, the first shared one has m - 1 of each node's at or after it, and none shared ahead of it.
    So a row whose rank leaves too few for every size in its group (``needed`` is least at one end of these sizes) goes.
    """
    order = Window.partitionBy("node").orderBy("df", "token")
    ahead = F.array_compact(F.array(*(F.lag("token", i).over(order) for i in range(1, before + 1)))).alias("before")
    some = rows.select("*", F.row_number().over(order).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy("node")).alias("held"), ahead)
    n = F.col("n")
    low, high = F.greatest("low", F.ceil(n * t[0] / t[1])), F.least("high", F.floor(n * t[1] / t[0]))
    at = lambda m: F.least(F.col("c") - F.ceil(n * t[0] / t[1]), -m * t[0] / t[1]) + (n + m) * t[0] / (t[0] + t[1])
    least = F.greatest(F.ceil(F.least(at(low), at(high)) - 1e-6), F.lit(1))
    return some.where((low <= high) & (F.col("rank") <= F.col("held") - least + 1)).drop("df", "low", "high")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, component_hash) of every row; similarity: least Jaccard as a fraction of two integers.

    The hashes tell texts that share an id: text_hash is xxhash64 of the row's text, component_hash that of the component's first text
    (its smallest id, and of that id's texts the one with the least hash). Rows that are linked with nothing are their own component."""
    spark, t, costs = docs.sparkSession, similarity, COSTS
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    hashed = rows.select("doc_id", "text", F.xxhash64("text").alias("h"))
    first = stored(hashed.mapInArrow(_first_pass(k), _FIRST), "sets")
    counts = first.where("slot is not null").groupBy("slot").agg(F.sum("seen").alias("seen")).toPandas()  # at most SLOTS rows
    seen = np.zeros(SLOTS, np.int32)
    seen[counts["slot"].to_numpy(np.int64)] = np.minimum(counts["seen"].to_numpy(np.int64), 1 << 30)
    held = spark.sparkContext.broadcast(seen)
    known = first.where("slot is null")
    linked = known.where("n > 0 and doc_id is not null")
    nodes = linked.groupBy("node").agg(F.min(F.struct(F.col("doc_id").alias("id"), "h")).alias("rep"), *(F.any_value(c).alias(c) for c in ("n", *_SKETCH)))
    nodes = stored(nodes, "nodes")

    prefix = rows.where("doc_id is not null").select("text").mapInArrow(_second_pass(k, t, held, costs), "token bigint, node bigint, n bigint, cost bigint")
    # Node sizes and shingle counts differ by row only where documents repeat, so this drops just repeats from several tasks.
    prefix = prefix.repartition("token").dropDuplicates(["token", "node"])
    by_token = Window.partitionBy("token")
    hub = F.max(F.struct("cost", "n", "node")).over(by_token)
    shared = prefix.select("*", hub.alias("hub"), F.max("node").over(by_token).alias("most"), F.min("node").over(by_token).alias("few")).where("most != few")
    required = _required(F.col("n"), F.col("cost"), t, costs).cast("int").alias("c")
    shared = stored(shared.select("token", "node", "n", required, F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "shared")

    # Round one: the hub under most of a node's shingles.
    hubs = shared.where(F.col("hub") != F.col("node")).where(_close("n", "hub_n", t)).groupBy("node", "hub").agg(F.count(F.lit(1)).alias("times"))
    best = hubs.groupBy("node").agg(F.max_by("hub", F.struct("times", -F.col("hub"))).alias("center")).withColumnRenamed("node", "member")
    mine, theirs = (["n", *_SKETCH], [f"{c}_" for c in ("n", *_SKETCH)])
    centers = nodes.select(F.col("node").alias("node_"), *(F.col(c).alias(f"{c}_") for c in mine))
    near = best.join(nodes.drop("rep"), F.col("member") == F.col("node")).join(centers, F.col("center") == F.col("node_"))
    one = _verified(near.where(_may_link(mine, theirs, t)).select("center", "member"), nodes, rows, k, t)

    # Round two: shingles under which different components still meet.
    label = components(one).withColumnRenamed("node", "at")
    placed = shared.select("token", "node", "n", "c").join(label, F.col("node") == F.col("at"), "left")
    placed = placed.select("token", "node", "n", "c", F.coalesce("component", "node").alias("of")).repartition("token")
    counted = placed.groupBy("token", "of").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("low"), F.max("n").alias("high"))
    groups = counted.groupBy("token").agg(F.max_by("of", F.struct("size", "of")).alias("largest"), F.sum("size").alias("df"), F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("several"))
    opened = _ranked(placed.join(groups.where("several > 1").drop("several"), "token"), t)
    marked = nodes.select(F.col("node").alias("at"), *_SKETCH)
    opened = stored(opened.join(marked, F.col("node") == F.col("at")).drop("at"), "open")
    discard(shared)
    columns = ("token", "node", "c", "of", "rank", "held", "before", *mine)
    x = opened.where("of != largest").select(*(F.col(c).alias(f"x_{c}") for c in columns))
    y = opened.select(*(F.col(c).alias(f"y_{c}") for c in columns), (F.col("of") == F.col("largest")).alias("big"))
    needed = _needed(t)
    first = (F.col("x_rank") <= F.col("x_held") - needed + 1) & (F.col("y_rank") <= F.col("y_held") - needed + 1) & ~F.arrays_overlap("x_before", "y_before")
    may = _may_link([f"x_{c}" for c in mine], [f"y_{c}" for c in mine], t)
    met = x.join(y, (F.col("x_token") == F.col("y_token")) & (F.col("x_of") != F.col("y_of")) & (F.col("big") | (F.col("x_node") < F.col("y_node"))) & first & may)
    pairs = met.select(F.least("x_node", "y_node").alias("member"), F.greatest("x_node", "y_node").alias("center")).distinct()
    two = _verified(pairs, nodes, rows, k, t)
    discard(opened)

    classes = nodes.select("node", "rep")
    label = components(one.unionAll(two)).withColumnRenamed("node", "at")
    classes = classes.join(label, F.col("node") == F.col("at"), "left").select("node", "rep", F.coalesce("component", "node").alias("of"))
    firsts = classes.groupBy("of").agg(F.min("rep").alias("first"))
    mapped = classes.join(firsts, "of").select(F.col("node").alias("own"), F.col("first.id").alias("component_id"), F.col("first.h").alias("component_hash"))
    is_linked = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("node"))
    out = known.join(mapped, is_linked == F.col("own"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("h").alias("text_hash"), F.coalesce("component_hash", "h").alias("component_hash"))
