"""Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups' roots, and a proof for every row.

``H`` is the lowercase hex SHA-256 of its inputs concatenated; digests enter as hex text. A leaf is H of its fields, each ``-`` if
null, else count of UTF-8 bytes, colon, value. While a group has several nodes, every ``fanout`` consecutive ones become their
H; the last run may be shorter, even one node.

Leaves are hashed where their rows lie, so that texts never move. They are put in order by ranges, an own rank within their group
comes from counts of each range, and ranks are cut into aligned blocks of ``fanout ** levels``: a block is one contiguous digest
matrix of 64-byte hex rows, reshaped by the fanout and hashed level by level in one task. Its node is a leaf of the next round,
so that a group of any size, be it all rows, climbs in few rounds of small tables. Going down again, each block adds its own siblings,
found by index arithmetic, to what its node got from above; proofs are thus made last and don't move.

Defined results: groups are ordered null first, then by bytes of UTF-8, rows of a group by key, null first, then by leaf; rows that
are equal in all fields have equal leaves, and a place each. An empty table has no rows, and no root. A group of one row has that
leaf as its root. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, stored

_PROOF = "array<struct<before:string,after:string>>"
_NODES = "grp string, rank long, n long, node string"


def leaf(*fields: Column) -> Column:
    """H of the fields."""
    own = (F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (f.cast("string") for f in fields))
    return F.sha2(F.concat(*own), 256)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _levels(nodes: np.ndarray, depth: int, fanout: int) -> list[np.ndarray]:
    """Digest matrices (rows of 64 bytes), from the given one up, through ``depth`` hashings."""
    out = [nodes]
    for _ in range(depth):
        at = out[-1]
        full = len(at) // fanout
        rows = [memoryview(row) for row in at[: full * fanout].reshape(full, fanout * 64)]
        if full * fanout < len(at):
            rows.append(memoryview(at[full * fanout :].reshape(-1)))
        digests = "".join(sha256(row).hexdigest() for row in rows)
        out.append(np.frombuffer(digests.encode("ascii"), np.uint8).reshape(-1, 64))
    return out


def _depth(n: int, levels: int, fanout: int) -> int:
    """Hashings within a block of a group of n nodes: all levels while there are several blocks, else as many as leave one node."""
    depth = 0
    while depth < levels and n > 1:
        n, depth = -(-n // fanout), depth + 1
    return depth


def _matrix(table: pa.Table) -> np.ndarray:
    """The nodes of a block in the order of their ranks, as bytes."""
    ordered = table.column("node").combine_chunks().take(pa.array(np.argsort(table.column("rank").to_numpy(), kind="stable")))
    return np.frombuffer("".join(ordered.to_pylist()).encode("ascii"), np.uint8).reshape(-1, 64)


def _proofs(levels: list[np.ndarray], fanout: int) -> list[list[dict]]:
    """For each node of the lowest level the siblings before and after its path, level by level."""
    at, steps = np.arange(len(levels[0])), []
    for nodes in levels[:-1]:
        text, first = nodes.tobytes().decode("ascii"), at // fanout * fanout
        last = np.minimum(first + fanout, len(nodes))
        ends = zip((first * 64).tolist(), (at * 64).tolist(), ((at + 1) * 64).tolist(), (last * 64).tolist(), strict=True)
        steps.append([{"before": text[a:b], "after": text[c:d]} for a, b, c, d in ends])
        at = at // fanout
    return [list(x) for x in zip(*steps, strict=True)] if steps else [[] for _ in range(len(levels[0]))]


def ranked(rows: DataFrame, order: list[str], what: str) -> DataFrame:
    """Stored rows with ``rank`` and ``n``: the place of a row in its ``grp`` by the columns of ``order``, and how many there are.

    Rows are dealt by ranges and sorted within them; only the counts of each range and group are summed up across ranges. Equal rows
    are dealt apart by where they were read, so that no number of them has to fit one range."""
    dealt = rows.withColumn("apart", F.xxhash64(F.monotonically_increasing_id()))
    keys = ["grp", *order, "apart"]
    sorted_ = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("apart")
    placed = stored(sorted_.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), what)
    counts = placed.groupBy("grp", "part").agg(F.count("*").alias("own"), F.min("place").alias("first"))
    # as many rows of a group as there are ranges
    before = F.expr("sum(own) over (partition by grp order by part rows between unbounded preceding and 1 preceding)")
    counts = counts.select("grp", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.expr("sum(own) over (partition by grp)").alias("n"))
    out = placed.join(counts, ["grp", "part"]).withColumn("rank", F.col("place") - F.col("first") + F.col("before")).drop("part", "place", "first", "before")
    out.stored_at = placed.stored_at
    return out


def _climb(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """Stored tables of nodes (the first is not stored here), round by round, until each group has one."""

    def hashed(key: tuple, block: pa.Table) -> pa.Table:
        n = block.column("n")[0].as_py()
        top = _levels(_matrix(block), _depth(n, levels, fanout), fanout)[-1]
        return pa.table({"grp": [key[0].as_py()], "rank": [key[1].as_py()], "n": [-(-n // fanout**levels)], "node": [top[0].tobytes().decode("ascii")]})

    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 1
    while True:
        block = F.floor(F.col("rank") / fanout**levels).alias("block")
        of = out[-1].select("grp", "rank", "n", "node", block).groupBy("grp", "block")
        out.append(stored(of.applyInArrow(hashed, _NODES), "merkle-nodes"))
        most = -(-most // fanout**levels)
        if most == 1:
            return out


def _descend(rounds: list[DataFrame], top: DataFrame, fanout: int, levels: int, keep: str) -> DataFrame:
    """The lowest nodes with their proofs: ``top`` has ``proof``, ``subroot`` and ``root`` for each group's only node.

    ``keep`` names columns of the lowest table, with their types, that come along."""
    upper = top
    for k, nodes in reversed(list(enumerate(rounds[:-1]))):
        more = [c.split()[0] for c in keep.split(", ")] if not k and keep else []
        upper = _one_down(nodes, upper, fanout, levels, more, f"{keep}, " if more else "")
    return upper


def _one_down(nodes: DataFrame, upper: DataFrame, fanout: int, levels: int, more: list[str], kinds: str) -> DataFrame:
    def proofs(key: tuple, block: pa.Table, above: pa.Table) -> pa.Table:
        order = np.argsort(block.column("rank").to_numpy(), kind="stable")
        block, node = block.take(pa.array(order)), above.slice(0, 1).to_pylist()[0]
        own = _proofs(_levels(_matrix(block), _depth(block.column("n")[0].as_py(), levels, fanout), fanout), fanout)
        proof = pa.array([x + node["proof"] for x in own], pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))
        same = {c: pa.array([node[c]] * len(own), pa.string()) for c in ("subroot", "root")}
        return pa.table({**{c: block.column(c) for c in (*more, "grp", "rank", "node")}, **same, "proof": proof})

    block = F.floor(F.col("rank") / fanout**levels).alias("block")
    lower = nodes.select(*more, "grp", "rank", "n", "node", block).groupBy("grp", "block")
    over = upper.select("grp", F.col("rank").alias("block"), "subroot", "root", "proof").groupBy("grp", "block")
    return lower.cogroup(over).applyInArrow(proofs, f"{kinds}grp string, rank long, node string, subroot string, root string, proof {_PROOF}")


def manifest(docs: DataFrame, fields: list[Column], key: str = "doc_id", group: str = "lang", claimed: Column | None = None, fanout: int = 8, levels: int = 4) -> DataFrame:
    """For each row its key, ``grp`` (the group's name), ``leaf``, ``claimed``, ``subroot``, ``root`` and ``proof``.

    ``proof`` is, level by level from the leaf to the root, the siblings' digests before and after the path. ``claimed`` is what someone
    says the leaf is (by default the leaf itself), for ``folded``."""
    own = leaf(*fields)
    # null before any name, names in the order of their bytes
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    hashed = docs.select(F.col(key).alias("key"), grp.alias("grp"), F.unhex(own).alias("leaf"), F.unhex(claimed if claimed is not None else own).alias("claimed"))
    hashed = stored(hashed, "merkle-leaves")  # ranges are drawn from these, not by hashing the texts twice
    leaves = ranked(hashed, ["key", "leaf"], "merkle-ranked")
    discard(hashed)
    leaves_of = leaves.select("key", "grp", "rank", "n", F.lower(F.hex("leaf")).alias("node"), F.lower(F.hex("claimed")).alias("claimed"))
    rounds = _climb(leaves_of, fanout, levels)
    roots = rounds[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("node"))
    subroots = ranked(roots, ["name"], "merkle-subroots")
    over = _climb(subroots, fanout, levels)
    top = over[-1].select("grp", "rank", F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"), F.array().cast(_PROOF).alias("proof"))
    tops = _descend(over, top, fanout, levels, "name string").select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("rank"), F.col("node").alias("subroot"), "root", "proof")
    kind = docs.schema[key].dataType.simpleString()
    out = _descend(rounds, stored(tops, "merkle-tops"), fanout, levels, f"key {kind}, claimed string")
    name = F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30)).alias("grp")
    return out.select(F.col("key").alias(key), name, F.col("node").alias("leaf"), "claimed", "subroot", "root", "proof")


def folded(node: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, node, lambda at, step: F.sha2(F.concat(step["before"], at, step["after"]), 256))


def siblings_digest(proof: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""), 256)
