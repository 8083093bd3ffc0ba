"""Connected components of very large graphs by alternating large-star and small-star steps.

Edges never meet in one place: minima are partial aggregates, and the joins that carry them back can be split where one
node has many edges. Each round is written to the shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).unionAll(edges.select(F.col("m").alias("u"), F.col("v").alias("w")))
    least = both.groupBy("u").agg(F.min("w").alias("least")).select(F.col("u").alias("of"), F.least("u", "least").alias("least"))
    up = both.where(F.col("w") > F.col("u")).join(least, F.col("u") == F.col("of"))
    return up.select(F.col("w").alias("v"), F.col("least").alias("m")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of these."""
    least = edges.groupBy("v").agg(F.min("m").alias("least")).select(F.col("v").alias("of"), "least")
    down = edges.join(least, F.col("v") == F.col("of")).select(F.col("m").alias("v"), F.col("least").alias("m")).where(F.col("v") != F.col("m"))
    return down.unionAll(least.select(F.col("of").alias("v"), F.col("least").alias("m"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; component: the least node reachable. Loops and nulls don't count."""
    ab = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).distinct()
    now = stored(ab, "components")
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        before, now = now, stored(_small(_large(now)), "components")
        discard(before)
        if (new := _state(now)) == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("m").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("v").alias("node"), F.col("m").alias("component")).unionAll(roots)
