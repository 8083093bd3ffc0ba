"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """The session with a checkpoint folder: the one that the cluster names in spark.checkpoint.dir, or, only where that is unset and
    the master is local (one machine), a temporary one. Elsewhere its absence is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return spark


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the checkpoint folder, which executors share."""
    with_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{what}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a statement are deleted when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written once to the checkpoint folder and read again: cuts lineage, and Spark knows its size. Nothing else reads the shuffles
    that made it, so they are deleted."""
    path = shared_path(df.sparkSession, what)
    with _shuffles_deleted(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once nothing that is still to be computed reads it."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def once_per(df: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``work`` makes of the distinct values of the key columns, joined back to every row (nulls are values too).

    For costly work on columns that repeat. The distinct values are counted out before anything moves, and stored; Spark sends them
    to all executors only if they are few."""
    few = stored(work(df.select(*keys).distinct()), "distinct")
    some = few.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in few.columns if c not in keys))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(some, on, "left").drop(*(f"__{k}" for k in keys))


def spread(df: DataFrame) -> DataFrame:
    """df dealt to three tasks a core, at random: for costly work on rows of a table that few tasks read, as Spark does with a small or
    well compressed file. The number is given, so that Spark doesn't merge small parts again."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


def session(name: str = "tallyspark", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return with_checkpoints(builder.getOrCreate())
