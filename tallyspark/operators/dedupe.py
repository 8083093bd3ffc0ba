"""Duplicates among new movements and those of the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import hashing as H
from tallyspark.functions.text import description_key, similarity
from tallyspark.session import stored

# Readers that once read amounts of these sources in another way.
LEGACY = (("banco-chile.tarjeta", "generico.tarjeta", None), ("banco-chile.tarjeta", "banco-chile.tarjeta", "0.1.0"), ("banco-falabella.cmr", "generico.tarjeta", None), ("banco-falabella.cmr", "banco-falabella.cmr", "0.1.0"))

#: So many files with conflicts are sent to all executors.
FEW = 10_000


def with_fingerprints(df: DataFrame) -> DataFrame:
    """Adds fingerprint, weak_fingerprint, legacy_fingerprint and legacy_weak_fingerprint."""
    c = F.col
    legacy, legacy_weak = H.legacy_fingerprints(c("account_id"), c("date"), c("amount"), c("amount_scale"), c("currency"), c("description"), c("reference"))
    return df.withColumns(
        {
            "fingerprint": H.fingerprint(c("account_id"), c("date"), c("amount"), c("currency"), c("description"), c("reference"), c("installment_remaining")),
            "weak_fingerprint": H.weak_fingerprint(c("account_id"), c("date"), c("amount"), c("currency")),
            "legacy_fingerprint": legacy,
            "legacy_weak_fingerprint": legacy_weak,
        }
    )


def with_idempotency_keys(df: DataFrame) -> DataFrame:
    """A key for each row: its fingerprint, and ``#2``, ``#3`` ... for repeats in the order of source_line."""
    n = F.row_number().over(Window.partitionBy("source_file_hash", "fingerprint").orderBy("source_line"))
    return df.withColumn("__n", n).withColumn("idempotency_key", F.when(F.col("__n") == 1, F.col("fingerprint")).otherwise(F.concat("fingerprint", F.lit("#"), "__n"))).drop("__n")


def classify(candidates: DataFrame, existing: DataFrame, *, threshold: float = 0.72, tolerance: int = 3) -> DataFrame:
    """Adds verdict (exact, probable, none), reason_code, existing_activity_id and score to candidates.

    In order: a fingerprint of the ledger (probable if that row was edited since), a repeat within the file, a source that an
    older reader read differently, a similar movement of the same account, day and amount, else new. All joins are on equality.
    existing: rows in ledger order (``ord``, newest first); of several with a fingerprint the last counts.
    """
    e = existing.select([F.col(c).alias(f"e_{c}") for c in existing.columns])
    last = Window.partitionBy("e_fingerprint").orderBy(F.desc("e_ord"))
    known = e.where(F.col("e_fingerprint").isNotNull()).withColumn("__n", F.row_number().over(last)).where("__n = 1")
    known = known.select("e_fingerprint", F.col("e_activity_id").alias("k_activity"), F.coalesce("e_host_modified", F.lit(False)).alias("k_modified"))
    older = known.select(F.col("e_fingerprint").alias("o_fingerprint"), F.col("k_activity").alias("o_activity"), F.col("k_modified").alias("o_modified"))
    # most rows have no legacy fingerprint: each gets a name of its own, which is none, as nulls would all meet in one task
    legacy = F.coalesce("legacy_fingerprint", F.concat(F.lit("-"), F.col("row_id").cast("string")))
    rows = candidates.join(known, F.col("fingerprint") == F.col("e_fingerprint"), "left").join(older, legacy == F.col("o_fingerprint"), "left")
    rows = rows.withColumns({"__stored": F.coalesce("k_activity", "o_activity"), "__edited": F.when(F.col("k_activity").isNotNull(), F.col("k_modified")).otherwise(F.col("o_modified"))})

    # of each file of the ledger one row for each parser whose older reading it is; the rows of a file never meet in one task
    was = F.array_compact(F.array(*(F.when((F.col("e_parser") == b) & (F.lit(True) if v is None else F.col("e_parser_version") == v), a) for a, b, v in LEGACY)))
    odd = e.select(F.col("e_file_hash").alias("source_file_hash"), F.explode(was).alias("source_parser"), "e_activity_id", "e_ord")
    odd = stored(odd.groupBy("source_file_hash", "source_parser").agg(F.min_by("e_activity_id", "e_ord").alias("c_activity")), "conflicts")
    rows = rows.join(odd.hint("broadcast" if odd.count() <= FEW else "merge"), ["source_file_hash", "source_parser"], "left")

    keys = candidates.select("row_id", "date", "amount", "currency", "description", "installment_remaining", F.explode(F.array_compact(F.array("weak_fingerprint", "legacy_weak_fingerprint"))).alias("weak"))
    near = keys.join(e, F.col("weak") == F.col("e_weak_fingerprint")).where(
        (F.abs(F.datediff("date", "e_date")) <= tolerance) & (F.col("amount") == F.col("e_amount")) & (F.col("currency") == F.col("e_currency"))
        & F.coalesce(F.col("installment_remaining") == F.col("e_installment_remaining"), F.lit(True))
    )
    # keys are named before they are compared, as similarity looks at each several times
    near = near.withColumns({"__key": description_key(F.col("description")), "__e_key": description_key(F.col("e_description"))}).withColumn("score", similarity(F.col("__key"), F.col("__e_key")))
    best = near.groupBy("row_id").agg(F.max_by(F.struct("e_activity_id", "score"), F.struct("score", -F.col("e_ord"))).alias("best"))
    rows = rows.join(best, "row_id", "left").withColumn("__similar", F.col("best.score") >= threshold)

    # A repeat follows a row with the same fingerprint that itself was found new.
    plain = F.col("c_activity").isNull() & ~F.coalesce("__similar", F.lit(False)) & F.col("__stored").isNull()
    before = F.row_number().over(Window.partitionBy("fingerprint").orderBy("source_line", "row_id"))
    rows = rows.withColumn("__again", plain & (before > 1))
    code = (
        F.when(F.col("__stored").isNotNull(), F.when(F.col("__edited"), "host-modified").otherwise("exact-fingerprint"))
        .when(F.col("__again"), "repeated-within-file")
        .when(F.col("c_activity").isNotNull(), "legacy-source-conflict")
        .when(F.col("__similar"), "similar")
        .otherwise("new")
    )
    rows = rows.withColumn("reason_code", code)
    r = F.col("reason_code")
    return rows.select(
        *candidates.columns,
        F.when(r == "exact-fingerprint", "exact").when(r == "new", "none").otherwise("probable").alias("verdict"),
        "reason_code",
        F.when(r.isin("exact-fingerprint", "host-modified"), F.col("__stored")).when(r == "legacy-source-conflict", F.col("c_activity")).when(r == "similar", F.col("best.e_activity_id")).alias("existing_activity_id"),
        F.when(r == "similar", F.col("best.score")).alias("score"),
    )


def bag_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two bags paired one to one by key: the keys, how many are in both, and how many only in a or b."""
    left, right = (x.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for x, n in ((a, "in_a"), (b, "in_b")))
    on = [left[k].eqNullSafe(right[k]) for k in keys]
    both = left.join(right, on, "full_outer").select(*(F.coalesce(left[k], right[k]).alias(k) for k in keys), F.coalesce("in_a", F.lit(0)).alias("in_a"), F.coalesce("in_b", F.lit(0)).alias("in_b"))
    matched = F.least("in_a", "in_b")
    return both.select(*keys, matched.alias("matched"), (F.col("in_a") - matched).alias("only_a"), (F.col("in_b") - matched).alias("only_b"))
