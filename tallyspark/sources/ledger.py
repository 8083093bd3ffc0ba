"""The ledger: movements as activities of a host with JSON metadata, appended without repeats, and the log of imports."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions.hashing import hash_fields
from tallyspark.functions.money import amount, canonical
from tallyspark.operators import imports

VERSION = 5


def _exists(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def append_new(rows: DataFrame, path: str, key: str = "idempotency_key") -> int:
    """Appends the rows whose key the table at ``path`` lacks, each key once; how many those were. Running it twice adds nothing."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates([key])
    old = _exists(spark, path)
    if old is not None:
        fresh = fresh.join(old.select(key), key, "left_anti")
    seen = Observation()
    fresh.select(rows.columns).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


#: What a row needs to be written, and what it is refused for without.
NEEDED = {"account_id": "no-account", "date": "no-date", "amount": "no-amount", "idempotency_key": "no-key"}


def import_rows(rows: DataFrame, path: str, run: str, size: int = 100) -> DataFrame:
    """Writes rows to the ledger at ``path``, a folder for each month, in batches in the order of their key; (batch, created, skipped,
    failed, reasons) of every batch, read back from what stands in the ledger.

    A row that lacks what it needs fails and the rest of its batch goes on. Rows whose key the ledger holds, or an earlier row of the
    import, are skipped, so that a run that broke off is resumed by running it again, whatever part of it was written. Only folders of
    months that the rows have are read: a key's row has one date. Two writers at once may both write a key; ``entries`` then
    takes one."""
    spark = rows.sparkSession
    lacks = F.array_compact(F.array(*(F.when(F.col(c).isNull(), why) for c, why in NEEDED.items())))
    batched = imports.in_order(rows, "idempotency_key", size).withColumns({"__lacks": lacks, "month": F.date_format("date", "yyyy-MM")})
    good = batched.where(F.size("__lacks") == 0).drop("__lacks")
    months = [r.month for r in good.select("month").distinct().collect()]  # months of a calendar
    old = entries(spark, path, months)
    first = good.groupBy("idempotency_key").agg(F.min_by(F.struct(*good.columns), F.struct("batch", F.xxhash64(*good.columns))).alias("row")).select("row.*")
    if old is not None:
        first = first.join(old.select("idempotency_key"), "idempotency_key", "left_anti")
    first.withColumn("run", F.lit(run)).write.mode("append").partitionBy("month").parquet(path)
    written = entries(spark, path, months)
    made = written.where(F.col("run") == run).groupBy("batch").agg(F.count(F.lit(1)).alias("created")) if written is not None else None
    counts = batched.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("__lacks") > 0).alias("failed"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__lacks")))).alias("reasons"))
    out = counts.join(made, "batch", "left") if made is not None else counts.withColumn("created", F.lit(None).cast("long"))
    created = F.coalesce("created", F.lit(0))
    return out.select("batch", created.alias("created"), (F.col("n") - F.col("failed") - created).alias("skipped"), "failed", "reasons")


def entries(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame | None:
    """The ledger's rows, of some months if given: folders of others aren't read. Of rows with one key, that of the first run and batch;
    null if nothing was ever written."""
    there = _exists(spark, path)
    if there is None:
        return None
    some = there if months is None else there.where(F.col("month").isin(months))
    place = F.row_number().over(Window.partitionBy("idempotency_key").orderBy("run", "batch"))
    return some.withColumn("__place", place).where("__place = 1").drop("__place")


def window(spark: SparkSession, path: str, start: dt.date, end: dt.date) -> tuple[DataFrame, DataFrame]:
    """(posted, drafts) of the days from start to end, both included; drafts wait for review. Reads the months of the window alone."""
    months = [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(start.year * 12 + start.month - 1, end.year * 12 + end.month)]
    some = entries(spark, path, months).where(F.col("date").between(F.lit(start), F.lit(end)))
    return some.where("status = 'POSTED'"), some.where("status = 'DRAFT'")


def _projection(date: Column, kind: Column, value: Column, currency: Column, comment: Column) -> Column:
    """What the metadata was true of: if any of this was edited, the metadata no longer counts."""
    return hash_fields(date.cast("string"), kind, canonical(amount(value)), currency, F.coalesce(comment, F.lit("")))


#: Fields of the metadata, by the version that first wrote them: where they stand, and their type.
FIELDS = {
    "fingerprint": (1, "$.fp", "string"), "kind": (1, "$.kind", "string"), "category": (1, "$.cat", "string"), "merchant": (1, "$.merchant", "string"), "current": (1, "$.cuota.n", "int"), "total": (1, "$.cuota.of", "int"),
    "remaining": (1, "$.cuotaRem", "int"), "substituted": (1, "$.subst", "boolean"), "direction": (2, "$.dir", "string"), "projection": (3, "$.proj", "string"), "cost_kind": (4, "$.fc", "string"), "kind_confidence": (5, "$.kc", "string"),
}
CONFIDENCES = ("confirmed", "suggested", "unresolved")


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def to_activities(facts: DataFrame, version: Column | None = None) -> DataFrame:
    """Host rows: unsigned amounts, a type that the account takes (``account_type``, if given), a comment, and the rest as JSON.

    ``version`` writes the metadata as an earlier version did, without the fields that came later."""
    version = F.lit(VERSION) if version is None else version
    part = F.when(F.col("installment").isNotNull(), F.concat(F.lit(" (cuota "), F.col("installment.current"), F.lit("/"), F.col("installment.total"), F.lit(")"))).otherwise("")
    read = imports.resolved_type(F.col("kind"), F.col("direction"), _optional(facts, "account_type"))
    rows = facts.withColumns({"__type": read, "comment": F.left(F.concat(F.trim("description"), part), F.lit(500)), "value": canonical(F.abs("amount")), "__v": version})
    rows = rows.withColumns({"activity_type": F.col("__type.type"), "__subst": F.col("__type.substituted")})
    since = lambda name, c: F.when(F.col("__v") >= FIELDS[name][0], c)
    plan = F.when(F.col("installment").isNotNull(), F.struct(F.col("installment.current").alias("n"), F.col("installment.total").alias("of")))
    meta = F.struct(
        F.col("__v").alias("v"), F.col("fingerprint").alias("fp"), "kind", F.col("category").alias("cat"), "merchant", plan.alias("cuota"), _optional(facts, "installment_remaining", "int").alias("cuotaRem"),
        F.when(F.col("__subst"), True).alias("subst"), since("direction", F.col("direction")).alias("dir"), since("cost_kind", _optional(facts, "cost_kind")).alias("fc"), since("kind_confidence", _optional(facts, "kind_confidence")).alias("kc"),
        since("projection", _projection(F.col("date"), F.col("activity_type"), F.col("value"), F.col("currency"), F.col("comment"))).alias("proj"),
    )
    subtype = F.when(~F.col("__subst") & (F.col("kind") == "refund"), "REFUND").when(~F.col("__subst") & (F.col("kind") == "interest") & (F.col("activity_type") == "FEE"), "INTEREST_CHARGE")
    status = F.when(F.col("kind") == "unknown", "DRAFT").otherwise("POSTED")
    return rows.select("account_id", "activity_type", subtype.alias("subtype"), "date", F.col("value").alias("amount"), "currency", "comment", status.alias("status"), F.to_json(meta).alias("metadata"))


def metadata_fields(metadata: Column) -> dict[str, Column]:
    """The fields of a metadata text of any version; null where its version has none, or where it says what can't be."""
    read = F.try_parse_json(metadata)
    v = F.try_variant_get(read, "$.v", "int")
    out = {name: F.when(v >= since, F.try_variant_get(read, path, kind)) for name, (since, path, kind) in FIELDS.items()}
    out["fingerprint"] = F.nullif(out["fingerprint"], F.lit(""))
    out["direction"] = F.when(out["direction"].isin("in", "out"), out["direction"])
    out["kind_confidence"] = F.when(out["kind_confidence"].isin(*CONFIDENCES), out["kind_confidence"])
    return out | {"v": v}


def from_activities(activities: DataFrame) -> DataFrame:
    """Facts from host rows with metadata of any version.

    Metadata counts while the row is the one that was written: since version 3 a hash tells, before it ``is_user_modified`` (if given).
    Direction follows the type, then the metadata, then the sign; a bare interest on a card follows current metadata, then is a charge.
    The recorded kind stands while it maps to the type that the host holds, on this account or on one that takes few types; else the
    type alone tells, with ``subtype`` and ``account_type`` if given."""
    fields = metadata_fields(F.col("metadata"))
    t, account, subtype = F.col("activity_type"), _optional(activities, "account_type"), _optional(activities, "subtype")
    rows = activities.withColumn("m", F.struct(*(c.alias(n) for n, c in fields.items())))
    same = F.col("m.projection") == _projection(F.col("date"), t, F.col("amount"), F.col("currency"), F.col("comment"))
    untouched = ~F.coalesce(_optional(activities, "is_user_modified", "boolean"), F.lit(False))
    current = F.col("m.fingerprint").isNotNull() & F.when(F.col("m.projection").isNull(), untouched).otherwise(same)
    rows = rows.withColumn("is_current", F.coalesce(current, F.lit(False)))
    kept = lambda name: F.when(F.col("is_current"), F.col(f"m.{name}"))
    value = amount(F.col("amount").try_cast("decimal(22,6)"))
    on_card = F.coalesce(account == "CREDIT_CARD", F.lit(False))
    stated = F.when((t == "INTEREST") & on_card, F.coalesce(kept("direction"), F.lit("out"))).otherwise(F.coalesce(imports.flow(t), F.col("m.direction")))
    rows = rows.withColumns({"__stated": stated, "__value": value}).withColumn("direction", F.coalesce("__stated", F.when(F.col("__value") < 0, "out").otherwise("in")))
    written = F.coalesce("m.direction", "direction")
    cached = F.coalesce("m.kind", F.lit("unknown"))
    forced = F.coalesce(F.col("m.substituted"), F.lit(False)) & (imports.resolved_type(cached, written, F.lit("CREDIT_CARD"))["type"] == t)
    kind = F.when(F.col("is_current") & ((imports.natural_type(cached, written) == t) | forced), cached).otherwise(imports.kind_of_type(t, subtype, account))
    rows = rows.withColumn("__kind", kind)
    signed = F.when(F.col("__stated") == "out", -F.abs("__value")).when(F.col("__stated") == "in", F.abs("__value")).otherwise(F.col("__value"))
    sure = F.when(F.col("is_current") & (F.col("__kind") == F.col("m.kind")), F.coalesce("m.kind_confidence", F.lit("suggested"))).otherwise("suggested")
    plan = F.when(kept("current").isNotNull(), F.struct(F.col("m.current").alias("current"), F.col("m.total").alias("total")))
    return rows.select(
        "account_id", F.col("m.fingerprint").alias("fingerprint"), "date", amount(signed).alias("amount"), "currency", "direction", F.col("__kind").alias("kind"), sure.alias("kind_confidence"),
        kept("category").alias("category"), F.when(F.col("__kind") != "cash_advance", kept("merchant")).alias("merchant"), kept("cost_kind").alias("cost_kind"), plan.alias("installment"), kept("remaining").alias("installment_remaining"),
        F.regexp_replace("comment", r"(?i)\s*\(cuota\s+\d+/\d+\)\s*$", "").alias("description"), "status", "is_current",
    )


def record_run(spark: SparkSession, path: str, **facts: object) -> str:
    """Appends a run to the log; its id."""
    run = uuid.uuid4().hex
    row = {"run_id": run, "at": dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), **facts}
    spark.createDataFrame([tuple(row.values())], list(row)).coalesce(1).write.mode("append").parquet(path)
    return run


def recent_runs(spark: SparkSession, path: str, n: int) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path).orderBy(F.desc("at"), "run_id").limit(n)
