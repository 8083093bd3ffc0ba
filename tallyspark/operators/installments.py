"""Instalment plans and what they commit in the months to come."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.dates import add_months_to_key, month_key
from tallyspark.functions.hashing import hash_fields


def plan_key(institution: Column, merchant: Column, total: Column, minor: Column, currency: Column) -> Column:
    """Charges of one purchase share this: amounts within about a percent are one band."""
    band = F.when(minor <= 0, 0).otherwise(F.round(F.log(minor.cast("double")) * 100).cast("int"))
    return hash_fields(F.lit("installment-plan"), institution, F.upper(merchant), total.cast("string"), band.cast("string"), currency)


def runs(charges: DataFrame, current: Column | None = None) -> DataFrame:
    """Adds run: a counter that came before in its run opens a new one, and forgets what was seen.

    Each plan's charges pass in order of day, fingerprint and counter; of a run only its counters, of which there are at most some
    dozen, are remembered. So no plan is ever held, however many charges it has.
    """
    counter = "__counter"
    ordered = charges.withColumn(counter, (F.col("installment.current") if current is None else current).cast("int")).repartition("plan_key").sortWithinPartitions("plan_key", "date", "fingerprint", counter)
    places = [ordered.columns.index(c) for c in ("plan_key", counter)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, seen, number = None, set(), 0
        for batch in batches:
            out = []
            for key, current in zip(*(batch.column(i).to_pylist() for i in places), strict=True):
                if key != plan:
                    plan, seen, number = key, set(), 0
                elif current in seen:
                    seen, number = set(), number + 1
                seen.add(current)
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, "run"])

    return ordered.mapInArrow(run, T.StructType([*ordered.schema.fields, T.StructField("run", T.IntegerType())])).drop(counter)


def build_plans(facts: DataFrame, least: str = "suggested") -> DataFrame:
    """A row for each plan: what was bought, which instalments were seen, what is left to pay."""
    rows = facts.where((F.col("kind") == "credit_card_purchase") & F.col("installment").isNotNull() & (F.col("merchant") != ""))
    if least == "confirmed":
        rows = rows.where(F.col("installment.confidence") == "confirmed")
    minor = F.abs("amount") * F.pow(F.lit(10), F.col("amount_scale")).cast("decimal(7,0)")
    rows = rows.withColumn("plan_key", plan_key(F.col("institution"), F.col("merchant"), F.col("installment.total"), minor, F.col("currency")))
    unsure = F.exists("warnings", lambda w: w["code"] == "ambiguous-installment-amount")
    # what passes by Python is flat and no more than plans are made of
    rows = rows.select("plan_key", "date", "fingerprint", "merchant", "description", "institution", "currency", F.abs("amount").alias("amount"), "installment.total", "installment.current", unsure.alias("unsure"), (F.col("installment.confidence") == "confirmed").alias("sure"))
    # counters of a run differ, so that their count tells of gaps; lists are made only where they are asked for
    some = runs(rows, F.col("current")).groupBy("plan_key", "run").agg(
        F.min(F.struct("date", "fingerprint", "merchant", "description", "institution", "currency", "amount", "total")).alias("first"),
        F.max("current").alias("highest"),
        F.min("current").alias("lowest"),
        F.count("current").alias("counted"),
        F.array_sort(F.collect_set("current")).alias("observed_installments"),
        F.coalesce(F.bool_or("unsure"), F.lit(False)).alias("unsure"),
        F.bool_or("sure").alias("sure"),
        F.transform(F.array_sort(F.collect_list(F.struct("date", "fingerprint"))), lambda x: x["fingerprint"]).alias("source_fingerprints"),
    )
    f, current, low = F.col("first"), F.col("highest"), F.col("lowest")
    left = F.greatest(F.lit(0), f["total"] - current)
    start = F.add_months(f["date"], 1 - low)
    return some.select(
        F.when(F.col("run") == 0, F.col("plan_key")).otherwise(F.concat("plan_key", F.lit("-"), "run")).alias("plan_id"),
        f["merchant"].alias("merchant"), f["description"].alias("description"), f["institution"].alias("institution"), f["currency"].alias("currency"),
        F.when(~F.col("unsure"), f["amount"] * f["total"]).cast("decimal(32,6)").alias("original_amount"), f["amount"].alias("installment_amount"), f["total"].alias("total_installments"),
        current.alias("current_installment"), left.alias("remaining_installments"), (f["amount"] * left).cast("decimal(32,6)").alias("remaining_amount"),
        start.alias("start_date"), F.add_months(start, f["total"] - 1).alias("estimated_end_date"), "source_fingerprints", "observed_installments",
        (F.col("counted") != current - low + 1).alias("has_gaps"), F.when(~F.col("unsure") & F.col("sure"), "confirmed").otherwise("suggested").alias("confidence"),
    )


def schedule(plans: DataFrame, from_month: str, horizon: int = 12) -> DataFrame:
    """What open plans charge in each month of the horizon, by currency."""
    due = plans.where("remaining_installments > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("remaining_installments"))))
    due = due.withColumn("month", month_key(F.add_months(F.col("start_date"), F.col("current_installment") + F.col("i") - 1)))
    inside = F.col("month").between(F.lit(from_month), add_months_to_key(F.lit(from_month), horizon - 1))
    return due.where(inside).groupBy("currency", "month").agg(F.sum("installment_amount").alias("amount"), F.count_distinct("plan_id").alias("plans"))


def committed(plans: DataFrame) -> DataFrame:
    """What is left to pay in all, whatever the horizon."""
    is_open = F.col("remaining_installments") > 0
    return plans.groupBy("currency").agg(
        F.coalesce(F.sum(F.when(is_open, F.col("remaining_amount"))), F.lit(0)).cast("decimal(38,6)").alias("committed_total"), F.count_if(is_open).alias("open_plans"), F.count_if(~is_open).alias("closed_plans")
    )


def due_in_month(plans: DataFrame, month: str) -> DataFrame:
    months = F.transform(F.sequence(F.lit(0), F.col("total_installments") - 1), lambda i: month_key(F.add_months(F.col("start_date"), i)))
    return plans.where(F.array_contains(months, month)).groupBy("currency").agg(F.sum("installment_amount").alias("amount"))


def ordered(plans: DataFrame) -> DataFrame:
    """The latest first."""
    return plans.orderBy(F.desc("start_date"), "plan_id")
