"""Charges that come back about every month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import fold_case
from tallyspark.operators import kinds as K
from tallyspark.operators.enrich import mandate, installment

# Names that say nothing about the merchant.
GENERIC = ("AUTOMATICO", "CARGO", "CARGO AUTOMATICO", "COMERCIO", "COMPRA", "DEBITO AUTOMATICO", "DESCONOCIDO", "PAC", "PAGO AUTOMATICO", "PAGO", "PAT", "SIN COMERCIO", "SUSCRIPCION")


def eligible(facts: DataFrame) -> DataFrame:
    """Spending of known merchants that is no instalment, with merchant_key."""
    key = F.trim(F.regexp_replace(fold_case(F.col("merchant")), "[^A-Z0-9]+", " "))
    declared = installment(F.col("description"), F.lit(""), K.kind() == "credit_card_purchase").isNotNull()
    rows = facts.where(K.is_spending() & (F.col("amount") < 0) & F.col("merchant").isNotNull() & F.col("installment").isNull()).where(~declared)
    return rows.withColumn("merchant_key", key).where((F.col("merchant_key") != "") & ~F.col("merchant_key").isin(*GENERIC))


def recurring_charges(
    facts: DataFrame, *, least: int = 3, likely: tuple[int, int] = (24, 38), possible: tuple[int, int] = (20, 45), likely_spread: int = 1500, possible_spread: int = 4000
) -> DataFrame:
    """A row for each merchant whose charges come in regular intervals with similar amounts.

    Charges of one day are one occurrence. Spreads are basis points off the lower median, compared exactly. ``likely`` needs narrow
    intervals and spread, one charge a day, three occurrences, and a standing order on every charge; two occurrences suffice for
    ``possible`` if all charges have a standing order and all else is narrow.
    """
    least = max(3, least)
    rows = eligible(facts).withColumn("mandate", mandate(F.col("normalized_description")))
    group = ["currency", "merchant_key"]
    last = F.struct("fingerprint", "merchant", "category")
    days = rows.groupBy(*group, "date").agg(
        F.sum(-F.col("amount")).alias("amount"), F.count(F.lit(1)).alias("charges"), F.max(last).alias("last"),
        F.bool_and(F.col("mandate").isNotNull()).alias("all_mandated"), F.bool_or(F.col("mandate") == "pac").alias("pac"), F.bool_or(F.col("mandate") == "pat").alias("pat"),
    )
    days = days.withColumn("gap", F.datediff("date", F.lag("date").over(Window.partitionBy(*group).orderBy("date"))))
    some = days.groupBy(*group).agg(
        F.count(F.lit(1)).alias("occurrences"), F.sum("charges").alias("charge_count"), F.max("charges").alias("most_a_day"),
        F.min("gap").alias("min_interval_days"), F.max("gap").alias("max_interval_days"), F.expr("percentile_disc(0.5) within group (order by gap)").cast("int").alias("median_interval_days"),
        F.expr("percentile_disc(0.5) within group (order by amount)").alias("median"), F.min("amount").alias("lowest"), F.max("amount").alias("highest"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max_by("last", "date").alias("last"),
        F.bool_and("all_mandated").alias("all_mandated"), F.bool_or("pac").alias("pac"), F.bool_or("pat").alias("pat"),
    )
    typical = F.col("median").cast("decimal(32,6)")
    # The amounts farthest off the median are the lowest and the highest.
    off = F.greatest(F.col("highest").cast("decimal(27,6)") - typical.cast("decimal(27,6)"), typical.cast("decimal(27,6)") - F.col("lowest").cast("decimal(27,6)"))
    within = lambda limit: off * 10000 <= typical.cast("decimal(27,6)") * limit
    worst = F.greatest(*(F.abs(F.col(c).cast("double") - typical.cast("double")) / typical.cast("double") for c in ("lowest", "highest")))
    kind = F.when(~F.col("all_mandated") | F.col("pac") & F.col("pat"), None).when(F.col("pac"), "pac").when(F.col("pat"), "pat").otherwise("automatico")
    some = some.withColumns({"typical_amount": typical, "mandate": kind, "amount_spread": F.when(typical == 0, 0.0).otherwise(worst)})
    low, high = F.col("min_interval_days"), F.col("max_interval_days")
    some = some.withColumn("regular", (low >= likely[0]) & (high <= likely[1]) & within(likely_spread))
    enough = F.col("occurrences") >= F.when(F.col("mandate").isNotNull(), max(2, least - 1)).otherwise(least)
    some = some.where(enough & (low >= possible[0]) & (high <= possible[1]) & within(possible_spread) & ((F.col("occurrences") >= 3) | F.col("regular")))
    sure = F.col("regular") & (F.col("most_a_day") == 1) & F.col("mandate").isNotNull() & (F.col("occurrences") >= 3)
    return some.select(
        "merchant_key", F.col("last.merchant").alias("merchant"), "currency", "typical_amount", "occurrences", "charge_count", "median_interval_days", "min_interval_days", "max_interval_days",
        "amount_spread", "first_date", "last_date", "mandate", F.when(sure, "likely").otherwise("possible").alias("confidence"), F.col("last.category").alias("category"),
    )


def charges_of(recurring: DataFrame, facts: DataFrame) -> DataFrame:
    """(merchant_key, currency, fingerprint) of every charge of the recurring merchants."""
    return eligible(facts).select("merchant_key", "currency", "fingerprint").join(recurring.select("merchant_key", "currency"), ["merchant_key", "currency"], "left_semi")


def ordered(charges: DataFrame) -> DataFrame:
    return charges.orderBy(F.when(F.col("confidence") == "likely", 0).otherwise(1), "currency", F.desc("typical_amount"), "merchant_key")
