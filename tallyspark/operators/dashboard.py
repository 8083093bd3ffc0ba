"""Thirteen months at a glance: every month of the window for every currency, with what each family of figures says of it.

Months without movements are rows too, so that months compare and charts have no holes. Families are aggregated on their own and
joined to the months by currency and month: nothing is counted twice, and rows are as many as currencies times months.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.dates import add_months_to_key, month_key
from tallyspark.operators import metrics

FIGURES = ("income", "refunds", "gross_spending", "fixed_expenses", "variable_expenses", "net_spending", "net_cash_flow")


def spine(facts: DataFrame, month: str, months: int = 13) -> DataFrame:
    """(currency, month) of the ``months`` up to and with ``month``, for every currency that has any movement in them."""
    some = within(facts, month, months).select("currency").distinct()
    return some.withColumn("month", F.explode(F.array(*(add_months_to_key(F.lit(month), -k) for k in range(months)))))


def within(facts: DataFrame, month: str, months: int = 13) -> DataFrame:
    """Movements of these months, with ``month``."""
    rows = facts.withColumn("month", month_key(F.col("date")))
    return rows.where((F.col("month") <= month) & (F.col("month") > add_months_to_key(F.lit(month), -months)))


def live_charges(charges: DataFrame, month: str) -> DataFrame:
    """Recurring charges that still run: last charged in the month before, or later."""
    return charges.where(month_key(F.col("last_date")) >= add_months_to_key(F.lit(month), -1))


def history(facts: DataFrame, month: str, months: int = 13) -> DataFrame:
    """A row for each currency and month: figures (0 without movements), the largest category and merchant with their amounts, what the
    issuer charged, and the change of net spending against the month before (null for the first).

    Among equal amounts the name that sorts first counts. savings_rate is null without income."""
    rows = within(facts, month, months)
    by = ("currency", "month")
    summary = metrics.summaries(rows).select(*by, "transaction_count", "savings_rate", *FIGURES)
    top = lambda df, name: df.where("amount > 0").groupBy(*by).agg(F.min_by(F.struct(name, "amount"), F.struct(-F.col("amount"), F.col(name))).alias("t")).select(*by, F.col(f"t.{name}").alias(f"top_{name}"), F.col("t.amount").alias(f"top_{name}_amount"))
    categories = metrics.category_totals(rows, by)
    merchants = metrics.merchant_totals(rows, 1, by)
    counted = categories.where("amount > 0").groupBy(*by).agg(F.count(F.lit(1)).alias("categories"))
    issuer = metrics.issuer_charges(rows, by).select(*by, F.col("amount").alias("issuer_charges"))
    out = spine(facts, month, months)
    for family in (summary, top(categories, "category"), top(merchants, "merchant"), counted, issuer):
        out = out.join(family, [*by], "left")
    out = out.fillna(0, ["transaction_count", "categories"]).withColumns({c: F.coalesce(c, F.lit(0)) for c in (*FIGURES, "issuer_charges")})
    return out.withColumn("net_spending_change", F.col("net_spending") - F.lag("net_spending").over(Window.partitionBy("currency").orderBy("month")))
