"""Remarks on a month, from its figures and those of the month before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.dates import add_months_to_key

# What change, amount, savings rate, fixed share and merchant share are worth a remark.
CHANGE, AMOUNT, SAVINGS, FIXED, MERCHANT = 0.15, 10_000, 0.2, 0.5, 0.2
_KEYS = ("currency", "month")


def change(before: Column, after: Column) -> Column:
    """Relative to the size of what was before; null if that is zero."""
    return F.when(before != 0, (after.cast("double") - before.cast("double")) / F.abs(before.cast("double")))


def _row(ord_: int, name: str, when: Column, severity: Column | str, value: Column) -> Column:
    return F.when(when, F.struct(F.lit(ord_).alias("ord"), F.lit(name).alias("id"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), value.cast("double").alias("value")))


def cash_flow(summary: DataFrame) -> DataFrame:
    """(currency, month, ord, id, severity, value) for each remark that holds."""
    w = Window.partitionBy("currency").orderBy("month")
    is_next = F.lag("month").over(w) == add_months_to_key(F.col("month"), -1)
    df = summary.withColumns({f"p_{c}": F.when(is_next, F.lag(c).over(w)) for c in ("net_spending", "net_cash_flow")})
    spent, flow = change(F.col("p_net_spending"), F.col("net_spending")), change(F.col("p_net_cash_flow"), F.col("net_cash_flow"))
    negative = F.col("net_cash_flow") < 0
    fixed = F.when(F.col("income") > 0, F.col("fixed_expenses").cast("double") / F.col("income").cast("double"))
    rows = F.array(
        _row(1, "net-negative", negative, "attention", F.col("net_spending") - F.col("income")),
        _row(1, "net-healthy", ~negative & (F.col("savings_rate") >= SAVINGS), "positive", F.col("savings_rate")),
        _row(2, "expenses-change", (F.abs(spent) >= CHANGE) & (F.abs(F.col("net_spending") - F.col("p_net_spending")) >= AMOUNT), F.when(spent > 0, "attention").otherwise("positive"), spent),
        _row(3, "net-declining", (F.col("net_cash_flow") < F.col("p_net_cash_flow")) & (F.abs(flow) >= CHANGE), "attention", flow),
        _row(4, "fixed-share-high", fixed >= FIXED, "attention", fixed),
    )
    return df.select(*_KEYS, F.inline(F.array_compact(rows)))


def category_changes(totals: DataFrame) -> DataFrame:
    """Of a month's eight largest categories the first four that changed much against the month before."""
    before = totals.select("currency", "category", add_months_to_key(F.col("month"), 1).alias("month"), F.col("amount").alias("before"))
    rank = F.row_number().over(Window.partitionBy(*_KEYS).orderBy(F.desc("amount"), "category"))
    top = totals.withColumn("rank", rank).where("rank <= 8").join(before, ["currency", "month", "category"])
    moved = change(F.col("before"), F.col("amount"))
    hit = top.withColumn("value", moved).where((F.abs("value") >= CHANGE) & (F.abs(F.col("amount") - F.col("before")) >= AMOUNT))
    nth = F.row_number().over(Window.partitionBy(*_KEYS).orderBy("rank"))
    hit = hit.withColumn("n", nth).where("n <= 4")
    return hit.select(*_KEYS, (F.col("n") + 4).alias("ord"), F.concat(F.lit("category-change:"), "category").alias("id"), F.when(F.col("value") > 0, "attention").otherwise("positive").alias("severity"), "value")


def concentration(merchants: DataFrame, summary: DataFrame) -> DataFrame:
    """A merchant with a fifth of the month's spending, where there are three or more. merchants: ranked by month."""
    top = merchants.groupBy(*_KEYS).agg(F.max_by("amount", -F.col("rank")).alias("top"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    share = F.when(F.col("net_spending") > 0, F.col("top").cast("double") / F.col("net_spending").cast("double"))
    rows = top.join(summary.select(*_KEYS, "net_spending"), list(_KEYS)).withColumn("value", share).where(F.col("value") >= MERCHANT)
    return rows.select(*_KEYS, F.lit(30).alias("ord"), F.lit("merchant-concentration").alias("id"), F.lit("neutral").alias("severity"), "value")


def installments(schedule: DataFrame, month: str, plans: DataFrame | None = None) -> DataFrame:
    """Remarks on what instalments charge; with plans also how many open ones are estimates or have gaps."""
    three = F.col("month") <= add_months_to_key(F.lit(month), 2)
    sums = schedule.groupBy("currency").agg(F.sum(F.when(three, F.col("amount"))).alias("three"), F.sum(F.when(F.col("month") == month, F.col("amount"))).alias("now"))
    rows = [_row(10, "installments-next-three", F.col("three") != 0, "neutral", F.col("three")), _row(11, "installments-this-month", F.col("now").isNotNull(), "neutral", F.col("now"))]
    out = sums.select("currency", F.lit(month).alias("month"), F.inline(F.array_compact(F.array(*rows))))
    if plans is None:
        return out
    unsure = plans.where((F.col("remaining_installments") > 0) & ((F.col("confidence") != "confirmed") | F.col("has_gaps"))).groupBy("currency").agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(unsure.select("currency", F.lit(month).alias("month"), F.lit(12).alias("ord"), F.lit("installments-uncertain").alias("id"), F.lit("attention").alias("severity"), F.col("n").cast("double").alias("value")))


def recurring(charges: DataFrame, month: str) -> DataFrame:
    """How many charges likely come back, what they come to in a month, and how many have a standing order."""
    likely, mandated = F.col("confidence") == "likely", F.col("mandate").isNotNull()
    sums = charges.groupBy("currency").agg(F.count_if(likely).alias("likely"), F.sum(F.when(likely, F.col("typical_amount"))).alias("monthly"), F.count_if(mandated).alias("mandated"))
    rows = F.array(
        _row(20, "recurring-count", F.col("likely") > 0, "neutral", F.col("likely")), _row(21, "recurring-monthly", F.col("likely") > 0, "neutral", F.col("monthly")), _row(22, "recurring-mandates", F.col("mandated") > 0, "neutral", F.col("mandated"))
    )
    return sums.select("currency", F.lit(month).alias("month"), F.inline(F.array_compact(rows)))


def ordered(*families: DataFrame) -> DataFrame:
    """All remarks: by currency and month, in the fixed order of families and of remarks within them."""
    out = families[0]
    for more in families[1:]:
        out = out.unionByName(more)
    return out.orderBy("currency", "month", "ord", "id")
