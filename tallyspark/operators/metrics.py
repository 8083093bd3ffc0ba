"""Monthly metrics over a facts frame, all months and currencies at once.

Facts have account_id, date, amount (signed decimal), currency, direction, kind, category, merchant, cost_kind, cost_confidence and
processor columns. Currencies never mix: every result is keyed by currency.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.dates import add_months_to_key, month_key
from tallyspark.operators import kinds as K
from tallyspark.operators.categories import is_fixed


class MixedCurrencyError(ValueError):
    def __init__(self, currencies: list[str]) -> None:
        super().__init__(f"movements in several currencies ({', '.join(currencies)}) have no exchange rate to be summed by")
        self.currencies = currencies


def single_currency(facts: DataFrame, fallback: str = "CLP") -> str:
    found = [r[0] for r in facts.select("currency").distinct().orderBy("currency").limit(100).collect()]
    if len(found) > 1:
        raise MixedCurrencyError(found)
    return found[0] if found else fallback


def _sum(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.abs("amount"))), F.lit(0).cast("decimal(32,6)"))


def summaries(facts: DataFrame) -> DataFrame:
    """A row for each currency and month.

    A movement counts once: as transfer, card payment, refund, income or spending, in this order; transfers and card payments by
    their outgoing leg. savings_rate is null without income.
    """
    moved, paid = K.kind() == "internal_transfer", K.kind() == "credit_card_payment"
    other = ~moved & ~paid
    refund, income, spending = other & K.is_refund(), other & K.is_income() & ~K.is_refund(), other & K.is_spending()
    fixed = is_fixed(F.col("category"))
    sums = facts.groupBy("currency", month_key(F.col("date")).alias("month")).agg(
        _sum(income).alias("income"),
        _sum(refund).alias("refunds"),
        _sum(spending).alias("gross_spending"),
        _sum(spending & K.is_consumption()).alias("consumption_spending"),
        _sum(spending & fixed).alias("fixed_expenses"),
        _sum(spending & ~fixed).alias("variable_expenses"),
        _sum(moved & (K.direction() == "out")).alias("internal_transfers"),
        _sum(paid & (K.direction() == "out")).alias("card_payments"),
        F.count(F.lit(1)).alias("transaction_count"),
    )
    net = F.col("gross_spending") - F.col("refunds")
    inflows = F.col("income") + F.col("refunds")
    rate = F.when(F.col("income") > 0, (F.col("income").cast("double") - F.col("net_spending").cast("double")) / F.col("income").cast("double"))
    return sums.withColumns({"net_spending": net, "cash_inflows": inflows, "net_cash_flow": inflows - F.col("gross_spending")}).withColumn("savings_rate", rate)


def by_currency(facts: DataFrame, month: str, fallback: str = "CLP") -> DataFrame:
    """One month's summary for each currency, most movements first; without movements a row of zeros in ``fallback``."""
    some = summaries(facts.where(month_key(F.col("date")) == month))
    blank = facts.sparkSession.createDataFrame([(fallback, month)], "fallback string, month string")
    empty = blank.join(some.select(F.lit(1).alias("x")).limit(1), F.lit(True), "left_anti")
    zeros = [F.lit(0).cast(some.schema[c].dataType).alias(c) for c in some.columns if c not in ("currency", "month", "savings_rate")]
    zero = empty.select(F.col("fallback").alias("currency"), "month", *zeros, F.lit(None).cast("double").alias("savings_rate"))
    return some.unionByName(zero).orderBy(F.desc("transaction_count"), "currency")


def delta(before: Column, after: Column) -> Column:
    """struct(kind, amount, before, after, absolute, ratio): how a figure changed; fields that don't apply are null."""
    none = before.isNull()
    kind = (
        F.when(none, "no-baseline")
        .when((before == 0) & (after == 0), "both-zero")
        .when(before == 0, "new")
        .when(after == 0, "gone")
        .when(F.signum(before) != F.signum(after), "sign-flip")
        .otherwise("relative")
    )
    both = kind.isin("sign-flip", "relative")
    ratio = (after.cast("double") - before.cast("double")) / F.abs(before.cast("double"))
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "new", after).when(kind == "gone", before).alias("amount"),
        F.when(both, before).alias("before"),
        F.when(both, after).alias("after"),
        F.when(both, after - before).alias("absolute"),
        F.when(kind == "relative", ratio).alias("ratio"),
    )


def comparisons(summary: DataFrame) -> DataFrame:
    """Each month against the month before, which must have movements to be compared with."""
    figures = ("net_spending", "income", "net_cash_flow")
    w = Window.partitionBy("currency").orderBy("month")
    is_next = F.lag("month").over(w) == add_months_to_key(F.col("month"), -1)
    before = {f: F.when(is_next, F.lag(f).over(w)) for f in figures}
    out = summary.withColumns({f"_{f}": c for f, c in before.items()} | {"previous_month": F.when(is_next, F.lag("month").over(w))})
    return out.select("currency", "month", "previous_month", F.col("previous_month").isNotNull().alias("comparable"), *(delta(F.col(f"_{f}"), F.col(f)).alias(f) for f in figures))


def category_totals(facts: DataFrame, by: tuple[str, ...] = ("currency",)) -> DataFrame:
    """Gross, refunds, net and share by category. Uncategorised spending is ``sin-categoria``; uncategorised refunds count nowhere;
    shares are of the positive amounts."""
    refund = K.is_refund()
    rows = facts.where(K.is_spending() | refund & F.col("category").isNotNull())
    some = rows.groupBy(*by, F.coalesce("category", F.lit("sin-categoria")).alias("category")).agg(_sum(~refund).alias("gross"), _sum(refund).alias("refunds"), F.count(F.lit(1)).alias("transaction_count"))
    some = some.withColumn("amount", F.col("gross") - F.col("refunds"))
    positive = F.when(F.col("amount") > 0, F.col("amount"))
    whole = F.sum(positive).over(Window.partitionBy(*by)).cast("double")
    return some.withColumn("share", F.coalesce(positive.cast("double") / whole, F.lit(0.0)))


def merchant_totals(facts: DataFrame, limit: int = 10, by: tuple[str, ...] = ("currency",)) -> DataFrame:
    """The ``limit`` merchants with most spending in each group, with their rank."""
    rows = facts.where(K.is_spending() & ~K.has_no_merchant() & (F.col("merchant") != ""))
    some = rows.groupBy(*by, "merchant").agg(F.sum(F.abs("amount")).alias("amount"), F.count(F.lit(1)).alias("transaction_count"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("amount"), "merchant"))
    return some.withColumn("rank", rank).where(F.col("rank") <= limit)


def unattributed(facts: DataFrame) -> DataFrame:
    rows = facts.where(K.is_spending() & ~K.has_no_merchant() & (F.coalesce("merchant", F.lit("")) == ""))
    return rows.groupBy("currency").agg(F.sum(F.abs("amount")).alias("amount"), F.count(F.lit(1)).alias("transaction_count"))


def unattributed_by_processor(facts: DataFrame) -> DataFrame:
    rows = facts.where(K.is_spending() & (F.coalesce("merchant", F.lit("")) == "") & (F.col("processor_visibility") == "hidden"))
    return rows.groupBy("currency", "processor_id").agg(F.max("processor").alias("processor"), F.sum(F.abs("amount")).alias("amount"), F.count(F.lit(1)).alias("transaction_count"))


def ordered_categories(totals: DataFrame) -> DataFrame:
    """Categories, the largest first; equals by name."""
    return totals.orderBy(F.desc("amount"), "category")


def ordered_processors(totals: DataFrame) -> DataFrame:
    """Processors by what they hide, the largest first; equals by name."""
    return totals.orderBy(F.desc("amount"), "processor_id")


def issuer_charges(facts: DataFrame, by: tuple[str, ...] = ("currency",)) -> DataFrame:
    rows = facts.where(K.is_spending() & K.is_issuer_charge())
    return rows.groupBy(*by).agg(F.sum(F.abs("amount")).alias("amount"), F.count(F.lit(1)).alias("transaction_count"))


def cost_breakdown(facts: DataFrame) -> DataFrame:
    """Confirmed financial costs by kind, and a total row (cost_kind null) for each currency, with the parts that are the price
    of borrowing and of having the card, and the cash advances."""
    costs = K.is_spending() & K.is_issuer_charge() & F.col("cost_kind").isNotNull()
    advance = (K.kind() == "cash_advance") & (K.direction() == "out")
    borrowing = F.col("cost_kind").isin(*K.BORROWING)
    rows = facts.where(costs | advance).withColumn("cost", F.when(costs, F.col("cost_kind"))).withColumn("advance", advance)
    cost = F.col("cost").isNotNull()
    some = rows.rollup("currency", F.coalesce("cost", F.lit("-")).alias("cost_kind")).agg(
        _sum(cost).alias("total"),
        _sum(cost & borrowing).alias("borrowing"),
        _sum(cost & ~borrowing).alias("instrument"),
        F.count_if(cost).alias("transaction_count"),
        _sum(F.col("advance")).alias("cash_advances"),
        F.count_if("advance").alias("cash_advance_count"),
        F.grouping_id().alias("level"),
    )
    return some.where((F.col("level") < 2) & (F.col("cost_kind").isNull() | (F.col("cost_kind") != "-"))).drop("level")


def preview_totals(rows: DataFrame) -> DataFrame:
    """Totals of an import preview by currency. Refunds count as income here."""
    chosen = F.col("will_import")
    moved, paid = K.kind() == "internal_transfer", K.kind() == "credit_card_payment"
    income, spending = ~moved & ~paid & K.is_income(), ~moved & ~paid & K.is_spending()
    out = rows.groupBy("currency").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(chosen).alias("to_import"),
        F.count_if(F.col("verdict") == "exact").alias("exact_duplicates"),
        F.count_if(F.col("verdict") == "probable").alias("probable_duplicates"),
        F.count_if(F.col("reason_code") == "host-modified").alias("host_modified_duplicates"),
        F.count_if("ignored").alias("ignored"),
        _sum(chosen & income).alias("income"),
        _sum(chosen & spending).alias("expenses"),
        _sum(chosen & moved & (K.direction() == "out")).alias("internal_transfers"),
        _sum(chosen & paid & (K.direction() == "out")).alias("card_payments"),
        F.count_if(chosen & (K.kind() == "unknown")).alias("unknown_kind"),
        F.count_if(chosen & K.needs_attention()).alias("needs_review"),
    )
    return out.withColumn("net", F.col("income") - F.col("expenses"))
