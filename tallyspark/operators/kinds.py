"""Kinds of movements and the predicates over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
KINDS = ("income", "expense", "internal_transfer", "credit_card_payment", "credit_card_purchase", "cash_advance", "refund", "fee", "interest", "tax", "investment", "unknown")
SPENDING = ("expense", "credit_card_purchase", "fee", "tax", "interest")
INCOME = ("income", "refund")
NON_SPENDING = ("internal_transfer", "credit_card_payment", "cash_advance", "investment", "unknown")
BORROWING = ("revolving_interest", "late_interest", "installment_interest", "cash_advance_interest", "cash_advance_fee", "collection", "credit_tax")
COST_KINDS = (*BORROWING, "maintenance", "international_purchase", "other")



def kind() -> Column:
    return F.col("kind")


def direction() -> Column:
    return F.col("direction")


def is_spending() -> Column:
    return (direction() == "out") & kind().isin(*SPENDING)


def is_income() -> Column:
    return (direction() == "in") & kind().isin(*INCOME, "interest")


def is_refund() -> Column:
    return (direction() == "in") & (kind() == "refund")


def is_consumption() -> Column:
    """Buying things, not paying for money."""
    return (direction() == "out") & kind().isin("expense", "credit_card_purchase") & F.col("cost_kind").isNull()


def is_issuer_charge() -> Column:
    return F.coalesce(F.col("cost_confidence") == "confirmed", F.lit(False))


def has_no_merchant() -> Column:
    return (kind() == "cash_advance") | is_issuer_charge()


def needs_attention() -> Column:
    unsettled = kind().isin("internal_transfer", "credit_card_payment") & (F.col("kind_confidence") != "confirmed")
    return (F.size("warnings") > 0) | (kind() == "unknown") | unsettled


def cost_transaction_kind(cost: Column) -> Column:
    return F.when(cost.isin("revolving_interest", "late_interest", "installment_interest", "cash_advance_interest"), "interest").when(cost == "credit_tax", "tax").otherwise("fee")
