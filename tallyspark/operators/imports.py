"""What of a preview is imported, what keeps it back, and what became of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import stored

#: A row that may have been written by an older parser with another amount; nobody can select it by hand.
CONFLICT = "legacy-source-conflict"
# Types of activities, the way their money goes, and those that a card's account takes.
FLOWS = {"DEPOSIT": "in", "WITHDRAWAL": "out", "TRANSFER_IN": "in", "TRANSFER_OUT": "out", "CREDIT": "in", "FEE": "out", "TAX": "out", "INTEREST": "in"}
ON_CARDS = ("WITHDRAWAL", "TRANSFER_IN", "CREDIT", "FEE", "INTEREST")


def crosses_gate() -> Column:
    """Whether a row is written: selected, and no conflict with an older parser's reading of the same file."""
    return F.col("will_import") & ~F.coalesce(F.col("reason_code") == CONFLICT, F.lit(False))


def selected(preview: DataFrame, choices: DataFrame, key: str = "row_id") -> DataFrame:
    """The preview with will_import as chosen by hand, where choices (key, will_import) name the row; conflicts stay out."""
    wanted = choices.groupBy(F.col(key).alias("__key")).agg(F.bool_and("will_import").alias("__wanted"))
    joined = preview.join(wanted, F.col(key) == F.col("__key"), "left")
    refused = F.col("__wanted") & F.coalesce(F.col("reason_code") == CONFLICT, F.lit(False))
    return joined.withColumn("will_import", F.when(refused, F.col("will_import")).otherwise(F.coalesce("__wanted", "will_import"))).drop("__key", "__wanted")


def bucket() -> Column:
    """The one reason that counts for each row: selected, exact, probable, rule or user."""
    return F.when(crosses_gate(), "selected").when(F.col("verdict") == "exact", "exact").when(F.col("verdict") == "probable", "probable").when(F.col("ignored"), "rule").otherwise("user")


def breakdown(preview: DataFrame, created: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of rows by what became of them. created (by..., created): rows that the ledger took; no more than were selected."""
    sums = preview.withColumn("__bucket", bucket()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("detected"),
        *(F.count_if(F.col("__bucket") == b).alias(name) for b, name in (("selected", "selected"), ("exact", "skipped_exact"), ("probable", "skipped_probable"), ("rule", "skipped_by_rule"), ("user", "skipped_by_user"))),
    )
    took = F.lit(0).cast("bigint")
    if created is not None:
        sums = sums.join(created, list(by), "left") if by else sums.join(created.limit(1), F.lit(True), "left")
        took = F.greatest(F.lit(0), F.least(F.coalesce("created", F.lit(0)), "selected")).cast("bigint")
    return sums.withColumn("created", took).withColumn("failed", F.col("selected") - F.col("created"))


def blockers(statements: DataFrame) -> DataFrame:
    """Adds blockers and can_import to statements with ok, account_verdict and duplicates_checked: what keeps each from being imported."""
    found = F.array_compact(F.array(
        F.when(F.col("account_verdict") == "blocked", "account-mismatch"), F.when(~F.col("ok"), "statement-invalid"), F.when(~F.col("duplicates_checked"), "duplicate-check-unavailable")
    ))
    return statements.withColumn("blockers", found).withColumn("can_import", F.size("blockers") == 0)


def batches(rows: DataFrame, key: str, size: int = 100) -> DataFrame:
    """Adds batch: rows in the order of their key in batches of about ``size``, dealt by ranges of the key, so that no task sees all."""
    parts = rows.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    number = F.monotonically_increasing_id()
    return parts.withColumn("__n", number).withColumn("batch", F.concat_ws("-", F.shiftright("__n", 33), F.floor(F.col("__n").bitwiseAND((1 << 33) - 1) / size))).drop("__n")


def in_order(rows: DataFrame, key: str, size: int = 100) -> DataFrame:
    """Stored rows with ``batch``: numbers from 0, ``size`` rows a batch in the order of the key (null first).

    Rows are dealt by ranges of the key and sorted within; a row's number is its place plus the counts of the ranges before, of which
    there are as many as tasks."""
    sorted_ = rows.repartitionByRange(F.col(key), F.xxhash64(F.monotonically_increasing_id())).sortWithinPartitions(key)
    placed = stored(sorted_.withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id()}), "in-order")
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("own"), F.min("__place").alias("first"))
    before = F.coalesce(F.sum("own").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__part", "first", before.alias("before"))
    place = F.col("__place") - F.col("first") + F.col("before")
    return placed.join(F.broadcast(counts), "__part").withColumn("batch", F.floor(place / size)).drop("__part", "__place", "first", "before")


def natural_type(kind: Column, direction: Column) -> Column:
    """The ledger's type of a kind of movement, whatever the account takes."""
    out = direction == "out"
    return (
        F.when(kind == "income", "DEPOSIT")
        .when(kind.isin("expense", "credit_card_purchase", "cash_advance"), "WITHDRAWAL")
        .when(kind.isin("internal_transfer", "investment", "credit_card_payment"), F.when(out, "TRANSFER_OUT").otherwise("TRANSFER_IN"))
        .when(kind == "refund", "CREDIT")
        .when(kind == "fee", "FEE")
        .when(kind == "tax", "TAX")
        .when(kind == "interest", F.when(out, "FEE").otherwise("INTEREST"))
        .otherwise("UNKNOWN")
    )


def flow(activity_type: Column) -> Column:
    """in or out, as the ledger's type says; null where it says nothing."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in FLOWS.items() for x in kv)), activity_type)


def kind_of_type(activity_type: Column, subtype: Column, account_type: Column) -> Column:
    """The kind that the ledger's type alone tells: a credit is a refund on a card, elsewhere what its subtype says."""
    t, sub = activity_type, F.upper(subtype)
    credit = F.when(account_type == "CREDIT_CARD", "refund").when(sub == "BONUS", "income").when(sub.isin("REFUND", "REBATE", "REIMBURSEMENT"), "refund").otherwise("unknown")
    return (
        F.when(t == "DEPOSIT", "income").when(t == "WITHDRAWAL", "expense").when(t.isin("TRANSFER_IN", "TRANSFER_OUT"), "internal_transfer").when(t == "CREDIT", credit)
        .when(t == "FEE", F.when(subtype == "INTEREST_CHARGE", "interest").otherwise("fee")).when(t == "TAX", "tax").when(t == "INTEREST", "interest").otherwise("unknown")
    )


def resolved_type(kind: Column, direction: Column, account_type: Column | None = None) -> Column:
    """struct(type, substituted): the ledger's type of a movement; another where its own goes the other way or the account refuses it."""
    out = direction == "out"
    natural = natural_type(kind, direction)
    nearest = F.when(out, "WITHDRAWAL").otherwise("CREDIT")
    wrong_way = F.coalesce(flow(natural) != direction, F.lit(False))
    card = F.coalesce(account_type == "CREDIT_CARD", F.lit(False)) if account_type is not None else F.lit(False)
    refused = card & (~natural.isin(*ON_CARDS) | (natural == "INTEREST") & ~out)
    chosen = F.when(wrong_way, nearest).when(refused & (natural == "INTEREST"), "CREDIT").when(refused & (natural == "TAX"), "FEE").when(refused, nearest).otherwise(natural)
    return F.struct(chosen.alias("type"), (wrong_way | refused).alias("substituted"))


def review_reason() -> Column:
    """Why an activity that needs review does: unresolved, substituted-type, or null."""
    return F.when(~F.coalesce("needs_review", F.lit(False)), None).when(F.col("kind") == "unknown", "unresolved").when(F.coalesce("substituted", F.lit(False)), "substituted-type")


def review_counts(activities: DataFrame) -> DataFrame:
    why = review_reason()
    return activities.agg(F.count_if(why == "unresolved").alias("unresolved"), F.count_if(why == "substituted-type").alias("substituted"), F.count_if(F.col("status") == "DRAFT").alias("drafts"))
