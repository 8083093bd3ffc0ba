from pyspark.sql import functions as F

from tallyspark.operators import imports as I
from tallyspark.operators import insights, reconcile


def test_selection_and_breakdown(spark):
    rows = [(1, "none", None, False, True), (2, "probable", I.CONFLICT, False, False), (3, "exact", None, False, False), (4, "none", None, True, False), (5, "none", None, False, False), (6, "probable", "similar", False, False)]
    preview = spark.createDataFrame(rows, "row_id long, verdict string, reason_code string, ignored boolean, will_import boolean")
    chosen = I.selected(preview, spark.createDataFrame([(2, True), (6, True), (1, True), (1, False), (99, True)], "row_id long, will_import boolean"))
    assert {r.row_id: r.will_import for r in chosen.collect()} == {1: False, 2: False, 3: False, 4: False, 5: False, 6: True}
    b = I.breakdown(chosen, spark.createDataFrame([(7,)], "created long")).first()
    assert (b.detected, b.selected, b.created, b.failed, b.skipped_exact, b.skipped_probable, b.skipped_by_rule, b.skipped_by_user) == (6, 1, 1, 0, 1, 1, 1, 2)
    assert I.breakdown(preview.limit(0)).first().detected == 0


def test_blockers_and_reviews(spark):
    rows = [("a", True, "confirmed", True), ("b", False, "blocked", False), ("c", True, None, False)]
    got = {r.id: list(r.blockers) for r in I.blockers(spark.createDataFrame(rows, "id string, ok boolean, account_verdict string, duplicates_checked boolean")).collect()}
    assert got == {"a": [], "b": ["account-mismatch", "statement-invalid", "duplicate-check-unavailable"], "c": ["duplicate-check-unavailable"]}
    acts = spark.createDataFrame([(True, "unknown", None, "DRAFT"), (True, "fee", True, "POSTED"), (True, "fee", None, "POSTED"), (None, "unknown", True, "DRAFT")], "needs_review boolean, kind string, substituted boolean, status string")
    assert tuple(I.review_counts(acts).first()) == (1, 1, 2)


def test_batches(spark):
    got = I.batches(spark.range(1000).withColumn("key", F.col("id").cast("string")), "key", 30).groupBy("batch").count().collect()
    assert sum(r["count"] for r in got) == 1000 and max(r["count"] for r in got) <= 30


def test_reconcile_in_a_window(spark):
    rows = [("a", "1", "2024-01-05", "-100", "out", "TRASPASO ENTRE CUENTAS", False), ("b", "2", "2024-01-06", "100", "in", "TRASPASO ENTRE CUENTAS", False), ("a", "3", "2023-12-31", "-70", "out", "TEF", False), ("b", "4", "2024-01-01", "70", "in", "TEF", False),
            ("a", "5", "2024-01-10", "-50", "out", "PAGO TARJETA", False), ("k", "6", "2024-01-11", "50", "in", "PAGO RECIBIDO", True)]
    df = spark.createDataFrame(rows, "account_id string, fingerprint string, date string, amount string, direction string, description string, is_card boolean")
    df = df.withColumns({"date": F.to_date("date"), "amount": F.col("amount").cast("decimal(22,6)"), "currency": F.lit("CLP"), "institution": F.lit("x"), "reference": F.lit(None).cast("string")})
    got = reconcile.reconcile(df, "2024-01-01", "2024-01-31")
    assert [(r.o_leg, r.i_leg) for r in got["confirmed"].collect()] == [("a:1", "b:2")] and sorted(r.leg for r in got["matched_legs"].collect()) == ["a:1", "a:5", "b:2", "k:6"]
    assert got["ambiguous"].count() == 0 and reconcile.with_account_type(df, spark.createDataFrame([("k", "CREDIT_CARD")], "id string, account_type string")).where("account_type is not null").count() == 1


def test_long_chains_settle(spark):
    """Legs wait for each other, a day further apart each: a round settles one pair of a chain."""
    rows, at = [], 0
    for i in range(8):
        rows += [(f"i{i}", 1, at + max(0, 2 * i - 1)), (f"o{i}", 0, at + max(0, 2 * i - 1) + 2 * i)]
        at = rows[-1][2]
    sided = spark.createDataFrame(rows, "leg string, side int, day int").selectExpr("leg", "side", "'CLP' currency", "'1' amount_key", "date_add(date '2024-01-01', day) date", "leg owner", "0 wording", "'' reference_key")
    settled, left, open_ = reconcile.settle(sided, 20)
    assert sorted((r.o_leg, r.i_leg) for r in settled.collect()) == [(f"o{i}", f"i{i}") for i in range(8)] and left.count() == open_.count() == 0


def test_uncertain_plans_and_monthly_sums(spark):
    plans = spark.createDataFrame([("CLP", 2, "suggested", False), ("CLP", 1, "confirmed", True), ("CLP", 3, "confirmed", False), ("CLP", 0, "suggested", True)], "currency string, remaining_installments int, confidence string, has_gaps boolean")
    due = spark.createDataFrame([("CLP", "2024-01", 10.0), ("CLP", "2024-03", 5.0), ("CLP", "2024-04", 1.0)], "currency string, month string, amount double")
    charges = spark.createDataFrame([("CLP", "likely", "pac", 30.0), ("CLP", "possible", None, 9.0)], "currency string, confidence string, mandate string, typical_amount double")
    got = [(r.id, r.value) for r in insights.ordered(insights.recurring(charges, "2024-01"), insights.installments(due, "2024-01", plans)).collect()]
    assert got == [("installments-next-three", 15.0), ("installments-this-month", 10.0), ("installments-uncertain", 2.0), ("recurring-count", 1.0), ("recurring-monthly", 30.0), ("recurring-mandates", 1.0)]
