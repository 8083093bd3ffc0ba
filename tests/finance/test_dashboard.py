import datetime as dt

from pyspark.sql import functions as F

from tallyspark.operators import dashboard as D


def test_every_month_is_a_row(spark):
    rows = [("CLP", "2024-01-10", -100.0, "expense", "out", "comida", "Uno"), ("CLP", "2024-01-11", -100.0, "expense", "out", "bebida", "Dos"), ("CLP", "2024-03-01", 50.0, "income", "in", None, None), ("USD", "2024-02-01", -7.0, "expense", "out", None, None), ("EUR", "2020-01-01", -1.0, "expense", "out", None, None)]
    df = spark.createDataFrame(rows, "currency string, date string, amount double, kind string, direction string, category string, merchant string")
    df = df.withColumns({"date": F.to_date("date"), "amount": F.col("amount").cast("decimal(22,6)"), "kind_confidence": F.lit("confirmed"), "cost_kind": F.lit(None).cast("string"), "cost_confidence": F.lit(None).cast("string"), "warnings": F.array().cast("array<struct<code:string,message:string>>")})
    got = {(r.currency, r.month): r for r in D.history(df, "2024-03", 3).collect()}
    assert sorted(got) == [(c, m) for c in ("CLP", "USD") for m in ("2024-01", "2024-02", "2024-03")]
    jan, feb, mar = (got["CLP", m] for m in ("2024-01", "2024-02", "2024-03"))
    assert (jan.net_spending, jan.top_category, jan.categories, jan.top_merchant, jan.net_spending_change) == (200, "bebida", 2, "Dos", None)
    assert (feb.transaction_count, feb.net_spending, feb.top_category, feb.savings_rate, feb.net_spending_change) == (0, 0, None, None, -200)
    assert (mar.income, mar.savings_rate) == (50, 1.0)
    assert D.history(df.limit(0), "2024-03").count() == 0


def test_charges_that_stopped_are_left_out(spark):
    charges = spark.createDataFrame([("a", dt.date(2024, 1, 31)), ("b", dt.date(2024, 2, 1)), ("c", dt.date(2024, 3, 9))], "merchant string, last_date date")
    assert sorted(r.merchant for r in D.live_charges(charges, "2024-03").collect()) == ["b", "c"]
