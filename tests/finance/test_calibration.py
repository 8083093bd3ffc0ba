from pyspark.sql import functions as F

from tallyspark.operators import calibration as C


def rows(spark, some):
    df = spark.createDataFrame(some, "file string, line int, date string, amount string, balance string")
    return df.select("file", "line", F.to_date("date").alias("date"), F.col("amount").cast("decimal(22,6)").alias("amount"), F.col("balance").cast("decimal(22,6)").alias("balance_after"), F.lit("p").alias("parser"), F.lit("expense").alias("kind"), F.lit("suggested").alias("kind_confidence"))


def test_ways_in_which_balances_fail(spark):
    some = [("a", 1, "2024-01-01", "10", "100"), ("a", 2, "2024-01-02", "-5", None), ("a", 3, "2024-01-02", "7.5", "102.5"), ("a", 4, "2024-01-03", "20", "82.5"), ("a", 5, "2024-01-03", "1", "182.5"), ("a", 6, "2024-01-04", "3000", "185.5"), ("a", 7, "2024-01-05", "4", "200"), ("a", 8, "2024-01-06", "0", "300")]
    got = {r.line: r.mismatch for r in C.steps(rows(spark, some), "file", "line").collect()}
    assert got == {3: None, 4: "sign", 5: "scale-100", 6: "scale-1000", 7: "other", 8: "other"}


def test_orders_and_counts(spark):
    some = [("a", 1, "2024-01-01", "10", None), ("a", 2, "2024-01-02", "-5.25", None), ("b", 1, "2024-01-02", "1", None), ("b", 2, "2024-01-01", None, None), ("c", 1, "2024-01-01", "0", None), ("d", 1, "2024-01-01", "0", None), ("d", 2, "2024-01-05", "0", None), ("d", 3, "2024-01-03", "0.5", None)]
    got = {(r.measure, r.value): r.n for r in C.profile(rows(spark, some)).collect()}
    assert {v: n for (m, v), n in got.items() if m == "order"} == {"ascending": 1, "descending": 1, "single-day": 1, "mixed": 1}
    assert {v: n for (m, v), n in got.items() if m == "scale"} == {"0": 5, "1": 1, "2": 1, None: 1}
    assert {v: n for (m, v), n in got.items() if m == "flow"} == {"in": 3, "out": 1, "zero": 3, None: 1}
    assert got["kind", "expense"] == got["confidence", "suggested"] == 8 and not [m for m, _ in got if m == "mismatch"]
    assert C.profile(rows(spark, some).limit(0)).count() == 0
