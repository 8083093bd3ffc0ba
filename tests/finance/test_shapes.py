import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from tallyspark.functions import dates as D
from tallyspark.functions import labels as L
from tallyspark.operators import enrich, rules
from tallyspark.sources import sheets as S


def test_cell_and_column_shapes(spark):
    cells = {"CLP": "currency", "us$": "currency", "12": "short-integer", "2024": "medium-integer", "45321": "long-integer", "$ 1.234": "decimal", "-5,5": "decimal", "05/01/2026": "date", "5 ene 2026": "date", "PAN": "currency", "pan": "text", "#!": "other", "  ": None}
    df = spark.createDataFrame([(k,) for k in cells], "c string")
    assert {r.c: r.s for r in df.select("c", S.cell_shape(F.col("c")).alias("s")).collect()} == cells
    rows = spark.createDataFrame([("f", 0, "1"), ("f", 0, ""), ("f", 0, "22"), ("f", 1, "x y"), ("f", 1, "3"), ("f", 2, " ")], "file string, col int, c string")
    assert {r.col: r.shape for r in S.column_shapes(rows, "file", "col", "c").collect()} == {0: "short-integer", 1: "mixed", 2: "empty"}


def test_rectangular(spark):
    rows = spark.createDataFrame([("f", 0, 0, ["a"]), ("f", 0, 1, ["b", "c", "d"]), ("f", 1, 0, ["e"])], "file_hash string, sheet_index int, row_index int, cells array<string>")
    assert sorted((r.sheet_index, r.row_index, r.cells) for r in S.rectangular(rows).collect()) == [(0, 0, ["a", "", ""]), (0, 1, ["b", "c", "d"]), (1, 0, ["e"])]


def test_small_readings(spark):
    df = spark.createDataFrame([("late_interest", "pac", "due_date", "3 Cuotas", ["a"], ["b", "a"]), ("x", None, "y", "CUOTAPARTE", None, ["c"])], "a string, b string, c string, d string, t array<string>, u array<string>")
    got = df.select(L.label(F.col("a"), L.COSTS), L.label(F.col("b"), L.MANDATES), L.label(F.col("c"), L.CARD_FACTS), enrich.mentions_installments(F.col("d")), rules.new_tags(F.col("t"), F.col("u"))).collect()
    assert [tuple(r) for r in got] == [("Interés por mora", "PAC — pago automático de cuentas", "Fecha de vencimiento", True, ["b"]), (None, None, None, False, ["c"])]
    zone = "Pacific/Kiritimati"
    before = dt.datetime.now(ZoneInfo(zone)).date()
    today = spark.range(1).select(D.civil_today(zone)).first()[0]
    assert before <= today <= dt.datetime.now(ZoneInfo(zone)).date()
