"""What is costly is read once: no list that nobody asked for, no text read again for each use."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyspark.functions import text as T
from tallyspark.operators import dedupe, installments
from tallyspark.plans import registry
from tallyspark.sources import sheets, statements

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keys_of_similar_movements_are_read_before_they_are_compared(spark):
    rows, old = registry._new_and_old(spark, SF)
    compared = [line for line in _plan(dedupe.classify(rows, old)).splitlines() if "levenshtein" in line]
    assert compared and not any("regexp_replace" in line for line in compared)


def test_plans_make_lists_only_where_they_are_asked_for(spark):
    plans = installments.build_plans(registry._card_charges(spark, SF))
    assert "collect_" in _plan(plans)
    assert "collect_" not in _plan(plans.drop("source_fingerprints", "observed_installments"))


def test_gaps_of_plans_follow_from_counts(spark):
    schema = "fingerprint string, date date, current int"
    days = [("a", 1, 1), ("b", 2, 3), ("c", 3, 1), ("d", 4, 2), ("e", 5, None), ("f", 6, None)]
    rows = spark.createDataFrame([(f, dt.date(2024, m, 1), c) for f, m, c in days], schema).select(
        "fingerprint", "date", F.lit("credit_card_purchase").alias("kind"), F.lit("M").alias("merchant"), F.lit("b").alias("institution"), F.lit("CLP").alias("currency"), F.lit(2).alias("amount_scale"),
        F.lit(-10).cast("decimal(22,6)").alias("amount"), F.lit("x").alias("description"), F.struct("current", F.lit(9).alias("total"), F.lit("confirmed").alias("confidence")).alias("installment"),
        F.array().cast("array<struct<code:string,message:string>>").alias("warnings"),
    )
    got = {r["start"]: (r["observed_installments"], r["has_gaps"], r["source_fingerprints"]) for r in installments.build_plans(rows).withColumn("start", F.col("source_fingerprints")[0]).collect()}
    assert got == {"a": ([1, 3], True, ["a", "b"]), "c": ([1, 2], False, ["c", "d", "e"]), "f": ([], None, ["f"])}


def test_texts_of_monthly_charges_are_read_by_month_not_by_line(spark):
    assert not any("lineitem" in f for f in registry.monthly_charges(spark, SF).inputFiles())


def test_rows_without_a_date_name_are_passed_over_before_cells_are_folded(spark):
    rows = spark.createDataFrame([("f", 0, 0, ["Féchà", "Glosa", "Monto $"]), ("f", 0, 1, ["FECHA", None, "x"]), ("g", 0, 4, ["ﬀecha ﬅ", "DETALLE", "Cargo"])], "file_hash string, sheet_index int, row_index int, cells array<string>")
    found = sheets.header_rows(rows)
    assert {(r["file_hash"], r["row_index"], tuple(r["header"])) for r in found.collect()} == {("f", 0, ("FECHA", "GLOSA", "MONTO $")), ("g", 4, ("FFECHA ST", "DETALLE", "CARGO"))}
    filters = [line for line in _plan(found).splitlines() if "Filter" in line and "transform" in line]
    assert len(filters) == 1 and filters[0].count("transform(") == 1  # named more often, Spark makes it for every row


def test_what_may_be_folded_to_a_word_is_never_passed_over(spark):
    texts = ["fecha", "FÉCHA", "  Fëcħa", "fêçhÅ", "f e c h a", "ﬀechẚ", "Posted date", "dátë", "data", "€ 5", "", None, "ＦＥＣＨＡ", "fecha\u0301", "DAꜲTE"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", T.may_hold(F.col("t"), ["DATE", "FECHA", "POSTED"]).alias("may"), T.fold_case(F.col("t")).rlike("DATE|FECHA|POSTED").alias("does")).collect()
    assert all(r["may"] for r in got if r["does"]) and any(r["does"] for r in got)
    assert [r["t"] for r in got if r["may"] is False] == ["f e c h a", "data", "€ 5", ""]


def test_patterns_of_parsers_are_sought_once(spark):
    schema = "file_hash string, path string, header_row int, roles map<string,int>, preamble string, vocabulary string, layouts array<array<string>>"
    files = spark.createDataFrame([("f", "/a/cartola.csv", 2, {"date": 0}, "CUENTA N: 00-123456", "BANCO DE CHILE", [["FECHA"]])], schema)
    plan = _plan(statements.detection(files))
    assert plan.count("BANCO\\s+FALABELLA|(?i)\\bFALABELLA") == 1
    first = statements.detection(files).orderBy("rank").first()
    assert (first["parser"], first["points"], first["reasons"]) == ("banco-chile.cuenta-corriente", 95, ["marker", "file-name", "header", "account"])
