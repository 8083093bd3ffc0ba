"""Costly work on rows is dealt to all cores, done once, and does without what Spark interprets slowly."""

from pyspark.sql import functions as F

from tallyspark.functions import text as T
from tallyspark.plans import registry
from tallyspark.sources import statements
from tallyspark.sources.card_facts import card_facts


def test_files_of_card_facts_are_dealt_and_each_amount_is_read_once(spark):
    files = spark.createDataFrame([("f", "PAGO MINIMO $ 1.000", "CLP")], "file_hash string, preamble string, currency string")
    plan = card_facts(files)._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {3 * spark.sparkContext.defaultParallelism}, true" in plan
    assert not any("try_cast" in line or "[.,]*$" in line for line in plan.splitlines() if "Filter" in line.split("(")[0])


def test_folding_without_upper_and_lower_is_the_same_for_every_letter(spark):
    rows = spark.createDataFrame([(chr(i),) for i in range(0x3000)], "c string")
    rows = rows.select(F.explode(F.array("c", F.concat(F.lit("aÉ"), "c", F.lit("ñz\n")))).alias("c"))
    odd = rows.where((T.fold_case(F.col("c")) != F.upper(F.translate("c", T.ACCENTED, T.PLAIN))) | (T.lower(F.col("c")) != F.lower("c")))
    assert [r.c for r in odd.collect()] == []


def test_common_texts_are_folded_without_upper(spark):
    assert spark.createDataFrame([("Descripción N° $ €",)], "c string").where(F.col("c").rlike(T._FOLDABLE)).count() == 1


def test_parser_ranking_makes_sheets_once_and_knows_its_headers_beforehand(spark, monkeypatch):
    class Seen(Exception):
        pass

    def layouts(rows):
        raise Seen(rows._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(statements, "layouts", layouts)
    try:
        registry.parser_ranking(spark, "/root/testdata/sf0.001")
    except Seen as e:
        assert "Window" not in str(e) and "Relation" in str(e)
    assert statements._plain_header("Nº Operación") == "N OPERACION"


def test_ledger_readings_deal_the_orders(spark):
    plan = registry.ledger_readings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {3 * spark.sparkContext.defaultParallelism}, true" in plan
