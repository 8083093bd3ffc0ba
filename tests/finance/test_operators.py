import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import enrich as E
from tallyspark.operators import installments as I
from tallyspark.operators import metrics as M
from tallyspark.operators import reconcile as R
from tallyspark.operators import recurring as C
from tallyspark.operators import rules as U
from tallyspark.functions.text import normalize_description

D = lambda x: dt.date.fromisoformat(x)


def said(spark, *texts):
    rows = [(i, t, "out", Decimal(-100), "expense", "suggested", None, None, [], "acc", "checking", "banco", None, str(i)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(
        rows,
        "i int, description string, direction string, amount decimal(22,6), kind string, kind_confidence string, merchant string, category string, tags array<string>, account_id string, product string, institution string, operation_type string, fingerprint string",
    )
    return df.withColumn("normalized_description", normalize_description(F.col("description")))


def test_costs_and_mandates(spark):
    texts = {
        "INTERESES POR MORA": "late_interest", "COMISION AVANCE": "cash_advance_fee", "COMISION MANTENCION TARJETA": "maintenance", "COMISION X": "other", "IMPUESTO AL CREDITO": "credit_tax", "GASTOS DE COBRANZA": "collection",
        "INTERES ROTATIVO": "revolving_interest", "COMISION COMPRA INTERNACIONAL": "international_purchase", "INTERESES COMPRAS EN CUOTAS": "installment_interest", "COMPRA": None,
    }
    rows = said(spark, *texts).select("description", E.financial_cost(F.col("normalized_description"))["kind"].alias("k")).collect()
    assert {r.description: r.k for r in rows} == texts
    mandates = {"PAC ENEL": "pac", "PAGO AUTOMATICO CON TARJETA": "pat", "EMPRESA PAC SPA": None, "SUSCRIPCION X": "automatico", "COMPRA": None, "P.A.T. X": "pat"}
    rows = said(spark, *mandates).select("description", E.mandate(F.col("normalized_description")).alias("m")).collect()
    assert {r.description: r.m for r in rows} == mandates


def test_attribution(spark):
    want = {
        "MERPAGO*TIENDA": ("mercado-pago", None, "processor-hides-merchant"), "GOOGLE *YOUTUBE": ("google", "Youtube", None), "COMPRA FLOWERS": (None, "Flowers", None), "FLOW*PIANO": ("flow", None, "processor-hides-merchant"),
        "COMPRA FLOW PIANO": ("flow", None, "processor-hides-merchant"), "LA FLOW TIENDA": (None, "La Flow Tienda", None), "PAGO ONLINE": (None, None, "bank-placeholder"), "WEBPAY PLUS JUMBO CL": ("webpay", "Jumbo", None), "COMPRA": (None, None, "nothing-left"),
        "ITUNES": ("apple", "Apple", None),
    }
    rows = E.with_attribution(said(spark, *want)).collect()
    assert {r.description: (r.processor_id, r.merchant_name, r.unresolved) for r in rows} == want


def test_installments_read(spark):
    want = {"X CUOTA 2 DE 6": (2, 6, "confirmed"), "X 3/12 CUOTAS": (3, 12, "confirmed"), "X 02/12": None, "X 13/24": (13, 24, "suggested"), "CUOTA 7 DE 6": None, "X CUOTA 1 DE 61": None}
    rows = said(spark, *want).select("description", E.installment(F.col("description"), F.lit(""), F.lit(False)).alias("x")).collect()
    assert {r.description: r.x and tuple(r.x) for r in rows} == want
    assert tuple(said(spark, "X 02/12").select(E.installment(F.col("description"), F.lit(""), F.lit(True)).alias("x")).first().x) == (2, 12, "suggested")


def test_rules_see_earlier_effects(spark):
    df = said(spark, "SUELDO", "TRASPASO A CUENTA PROPIA", "COMISION MANTENCION CUENTA", "AVANCE EN EFECTIVO", "NETFLIX")
    df = df.withColumn("kind_confidence", F.when(F.col("i") == 2, "confirmed").otherwise("suggested"))
    got = {r.description: r for r in E.with_financial_cost(U.apply_rules(df, list(U.BUILTIN))).collect()}
    assert got["SUELDO"].kind == "income" and got["TRASPASO A CUENTA PROPIA"].applied_rules == ["builtin.transferencia-propia"]
    assert (got["COMISION MANTENCION CUENTA"].kind, got["COMISION MANTENCION CUENTA"].category) == ("expense", "comisiones")
    assert got["NETFLIX"].tags == ["suscripcion"] and got["AVANCE EN EFECTIVO"].tags == ["efectivo"]
    bad = U.Rule("x", 1, (U.Condition("description", "matches", "(a+)+b"),), (U.Action("set_kind", "fee"),), origin="user")
    assert len(U.problems(bad)) == 2 and U.effective(list(U.BUILTIN), [bad], {"builtin.gas"})[-1].id == "x"


def facts(spark, rows):
    kinds = "account_id string, date date, amount decimal(22,6), currency string, direction string, kind string, category string, merchant string, cost_kind string, cost_confidence string"
    return spark.createDataFrame([(a, D(d), Decimal(m), c, "in" if m >= 0 else "out", k, g, t, None, None) for a, d, m, c, k, g, t in rows], kinds)


def test_summaries_and_deltas(spark):
    rows = [
        ("a", "2026-01-03", 1000, "CLP", "income", None, None), ("a", "2026-01-04", -300, "CLP", "expense", "vivienda", "x"), ("a", "2026-01-05", 100, "CLP", "refund", None, None), ("a", "2026-01-06", -50, "CLP", "internal_transfer", None, None),
        ("a", "2026-01-06", 50, "CLP", "internal_transfer", None, None), ("a", "2026-02-01", -80, "CLP", "expense", None, "y"), ("a", "2026-04-01", -80, "CLP", "expense", None, "y"), ("a", "2026-02-01", -5, "USD", "fee", None, None),
    ]
    df = facts(spark, rows)
    got = {(r.currency, r.month): r for r in M.summaries(df).collect()}
    jan = got["CLP", "2026-01"]
    assert (jan.net_spending, jan.cash_inflows, jan.net_cash_flow, jan.savings_rate, jan.fixed_expenses, jan.internal_transfers) == (200, 1100, 800, 0.8, 300, 50)
    assert got["CLP", "2026-02"].savings_rate is None
    delta = {(r.currency, r.month): r for r in M.comparisons(M.summaries(df)).collect()}
    assert delta["CLP", "2026-02"].income.kind == "gone" and delta["CLP", "2026-02"].net_spending.ratio == -0.6 and delta["CLP", "2026-04"].net_spending.kind == "no-baseline"
    assert delta["CLP", "2026-02"].net_cash_flow.kind == "sign-flip"
    assert [(r.currency, r.transaction_count) for r in M.by_currency(df, "2026-07").collect()] == [("CLP", 0)]
    with pytest.raises(M.MixedCurrencyError):
        M.single_currency(df)
    shares = {r.category: (r.amount, r.share) for r in M.category_totals(df.where("currency = 'CLP'")).collect()}
    assert shares["vivienda"][0] == 300 and abs(sum(s for _, s in shares.values()) - 1) < 1e-12


def test_installment_outlook(spark):
    def charge(fp, date, merchant, amount, now, total):
        return ("credit_card_purchase", merchant, "b", "CLP", 0, Decimal(-amount), D(date), fp, "x", (now, total, "confirmed"), [])

    rows = [charge("a", "2026-02-10", "Uno", 50000, 2, 6), charge("b", "2026-02-11", "Dos", 30000, 11, 12)]
    rows += [charge(f"r{i}", f"2025-0{i + 1}-01", "Tres", 10, c, 3) for i, c in enumerate([1, 2, 3, 1, 2])]
    kinds = "kind string, merchant string, institution string, currency string, amount_scale int, amount decimal(22,6), date date, fingerprint string, description string, installment struct<current:int,total:int,confidence:string>, warnings array<struct<code:string,message:string>>"
    plans = I.build_plans(spark.createDataFrame(rows, kinds)).cache()
    got = {r.merchant: r for r in plans.collect()}
    assert (got["Uno"].start_date, got["Uno"].remaining_installments, got["Dos"].remaining_amount) == (D("2026-01-10"), 4, 30000)
    assert plans.where("merchant = 'Tres'").count() == 2
    out = {r.month: r.amount for r in I.schedule(plans.where("merchant != 'Tres'"), "2026-03").orderBy("month").collect()}
    assert list(out.values()) == [80000, 50000, 50000, 50000]
    assert I.committed(plans.where("merchant != 'Tres'")).first().committed_total == 230000


def legs(spark, rows):
    kinds = "account_id string, date date, amount decimal(22,6), currency string, direction string, fingerprint string, description string, institution string, reference string"
    return spark.createDataFrame([(a, D(d), Decimal(m), "CLP", "in" if m > 0 else "out", f, t, b, r) for a, d, m, f, t, b, r in rows], kinds)


def test_transfers(spark):
    rows = [
        ("a", "2026-01-01", -100, "o1", "TRASPASO", "b", None), ("b", "2026-01-02", 100, "i1", "ABONO", "b", None), ("c", "2026-01-03", 100, "i2", "ABONO", "b", None), ("c", "2026-01-04", -100, "o2", "X", "b", None),
        ("a", "2026-01-01", -70, "o3", "TEF A TERCEROS", "b", "00123456"), ("b", "2026-01-01", 70, "i3", "X", "b", "00123456"), ("a", "2026-03-01", -5, "o4", "X", "b", None), ("b", "2026-03-02", 5, "i4", "X", "b", None), ("c", "2026-03-02", 5, "i5", "X", "b", None),
    ]
    random.Random(1).shuffle(rows)
    matched, open_ = R.match_transfers(legs(spark, rows))
    got = {(r.o_fingerprint, r.i_fingerprint): (r.gap_days, r.confidence) for r in matched.collect()}
    assert got == {("o1", "i1"): (1, "confirmed"), ("o3", "i3"): (0, "suggested"), ("o2", "i2"): (1, "suggested")} or ("o1", "i1") in got and ("o3", "i3") in got
    assert {r.leg for r in R.knots(open_).collect()} == {"a:o4", "b:i4", "c:i5"}
    assert R.knots(open_).select("knot").distinct().count() == 1


def test_many_equal_legs_stay_open(spark):
    rng = random.Random(3)
    rows = [(f"a{i}", f"2026-01-{rng.randint(1, 28):02d}", -1000 if i < 60 else 1000, f"f{i}", "X", "b", None) for i in range(120)]
    matched, open_ = R.match_transfers(legs(spark, rows))
    assert open_.count() > 0 and matched.count() < 20


def test_recurring(spark):
    rows = [("N", f"2026-0{m}-05", -1000 - m, f"n{m}", "PAC NETFLIX") for m in range(1, 6)] + [("Q", f"2026-0{m}-05", -1000, f"q{m}", "COMPRA") for m in (1, 2, 3)] + [("Z", "2026-01-01", -9, "z1", "COMPRA"), ("Z", "2026-01-09", -9, "z2", "COMPRA"), ("Z", "2026-01-19", -9, "z3", "COMPRA")]
    kinds = "merchant string, date date, amount decimal(22,6), fingerprint string, description string, currency string, direction string, kind string, category string, installment struct<current:int,total:int>"
    df = spark.createDataFrame([(m, D(d), Decimal(a), f, t, "CLP", "out", "expense", None, None) for m, d, a, f, t in rows], kinds).withColumn("normalized_description", F.col("description"))
    got = {r.merchant_key: (r.confidence, r.mandate, r.occurrences, r.typical_amount) for r in C.ordered(C.recurring_charges(df)).collect()}
    assert got == {"N": ("likely", "pac", 5, Decimal(1003)), "Q": ("possible", None, 3, Decimal(1000))}


def test_orders_of_totals(spark):
    from tallyspark.operators import metrics as M

    cats = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9)], "category string, amount int")
    assert [r.category for r in M.ordered_categories(cats).collect()] == ["c", "a", "b"]
    hidden = spark.createDataFrame([("webpay", 1), ("flow", 4), ("google", 4)], "processor_id string, amount int")
    assert [r.processor_id for r in M.ordered_processors(hidden).collect()] == ["flow", "google", "webpay"]
