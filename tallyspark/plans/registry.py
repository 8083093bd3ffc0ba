"""All queries of the finance library, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import dates as D
from tallyspark.functions import privacy as P
from tallyspark.functions import text as T
from tallyspark.functions.money import amount, with_amount
from tallyspark.operators import balances, calibration, dedupe, enrich, imports, insights, installments, metrics, reconcile, recurring, rules
from tallyspark.operators import dashboard as dashboards
from tallyspark.operators.categories import labelled
from tallyspark.plans import facts
from tallyspark.plans import more_oracles
from tallyspark.plans.oracles import ORACLES
from tallyspark.session import shared_path, spread, stored
from tallyspark.sources import card_facts as labelled_facts
from tallyspark.sources import ledger, sections, sheets, statements
from tallyspark.sources.profiles import PROFILES



def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and counts as longs, the way results are compared."""
    kinds = {n: t for n, t in df.dtypes}
    return df.select(*(F.col(n).cast("double").alias(n) if t.startswith("decimal") else F.col(n).cast("bigint").alias(n) if t == "int" else F.col(n) for n, t in kinds.items()))


def monthly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(metrics.summaries(facts.movements(spark, sf_dir)))


def month_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.comparisons(metrics.summaries(facts.movements(spark, sf_dir)))
    parts = [F.col(f"{f}.{p}").alias(f"{f}_{p}") for f in ("net_spending", "income", "net_cash_flow") for p in ("kind", "absolute", "ratio")]
    return _plain(rows.select("currency", "month", "previous_month", "comparable", *parts))


def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(metrics.category_totals(facts.movements(spark, sf_dir)))
    return _plain(rows.select("currency", "category", "label", "category_group", "gross", "refunds", "amount", "transaction_count", "share"))


def merchant_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(metrics.merchant_totals(facts.movements(spark, sf_dir)))


def unattributed_spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(metrics.unattributed(facts.movements(spark, sf_dir)))


def issuer_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(metrics.issuer_charges(facts.movements(spark, sf_dir)))


def cost_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(metrics.cost_breakdown(facts.movements(spark, sf_dir)))


def _recurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = {
        "description": F.lit("PAC"), "normalized_description": F.when(F.col("account_id") % 2 == 0, "PAC CUENTA").otherwise("COMPRA"), "installment": F.lit(None).cast("struct<current:int,total:int,confidence:string>"),
        "fingerprint": F.col("row_id").cast("string"), "merchant": F.concat(F.lit("Cliente "), "account_id"),
    }
    rows = facts.orders(spark, sf_dir).withColumns(more)
    return recurring.recurring_charges(rows, likely=(1, 900), possible=(1, 1500), likely_spread=6000, possible_spread=15000)


def recurring_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_recurring(spark, sf_dir).drop("category", "merchant"))


def _card_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = facts.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity")
    return line.select(
        F.lit("credit_card_purchase").alias("kind"), F.concat(F.lit("S"), "l_suppkey").alias("merchant"), F.lit("banco-chile").alias("institution"), F.lit("CLP").alias("currency"), F.lit(2).alias("amount_scale"),
        amount(-F.floor(F.col("l_quantity") / 25 + 1).cast("decimal(22,2)") * 1000).alias("amount"), F.col("l_shipdate").cast("date").alias("date"), F.format_string("%012d-%d", "l_orderkey", "l_linenumber").alias("fingerprint"),
        F.lit("x").alias("description"), F.struct(F.col("l_linenumber").alias("current"), F.lit(9).alias("total"), F.when(F.col("l_linenumber") > 2, "confirmed").otherwise("suggested").alias("confidence")).alias("installment"),
        F.array().cast("array<struct<code:string,message:string>>").alias("warnings"),
    )


def installment_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(installments.build_plans(_card_charges(spark, sf_dir)).drop("source_fingerprints").withColumn("observed_installments", F.array_join("observed_installments", ",")))


def installment_outlook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(installments.schedule(installments.build_plans(_card_charges(spark, sf_dir)), "1998-01"))


def _candidates(rows: DataFrame) -> DataFrame:
    return rows.select("o_leg", "i_leg", F.col("gap_days").cast("bigint").alias("gap_days"), F.col("rank").cast("bigint").alias("rank"), "third_party")


def transfer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates at most two days apart, the window of SURVEY 7.3 and of this query's oracle."""
    return _candidates(reconcile.candidates(facts.from_events(spark, sf_dir), window=2))


def transfer_candidates_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the whole window, five days, that transfer_matches chooses from."""
    return _candidates(reconcile.candidates(facts.from_events(spark, sf_dir)))


def transfer_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(reconcile.transfers(facts.from_events(spark, sf_dir))[0].select("o_leg", "i_leg", "gap_days", "confidence", "reason"))


def ambiguous_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.knots(reconcile.match_transfers(facts.from_events(spark, sf_dir))[1])


def transfer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly summaries of events once transfers are matched and stamped, and payments of cards told by their wording."""
    rows = facts.from_events(spark, sf_dir)
    none = lambda kind="string": F.lit(None).cast(kind)
    out, paid = F.col("direction") == "out", (F.col("description") == "PAGO TARJETA") & ~F.col("is_card")
    more = {"kind": F.when(out & paid, "credit_card_payment").when(out, "expense").otherwise("income"), "kind_confidence": F.lit("suggested"), "category": none(), "merchant": none(), "cost_kind": none(), "cost_confidence": none()}
    return _plain(metrics.summaries(reconcile.stamp(rows.withColumns(more), reconcile.transfers(rows)[0])))


def card_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.match_card_payments(facts.from_events(spark, sf_dir))


def stamped_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are legs of a paired card payment, once both legs are stamped."""
    rows = facts.from_events(spark, sf_dir).withColumns({"kind": F.lit("unknown"), "kind_confidence": F.lit("unresolved")})
    out = reconcile.stamp_payments(rows, reconcile.match_card_payments(rows))
    return out.where("kind != 'unknown'").select("row_id", "kind", "kind_confidence", "counterpart_fingerprint")


def file_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as files of several kinds, encodings, delimiters and quotings, read back from their bytes: rows of each file's data sheet below its header."""
    files = stored(facts.order_files(spark, sf_dir), "files")
    rows = stored(sheets.sheets_of(files), "sheets")
    data = sheets.data_sheets(rows.where("error is null"))
    first = sheets.headers(data).select("file_hash", "header_row", *(F.element_at("roles", r).alias(f"{r}_at") for r in ("date", "description", "amount")))
    cell = lambda r, of="cells": F.get(of, F.col(f"{r}_at"))
    below = data.join(first, "file_hash").where("row_index > header_row")
    return below.select("path", "kind", F.col("sheet_index").cast("bigint").alias("sheet_index"), F.col("row_index").cast("bigint").alias("row_index"), cell("date").alias("date"), cell("description").alias("description"), cell("amount").alias("amount"), cell("amount", "formats").alias("amount_format"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedupe.with_fingerprints(facts.described(spark, sf_dir))
    return rows.select("row_id", "fingerprint", "weak_fingerprint", "legacy_fingerprint")


def _new_and_old(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = dedupe.with_fingerprints(facts.described(spark, sf_dir)).withColumns({"source_file_hash": F.lit("f"), "source_parser": F.lit("p"), "source_line": F.col("row_id")})
    old = rows.where("row_id % 3 = 0").select(
        F.when(F.col("row_id") % 2 == 0, F.col("fingerprint")).alias("fingerprint"), "weak_fingerprint", F.concat(F.lit("a"), "row_id").alias("activity_id"), "date", "amount", "currency",
        F.concat("description", F.lit(" EXTRA")).alias("description"), (F.col("row_id") % 12 == 0).alias("host_modified"), F.lit("q").alias("parser"), F.lit("1").alias("parser_version"), F.lit("g").alias("file_hash"),
        F.lit(None).cast("int").alias("installment_remaining"), (-F.col("row_id")).alias("ord"),
    )
    return rows, old


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.classify(*_new_and_old(spark, sf_dir)).select("row_id", "verdict", "reason_code", "existing_activity_id", "score")


def legacy_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates where two of ten files were once read by an older parser, so that their other rows are conflicts."""
    rows, old = _new_and_old(spark, sf_dir)
    new_parser, old_parser, version = dedupe.LEGACY[0]
    of = F.concat(F.lit("f"), F.abs("ord") % 10)
    old = old.withColumns({"file_hash": of, "parser": F.when(of.isin("f2", "f5"), old_parser).otherwise("q"), "parser_version": F.lit(version or "1")})
    rows = rows.withColumns({"source_file_hash": F.concat(F.lit("f"), F.col("row_id") % 10), "source_parser": F.lit(new_parser)})
    return dedupe.classify(rows, old).select("row_id", "verdict", "reason_code", "existing_activity_id", "score")


def import_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedupe.classify(*_new_and_old(spark, sf_dir)).withColumn("ignored", F.col("row_id") % 11 == 0)
    return _plain(metrics.preview_totals(rows.withColumn("will_import", ~F.col("ignored") & (F.col("verdict") == "none"))))


def _preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The duplicates' preview, with every seventh row selected by hand and every row of the sixth file of an older parser's."""
    rows = dedupe.classify(*_new_and_old(spark, sf_dir)).withColumns({"ignored": F.col("row_id") % 11 == 0, "reason_code": F.when(F.col("row_id") % 13 == 0, imports.CONFLICT).otherwise(F.col("reason_code"))})
    rows = rows.withColumn("will_import", ~F.col("ignored") & (F.col("verdict") == "none"))
    choices = facts.table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("row_id"), (F.col("o_orderkey") % 2 == 0).alias("will_import"))
    return imports.selected(rows, choices)


def import_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _preview(spark, sf_dir)
    created = facts.orders(spark, sf_dir).where("row_id % 5 <> 0").groupBy("currency").agg(F.floor(F.count(F.lit(1)) / 3).alias("created"))
    return _plain(imports.breakdown(rows, created, ("currency",)))


def activity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's type of every movement, on accounts that are cards for every other account."""
    rows = facts.movements(spark, sf_dir)
    kind = F.when(F.col("row_id") % 9 == 0, "interest").when(F.col("row_id") % 9 == 1, "tax").when(F.col("row_id") % 9 == 2, "internal_transfer").when(F.col("row_id") % 9 == 3, "unknown").otherwise(F.col("kind"))
    read = imports.resolved_type(kind, F.col("direction"), F.when(F.col("account_id") % 2 == 0, "CREDIT_CARD").otherwise("CASH"))
    named = rows.select(kind.alias("kind"), "direction", (F.col("account_id") % 2 == 0).alias("on_card"), read["type"].alias("activity_type"), read["substituted"].alias("substituted"))
    return named.groupBy("kind", "direction", "on_card", "activity_type", "substituted").agg(F.count(F.lit(1)).alias("n"))


def ledger_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as activities with metadata of all five versions, read back; some were given another type or comment since."""
    o = spread(facts.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"))
    k, odd = F.col("o_orderkey"), F.col("o_custkey") % 2 == 1
    kinds = ("income", "expense", "credit_card_purchase", "cash_advance", "internal_transfer", "investment", "credit_card_payment", "refund", "fee", "tax", "interest", "unknown")
    out = F.floor(k / 12) % 2 == 0
    money = amount(F.col("o_totalprice").cast("decimal(22,2)"))
    rows = o.select(
        k.cast("string").alias("account_id"), F.when(odd, "CASH").otherwise("CREDIT_CARD").alias("account_type"), F.element_at(F.array(*map(F.lit, kinds)), (k % 12 + 1).cast("int")).alias("kind"), F.when(out, "out").otherwise("in").alias("direction"),
        F.col("o_orderdate").cast("date").alias("date"), F.when(out, -money).otherwise(money).alias("amount"), F.lit("CLP").alias("currency"), F.lit("GLOSA").alias("description"), F.concat(F.lit("f"), k).alias("fingerprint"), F.lit("c").alias("category"), F.lit("m").alias("merchant"),
        F.when(k % 4 == 0, F.struct(F.lit(2).alias("current"), F.lit(6).alias("total"))).alias("installment"), F.when(k % 2 == 0, "commission").alias("cost_kind"), F.lit("confirmed").alias("kind_confidence"),
    )
    e = F.col("account_id").cast("long")
    host = ledger.to_activities(rows, (F.col("fingerprint").substr(F.lit(2), F.length("fingerprint")).cast("long") % 5 + 1).cast("int"))
    cash = rows.select(F.col("account_id").alias("own"), "account_type")
    host = host.join(cash, F.col("account_id") == F.col("own")).withColumns(
        {
            "activity_type": F.when(e % 7 == 0, "CREDIT").when(e % 7 == 2, "INTEREST").otherwise(F.col("activity_type")), "comment": F.when(e % 7 == 1, "OTRA").otherwise(F.col("comment")), "is_user_modified": e % 7 < 3,
            "subtype": F.when(e % 7 == 0, F.when(e % 3 == 1, "Bonus").when(e % 3 == 2, "REBATE")).otherwise(F.col("subtype")),
        }
    )
    back = ledger.from_activities(host.drop("own"))
    return _plain(back.select(F.col("account_id").cast("long").alias("o_orderkey"), "direction", "kind", "kind_confidence", "amount", "category", "cost_kind", F.col("installment.total").alias("installment_total"), "description", "is_current"))


def import_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders imported in batches of a hundred into a ledger that holds a third of them; every fiftieth lacks its amount."""
    o = facts.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    k = F.col("o_orderkey")
    rows = o.select(
        F.format_string("%012d", k).alias("idempotency_key"), F.col("o_custkey").cast("string").alias("account_id"), F.col("o_orderdate").cast("date").alias("date"), F.when(k % 50 != 0, F.col("o_totalprice").cast("decimal(22,2)")).alias("amount"), F.lit("POSTED").alias("status"), k.alias("number")
    )
    path = shared_path(spark, "ledger")
    ledger.import_rows(rows.where(k % 3 == 0).drop("number"), path, "1").count()
    out = ledger.import_rows(rows.drop("number"), path, "2")
    return out.withColumn("reasons", F.array_join("reasons", ","))


def monthly_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurring charges under the usual thresholds: one charge a month and supplier, of a third of them nearly steady, of a third
    wavering, of a third anything."""
    line = facts.table(spark, sf_dir, "lineitem").select("l_suppkey", F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("month"))
    line = stored(line.distinct(), "months")  # or Spark would read texts of each line, not of each month
    k, odd = F.col("l_suppkey"), F.month("month") % 2
    wave = F.when(k % 3 == 0, 100).when(k % 3 == 1, 300).otherwise(900) * odd
    word = F.when(k % 2 == 0, "PAC CUENTA").otherwise("COMPRA")
    rows = line.select(
        F.date_add("month", (k % 5).cast("int")).alias("date"), amount(-(F.lit(1000) + wave)).alias("amount"), F.lit("CLP").alias("currency"), F.lit("out").alias("direction"), F.lit("expense").alias("kind"), F.concat(F.lit("Proveedor "), k).alias("merchant"),
        F.lit(None).cast("string").alias("category"), word.alias("description"), word.alias("normalized_description"), F.lit(None).cast("struct<current:int,total:int,confidence:string>").alias("installment"),
        F.concat_ws("-", k, "month").alias("fingerprint"), k.alias("account_id"),
    )
    return _plain(recurring.recurring_charges(rows).drop("category", "merchant"))


def idempotency_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts.table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", "event_type").alias("fingerprint"), F.col("event_id").alias("source_line"), F.lit("f").alias("source_file_hash"))
    return dedupe.with_idempotency_keys(e).select("source_line", "idempotency_key")


def rule_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.apply_once(facts.described(spark, sf_dir), list(rules.BUILTIN))
    return rows.select("row_id", "merchant", "category", "kind", "kind_confidence", F.array_join("tags", ",").alias("tags"), F.array_join("applied_rules", ",").alias("applied_rules"), "cost_kind", "cost_confidence")


def _read_statements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sheets and their evidence under the best parser of each file, each written once, and their movements."""
    rows = stored(facts.statement_sheets(spark, sf_dir), "sheets")
    files = stored(statements.layouts(rows), "layouts")
    chosen = statements.detection(files).where("rank = 1").select("file_hash", "parser")
    known = stored(statements.evidence(rows, statements.described(files, chosen)), "evidence")
    return rows, known, statements.movements(rows, known)


def parser_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(facts.statement_sheets(spark, sf_dir), "sheets")  # layouts read them several times
    return _plain(statements.detection(statements.layouts(rows)).select("file_hash", "parser", "institution", "score", "rank", F.array_join("reasons", ",").alias("reasons")))


def statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, moved = _read_statements(spark, sf_dir)
    plan = F.concat_ws("/", F.col("installment.current"), F.col("installment.total"))
    return _plain(moved.select("file_hash", "parser", "source_line", "status", "failure", "date", "amount", "direction", "balance_after", "card_last4", plan.alias("plan"), F.array_join("warnings", ",").alias("warnings")))


def statement_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, known, moved = _read_statements(spark, sf_dir)
    out = statements.statements(rows, known, stored(moved, "movements"))
    issues = F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["level"], i["code"])), ",").alias("issues")
    return _plain(out.select("file_hash", "parser", "account_number", "currency", "period_from", "period_to", "opening", "opening_source", "closing", "data_rows", "mapped", "skipped", "failed", "balance_reconciles", "ok", issues))


def card_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of an invented card statement of each customer, with notes, dots and a policy's date; every fifth says two things of its minimum payment."""
    c = facts.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    money = F.abs("c_acctbal").cast("decimal(22,2)")
    shown = facts.spanish_number(money)
    lines = [
        F.concat(F.lit("Tarjeta N° **** **** 4412 Cupo total $ 9.999"), F.lit("")), F.concat(F.lit("Pago mínimo (1): $ "), shown), F.when(F.col("c_custkey") % 5 == 0, "Monto mínimo a pagar $ 1,00").otherwise("Pago recibido $ 5.000"),
        F.concat(F.lit(f"Monto total facturado {'.' * 50} "), shown), F.concat(F.lit("Deuda internacional USD "), shown), F.concat(F.lit("Cupo total $ 1.000.000   Cupo disponible ($ "), shown, F.lit(")")), F.lit("Cupo total utilizado $ 77.000"),
        F.concat(F.lit("Pagar hasta "), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")), "dd/MM/yyyy")), F.lit("Periodo de facturación: 01/01/2024 al 31/01/2024"),
        F.lit("Fecha de vencimiento de la póliza 05/05/2025"),
    ]
    files = c.select(F.col("c_custkey").cast("string").alias("file_hash"), F.concat_ws("\n", *lines).alias("preamble"), F.lit("CLP").alias("currency"))
    return _plain(labelled_facts.card_facts(files))


def amount_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in seven ways of writing, by line number."""
    line = facts.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    money, n = F.col("l_extendedprice").cast("decimal(22,2)"), F.col("l_linenumber")
    spanish, plain = facts.spanish_number(money), money.cast("string")
    whole = F.format_number(F.floor(money), 0)
    text = (
        F.when(n == 1, F.concat(F.lit("$ "), spanish)).when(n == 2, F.concat(F.lit("("), spanish, F.lit(")"))).when(n == 3, F.concat(F.translate(plain, ".", ","), F.lit("-"))).when(n == 4, F.concat(spanish, F.lit(" CR")))
        .when(n == 5, F.concat(F.lit("USD "), plain)).when(n == 6, F.concat(F.lit("-"), F.translate(whole, ",", "."))).otherwise(whole)
    )
    rows = with_amount(line.select("l_orderkey", "l_linenumber", text.alias("text")), "r", F.col("text"), "es-CL", with_marker=True)
    return _plain(rows.select("l_orderkey", "l_linenumber", F.col("r.amount").alias("amount"), F.col("r.scale").alias("scale"), F.col("r.ambiguous").alias("ambiguous"), F.col("r.explicit_sign").alias("explicit_sign"), F.col("r.error").alias("error")))


def rule_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small set of rules over parts, each seeing what those before it did."""
    C, A, R = rules.Condition, rules.Action, rules.Rule
    some = [
        R("a", 10, (C("abs_amount", "gte", 1500), C("description", "contains", "BRASS")), (A("set_category", "metal"), A("add_tag", "caro")), match="all"),
        R("b", 20, (C("category", "equals", "metal"),), (A("set_merchant", "Herrero"),), stop=True),
        R("c", 30, (C("abs_amount", "between", (1000, 1200)), C("description", "starts_with", "standard")), (A("set_category", "normal"),)),
        R("d", 40, (C("description", "matches", r"\bTIN$"), C("merchant", "not_equals", "Herrero")), (A("ignore"), A("add_tag", "estaño")), match="all", origin="user"),
    ]
    part = facts.table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice")
    rows = part.select(
        "p_partkey", amount(-F.col("p_retailprice").cast("decimal(22,2)")).alias("amount"), T.normalize_description(F.col("p_type")).alias("normalized_description"), F.lit("expense").alias("kind"), F.lit("suggested").alias("kind_confidence"),
        F.lit(None).cast("string").alias("merchant"), F.lit(None).cast("string").alias("category"), F.array().cast("array<string>").alias("tags"), F.lit("out").alias("direction"), F.lit("x").alias("account_id"),
    )
    return rules.apply_rules(rows, some, attribute=False).select("p_partkey", "merchant", "category", F.array_join("tags", ",").alias("tags"), F.array_join("applied_rules", ",").alias("applied_rules"), "ignored")


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.table(spark, sf_dir, "documents").select("doc_id", T.normalize_description(F.col("text")).alias("n"))
    n = F.col("n")
    return rows.select("doc_id", F.sha2(n, 256).alias("normal"), F.sha2(T.key_of_normalized(n), 256).alias("key"), F.size(T.tokens(n)).cast("bigint").alias("tokens"))


def redactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.table(spark, sf_dir, "documents").select("doc_id", F.sha2(P.redact(F.col("text")), 256).alias("redacted"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return facts.table(spark, sf_dir, "orders").select(
        "o_orderkey", D.month_key(d).alias("month"), D.add_months_to_key(D.month_key(d), 5).alias("later"), F.add_months(d, 1).alias("next_month"), F.last_day(d).alias("month_end"), D.days_between(d, F.lit("1998-08-02").cast("date")).cast("bigint").alias("days")
    )


def date_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "d-M-yy"))
    read = D.parse_date(text)
    return facts.table(spark, sf_dir, "orders").select("o_orderkey", read["date"].alias("date"), read["ambiguous"].alias("ambiguous"), read["error"].alias("error"))


def date_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates with month names, without years, and as what is no date, by the order's number."""
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    name = F.element_at(F.array(*map(F.lit, D.LABELS)), F.month(d))
    day, year = F.dayofmonth(d).cast("string"), F.year(d).cast("string")
    text = (
        F.when(k % 6 == 0, F.concat_ws(" ", day, F.left(name, F.lit(3)), year)).when(k % 6 == 1, F.concat(day, F.lit(" de "), F.initcap(name), F.lit(" de "), year)).when(k % 6 == 2, F.date_format(d, "dd/MM"))
        .when(k % 6 == 3, F.lit("31/02/1995")).when(k % 6 == 4, F.concat_ws("-", day, F.lit("foo"), year)).otherwise(F.concat(F.date_format(d, "dd/MM/yyyy"), F.lit(" 10:30 AM")))
    )
    read = D.parse_date(text, "DMY", F.trunc(d, "year"), F.date_add(F.add_months(F.trunc(d, "year"), 12), -1))
    return facts.table(spark, sf_dir, "orders").select("o_orderkey", read.alias("r")).select("o_orderkey", "r.date", "r.ambiguous", "r.error")


def date_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    rows = facts.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("file"), F.when(F.col("o_custkey") % 50 % 2 == 0, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy")).alias("cell"))
    return _plain(sheets.date_order(rows, "file", "cell", "DMY"))


def balance_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.orders(spark, sf_dir)
    return _plain(balances.walk(balances.example(rows), "account_id"))


def bag_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = facts.table(spark, sf_dir, "events").where("event_id % 2 = 0").select("user_id", "event_type")
    b = facts.table(spark, sf_dir, "events").where("event_id % 2 = 1").select("user_id", "event_type")
    return dedupe.bag_diff(a, b, ["user_id", "event_type"])


def month_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.movements(spark, sf_dir).withColumn("month", D.month_key(F.col("date")))
    summary = metrics.summaries(rows)
    by = ("currency", "month")
    parts = [insights.cash_flow(summary), insights.category_changes(metrics.category_totals(rows, by)), insights.concentration(metrics.merchant_totals(rows, 8, by), summary)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _plain(out)


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirteen months up to November 1998, in which movements end in between."""
    return _plain(dashboards.history(facts.movements(spark, sf_dir), "1998-11"))


def calibration_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as statements of customers, whose printed amounts are some of them wrong while balances go by the right ones."""
    o = facts.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("date"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    right = F.when(F.col("o_orderstatus") == "O", 1).otherwise(-1) * F.when(k % 2 == 0, F.col("o_totalprice").cast("decimal(22,2)")).otherwise(F.floor("o_totalprice").cast("decimal(22,2)"))
    shown = F.when(k % 31 == 0, -right).when(k % 37 == 0, right / 100).when(k % 41 == 0, right * 1000).when(k % 43 == 0, right + 1).otherwise(right)
    line = F.when(c % 4 == 0, -k).otherwise(k)
    time = Window.partitionBy("o_custkey")
    order = F.row_number().over(time.orderBy("date", "o_orderkey"))
    rows = o.select("*", F.when(c % 4 == 0, -order).when(c % 4 == 1, line).otherwise(order).cast("bigint").alias("line"), amount(right).alias("right"), amount(shown).alias("amount"))
    balance = F.sum("right").over(time.orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    kind = F.when(k % 5 == 0, "unknown").when(F.col("amount") > 0, "income").otherwise("expense")
    typed = rows.select(
        F.concat(F.lit("p"), c % 3).alias("parser"), c.alias("file"), "line", "date", "amount", kind.alias("kind"), F.when(k % 5 == 0, "unresolved").when(k % 7 == 0, "confirmed").otherwise("suggested").alias("kind_confidence"), F.when(k % 3 != 0, balance).alias("balance_after")
    )
    return calibration.profile(typed)


def charge_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remarks on instalments due from January 1998 on and on recurring charges, in their fixed order."""
    plans = stored(installments.build_plans(_card_charges(spark, sf_dir)).drop("source_fingerprints", "observed_installments"), "plans")
    due = insights.installments(installments.schedule(plans, "1998-01"), "1998-01", plans)
    return _plain(insights.ordered(due, insights.recurring(monthly_charges(spark, sf_dir), "1998-01")))


def import_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of customers beside the accounts they are to go to: how both match, and what keeps each from being imported."""
    c = facts.table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    parser = F.element_at(F.array(*(F.lit(p.parser) for p in PROFILES)), (k % len(PROFILES) + 1).cast("int"))
    number = F.format_string("00-%09d", k)
    found = c.select(k.cast("string").alias("file_hash"), k.cast("string").alias("account_id"), parser.alias("parser"), F.when(k % 5 == 0, "usd").otherwise("CLP").alias("currency"), F.when(k % 6 == 0, None).otherwise(number).alias("account_number"))
    own = F.when(k % 4 == 0, F.format_string("%09d", k)).when(k % 4 == 1, F.format_string("%09d", k + 1)).when(k % 4 == 2, "123")
    accounts = c.select(k.cast("string").alias("id"), F.when(k % 3 == 0, "CREDIT_CARD").otherwise("CASH").alias("account_type"), F.when(k % 10 == 0, "USD").otherwise("CLP").alias("currency"), own.alias("account_number"))
    n = F.col("file_hash").cast("long")
    read = statements.match_accounts(found, accounts).withColumns({"ok": n % 11 != 0, "duplicates_checked": n % 13 != 0}).withColumnRenamed("verdict", "account_verdict")
    return imports.blockers(read).select("file_hash", "account_verdict", F.array_join("reasons", ",").alias("reasons"), F.array_join("blockers", ",").alias("blockers"), "can_import")


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders laid out as words on the pages of a statement for each customer, a section's name before every fifth but the first five."""
    o = facts.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"))
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")) - 1
    rows = o.withColumn("n", n).withColumns({"page": F.floor(F.col("n") / 12), "top": F.lit(700) - F.col("n") % 12 * 20})
    k = F.col("o_orderkey")
    word = lambda x, up, text: F.struct(F.lit(float(x)).alias("x"), (F.col("top") + up).cast("double").alias("y"), text.alias("text"))
    money = F.translate(F.format_number(F.floor("o_totalprice"), 0), ",", ".")
    name = F.element_at(F.array(F.lit("Compras Nacionales"), F.lit("Cargos, comisiones, impuestos y abonos"), F.lit("Compras internacionales")), (F.col("n") / 5 % 3 + 1).cast("int"))
    header = F.when((F.col("n") % 5 == 0) & (F.col("n") > 0), F.array(*(word(10 + i, 10 + i, F.coalesce(F.get(F.split(name, " "), F.lit(i)), F.lit(" "))) for i in range(5))))
    date = F.when(k % 9 == 0, F.lit("sin fecha")).otherwise(F.date_format("day", "dd/MM/yyyy"))
    movement = F.array(word(300, k % 3, money), word(10, k % 2, date), word(90, 1, F.lit("COMPRA")))
    words = rows.select(F.col("o_custkey").alias("file"), "page", F.inline(F.concat(movement, F.coalesce(header, F.array().cast("array<struct<x:double,y:double,text:string>>")))))
    return _plain(sections.sections(sections.lines(words)))


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = facts.described(spark, sf_dir).groupBy("description", "normalized_description").agg(F.count(F.lit(1)).alias("n"))
    return enrich.with_attribution(few).groupBy("description").agg(*(F.max(c).alias(c) for c in ("processor_id", "merchant_name", "merchant_confidence", "merchant_source", "unresolved")), F.sum("n").alias("n"))


def kind_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.described(spark, sf_dir).withColumn("is_card", F.col("product") == "credit_card")
    kind = enrich.default_kind(F.col("normalized_description"), F.col("is_card"))
    return rows.withColumn("d", kind).groupBy("description", "is_card", "direction").agg(F.max("d.kind").alias("default_kind"), F.max("d.confidence").alias("default_confidence"), F.count(F.lit(1)).alias("n"))


NAMES = (
    monthly_summary, month_comparison, category_totals, merchant_totals, unattributed_spending, issuer_charges, cost_breakdown, recurring_charges, installment_plans, installment_outlook, transfer_candidates,
    transfer_candidates_all, transfer_matches, ambiguous_transfers, transfer_summary, card_payments, stamped_payments, file_movements, ledger_readings, import_batches, fingerprints, duplicates, legacy_conflicts, import_totals, idempotency_keys, rule_outcomes, rule_cases, text_keys, redactions, calendar, date_readings, date_shapes, date_orders, balance_walk,
    bag_diff, month_insights, dashboard, calibration_profile, charge_insights, import_readiness, page_sections, attribution, kind_defaults, parser_ranking, statement_rows, statement_balances, amount_readings, card_facts, import_breakdown, activity_types, monthly_charges,
)


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


def oracle_sql() -> dict:
    return {k: v for k, v in (ORACLES | more_oracles.ORACLES).items() if k in queries()}
