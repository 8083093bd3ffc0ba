"""Facts frames over the star-schema tables: movements with accounts, dates, signed amounts and currencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import amount
from tallyspark.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _currencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pseudo-currency and name for each nation: two tables of fixed, tiny size."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.col("r_name").alias("currency"))


def _signed(value: str, outgoing: Column) -> Column:
    money = amount(F.col(value).cast("decimal(22,2)"))
    return amount(F.when(outgoing, -money).otherwise(money))


_STATUS = {"O": "income", "F": "expense", "P": "credit_card_purchase"}


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One movement per order: open orders come in, others go out; a category by priority, the customer's nation as merchant."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(_currencies(spark, sf_dir)), F.col("c_nationkey") == F.col("n_nationkey"))
    status = F.col("o_orderstatus")
    kind = F.when(status == "O", "income").when(status == "F", "expense").otherwise("credit_card_purchase")
    first = F.left("o_orderpriority", F.lit(1))
    category = F.when(first == "1", "vivienda").when(first == "2", "servicios").when(first == "3", "alimentacion").when(first == "5", "compras")
    return rows.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        _signed("o_totalprice", status != "O").alias("amount"),
        "currency",
        F.when(status == "O", "in").otherwise("out").alias("direction"),
        kind.alias("kind"),
        category.alias("category"),
        F.col("n_name").alias("merchant"),
        F.lit(None).cast("string").alias("cost_kind"),
        F.lit(None).cast("string").alias("cost_confidence"),
    )


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One movement per line: returned lines are refunds, others expenses, cash advances and bank costs."""
    columns = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_returnflag", "l_shipdate"]
    line = table(spark, sf_dir, "lineitem").select(*columns)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    rows = line.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(_currencies(spark, sf_dir)), F.col("s_nationkey") == F.col("n_nationkey"))
    flag, n = F.col("l_returnflag"), F.col("l_linenumber")
    kind = F.when(flag == "R", "refund").when(flag == "A", "fee").when(n == 6, "cash_advance").otherwise("expense")
    category = F.when(n == 1, "alimentacion.supermercado").when(n == 2, "vivienda.arriendo").when(n == 4, "transporte").when(n == 5, "suscripciones")
    cost = F.when(flag == "A", F.when(n % 3 == 0, "maintenance").when(n % 3 == 1, "late_interest").otherwise("credit_tax"))
    return rows.select(
        (F.col("l_orderkey") * 10 + n).alias("row_id"),
        F.col("l_suppkey").alias("account_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        _signed("l_extendedprice", flag != "R").alias("amount"),
        "currency",
        F.when(flag == "R", "in").otherwise("out").alias("direction"),
        kind.alias("kind"),
        category.alias("category"),
        F.when(n != 3, F.col("s_name")).alias("merchant"),
        cost.alias("cost_kind"),
        F.when(cost.isNotNull(), F.when(n == 7, "suggested").otherwise("confirmed")).alias("cost_confidence"),
    )


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).unionByName(lineitems(spark, sf_dir))


#: Invented descriptions in the manner of bank statements; a row's number picks one.
DESCRIPTIONS = (
    "COMPRA NACIONAL SUPERMERCADO LIDER SANTIAGO", "Pago automático de cuentas ENEL", "TRANSFERENCIA A TERCEROS JUAN", "Traspaso entre cuentas propias", "COMISION POR MANTENCION DE TARJETA",
    "INTERESES POR MORA", "MERPAGO*TIENDA ROSA", "GOOGLE *YOUTUBE PREMIUM", "Compra en Café Ñandú 123456 PROVIDENCIA", "PAGO TARJETA DE CREDITO", "SUELDO MARZO EMPRESA SPA",
    "GIRO CAJERO AUTOMATICO", "IMPUESTO TIMBRES Y ESTAMPILLAS", "NETFLIX.COM 02/12", "FARMACIAS CRUZ VERDE CUOTA 2 DE 6", "WEBPAY PLUS LIBRERIA EL SOL", "PAGO ONLINE", "SEGURO DE VIDA POLIZA 889",
    "FLOW*CLASES DE PIANO", "AVANCE EN EFECTIVO",
)


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order movements with an invented description each, ready to be enriched."""
    from tallyspark.functions.text import normalize_description

    rows = orders(spark, sf_dir)
    text = F.element_at(F.array(*map(F.lit, DESCRIPTIONS)), (F.col("row_id") % len(DESCRIPTIONS) + 1).cast("int"))
    more = {
        "description": text, "amount_scale": F.lit(2), "institution": F.lit("banco-chile"), "reference": F.when(F.col("row_id") % 3 == 0, F.col("row_id").cast("string")), "tags": F.array().cast("array<string>"),
        "installment_remaining": F.lit(None).cast("int"), "kind_confidence": F.when(F.col("row_id") % 7 == 0, "confirmed").otherwise("suggested"), "product": F.when(F.col("kind") == "credit_card_purchase", "credit_card").otherwise("checking"),
        "operation_type": F.lit(None).cast("string"), "warnings": F.array().cast("array<struct<code:string,message:string>>"),
    }
    rows = rows.withColumns(more).drop("merchant", "category", "cost_kind", "cost_confidence")
    return rows.withColumns({"normalized_description": normalize_description(F.col("description")), "merchant": F.lit(None).cast("string"), "category": F.lit(None).cast("string")})


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One movement per event: purchases and errors go out, others come in; users are accounts."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    out = F.col("event_type").isin("purchase", "error")
    words = F.when(F.col("event_id") % 3 == 0, "TRASPASO ENTRE CUENTAS").when(F.col("event_id") % 3 == 1, "TEF A TERCEROS").otherwise("PAGO TARJETA")
    return e.select(
        F.col("event_id").alias("row_id"), F.col("user_id").alias("account_id"), F.col("ts").cast("date").alias("date"), _signed("value", out).alias("amount"), F.lit("CLP").alias("currency"),
        F.when(out, "out").otherwise("in").alias("direction"), F.col("event_id").cast("string").alias("fingerprint"), words.alias("description"), F.lit("banco-chile").alias("institution"),
        F.lit(None).cast("string").alias("reference"), (F.col("user_id") % 2 == 0).alias("is_card"),
    )


def spanish_number(c: Column) -> Column:
    """1234.5 as 1.234,50."""
    return F.translate(F.format_number(c, 2), ",.", ".,")


def statement_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sheets of statement files, one file a customer, in three layouts by the customer's number: an account with
    charges, credits and balance, a card, and an amount with a direction column. Some rows have faults, by their order's number:
    of 11 no date, of 13 an unreadable amount, of 17 no description, of 19 no amount; accounts, of 23, both a charge and a credit."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").cast("date"), "o_orderkey")
    n, k = F.row_number().over(w), F.col("o_orderkey")
    layout = (F.col("o_custkey") % 3).cast("int")
    incoming, money = F.col("o_orderstatus") == "O", F.col("o_totalprice").cast("decimal(22,2)")
    good = (k % 11 != 0) & (k % 13 != 0) & (k % 17 != 0) & (k % 19 != 0) & (k % 23 != 0)
    balance = F.sum(F.when(good, F.when(incoming, money).otherwise(-money)).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1000
    shown = F.when(k % 19 == 0, "0,00").when(k % 13 == 0, "x1").otherwise(spanish_number(money))
    date = F.when(k % 11 == 0, "").otherwise(F.date_format(F.col("o_orderdate").cast("date"), "dd/MM/yyyy"))
    text = F.when(k % 17 == 0, "").otherwise(F.element_at(F.array(*map(F.lit, DESCRIPTIONS)), (k % len(DESCRIPTIONS) + 1).cast("int")))
    both = (k % 23 == 0) & (k % 19 != 0)
    account = F.array(date, text, F.when(~incoming | both, shown).otherwise(""), F.when(incoming | both, shown).otherwise(""), spanish_number(balance))
    card = F.array(date, text, F.when(incoming, F.concat(F.lit("-"), shown)).otherwise(shown), F.when(k % 5 == 0, "2 de 6").otherwise(""), F.lit("**** 4412"))
    flag = F.array(date, text, shown, F.when(incoming, "A").otherwise("C"))
    cells = F.when(layout == 0, account).when(layout == 1, card).otherwise(flag)
    data = o.select("o_custkey", (n + 2).cast("int").alias("row_index"), cells.alias("cells"))
    head = lambda *cells: F.array(*map(F.lit, cells))
    tops = (
        F.array(head("Banco de Chile - Cartola"), F.array(F.lit("Cuenta Corriente N:"), F.format_string("00-%09d", "o_custkey")), head("Fecha", "Descripcion", "Cargos (PESOS)", "Abonos (PESOS)", "Saldo (PESOS)")),
        F.array(head("Estado CMR"), head("Periodo: 01/01/1992 al 31/12/1998"), head("Fecha", "Descripcion", "Monto", "Cuotas", "Tarjeta")),
        F.array(head("Movimientos"), head("Moneda: CLP"), head("Fecha", "Glosa", "Monto", "Cargo Abono")),
    )
    top = F.when(layout == 0, tops[0]).when(layout == 1, tops[1]).otherwise(tops[2])
    heads = spread(o.select("o_custkey").distinct()).select("o_custkey", F.posexplode(top).alias("row_index", "cells"))
    rows = data.unionByName(heads)
    return rows.select(
        F.concat(F.lit("/s/"), "o_custkey", F.lit(".csv")).alias("path"), F.col("o_custkey").cast("string").alias("file_hash"), F.lit("csv").alias("kind"), F.lit(0).alias("sheet_index"), F.lit("").alias("sheet"), "row_index", "cells",
        F.transform("cells", lambda c: F.lit("")).alias("formats"), F.lit(None).cast("string").alias("error"),
    )


#: A file holds at most so many orders; a customer with more has several.
ORDERS_A_FILE = 500
#: What a description holds beyond its number: letters outside ASCII, every delimiter, quotes and a line break.
_ODD = 'CAFÉ "EL NIÑO"; S.A., UNO|DOS\tTRES\nAÑO €'


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of orders as files, one or more a customer, in six forms by the customer's number: UTF-8 with a mark and
    semicolons, UTF-8 with commas, windows-1252 with tabs, windows-1252 with bars, a workbook, and a workbook whose first sheet is a note."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"))
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")) - 1
    rows = o.withColumns({"part": F.floor(n / ORDERS_A_FILE), "n": n % ORDERS_A_FILE, "form": F.col("o_custkey") % 6})
    text = F.concat(F.lit(_ODD), F.lit(" "), F.col("o_orderkey"))
    one = rows.groupBy("o_custkey", "part", "form").agg(F.sort_array(F.collect_list(F.struct("n", "day", text.alias("text"), F.col("o_totalprice").cast("decimal(22,2)").alias("money")))).alias("rows"))

    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))

    def delimited(sign: str) -> Column:
        line = lambda r: F.concat_ws(sign, F.date_format(r["day"], "dd/MM/yyyy"), quoted(r["text"]), quoted(spanish_number(r["money"])))
        head = F.concat(F.lit(f"Titular{sign}Cliente "), F.col("o_custkey"), F.lit(f"\r\n\r\nFecha{sign}Glosa{sign}Monto\r\n"))
        return F.concat(head, F.array_join(F.transform("rows", line), "\r\n"), F.lit("\r\n\r\n"))

    form = F.col("form")
    body = F.when(form == 0, delimited(";")).when(form == 1, delimited(",")).when(form == 2, delimited("\t")).when(form == 3, delimited("|"))
    name = F.concat(F.lit("/files/"), F.col("o_custkey"), F.lit("-"), F.col("part"), F.when(form.isin(0, 1), ".csv").when(form.isin(2, 3), ".txt").otherwise(".xlsx"))
    cells = F.transform("rows", lambda r: F.struct(F.datediff(r["day"], F.lit("1899-12-30").cast("date")).alias("day"), r["text"].alias("text"), r["money"].cast("double").alias("money")))
    some = one.select(name.alias("path"), form.cast("int").alias("form"), F.col("o_custkey").cast("string").alias("customer"), F.when(form >= 4, cells).alias("rows"), body.alias("body"))
    return some.mapInArrow(_files, "path string, content binary")


def _files(batches):
    import pyarrow as pa

    from tallyspark.sources.xlsx import workbook

    for batch in batches:
        contents = []
        for _, form, customer, rows, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if form < 4:
                contents.append(body.encode(("utf-8-sig", "utf-8", "cp1252", "cp1252")[form]))
            else:
                lines = [["Titular", f"Cliente {customer}"], [], ["Fecha", "Glosa", "Monto"], *([r["day"], r["text"], r["money"]] for r in rows)]
                contents.append(workbook({**({"Nota": [["Solo una nota"]]} if form == 5 else {}), "Movimientos": lines}, formats=[14, 0, 4]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary())], ["path", "content"])
