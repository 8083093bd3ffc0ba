import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import sheets, statements
from tallyspark.sources.profiles import PROFILES, institutions

CHECKING = """Banco de Chile - Cartola Cuenta Corriente
Titular: ANA
Cuenta Corriente N: 00-123-45678-90
Fecha de Emision: 31/01/2026

Fecha;Descripcion;Canal o Sucursal;Cargos (PESOS);Abonos (PESOS);Saldo (PESOS)
30/12;SALDO INICIAL;;;;100.000
31/12;ABONO SUELDO;OFICINA;;50.000;150.000
02/01;PAGO TARJETA DE CREDITO;INTERNET;20.000;;130.000
05/01;COMPRA LIDER;INTERNET;5.500;;124.500
05/01;;;;;
06/01;NADA;X;0;0,00;124.500
31/01;SALDO FINAL;;;;124.500
"""
CARD = """Banco Falabella CMR
Tarjeta N: XXXX-XXXX-XXXX-4412
Periodo: 01/02/2026 al 28/02/2026

Fecha;Descripcion;Monto;Valor Cuota;Cuotas Pendientes
03/02/2026;TIENDA UNO;90.000;30.000;2
05/02/2026;TIENDA DOS;7.450;;
14/02/2026;PAGO TARJETA;-95.000;;
15/02/2026;DEVOLUCION TIENDA;12.300 CR;;
TOTAL;;1;;
"""
BROKEN = """Cuenta N 12345678
Fecha;Glosa;Monto;Cargo Abono;Moneda
13/02/2026;UNO;1.000;C;CLP
14/02/2026;DOS;2.000;A;CLP
;TRES;3.000;A;CLP
40/02/2026;CUATRO;4.000;A;CLP
15/02/2026;;5.000;A;CLP
16/02/2026;SEIS;x1;A;CLP
17/02/2026;SIETE;7.000;Z;USD
28/02/2026;;490.000;;
;;500.000;;
18/02/2026;OCHO;1,5;+;$
"""
BACKWARDS = """Fecha;Detalle;Cargo;Abono;Saldo
10/03/2026;C;1.000;;8.000
09/03/2026;B;;2.000;9.000
08/03/2026;A;3.000;;7.000
"""
USD = "Movimientos Internacionales\nMonto Facturado\nCategoría;Fecha;Descripción;País;Monto Moneda Origen;Monto (USD)\nx;01/02/2026;UNO;US;1;2\n"


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    texts = {"cartola.csv": CHECKING, "cmr.csv": CARD, "broken.csv": BROKEN, "back.csv": BACKWARDS, "usd.csv": USD, "empty.csv": "nada\nde nada\n"}
    for name, text in texts.items():
        (folder / name).write_text(text)
    rows = sheets.read_sheets(spark, str(folder)).cache()
    files = statements.layouts(rows).cache()
    best = statements.detection(files).cache()
    names = {r.file_hash: r.path.rsplit("/", 1)[1] for r in files.select("file_hash", "path").collect()}
    wanted = {"broken.csv": "generico.cuenta", "empty.csv": "generico.cuenta", "usd.csv": "banco-chile.tarjeta"}
    chosen = spark.createDataFrame([(h, wanted.get(n) or best.where((F.col("file_hash") == h) & (F.col("rank") == 1)).first().parser) for h, n in names.items()], "file_hash string, parser string")
    known = statements.evidence(rows, statements.described(files, chosen)).cache()
    moved = statements.movements(rows, known).cache()
    return rows, files, best, names, known, moved


def test_ranking(read):
    _, _, best, names, _, _ = read
    first = {names[r.file_hash]: (r.parser, r.points) for r in best.where("rank = 1").collect()}
    assert first["cartola.csv"] == ("banco-chile.cuenta-corriente", 100)
    assert first["cmr.csv"][0] == "banco-falabella.cmr" and first["back.csv"] == ("generico.cuenta", 30 + 25 + 35)
    assert "empty.csv" not in first and first["usd.csv"][0] == "banco-chile.tarjeta"
    assert not best.where("parser = 'banco-chile.tarjeta'").join(read[1].where("path like '%cmr.csv'"), "file_hash").count()
    assert [len(p) for _, p in institutions().values()] == [2, 1, 2, 2] and len(PROFILES) == 7


def rows_of(read, name):
    _, _, _, names, _, moved = read
    hash_ = next(h for h, n in names.items() if n == name)
    return moved.where(F.col("file_hash") == hash_).orderBy("source_line").collect()


def test_checking_account_without_years(read):
    got = rows_of(read, "cartola.csv")
    assert [r.status for r in got] == ["skipped", "mapped", "mapped", "mapped", "skipped", "skipped", "skipped"]
    assert [(r.date, int(r.amount), int(r.balance_after), r.operation_type) for r in got if r.status == "mapped"] == [
        (dt.date(2025, 12, 31), 50_000, 150_000, "OFICINA"), (dt.date(2026, 1, 2), -20_000, 130_000, "INTERNET"), (dt.date(2026, 1, 5), -5_500, 124_500, "INTERNET"),
    ]
    assert got[2].kind == "credit_card_payment" and got[1].account_number == "00-123-45678-90" and got[1].raw["credit"] == "50.000"


def test_card(read):
    got = rows_of(read, "cmr.csv")
    assert [(r.status, r.amount and int(r.amount)) for r in got] == [("mapped", -30_000), ("mapped", -7_450), ("mapped", 95_000), ("mapped", 12_300), ("skipped", None)]
    assert got[0].installment_remaining == 2 and got[0].raw["amount"] == "90.000"


def test_rows_that_fail(read):
    got = rows_of(read, "broken.csv")
    assert [(r.status, r.failure) for r in got] == [
        ("mapped", None), ("mapped", None), ("failed", "missing-date"), ("failed", "unreadable-date"), ("failed", "missing-description"), ("failed", "unreadable-amount"), ("failed", "unknown-direction"),
        ("failed", "missing-description"), ("skipped", None), ("mapped", None),
    ]
    assert [float(r.amount) for r in got if r.status == "mapped"] == [-1000, 2000, 1.5] and got[2].failure_text == "Fila 5: la fila tiene monto pero no fecha"


def test_statements(read):
    rows, _, _, names, known, moved = read
    got = {names[r.file_hash]: r for r in statements.statements(rows, known, moved).collect()}
    a = got["cartola.csv"]
    assert (a.ok, int(a.opening), a.opening_source, int(a.closing), a.balance_reconciles, a.period_from, a.period_to) == (True, 100_000, "derived", 124_500, True, dt.date(2025, 12, 30), dt.date(2026, 1, 31))
    assert [i.code for i in a.issues] == ["profile-unverified"] and (a.data_rows, a.mapped, a.skipped, a.failed) == (7, 3, 4, 0)
    b = got["back.csv"]
    assert (b.ok, b.order, int(b.opening), int(b.closing), b.balance_reconciles) == (True, "descending", 10_000, 8_000, True)
    c = got["broken.csv"]
    assert not c.ok and {"row-parse-failed", "mixed-currency"} <= {i.code for i in c.issues} and c.failed == 6
    assert not got["usd.csv"].ok and got["usd.csv"].issues[-1].code == "foreign-currency-unsupported"
    assert not got["empty.csv"].ok and "no-header" in {i.code for i in got["empty.csv"].issues}


def test_accounts(spark, read):
    accounts = spark.createDataFrame([("a", "CASH", "CLP", "5678-90"), ("b", "CASH", "USD", None), ("c", "CREDIT_CARD", "CLP", "12"), ("d", "CASH", "CLP", "99999999")], "id string, account_type string, currency string, account_number string")
    found = spark.createDataFrame([("f", "banco-estado.cuenta", "CLP", "00-123-45678-90", x) for x in "abcd"], "file_hash string, parser string, currency string, account_number string, account_id string")
    got = {r.account_id: r.verdict for r in statements.match_accounts(found, accounts).collect()}
    assert got == {"a": "confirmed", "b": "blocked", "c": "warning", "d": "blocked"}
