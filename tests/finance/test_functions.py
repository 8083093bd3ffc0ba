from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import dates as D
from tallyspark.functions import money as M
from tallyspark.functions import privacy as P
from tallyspark.functions import text as T


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    kinds = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([values], kinds).select(column(*map(F.col, names)).alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "number_format", "want"),
    [
        ("$1.234.567", "es-CL", "1234567"), ("1.234", "es-CL", "1234"), ("1,234", "es-CL", "1.234"), ("1,234", "en-US", "1234"), ("1.234,50", "es-CL", "1234.5"), ("1,234.50", "es-CL", "1234.5"),
        ("(500)", "es-CL", "-500"), ("500-", "es-CL", "-500"), ("-(500)", "es-CL", None), ("- $ 12", "es-CL", "-12"), ("US$ 10,5", "es-CL", "10.5"), ("", "es-CL", None), ("abc", "es-CL", None), ("1.23.456", "es-CL", None),
        ("0,1234567", "es-CL", None), ("99999999999999999", "es-CL", None), ("UF 1.5", "auto", "1.5"), ("0", "es-CL", "0"), ("$", "es-CL", None),
    ],
)
def test_amounts(spark, raw, number_format, want):
    got = one(spark, lambda c: M.parse_amount(c, number_format), raw)
    assert (got.amount if want is None else got.amount == Decimal(want)) in (None, True), got
    assert (got.error is None) == (want is not None)


def test_markers_and_ambiguity(spark):
    got = one(spark, lambda c: M.parse_amount(c, "es-CL", True), "1.500 DB")
    assert (got.amount, got.explicit_sign) == (Decimal(-1500), "debit")
    got = one(spark, lambda c: M.parse_amount(c, "es-CL", True), "1.500 CR")
    assert (got.amount, got.explicit_sign) == (Decimal(1500), "credit")
    assert one(spark, M.parse_amount, "1,500").ambiguous and not one(spark, M.parse_amount, "1.500").ambiguous
    assert one(spark, lambda c: M.canonical(c), "1200.000") == "1200" and one(spark, lambda c: M.canonical(c), "-0.50") == "-0.5"
    assert one(spark, lambda c: M.money_text(c.cast("decimal(22,6)"), F.lit("CLP")), "-1234567") == "-$1.234.567"


@pytest.mark.parametrize(
    ("raw", "order", "want"),
    [
        ("2026-02-05", "DMY", "2026-02-05"), ("05/02/2026 10:31", "DMY", "2026-02-05"), ("05/02/2026", "MDY", "2026-05-02"), ("25/02/26", "MDY", "2026-02-25"), ("5-2-69", "DMY", "2069-02-05"), ("5-2-70", "DMY", "1970-02-05"),
        ("5 de marzo de 2026", "DMY", "2026-03-05"), ("05 sept 2026", "DMY", "2026-09-05"), ("30/02/2026", "DMY", "invalid-calendar-date"), ("5 foo 2026", "DMY", "unknown-month-name"), ("", "DMY", "empty"), ("x", "DMY", "unrecognised-format"),
        ("15/12", "DMY", "2025-12-15"), ("15 ene", "DMY", "2026-01-15"), ("15/06", "DMY", "missing-year"), ("31/01", "DMY", "outside-declared-period"),
    ],
)
def test_dates(spark, raw, order, want):
    got = one(spark, lambda c: D.parse_date(c, order, F.lit("2025-12-10").cast("date"), F.lit("2026-01-20").cast("date")), raw)
    assert want in (str(got.date), got.error)


def test_months(spark):
    assert one(spark, lambda c: D.add_months_to_key(c, -2), "2026-01") == "2025-11"
    assert one(spark, D.month_label, "2026-03") == "marzo 2026"


def test_text(spark):
    assert one(spark, T.normalize_description, "  Café  Ñandú, N° 12/b ") == "CAFE NANDU N 12/B"
    assert one(spark, T.description_key, "Compra 12/34 a b-Café 5") == "COMPRA CAFE"
    assert one(spark, T.similarity, "ABCD", "ABCE") == 0.75 and one(spark, T.similarity, "", "") == 1
    assert one(spark, lambda c: T.truncate(c, 4), "abcdef") == "abc…"
    assert one(spark, T.collapse_spaces, " a   b\t") == "a b"


def test_privacy(spark):
    text = "tarjeta 4111 1111 1111 1111 rut 12.345.678-5 mail a.b@x.cl key_abcdefgh123 cuenta 00-123-45678 fecha 2026-01-31 y 31/12/2025 n 12345"
    got = one(spark, P.redact, text)
    assert got == "tarjeta [CARD] rut [RUT] mail [EMAIL] [TOKEN] cuenta [NUM] fecha 2026-01-31 y 31/12/2025 n 12345"
    assert one(spark, P.mask_rut, "12.345.678-5") == "••.•••.678-5" and one(spark, P.mask_card, "4111111111111234") == "•••• •••• •••• 1234"
    assert one(spark, P.mask_account, "123456789") == "••••6789" and one(spark, lambda c: P.amount_bucket(c.cast("long")), "-1500") == "-1e3..1e4"
