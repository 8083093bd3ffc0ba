"""Exact money: decimal(22,6) amounts beside a currency, never floats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.binding import let

AMOUNT = "decimal(22,6)"
#: The largest magnitude, in units of the last decimal, that counts as exact.
MOST = 2**53 - 1
_NOISE = r"(?i)CLP|CLF|USD|EUR|UF|UTM|US\$|\$|€"
_MARKER = r"(?i)\b(CREDITO|CRÉDITO|CR|ABONO|DB|DEBITO|DÉBITO|CARGO|D)\s*$"


def amount(c: Column) -> Column:
    return c.cast(AMOUNT)


def canonical(c: Column) -> Column:
    """Decimal text without trailing zeros, the same whatever the scale."""
    text = F.regexp_replace(F.regexp_replace(c.cast(AMOUNT).cast("string"), "0+$", ""), r"\.$", "")
    return F.when(text == "-0", "0").otherwise(text)


def magnitude(c: Column) -> Column:
    return F.abs(c)


def money_text(c: Column, currency: Column, scale: int = 0) -> Column:
    """As people read it: ``$1.234.567`` for pesos, ``USD 12,50`` otherwise."""
    body = F.translate(F.format_number(F.abs(c), scale), ",.", ".,")
    symbol = F.when(currency == "CLP", "$").otherwise(F.concat(currency, F.lit(" ")))
    return F.concat(F.when(c < 0, "-").otherwise(""), symbol, body)


def parse_amount(c: Column, number_format: str | Column = "es-CL", with_marker: bool | Column = False) -> Column:
    """struct(amount, scale, ambiguous, explicit_sign, error) read from a cell.

    Parentheses and leading or trailing minus signs negate; currency names and signs are skipped; with ``with_marker`` a
    trailing CR or DB word gives the sign. Of two kinds of marks the last is the decimal one; a mark that repeats groups
    thousands; a single one before three digits is read by ``number_format`` (es-CL, en-US or auto, or a column of these). error: a
    code, or null.

    For few values: as one expression it is interpreted. ``with_amount`` reads columns of many.
    """
    steps = _steps(c, number_format, with_marker)

    def rest(k: int, known: dict[str, Column]) -> Column:
        if k == len(steps):
            return known["read"]
        found = steps[k](known.__getitem__)
        return let(F.struct(*(v.alias(n) for n, v in found.items())), lambda s: rest(k + 1, known | {n: s[n] for n in found}))

    return rest(0, {})


def with_amount(df: DataFrame, name: str, c: Column, number_format: str | Column = "es-CL", with_marker: bool | Column = False) -> DataFrame:
    """df with ``parse_amount`` of c as column ``name``, in projections that follow each other: all of it is compiled, step by step."""
    own = lambda n: f"__{name}_{n}"
    for step in _steps(c, number_format, with_marker):
        df = df.withColumns({own(n): v for n, v in step(lambda n: F.col(own(n))).items()})
    temporary = [n for n in df.columns if n.startswith(own("")) and n != own("read")]
    return df.withColumn(name, F.col(own("read"))).drop(own("read"), *temporary)


def _steps(c: Column, number_format: str | Column, with_marker: bool | Column) -> list[Callable[[Callable[[str], Column]], dict[str, Column]]]:
    """How an amount is read: each step names values, from those that the steps before it named."""
    named = number_format if isinstance(number_format, Column) else F.lit(number_format)
    wanted = with_marker if isinstance(with_marker, Column) else F.lit(with_marker)

    def whole(_) -> dict[str, Column]:
        return {"whole": F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\u00a0\u202f\u2009\t\r\n]", " "))}

    def unwrapped(at) -> dict[str, Column]:
        bracketed = at("whole").startswith("(") & at("whole").endswith(")") & (F.length(at("whole")) > 1)
        return {"bracketed": bracketed, "inner": F.when(bracketed, F.trim(F.substring(at("whole"), F.lit(2), F.length(at("whole")) - 2))).otherwise(at("whole"))}

    def word(at) -> dict[str, Column]:
        return {"word": F.when(wanted, F.upper(F.regexp_extract(at("inner"), _MARKER, 1))).otherwise("")}

    def unmarked(at) -> dict[str, Column]:
        w = at("word")
        debit = w.isin("D", "DB", "CARGO") | w.startswith("DEB") | w.startswith("DÉB")
        bare = F.when(w != "", F.trim(F.regexp_replace(at("inner"), _MARKER, ""))).otherwise(at("inner"))
        return {"sign": F.when(w != "", F.when(debit, "debit").otherwise("credit")), "wrapped": at("bracketed") | debit, "plain": F.trim(F.regexp_replace(bare, _NOISE, ""))}

    def unsigned(at) -> dict[str, Column]:
        t = at("plain")
        return {"leading": t.startswith("-"), "rest": F.when(t.startswith("-") | t.startswith("+"), F.trim(F.substring(t, F.lit(2), F.length(t)))).otherwise(t)}

    def ended(at) -> dict[str, Column]:
        t = at("rest")
        trailing = t.endswith("-")
        return {"bare": F.regexp_replace(F.when(trailing, F.trim(F.left(t, F.length(t) - 1))).otherwise(t), r"\s", ""), "negative": (at("wrapped") != at("leading")) != trailing}

    def marks(at) -> dict[str, Column]:
        t = at("bare")
        dots, commas = (F.length(t) - F.length(F.replace(t, F.lit(m))) for m in ".,")
        return {"dots": dots, "commas": commas, "tail": F.regexp_extract(t, r"[^.,]*$", 0), "digits": F.translate(t, ".,", "")}

    def shape(at) -> dict[str, Column]:
        dots, commas = at("dots"), at("commas")
        both, none = (dots > 0) & (commas > 0), (dots == 0) & (commas == 0)
        repeated = ~both & (dots + commas > 1)
        three = ~both & (dots + commas == 1) & (F.length(at("tail")) == 3)
        single = F.when(dots > 0, ".").otherwise(",")
        whole_mark = F.when(named == "es-CL", ".").when(named == "en-US", ",")
        as_whole = none | repeated | three & F.coalesce(single == whole_mark, F.lit(True))
        return {
            "fraction": F.when(as_whole, "").otherwise(at("tail")), "ambiguous": three & F.coalesce(single != whole_mark, F.lit(True)),
            "malformed": repeated & ~at("bare").rlike(r"^\d{1,3}([.,]\d{3})+$"),
        }

    def checked(at) -> dict[str, Column]:
        digits = at("digits")
        large = (F.try_to_number(F.right(F.concat(F.lit("0" * 20), digits), F.lit(20)), F.lit("9" * 20)) > MOST) | (F.length(F.regexp_replace(digits, "^0+", "")) > 16)
        error = (
            F.when(at("whole") == "", "empty")
            .when(at("bare") == "", "no-digits")
            .when(~at("bare").rlike(r"^[\d.,]+$"), "unexpected-characters")
            .when(at("malformed"), "malformed-grouping")
            .when(F.length(at("fraction")) > 6, "too-many-decimals")
            .when(digits.cast("decimal(38,0)").isNull() & (digits != "") | large, "too-large")
        )
        return {"error": error, "integer": F.left(digits, F.length(digits) - F.length(at("fraction")))}

    def read(at) -> dict[str, Column]:
        integer, fraction, good = at("integer"), at("fraction"), at("error").isNull()
        value = F.concat(F.when(at("negative"), "-").otherwise(""), F.when(integer == "", "0").otherwise(integer), F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)))
        return {
            "read": F.struct(
                F.when(good, value.try_cast(AMOUNT)).alias("amount"), F.when(good, F.length(fraction)).alias("scale"), F.when(good, at("ambiguous")).alias("ambiguous"),
                F.when(good, at("sign")).alias("explicit_sign"), at("error").alias("error"),
            )
        }

    return [whole, unwrapped, word, unmarked, unsigned, ended, marks, shape, checked, read]
