"""Civil dates without time zones, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.binding import let
from tallyspark.functions.text import lower

#: Month names and their short forms, and full labels in order.
MONTHS = {
    "ene": 1, "enero": 1, "feb": 2, "febrero": 2, "mar": 3, "marzo": 3, "abr": 4, "abril": 4, "may": 5, "mayo": 5, "jun": 6, "junio": 6,
    "jul": 7, "julio": 7, "ago": 8, "agosto": 8, "sep": 9, "sept": 9, "septiembre": 9, "setiembre": 9, "oct": 10, "octubre": 10,
    "nov": 11, "noviembre": 11, "dic": 12, "diciembre": 12,
}
LABELS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]


def month_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def month_start(key: Column) -> Column:
    return F.to_date(F.concat(key, F.lit("-01")))


def add_months_to_key(key: Column, months: Column | int) -> Column:
    return month_key(F.add_months(month_start(key), months))


def month_label(key: Column) -> Column:
    return F.concat(F.element_at(F.array(*map(F.lit, LABELS)), F.substring(key, 6, 2).cast("int")), F.lit(" "), F.substring(key, 1, 4))


def date_label(c: Column) -> Column:
    return F.date_format(c, "dd-MM-yyyy")


def civil_today(zone: str) -> Column:
    """The day that the calendar on the wall shows in a time zone, whatever the session's."""
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit(zone), F.current_timestamp().cast("timestamp_ntz")))


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a)


def ymd(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is none in the years 1900 to 2200."""
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return F.when(year.between(1900, 2200), text.try_cast("date"))


def _expand(year: Column, pivot: int) -> Column:
    return F.when(year >= 100, year).when(year < pivot, year + 2000).otherwise(year + 1900)


def year_for_month(month: Column, start: Column, end: Column) -> Column:
    """The only year that has days of this month between start and end; null if none or several."""
    years = F.when(start <= end, F.sequence(F.year(start), F.year(end)))
    fit = F.filter(years, lambda y: (F.make_date(y, month, F.lit(1)) <= end) & (F.last_day(F.make_date(y, month, F.lit(1))) >= start))
    return F.when(month.between(1, 12) & (F.size(fit) == 1), fit[0])


def parse_date(c: Column, order: str | Column = "DMY", start: Column | None = None, end: Column | None = None, pivot: int = 70) -> Column:
    """struct(date, ambiguous, error) read from a cell.

    ISO dates, days with Spanish month names, and numbers in ``order`` (or a column of orders; the other where that alone is a date), with a
    time of day after them or not. Dates without a year take theirs from the period from ``start`` to ``end``, in which they
    must lie. error: empty, unrecognised-format, invalid-calendar-date, unknown-month-name, missing-year or
    outside-declared-period, else null.
    """
    start = F.lit(None).cast("date") if start is None else start
    end = F.lit(None).cast("date") if end is None else end
    text = F.trim(F.coalesce(c, F.lit("")))
    only = F.trim(F.regexp_replace(text, r"(?i)[T\s]+\d{1,2}:\d{2}(:\d{2})?(\s*[AP]M)?.*$", ""))
    return let(only, lambda x: _read_date(x, order, start, end, pivot))


def _read_date(only: Column, order: str | Column, start: Column, end: Column, pivot: int) -> Column:
    low = lower(only)
    number = lambda x, pattern, g: F.regexp_extract(x, pattern, g).try_cast("int")
    iso = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$"
    named = r"^(\d{1,2})[\s\-/.]+([a-zà-ÿ]+)[\s\-/.]+(\d{2,4})$"
    named_short = r"^(\d{1,2})[\s\-/.]+([a-zà-ÿ]+)$"
    short = r"^(\d{1,2})[-/.](\d{1,2})$"
    full = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})$"
    names = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    plain = lambda x: F.translate(x, "áéíóúüñàèìòùâêîôûäëïö", "aeiouunaeiouaeiouaeio")
    without_de = F.regexp_replace(low, r"\bde\b", " ")

    month = F.try_element_at(names, plain(F.regexp_extract(without_de, named, 2)))
    named_date = ymd(_expand(number(without_de, named, 3), pivot), month, number(without_de, named, 1))
    a, b, year = number(only, full, 1), number(only, full, 2), _expand(number(only, full, 3), pivot)
    day_first, month_first = ymd(year, b, a), ymd(year, a, b)
    american = (order if isinstance(order, Column) else F.lit(order)) == "MDY"
    choose = lambda mdy, dmy: F.when(american, mdy).otherwise(dmy)
    first, second = choose(month_first, day_first), choose(day_first, month_first)
    month_a = F.try_element_at(names, plain(F.regexp_extract(low, named_short, 2)))
    x, y = number(only, short, 1), number(only, short, 2)
    month_b, day_b = choose(x, y), choose(y, x)

    def yearless(month: Column, day: Column) -> tuple[Column, Column]:
        found = year_for_month(month, start, end)
        date = ymd(found, month, day)
        inside = date.between(start, end)
        error = F.when(found.isNull(), "missing-year").when(date.isNull(), "invalid-calendar-date").when(~inside, "outside-declared-period")
        return F.when(inside, date), error

    def parts(pair: tuple[Column, Column]) -> Column:
        return F.struct(pair[0].alias("date"), pair[1].alias("error"))

    # Each reading is made only of a text that has its shape.
    shapes = {"is_iso": only.rlike(iso), "is_named": without_de.rlike(named), "is_named_short": low.rlike(named_short), "is_short": only.rlike(short), "is_full": only.rlike(full)}

    def readings(s: Column) -> Column:
        return F.struct(
            *(s[k].alias(k) for k in shapes),
            F.when(s["is_named"], named_date).alias("named"), F.when(s["is_named"], month).alias("named_month"), F.when(s["is_full"], first).alias("first"), F.when(s["is_full"], second).alias("second"),
            F.when(s["is_full"], a != b).alias("differ"), F.when(s["is_short"], month_b).alias("month"),
            F.when(s["is_named_short"], let(month_a, lambda m: let(number(low, named_short, 1), lambda d: parts(yearless(m, d))))).alias("short_named"), F.when(s["is_named_short"], month_a.isNull()).alias("unnamed"),
            F.when(s["is_short"], let(month_b, lambda m: let(day_b, lambda d: parts(yearless(m, d))))).alias("short"), F.when(s["is_iso"], ymd(number(only, iso, 1), number(only, iso, 2), number(only, iso, 3))).alias("iso"),
        )

    bound = let(F.struct(*(c.alias(k) for k, c in shapes.items())), readings)
    return let(bound, lambda v: _chosen_date(only, v))


def _chosen_date(only: Column, v: Column) -> Column:
    bad = "invalid-calendar-date"
    date = (
        F.when(v["is_iso"], v["iso"]).when(v["is_named"], v["named"]).when(v["is_named_short"], v["short_named"]["date"]).when(v["is_short"], v["short"]["date"]).when(v["is_full"], F.coalesce(v["first"], v["second"]))
    )
    error = (
        F.when(only == "", "empty")
        .when(v["is_iso"], F.when(v["iso"].isNull(), bad))
        .when(v["is_named"], F.when(v["named_month"].isNull(), "unknown-month-name").when(v["named"].isNull(), bad))
        .when(v["is_named_short"], F.when(v["unnamed"], "unknown-month-name").otherwise(v["short_named"]["error"]))
        .when(v["is_short"], F.when(~v["month"].between(1, 12), bad).otherwise(v["short"]["error"]))
        .when(v["is_full"], F.when(F.coalesce(v["first"], v["second"]).isNull(), bad))
        .otherwise("unrecognised-format")
    )
    ambiguous = v["is_full"] & ~v["is_iso"] & v["first"].isNotNull() & v["second"].isNotNull() & v["differ"]
    return F.struct(date.alias("date"), F.coalesce(ambiguous, F.lit(False)).alias("ambiguous"), error.alias("error"))
