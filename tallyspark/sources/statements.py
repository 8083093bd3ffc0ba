"""From sheets of many statement files to typed movements, balances, issues and verdicts, all files at once.

A file's layout (header, preamble, roles of columns) is small and comes from its first rows; movements are expressions over rows
joined with their file's layout. A row that can't be read is a row with an error, never an exception, and its file is not valid.
Everything is grouped by file_hash; files are bounded, so no group is more than a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.binding import let
from tallyspark.functions.dates import parse_date
from tallyspark.functions.money import AMOUNT, amount, parse_amount, with_amount
from tallyspark.functions.text import fold_case, normalize_description
from tallyspark.operators import balances
from tallyspark.operators.enrich import default_kind, installment, remaining_installments
from tallyspark.session import once_per, spread, stored
from tallyspark.sources import sheets
from tallyspark.sources.profiles import BY_PARSER, FLOOR, IGNORED, PROFILES, Profile

#: Rows of a sheet without a header that count as its preamble.
PREAMBLE_ROWS = 25
# Account numbers, currencies, periods and balances as statements print them, and what becomes of a row.
ACCOUNTS = (
    r"(?i)\b(?:CUENTA|CTA)\.?\s*(?:CORRIENTE|VISTA|RUT|DE\s+AHORRO)?\s*(?:N[º°]?|NRO\.?|NUMERO)?\s*:?\s*([\d.-]{6,})",
    r"(?i)\bTARJETA\s*(?:N[º°]?|NRO\.?)?\s*:?\s*([\dX*.-]{8,})",
)
CURRENCIES = ((r"(?i)\b(?:PESOS|MONEDA\s+NACIONAL|CLP|\$\s*CHILENOS?)\b", "CLP"), (r"(?i)\b(?:D[OÓ]LARES?|USD|US\$)\b", "USD"), (r"(?i)\b(?:UF|UNIDAD(?:ES)?\s+DE\s+FOMENTO)\b", "CLF"))
PERIOD = r"(?i)\b(?:PER[IÍ]ODO|DESDE|ENTRE)\b[^\d]{0,20}(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{4}-\d{2}-\d{2})[^\d]{1,20}(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{4}-\d{2}-\d{2})"
OPENING = r"(?i)\bSALDO\s+(?:INICIAL|ANTERIOR)\b[^\d(+-]{0,40}([(+-]?[\d.,]+\)?-?)"
CLOSING = r"(?i)\bSALDO\s+(?:FINAL|CONTABLE)\b[^\d(+-]{0,40}([(+-]?[\d.,]+\)?-?)"
CARD_TAIL = r"(?i)(?:\*{2,}|X{2,}|(?<![\p{L}])N[°º]\s*)(\d{4})\b"
FAILURES = {
    "missing-date": "la fila tiene monto pero no fecha",
    "unreadable-date": "no se pudo leer la fecha",
    "missing-description": "la fila trae monto y fecha pero no glosa",
    "unreadable-amount": "no se pudo leer el monto",
    "debit-and-credit": "la fila tiene cargo y abono simultáneos",
    "unknown-direction": "la columna de dirección trae un valor no reconocido",
    "missing-amount": "la fila tiene fecha pero ninguna columna de monto con contenido",
}


def _by_parser(value) -> Column:
    """A value of each profile, for the row's parser; null where the profile has none."""
    known = [(p.parser, v) for p in PROFILES if (v := value(p)) is not None]
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in known for x in pair)), F.col("parser"))


def _of_parser(test) -> Column:
    """A condition of each profile, for the row's parser; ``test`` gives None where the profile has none."""
    out = F.lit(False)
    for p in PROFILES:
        if (c := test(p)) is not None:
            out = F.when(F.col("parser") == p.parser, c).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("|".join(patterns)) if patterns else F.lit(False)


def _file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


# Layouts.


def layouts(rows: DataFrame) -> DataFrame:
    """(file_hash, path, kind, sheet_index, header_row, header, roles, preamble, vocabulary, layouts, sheets) of every file.

    preamble: the data sheet's rows down to the header, as lines; vocabulary: those of all sheets, folded; layouts: every
    header row of every sheet; sheets: how many have any content. header_row is null where no row names what a header must.
    """
    rows = rows.where("cells is not null")
    plausible = stored(sheets.header_rows(rows), "headers")
    first = plausible.groupBy("file_hash", "sheet_index").agg(F.min_by(F.struct(F.col("row_index").alias("header_row"), "header", "roles"), "row_index").alias("h"))
    top = rows.where(F.col("row_index") <= 30).select("file_hash", "sheet_index", "row_index", F.array_join("cells", " ").alias("line")).join(first, ["file_hash", "sheet_index"], "left")
    top = top.where(F.col("row_index") <= F.coalesce("h.header_row", F.lit(PREAMBLE_ROWS - 1)))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "line"))), lambda x: x["line"]), "\n")
    by_sheet = stored(top.groupBy("file_hash", "sheet_index").agg(lines.alias("preamble"), F.any_value("h").alias("h")), "preambles")
    all_sheets = by_sheet.groupBy("file_hash").agg(fold_case(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet_index", "preamble"))), lambda x: x["preamble"]), "\n")).alias("vocabulary"))
    named = plausible.groupBy("file_hash").agg(F.collect_list("header").alias("layouts"))
    filled = rows.where(F.exists("cells", lambda c: c != ""))
    files = filled.groupBy("file_hash").agg(F.any_value("path").alias("path"), F.any_value("kind").alias("kind"), F.count_distinct("sheet_index").cast("int").alias("sheets"))
    data = sheets.data_sheets(rows.select("file_hash", "sheet_index", "cells")).select("file_hash", "sheet_index").distinct()
    out = data.join(by_sheet, ["file_hash", "sheet_index"]).join(all_sheets, "file_hash").join(files, "file_hash").join(named, "file_hash", "left")
    return out.select("file_hash", "path", "kind", "sheet_index", "h.header_row", "h.header", "h.roles", "preamble", "vocabulary", F.coalesce("layouts", F.array().cast("array<array<string>>")).alias("layouts"), "sheets")


def account_number(preamble: Column) -> Column:
    found = (F.regexp_extract(preamble, p, 1) for p in ACCOUNTS)
    return F.coalesce(*(F.when(x != "", F.regexp_replace(x, r"[.\s]", "")) for x in found))


def currency_code(text: Column) -> Column:
    """The currency that a text names; null if none."""
    return F.coalesce(*(F.when(text.rlike(p), code) for p, code in CURRENCIES))


def _has_layout(headers: tuple[str, ...]) -> Column:
    wanted = F.array(*(F.lit(_plain_header(h)) for h in headers))
    return F.exists("layouts", lambda h: F.size(F.array_except(wanted, h)) == 0)


def structural_fit(profile: Profile, roles: Column) -> Column:
    """How well the columns suit a card's or an account's statement, in hundredths."""
    has = lambda role: F.coalesce(F.map_contains_key(roles, role), F.lit(False))
    balance, both, plan = has("balance"), has("debit") & has("credit"), has("installment")
    points = lambda when, n: F.when(when, n).otherwise(0)
    if profile.is_card:
        return points(plan, 20) + points(balance, -30) + points(both, -15)
    return points(balance, 20) + points(both, 15) + points(plan & ~balance, -15)


def detection(files: DataFrame) -> DataFrame:
    """(file_hash, parser, institution, points, score, rank, reasons) of every parser that may read a file, the best first.

    files: ``layouts``. Scores count in hundredths, so that sums are exact; equals keep the order of the registry.
    """
    text, name = F.col("vocabulary"), _file_name(F.col("path"))

    def seen(p: Profile) -> Column:
        """What a file shows of a profile: each pattern is sought once, whatever is made of it."""
        signature = F.lit(False)
        for headers in p.signatures:
            signature = signature | _has_layout(headers)
        return F.struct(
            _any(text, p.strong).alias("strong"), sum((text.rlike(w).cast("int") for w in p.weak), F.lit(0)).alias("weak"), _any(name, p.file_names).alias("named"),
            structural_fit(p, F.col("roles")).alias("fit"), signature.alias("signature"), _any(text, p.disqualifying).alias("other"),
        )

    def judged(i: int, p: Profile) -> Column:
        at = lambda what: F.col(f"__{i}.{what}")
        marks = {
            "marker": (at("strong"), F.lit(50)), "vocabulary": (at("weak") > 0, F.least(F.lit(30), at("weak") * 10)), "file-name": (at("named"), F.lit(15)),
            "header": (F.lit(True), F.lit(25)), "columns": (at("fit") != 0, at("fit")), "layout": (at("signature"), F.lit(35)), "account": (F.col("__number"), F.lit(5)),
        }
        total = sum((F.when(on, n).otherwise(0) for on, n in marks.values()), F.lit(0))
        none = F.col("header_row").isNull() | at("other")
        reasons = F.array_compact(F.array(*(F.when(on, k) for k, (on, _) in marks.items())))
        return F.struct(F.lit(i).alias("place"), F.lit(p.parser).alias("parser"), F.lit(p.institution).alias("institution"), F.when(none, 0).otherwise(F.least(F.lit(100), total)).alias("points"), reasons.alias("reasons"))

    shown = spread(files).select("file_hash", "header_row", account_number(F.col("preamble")).isNotNull().alias("__number"), *(seen(p).alias(f"__{i}") for i, p in enumerate(PROFILES)))
    every = shown.select("file_hash", F.inline(F.array(*(judged(i, p) for i, p in enumerate(PROFILES))))).where(F.col("points") >= FLOOR)
    rank = F.row_number().over(Window.partitionBy("file_hash").orderBy(F.desc("points"), "place"))
    return every.select("file_hash", "parser", "institution", "points", (F.col("points") / 100).alias("score"), rank.alias("rank"), "reasons")


def merge_roles(header: list[str], roles: dict[str, int], parser: str) -> dict[str, int]:
    """Roles that the general names left open, by the profile's own names of free columns; names must be equal."""
    out = dict(roles)
    for role, names in BY_PARSER[parser].synonyms.items():
        free = (i for n in names for i, cell in enumerate(header) if role not in out and i not in out.values() and cell == _plain_header(n))
        if role not in out and (hit := next(free, None)) is not None:
            out[role] = hit
    return out


def _plain_header(name: str) -> str:
    """``sheets.normalize_header`` of a fixed name."""
    import re
    import unicodedata

    folded = "".join(c for c in unicodedata.normalize("NFD", re.sub("[º°ª]", " ", name)) if not 0x300 <= ord(c) <= 0x36F).upper()
    return re.sub("[^A-Z0-9$]+", " ", folded).strip()


def _merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        merged = [list(merge_roles(h or [], dict(r or []), p).items()) for h, r, p in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(merged, pa.map_(pa.string(), pa.int32()))], ["file_hash", "roles"])


def described(files: DataFrame, chosen: DataFrame) -> DataFrame:
    """``layouts`` of the files with a chosen parser (file_hash, parser), with what the parser's profile adds: roles, account,
    declared currency, period and balances, whether the layout is one that can't be imported."""
    files = stored(spread(files.join(chosen.select("file_hash", "parser"), "file_hash")), "chosen")  # texts of each are read at length
    merged = files.select("file_hash", "header", "roles", "parser").mapInArrow(_merging, "file_hash string, roles map<string,int>")
    files = files.drop("roles").join(merged, "file_hash")
    text = F.col("preamble")
    line = F.transform(F.split(text, "\n"), lambda x: x)

    def period(p: Profile | None) -> Column:
        if p is None:
            return F.struct(F.regexp_extract(text, PERIOD, 1).alias("a"), F.regexp_extract(text, PERIOD, 2).alias("b"))
        hit = F.get(F.filter(line, lambda x: x.rlike(p.period)), F.lit(0))
        return F.struct(F.coalesce(F.regexp_extract(hit, p.period, 1), F.lit("")).alias("a"), F.coalesce(F.regexp_extract(hit, p.period, 2), F.lit("")).alias("b"))

    general = period(None)
    ends = general
    for p in PROFILES:
        if p.period:
            ends = F.when((general["a"] == "") & (F.col("parser") == p.parser), period(p)).otherwise(ends)
    read = lambda c: parse_date(c, "DMY")["date"]
    dates = let(ends, lambda e: F.struct(read(e["a"]).alias("from"), read(e["b"]).alias("to")))
    unsupported = F.lit(None).cast("struct<code:string,message:string>")
    for p in PROFILES:
        for header, code, message in p.unsupported:
            unsupported = F.when((F.col("parser") == p.parser) & _has_layout((header,)), F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"))).otherwise(unsupported)
    is_card = _of_parser(lambda p: F.lit(True) if p.is_card else None)
    declared = lambda pattern: F.when(~is_card, parse_amount(F.regexp_extract(text, pattern, 1), _by_parser(lambda p: p.number_format))["amount"])
    ordered = (F.col("__p.from") <= F.col("__p.to")) & ~_of_parser(lambda p: F.lit(True) if p.anchors else None)
    more = {
        "is_card": is_card, "account_number": account_number(text), "declared_currency": F.coalesce(currency_code(text), _by_parser(lambda p: p.currency)), "unsupported": unsupported,
        "declared_from": F.when(ordered, F.col("__p.from")), "declared_to": F.when(ordered, F.col("__p.to")), "declared_opening": declared(OPENING), "declared_closing": declared(CLOSING),
    }
    return files.withColumn("__p", dates).withColumns(more).drop("__p", "vocabulary", "layouts")


def _cell(role: str) -> Column:
    return F.trim(F.coalesce(F.get("cells", F.try_element_at("roles", F.lit(role))), F.lit("")))


def _has(role: str) -> Column:
    return F.coalesce(F.map_contains_key("roles", role), F.lit(False))


def _data(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows below the header, with their file's layout, the label of each, and whether it is blank or to be passed over."""
    some = files.where("header_row is not null and unsupported is null").drop("path", "kind", "preamble").withColumn("__ignored", _by_parser(lambda p: "|".join(p.ignored) or None))
    below = rows.where("cells is not null").select("file_hash", "sheet_index", "row_index", "cells", "formats").join(some, ["file_hash", "sheet_index"]).where("row_index > header_row")
    label = F.when(_cell("description") != "", _cell("description")).otherwise(F.trim(F.coalesce(F.get(F.filter("cells", lambda c: c.rlike(r"\p{L}{2,}")), F.lit(0)), F.lit(""))))
    below = below.withColumns({"label": label, "blank": ~F.exists("cells", lambda c: F.trim(c) != "")})
    own = F.coalesce(F.rlike("label", F.col("__ignored")), F.lit(False))
    return below.withColumn("passed", (F.col("label") != "") & (_any(F.col("label"), IGNORED) | own)).drop("__ignored")


def evidence(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``described`` files with what all their rows tell: currencies, order of dates, formats of columns, anchors of the period.

    Adds currency, currencies, date_order, date_source, ambiguous_dates, formats_by_role (role to number format), conflicts,
    period_from, period_to, anchor_opening and anchor_closing.
    """
    files = stored(files, "described")  # what follows reads both several times
    below = stored(_data(rows, files), "data-rows")
    moving = below.where("not blank and not passed")
    code = F.when(_cell("currency") == "$", "CLP").otherwise(F.coalesce(currency_code(_cell("currency")), F.upper(_cell("currency"))))
    named = moving.where(_cell("currency") != "").groupBy("file_hash", code.alias("code")).agg(F.min("row_index").alias("at"))
    named = named.groupBy("file_hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]).alias("currencies"))
    votes = moving.select("file_hash", F.explode(F.array(_cell("date"), _cell("posted_date"))).alias("cell")).where("cell != ''")  # others vote for nothing
    order = sheets.date_order(votes, "file_hash", "cell", "DMY").select("file_hash", "date_order", F.col("source").alias("date_source"), F.col("ambiguous_rows").alias("ambiguous_dates"))

    sheet = F.col("kind").isin("xlsx", "xls")
    facts, shown = [], []
    for role in sorted({r for p in PROFILES for r in p.formats}):
        texts = _of_parser(lambda p: _cell(role).rlike(p.format_texts[role]) if role in p.format_texts else None)  # noqa: B023
        shape = F.coalesce(F.get("formats", F.try_element_at("roles", F.lit(role))), F.lit(""))
        fit = _of_parser(lambda p: shape.isin(*p.format_shapes[role]) if role in p.format_shapes else None)  # noqa: B023
        judged = _of_parser(lambda p: F.lit(True) if role in p.format_shapes else None)  # noqa: B023
        odd = judged & (_cell(role) != "") & ~fit & ~shape.isin("", "general", "str", "text", "date")
        facts += [F.bool_or(texts).alias(f"{role}_text"), F.bool_and(F.when(_cell(role) != "", fit)).alias(f"{role}_shape"), F.min(F.when(odd, shape)).alias(f"{role}_odd")]
        wanted = _by_parser(lambda p: p.formats.get(role))  # noqa: B023
        shown.append((role, F.when(F.coalesce(F.col(f"{role}_text"), F.lit(False)) | F.coalesce(F.col(f"{role}_shape"), F.lit(False)), wanted), F.when(~F.coalesce(F.col(f"{role}_shape"), F.lit(False)), F.col(f"{role}_odd"))))
    proofs = below.groupBy("file_hash").agg(*facts)

    anchored = []
    for k, what in enumerate(("opening", "closing")):
        here = _of_parser(lambda p: F.exists("cells", lambda c: F.trim(c).rlike(p.anchors[k])) if p.anchors else None)  # noqa: B023
        for role in ("date", "balance"):
            anchored.append(F.min_by(F.when(here & (_cell(role) != ""), _cell(role)), F.when(here & (_cell(role) != ""), F.col("row_index"))).alias(f"{what}_{role}"))
    anchors = below.groupBy("file_hash").agg(*anchored)

    out = files.join(named, "file_hash", "left").join(order, "file_hash", "left").join(proofs, "file_hash", "left").join(anchors, "file_hash", "left")
    labels = _by_parser(lambda p: p.anchors and p.anchors[2])
    issue = F.lit(None).cast("date")
    for p in PROFILES:
        if p.anchors:
            issue = F.when(F.col("parser") == p.parser, parse_date(F.regexp_extract("preamble", p.anchors[2], 1))["date"]).otherwise(issue)
    out = out.withColumn("__issue", issue)
    part = lambda what, g: F.regexp_extract(F.col(f"{what}_date"), r"^(\d{1,2})[-/.](\d{1,2})$", g).try_cast("int")
    close_year = F.year("__issue")
    agree = (part("closing", 2) == F.month("__issue")) & (part("closing", 1) == F.day("__issue"))
    from_year = F.when(part("opening", 2) > part("closing", 2), close_year - 1).otherwise(close_year)
    made = lambda y, m, d: F.format_string("%04d-%02d-%02d", y, m, d).try_cast("date")
    opened = F.when(agree, made(from_year, part("opening", 2), part("opening", 1)))
    closed = F.when(agree, F.col("__issue"))
    inside = labels.isNotNull() & (opened <= closed)
    fmt = _by_parser(lambda p: p.number_format)
    known = F.map_filter(F.map_from_arrays(F.array(*(F.lit(r) for r, _, _ in shown)), F.array(*(F.when(sheet, f) for _, f, _ in shown))), lambda k, v: v.isNotNull())
    conflicts = F.array_compact(F.array(*(F.when(sheet, x) for _, _, x in shown)))
    more = {
        "currency": F.upper(F.coalesce(F.get("currencies", F.lit(0)), "declared_currency")), "currencies": F.coalesce("currencies", F.array().cast("array<string>")), "date_order": F.coalesce("date_order", F.lit("DMY")),
        "date_source": F.coalesce("date_source", F.lit("profile")), "ambiguous_dates": F.coalesce("ambiguous_dates", F.lit(0)), "formats_by_role": known, "conflicts": conflicts,
        "hint_from": F.when(inside, opened).otherwise(F.col("declared_from")), "hint_to": F.when(inside, closed).otherwise(F.col("declared_to")),
        "declared_opening": F.coalesce(parse_amount(F.col("opening_balance"), fmt)["amount"], "declared_opening"), "declared_closing": F.coalesce(parse_amount(F.col("closing_balance"), fmt)["amount"], "declared_closing"),
    }
    drop = [c for c in (*proofs.columns, *anchors.columns) if c != "file_hash"]
    return out.withColumns(more).drop("__issue", *drop)


# Movements.


def direction_of_flag(flag: Column, heading: Column) -> Column:
    """debit, credit or null: what a cell of a direction column means under its heading."""
    text, raw = normalize_description(flag), F.trim(flag)
    charges = heading.contains("CARGO") | heading.contains("ABONO")
    return (
        F.when(charges & text.rlike("^(C|CARGO|CARGOS)$"), "debit")
        .when(charges & text.rlike("^(A|AB|ABONO|ABONOS)$"), "credit")
        .when(text.rlike("^(D|DB|DEBITO|DEBE|CARGO|CARGOS)$") | (raw == "-"), "debit")
        .when(text.rlike("^(C|CR|CREDITO|H|HABER|ABONO|ABONOS|A|AB)$") | (raw == "+"), "credit")
    )


def card_last4(cell: Column, description: Column) -> Column:
    source = F.when(cell != "", cell).otherwise(description)
    marked, digits = F.regexp_extract(source, CARD_TAIL, 1), F.regexp_replace(cell, r"\D", "")
    return F.when(marked != "", marked).when(F.length(digits) >= 4, F.right(digits, F.lit(4)))


def _signed(value: Column, marker: Column) -> Column:
    return F.when(marker == "debit", -F.abs(value)).otherwise(F.abs(value))


_MARKED = ("installment_amount", "debit", "credit", "amount")
_PLAIN = ("debit", "credit", "balance")


def _amounts(below: DataFrame) -> DataFrame:
    """(__row, __m0 to __m3, __p0 to __p2): the amounts in the cells of each row, with and without markers, null where a cell is empty.

    Filled cells are rows of their own while they are read, so that one compiled chain reads all of them."""
    kinds = [*((f"__m{i}", r, True) for i, r in enumerate(_MARKED)), *((f"__p{i}", r, False) for i, r in enumerate(_PLAIN))]
    some = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(m).alias("marked"), F.col(f"__{r}").alias("text"), F.col(f"__{r}_format").alias("format")) for n, r, m in kinds))
    cells = below.select("__row", F.inline(some)).where("text != ''")
    read = with_amount(cells, "read", F.col("text"), F.col("format"), F.col("marked")).select("__row", "name", "read")
    return read.groupBy("__row").agg(*(F.max(F.when(F.col("name") == n, F.col("read"))).alias(n) for n, _, _ in kinds))


def movements(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Every row below the headers of ``evidence`` files: status mapped, skipped or failed, with its reason, and the typed movement.

    Amounts: an instalment's own column comes first, then debit and credit (both filled is a failure), then the amount with its
    marker, the direction column, or the sign that the profile gives to plain figures. Money out is negative.

    What a profile says is joined with its file. Rows are stored once; amounts are read cell by cell, dates and descriptions once for all
    rows that have them, and what is left of a row is choosing among what was read.
    """
    remaining = _of_parser(lambda p: F.get("header", F.try_element_at("roles", F.lit("installment"))).isin(*p.remaining_headers) if p.remaining_headers else None)
    told = files.withColumns(
        {
            "__omits_year": _of_parser(lambda p: F.lit(True) if p.date_omits_year else None), "__positive_is_debit": _of_parser(lambda p: F.lit(True) if p.amount_sign == "debit-positive" else None), "__remaining": remaining,
            "institution": _by_parser(lambda p: p.institution), "__format": _by_parser(lambda p: p.number_format), "heading": F.coalesce(F.get("header", F.try_element_at("roles", F.lit("direction_flag"))), F.lit("")),
        }
    )
    formatted = lambda role: F.coalesce(F.try_element_at("formats_by_role", F.lit(role)), F.col("__format"))
    below = _data(rows, stored(told, "told")).withColumns(
        {
            **{f"__{r}": _cell(r) for r in (*_MARKED, "balance", "date", "posted_date", "description", "installment", "direction_flag", "card", "reference", "operation_type")},
            **{f"__has_{r}": _has(r) for r in ("debit", "credit", "installment_amount")}, **{f"__{r}_format": formatted(r) for r in (*_MARKED, "balance")},
            "__from": F.when(F.col("__omits_year"), F.col("hint_from")), "__to": F.when(F.col("__omits_year"), F.col("hint_to")),
            "raw": F.map_filter(F.map_from_entries(F.transform(F.map_entries("roles"), lambda e: F.struct(e["key"], F.left(F.trim(F.coalesce(F.get("cells", e["value"]), F.lit(""))), F.lit(200)).alias("value")))), lambda k, v: v != ""),
        }
    )
    kept = ["file_hash", "parser", "account_number", "row_index", "currency", "is_card", "date_order", "blank", "passed", "institution", "heading", "raw"]
    below = stored(below.select(*kept, *(c for c in below.columns if c.startswith("__"))), "below").withColumn("__row", F.monotonically_increasing_id())
    read = below.join(_amounts(below), "__row", "left")
    day = lambda c: lambda df: df.withColumn(f"{c}_read", F.when(F.col(c) != "", parse_date(F.col(c), F.col("date_order"), F.col("__from"), F.col("__to"))))
    for c in ("__date", "__posted_date"):
        read = once_per(read, [c, "date_order", "__from", "__to"], day(c))
    told_by = {"__normalized": normalize_description(F.col("__description")), "__installment_read": installment(F.col("__description"), F.col("__installment"), F.col("is_card")), "__last4": card_last4(F.col("__card"), F.col("__description")), "__left": remaining_installments(F.col("__installment"))}
    kind = lambda df, way: df.withColumn("direction", F.lit(way)).withColumn(f"__kind_{way}", default_kind(F.col("__normalized"), F.col("is_card"))).drop("direction")
    read = once_per(read, ["__description", "__installment", "__card", "is_card"], lambda df: kind(kind(df.withColumns(told_by), "out"), "in"))
    read = once_per(read, ["__direction_flag", "heading"], lambda df: df.withColumn("__flagged", direction_of_flag(F.col("__direction_flag"), F.col("heading"))))

    marked = {r: F.col(f"__m{i}") for i, r in enumerate(_MARKED)}
    plain = {r: F.col(f"__p{i}") for i, r in enumerate(_PLAIN)}
    has = lambda role: F.col(f"__has_{role}")
    text = lambda r: F.col(f"__{r}")
    there = lambda r: ~text(r).isin("", "-") & (marked[r]["error"].isNotNull() | (marked[r]["amount"] != 0))
    content = there("installment_amount") | there("debit") | there("credit") | there("amount")
    given = lambda r: ~text(r).isin("", "-", "0")
    side = lambda r: F.when(given(r), plain[r]["amount"])
    nonzero = lambda r: F.coalesce(side(r) != 0, F.lit(False))
    positive_is_debit = F.col("__positive_is_debit")
    own = text("installment_amount") != ""
    sides = has("debit") | has("credit")
    bad_side = (given("debit") & plain["debit"]["error"].isNotNull()) | (given("credit") & plain["credit"]["error"].isNotNull())
    column = lambda r: F.when(marked[r]["explicit_sign"].isNotNull(), _signed(marked[r]["amount"], marked[r]["explicit_sign"]))
    by_default = lambda r: F.when(positive_is_debit, -marked[r]["amount"]).otherwise(marked[r]["amount"])
    flagged = F.col("__flagged")
    unmarked = marked["amount"]["explicit_sign"].isNull()
    from_sides = sides & (nonzero("debit") | nonzero("credit"))
    value = (
        F.when(own, F.coalesce(column("installment_amount"), by_default("installment_amount")))
        .when(from_sides, F.when(nonzero("debit"), -F.abs(side("debit"))).otherwise(F.abs(side("credit"))))
        .otherwise(F.coalesce(column("amount"), F.when(text("direction_flag") != "", _signed(marked["amount"]["amount"], flagged)).otherwise(by_default("amount"))))
    )
    failure = (
        F.when(text("date") == "", "missing-date")
        .when((text("date") != "") & F.col("__date_read.error").isNotNull(), "unreadable-date")
        .when(text("description") == "", "missing-description")
        .when(own, F.when(marked["installment_amount"]["error"].isNotNull(), "unreadable-amount"))
        .when(sides & bad_side, "unreadable-amount")
        .when(sides & nonzero("debit") & nonzero("credit"), "debit-and-credit")
        .when(from_sides, None)
        .when(text("amount") == "", "missing-amount")
        .when(marked["amount"]["error"].isNotNull(), "unreadable-amount")
        .when(unmarked & (text("direction_flag") != "") & flagged.isNull(), "unknown-direction")
    )
    skipped = F.col("blank") | F.col("passed") | ~content | ((text("date") == "") & (text("description") == ""))
    read = read.withColumns({"__skipped": skipped, "failure": F.when(~skipped, failure)})
    ok = ~F.col("__skipped") & F.col("failure").isNull()
    read = read.withColumns({"status": F.when(F.col("__skipped"), "skipped").when(F.col("failure").isNotNull(), "failed").otherwise("mapped"), "amount": amount(F.when(ok, value)), "__ok": ok})
    when = lambda c: F.when(F.col("__ok"), c)
    read = read.withColumns({"direction": when(F.when(F.col("amount") < 0, "out").otherwise("in")), "installment": when(F.col("__installment_read")), "__kind": when(F.when(F.col("amount") < 0, F.col("__kind_out")).otherwise(F.col("__kind_in")))})
    plan = F.col("installment").isNotNull()
    ambiguous = F.when(own, False).when(sides & (F.coalesce(plain["debit"]["ambiguous"] & given("debit"), F.lit(False)) | F.coalesce(plain["credit"]["ambiguous"] & given("credit"), F.lit(False))), True).when(from_sides, False).otherwise(F.coalesce(marked["amount"]["ambiguous"], F.lit(False)))
    warnings = {
        "unparsed-column": (text("posted_date") != "") & F.col("__posted_date_read.error").isNotNull(), "ambiguous-amount-format": ambiguous, "zero-amount": F.col("amount") == 0,
        "ambiguous-installment": F.col("installment.confidence") == "suggested", "ambiguous-installment-amount": plan & ~has("installment_amount"), "ambiguous-card-credit": F.col("__kind.ambiguous_card_credit"),
    }
    tail = lambda role: F.when(text(role) != "", text(role))
    return read.select(
        "file_hash", "parser", "institution", "account_number", (F.col("row_index") + 1).alias("source_line"), "status", "failure",
        F.when(F.col("failure").isNotNull(), F.concat(F.lit("Fila "), F.col("row_index") + 1, F.lit(": "), F.element_at(F.create_map(*(F.lit(x) for kv in FAILURES.items() for x in kv)), F.col("failure")))).alias("failure_text"),
        when(F.col("__date_read.date")).alias("date"), when(F.col("__posted_date_read.date")).alias("posted_date"), when(text("description")).alias("description"), when(F.col("__normalized")).alias("normalized_description"), "amount", "currency", "direction",
        when(F.when(text("balance") != "", plain["balance"]["amount"])).cast(AMOUNT).alias("balance_after"), when(tail("reference")).alias("reference"), when(tail("operation_type")).alias("operation_type"),
        when(F.col("__last4")).alias("card_last4"), F.col("__kind.kind").alias("kind"), F.col("__kind.confidence").alias("kind_confidence"), "installment",
        when(F.when(~plan & F.col("__remaining"), F.col("__left"))).alias("installment_remaining"),
        when(F.array_compact(F.array(*(F.when(c, k) for k, c in warnings.items())))).alias("warnings"), when(F.col("raw")).alias("raw"),
    )


# Statements.


def ledger_ends(mapped: DataFrame) -> DataFrame:
    """(file_hash, order, derived_opening, derived_closing): balances that follow from the first and last movement, in the order of
    time, where dates tell that order and the end's day has no other row in a file printed backwards."""
    order = balances.ledger_order(mapped, "file_hash", "source_line")
    w = Window.partitionBy("file_hash").orderBy("source_line")
    near = mapped.select("file_hash", "source_line", F.struct("amount", "balance_after", "date", F.lag("date").over(w).alias("before"), F.lead("date").over(w).alias("after")).alias("m"))
    ends = near.groupBy("file_hash").agg(F.min_by("m", "source_line").alias("top"), F.max_by("m", "source_line").alias("end"), F.count(F.lit(1)).alias("n")).join(order, "file_hash")
    single, up, down = F.col("n") == 1, F.col("order") == "ascending", F.col("order") == "descending"
    opening = F.when(up | single, F.col("top.balance_after") - F.col("top.amount")).when(down & ~F.col("end.date").eqNullSafe(F.col("end.before")), F.col("end.balance_after") - F.col("end.amount"))
    closing = F.when(up | single, F.col("end.balance_after")).when(down & ~F.col("top.date").eqNullSafe(F.col("top.after")), F.col("top.balance_after"))
    return ends.select("file_hash", F.when(single, "ascending").otherwise(F.col("order")).alias("order"), opening.cast(AMOUNT).alias("derived_opening"), closing.cast(AMOUNT).alias("derived_closing"))


def statements(rows: DataFrame, files: DataFrame, moved: DataFrame) -> DataFrame:
    """A row for each of the ``evidence`` files: counts of rows, period, balances with their sources, checks, and whether it is valid.

    moved: ``movements`` of these files, stored if they are used again. issues: codes by level; errors make a file invalid.
    """
    mapped = moved.where("status = 'mapped'")
    count = moved.groupBy("file_hash").agg(
        F.count(F.lit(1)).alias("data_rows"), F.count_if(F.col("status") == "mapped").alias("mapped"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum("amount").cast("decimal(38,6)").alias("movements"), F.count_if(F.array_contains("warnings", "ambiguous-amount-format")).alias("ambiguous_amounts"),
        F.count_distinct("date").alias("days"),
    )
    out = files.join(count, "file_hash", "left").fillna(0, ["data_rows", "mapped", "skipped", "failed", "ambiguous_amounts"]).join(ledger_ends(mapped), "file_hash", "left")
    clean = F.col("failed") == 0
    out = out.withColumns({c: F.when(clean, F.col(c)) for c in ("derived_opening", "derived_closing")})
    both = F.col("hint_from").isNotNull() & F.col("hint_to").isNotNull()
    out = out.withColumns(
        {
            "period_from": F.when(both, F.col("hint_from")).otherwise(F.coalesce("hint_from", "first_date")), "period_to": F.when(both, F.col("hint_to")).otherwise(F.coalesce("hint_to", "last_date")),
            "opening": F.coalesce("derived_opening", "declared_opening"), "closing": F.coalesce("derived_closing", "declared_closing"),
            "opening_source": F.when(F.col("derived_opening").isNotNull(), "derived").when(F.col("declared_opening").isNotNull(), "declared"),
            "closing_source": F.when(F.col("derived_closing").isNotNull(), "derived").when(F.col("declared_closing").isNotNull(), "declared"),
        }
    )
    # The walk goes in the order of time, from the opening balance where that was declared.
    turned = mapped.select("file_hash", "source_line", "amount", "balance_after").join(out.select("file_hash", "order").where("order != 'unknown'"), "file_hash")
    turned = turned.select("file_hash", F.when(F.col("order") == "descending", -F.col("source_line")).otherwise(F.col("source_line")).alias("line"), "amount", "balance_after")
    start = out.where("opening_source = 'declared' and order != 'unknown'").select("file_hash", F.lit(-(1 << 31)).cast("int").alias("line"), F.lit(0).cast(AMOUNT).alias("amount"), F.col("opening").cast(AMOUNT).alias("balance_after"))
    out = out.join(balances.walk(turned.unionByName(start), "file_hash"), "file_hash", "left")
    off = F.coalesce(F.col("mismatches") > 0, F.lit(False))
    total_off = (F.col("opening_source") == "declared") | (F.col("closing_source") == "declared")
    total_off = total_off & clean & (F.col("opening") + F.coalesce("movements", F.lit(0)) != F.col("closing"))
    disagree = lambda end: F.col(f"derived_{end}") != F.col(f"declared_{end}")
    strict, sure = _of_parser(lambda p: F.lit(True) if p.balance_check == "authoritative" else None), _of_parser(lambda p: F.lit(True) if p.verified else None)
    doubtful = _of_parser(lambda p: F.lit(True) if p.ambiguous_is_error else None)
    found = {
        "multiple-sheets": ("warning", F.col("sheets") > 1), "no-header": ("error", F.col("header_row").isNull()), "mixed-currency": ("error", F.size("currencies") > 1), "spreadsheet-number-format-conflict": ("error", F.size("conflicts") > 0),
        "date-order-differs": ("warning", (F.col("date_source") == "file") & (F.col("date_order") != "DMY")), "date-order-conflict": ("warning", F.col("date_source") == "conflict"), "ambiguous-date-order": ("warning", (F.col("date_source") == "profile") & (F.col("ambiguous_dates") > 0)),
        "row-parse-failed": ("error", F.col("failed") > 0), "profile-unverified": ("warning", ~sure), "no-transactions": ("error", (F.col("mapped") == 0) & F.col("unsupported").isNull() & F.col("header_row").isNotNull()),
        "balance-declared-mismatch": ("warning", disagree("opening") | disagree("closing")), "balance-order-ambiguous": ("info", (F.col("order") == "unknown") & (F.col("days") == 1)), "balance-walk-skipped": ("info", (F.col("order") == "unknown") & (F.col("days") > 1)),
        "balance-walk-systematic": ("error", F.col("systematic")), "balance-total-mismatch": ("warning", total_off),
    }
    issues = [F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for code, (level, on) in found.items()]
    level = lambda hard: F.when(hard, "error").otherwise("warning")
    issues.append(F.when(off & ~F.col("systematic"), F.struct(level(strict).alias("level"), F.lit("balance-walk-mismatch").alias("code"))))
    issues.append(F.when(F.col("ambiguous_amounts") > 0, F.struct(level(doubtful).alias("level"), F.lit("ambiguous-amount-format").alias("code"))))
    issues.append(F.when(F.col("unsupported").isNotNull(), F.struct(F.lit("error").alias("level"), F.col("unsupported.code").alias("code"))))
    out = out.withColumn("issues", F.array_compact(F.array(*issues)))
    return out.select(
        "file_hash", "path", "parser", _by_parser(lambda p: p.institution).alias("institution"), "account_number", "currency", "period_from", "period_to", "opening", "opening_source", "closing", "closing_source", "order",
        "data_rows", "mapped", "skipped", "failed", F.when(F.col("steps") > 0, ~off).alias("balance_reconciles"), ((F.col("mapped") > 0) & ~F.exists("issues", lambda i: i["level"] == "error")).alias("ok"), "issues",
    )


def match_accounts(found: DataFrame, accounts: DataFrame, least: int = 4, most: int = 8) -> DataFrame:
    """(file_hash, account_id, verdict, reasons): how each statement goes with each account of ``accounts`` (id, account_type, currency,
    account_number) that it is checked against; pairs come with ``found`` as account_id.

    Another currency blocks. Account numbers are compared by their last digits, ``least`` to ``most`` of them: equal confirms,
    different blocks. A product that isn't the account's type is a warning.
    """
    digits = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    both = found.join(accounts.select(F.col("id").alias("account_id"), "account_type", F.col("currency").alias("own_currency"), F.col("account_number").alias("own_number")), "account_id")
    mine, theirs = digits(F.col("own_number")), digits(F.col("account_number"))
    n = F.least(F.length(mine), F.length(theirs), F.lit(most))
    known = n >= least
    same = F.right(mine, n) == F.right(theirs, n)
    card = _of_parser(lambda p: F.lit(True) if p.is_card else None)
    odd = (card & (F.col("account_type") != "CREDIT_CARD")) | (~card & (F.col("account_type") == "CREDIT_CARD"))
    other = F.upper("own_currency") != F.upper("currency")
    reasons = F.array_compact(F.array(F.when(other, "currency"), F.when(known & ~same, "number-differs"), F.when(known & same, "number-equal"), F.when(odd, "product")))
    verdict = F.when(other | known & ~same, "blocked").when(odd, "warning").when(known & same, "confirmed").otherwise("unknown")
    return both.select("file_hash", "account_id", verdict.alias("verdict"), reasons.alias("reasons"))
