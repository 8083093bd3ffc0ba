"""Statement files as sheets of text cells, and what their columns mean.

``read_sheets`` turns files into one row per sheet row; everything after is DataFrame work over all files at once. Files are read whole
and with all their rows, since each has its own encoding, delimiter and quoting; Spark spreads the files over tasks. A file over the size
limit is one row with an error, like any other that can't be read.
"""

from __future__ import annotations

import csv
import hashlib
import io
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyspark.functions.dates import parse_date
from tallyspark.functions.text import fold_case, may_hold
from tallyspark.sources.xlsx import read_xlsx

MOST_BYTES = 10 << 20
#: Rows of a sheet that the XLSX format has room for: a file that names one below is broken.
MOST_ROWS = 1 << 20
DELIMITERS = (";", ",", "\t", "|")
SHEETS = "path string, file_hash string, kind string, sheet_index int, sheet string, row_index int, cells array<string>, formats array<string>, error string"


def file_kind(content: bytes, path: str) -> str:
    """xlsx, xls, csv, delimited or unsupported: by the first bytes, then the extension, then whether it looks like text."""
    extension = path.rpartition(".")[2].lower()
    if content[:2] == b"PK" and len(content) > 4:
        return "xlsx"
    if content[:4] == b"\xd0\xcf\x11\xe0" and len(content) > 8:
        return "xls"
    if extension == "csv":
        return "csv"
    if extension in ("txt", "tsv", "xls", "xlsx"):
        return "delimited"
    sample = content[:512]
    odd = sum(x < 32 and x not in (9, 10, 11, 12, 13) for x in sample)
    text = 0 not in sample and odd < 0.05 * max(1, len(sample))
    return "delimited" if text and extension != "pdf" else "unsupported"


def decode_text(data: bytes) -> str:
    """UTF-8, with or without a mark; what isn't is windows-1252."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def delimiter_of(text: str) -> str:
    """The sign under which most of the first forty lines have the same number of fields; more fields win ties."""
    lines = [x for x in text.splitlines() if x.strip()][:40]
    best, most = ";", -1
    for d in DELIMITERS:
        widths = Counter(n for x in lines if (n := len(next(csv.reader([x], delimiter=d), []))) > 1)
        if widths:
            columns, count = max(widths.items(), key=lambda x: (x[1], x[0]))
            if count * 1000 + columns > most:
                best, most = d, count * 1000 + columns
    return best


def read_delimited(text: str) -> list[list[str]]:
    rows = []
    for row in csv.reader(io.StringIO(text.replace("\r\n", "\n").replace("\r", ""), newline=""), delimiter=delimiter_of(text)):
        rows.append([c.strip() for c in row] or [""])
    while rows and not any(rows[-1]):
        rows.pop()
    return rows


def file_rows(path: str, content: bytes, most_bytes: int = MOST_BYTES) -> Iterator[tuple]:
    """The rows of one file, as SHEETS; one row with an error if it can't be read or is over the size limit."""
    mark, kind = hashlib.sha256(content).hexdigest(), file_kind(content, path)
    try:
        if len(content) > most_bytes:
            raise ValueError(f"file of {len(content)} bytes is over the limit of {most_bytes}")
        if kind == "xlsx":
            sheets = read_xlsx(content, MOST_ROWS)
        elif kind in ("csv", "delimited"):
            found = read_delimited(decode_text(content))
            sheets = [("", found, [[""] * len(r) for r in found])]
        else:
            raise ValueError(f"unsupported file: {kind}")
    except Exception as e:  # one bad file is an issue, not the end of the job
        yield (path, mark, kind, None, None, None, None, None, str(e) or type(e).__name__)
        return
    for i, (name, found, shapes) in enumerate(sheets):
        for j, (cells, formats) in enumerate(zip(found, shapes, strict=True)):
            yield (path, mark, kind, i, name, j, cells, formats, None)


def sheets_of(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """All rows of all sheets of ``files`` (path, content); extra columns play no part. A null content is an empty file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
        names = [x.split()[0] for x in SHEETS.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = file_rows(path.as_py() or "", content.as_py() or b"", most_bytes)
                while some := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some, strict=True), kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, SHEETS)


def read_sheets(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """All rows of all sheets of the files under ``path``, in any store that Spark reads; a file that can't be read, or is over the size
    limit, is one row with an error."""
    files = spark.read.format("binaryFile").load(path)
    over = files.where(F.col("length") > most_bytes).select("path", F.format_string(f"file of %d bytes is over the limit of {most_bytes}", "length").alias("error"))
    return sheets_of(files.where(F.col("length") <= most_bytes), most_bytes).unionByName(over, allowMissingColumns=True)


class _File(InputPartition):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size


class _Files(DataSourceReader):
    def __init__(self, options) -> None:  # names in any case
        self.path, self.most_bytes = options["path"], int(options.get("mostBytes", MOST_BYTES))

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = [info for info in store.get_file_info(fs.FileSelector(root, recursive=True)) if info.is_file]
        return [_File(i.path, i.size) for i in sorted(found, key=lambda i: i.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        from pyarrow import fs

        if partition.size > self.most_bytes:
            error = f"file of {partition.size} bytes is over the limit of {self.most_bytes}"
            yield (partition.path, None, None, None, None, None, None, None, error)
            return
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        with store.open_input_stream(partition.path) as stream:
            yield from file_rows(partition.path, stream.read(), self.most_bytes)


class SheetFiles(DataSource):
    """``spark.read.format("sheets").load(folder)``: a task for each file, rows as they are read. For stores that pyarrow opens; ``read_sheets``
    reads from all that Spark does. Register with ``spark.dataSource.register(SheetFiles)``; option ``mostBytes`` is the size limit."""

    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> str:
        return SHEETS

    def reader(self, schema) -> _Files:
        return _Files(self.options)


def data_sheets(rows: DataFrame) -> DataFrame:
    """Rows of each file's data sheet: that with the most cells, the first of equals."""
    size = rows.groupBy("file_hash", "sheet_index").agg((F.count(F.lit(1)) * F.max(F.size("cells"))).alias("size"))
    best = size.groupBy("file_hash").agg(F.max_by("sheet_index", F.struct("size", -F.col("sheet_index"))).alias("sheet_index"))
    return rows.join(best, ["file_hash", "sheet_index"])


def normalize_header(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold_case(F.regexp_replace(F.coalesce(c, F.lit("")), "[º°ª]", " ")), "[^A-Z0-9$]+", " "))


# Roles in order, with the names that columns of each have.
ROLES = {
    "date": ("FECHA", "FECHA TRANSACCION", "FECHA DE TRANSACCION", "FECHA MOVIMIENTO", "FECHA OPERACION", "FECHA COMPRA", "FECHA TRX", "DATE"),
    "posted_date": ("FECHA CONTABLE", "FECHA DE CONTABILIZACION", "FECHA PROCESO", "FECHA ABONO", "FECHA CARGO", "POSTED DATE"),
    "description": ("DESCRIPCION", "DESCRIPCION MOVIMIENTO", "DETALLE", "DETALLE MOVIMIENTO", "GLOSA", "CONCEPTO", "MOVIMIENTO", "COMERCIO", "DESCRIPTION"),
    "amount": ("MONTO", "MONTO TRANSACCION", "MONTO MOVIMIENTO", "MONTO OPERACION", "IMPORTE", "VALOR", "MONTO $", "AMOUNT"),
    "installment_amount": ("VALOR CUOTA", "MONTO CUOTA", "VALOR DE LA CUOTA", "MONTO DE LA CUOTA", "CUOTA MENSUAL"),
    "purchase_amount": ("MONTO TOTAL", "MONTO COMPRA", "MONTO ORIGINAL", "VALOR COMPRA", "MONTO OPERACION ORIGINAL"),
    "debit": ("CARGO", "CARGOS", "DEBITO", "DEBE", "GIRO", "GIROS", "MONTO CARGO", "DEBIT"),
    "credit": ("ABONO", "ABONOS", "CREDITO", "HABER", "DEPOSITO", "DEPOSITOS", "MONTO ABONO", "CREDIT"),
    "balance": ("SALDO", "SALDO CONTABLE", "SALDO DISPONIBLE", "SALDO FINAL", "BALANCE"),
    "reference": ("N DOCUMENTO", "NRO DOCUMENTO", "NUMERO DOCUMENTO", "DOCUMENTO", "N OPERACION", "NRO OPERACION", "FOLIO", "REFERENCIA", "ID TRANSACCION", "CODIGO", "REFERENCE"),
    "operation_type": ("TIPO", "TIPO MOVIMIENTO", "TIPO TRANSACCION", "TIPO OPERACION", "CANAL"),
    "currency": ("MONEDA", "DIVISA", "CURRENCY"),
    "installment": ("CUOTA", "CUOTAS", "N CUOTAS", "NRO CUOTA", "CUOTA DE"),
    "card": ("TARJETA", "N TARJETA", "NUMERO TARJETA", "CARD"),
    "category": ("CATEGORIA", "RUBRO", "CATEGORY"),
    "direction_flag": ("TIPO CARGO ABONO", "CARGO ABONO", "D C", "DEBE HABER"),
}


def map_columns(header: list[str]) -> dict[str, int]:
    """Role to column of one normalised header row. Three passes, equal, beginning and containing names; each column has one role."""
    found: dict[str, int] = {}
    tests = (lambda cell, name: cell == name, lambda cell, name: cell.startswith(name), lambda cell, name: name in cell)
    for test in tests:
        for role, names in ROLES.items():
            if role not in found:
                free = ((i, n) for n in names for i, cell in enumerate(header) if cell and i not in found.values() and test(cell, n))
                if (hit := next(free, None)) is not None:
                    found[role] = hit[0]
    if "date" not in found and "posted_date" in found:
        found["date"] = found.pop("posted_date")
    return found


def is_header(roles: dict[str, int]) -> bool:
    return {"date", "description"} <= roles.keys() and not roles.keys().isdisjoint(("amount", "installment_amount", "purchase_amount", "debit", "credit"))


def header_rows(rows: DataFrame, within: int = 30) -> DataFrame:
    """(file_hash, sheet_index, row_index, header, roles) of the rows that name a date, a description and an amount."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = [map_columns(h) for h in batch.column(3).to_pylist()]
            keep = [i for i, r in enumerate(roles) if is_header(r)]
            some = batch.take(pa.array(keep, pa.int64()))
            maps = pa.array([list(roles[i].items()) for i in keep], pa.map_(pa.string(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*some.columns, maps], [*some.schema.names, "roles"])

    # Every header names a date: rows without the first word of such a name are passed over before anything is folded, which is most.
    dates = {n.split()[0] for r in ("date", "posted_date") for n in ROLES[r]}
    some = rows.where((F.col("row_index") < within) & may_hold(F.array_join("cells", " "), sorted(dates)))
    named = some.select("file_hash", "sheet_index", "row_index", F.transform("cells", normalize_header).alias("header"))
    # A header holds a name of each kind somewhere; few other rows do, so few are read by name. One pattern asks for all kinds: Spark
    # would fold every row's cells ahead of the whole condition if it named them more than once.
    a_name = lambda *roles: rf"(?=[\s\S]*(?:{'|'.join(re.escape(n) for r in roles for n in ROLES[r])}))"
    kinds = a_name("date", "posted_date") + a_name("description") + a_name("amount", "installment_amount", "purchase_amount", "debit", "credit")
    named = named.where(F.array_join("header", "\n").rlike(rf"\A{kinds}"))
    return named.mapInArrow(run, "file_hash string, sheet_index int, row_index int, header array<string>, roles map<string,int>")


def headers(rows: DataFrame, within: int = 30) -> DataFrame:
    """(file_hash, header_row, roles) of the first row of each file that names a date, a description and an amount."""
    return header_rows(rows, within).groupBy("file_hash").agg(F.min("row_index").alias("header_row"), F.min_by("roles", "row_index").alias("roles"))


def records(rows: DataFrame) -> DataFrame:
    """Rows below each file's header with a column per role: null where the file has no such column."""
    data = rows.join(headers(rows), "file_hash").where((F.col("row_index") > F.col("header_row")) & F.exists("cells", lambda c: c != ""))
    return data.select("path", "file_hash", F.col("row_index").alias("source_line"), *(F.trim(F.get("cells", F.element_at("roles", role))).alias(role) for role in ROLES))


_TIME = r"(?i)[T\s]+\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AP]M)?.*$"


def date_order(rows: DataFrame, file: str, cell: str, declared: str) -> DataFrame:
    """(file, date_order, source, ambiguous_rows): a field over 12 proves that it is the day; proofs of both are a conflict."""
    shape = r"^(\d{1,2})[-/.](\d{1,2})(?:[-/.]\d{2,4})?$"
    text = F.trim(F.regexp_replace(F.trim(F.col(cell)), _TIME, ""))
    a, b = (F.regexp_extract("__text", shape, g).try_cast("int") for g in (1, 2))
    some = rows.select(file, text.alias("__text")).select(file, a.alias("a"), b.alias("b")).groupBy(file).agg(
        F.coalesce(F.bool_or((F.col("a") > 12) & (F.col("b") <= 12)), F.lit(False)).alias("dmy"),
        F.coalesce(F.bool_or((F.col("b") > 12) & (F.col("a") <= 12)), F.lit(False)).alias("mdy"),
        F.count_if((F.col("a") <= 12) & (F.col("b") <= 12) & (F.col("a") != F.col("b"))).alias("n"),
    )
    both, one = F.col("dmy") & F.col("mdy"), F.col("dmy") != F.col("mdy")
    order = F.when(both, declared).when(F.col("dmy"), "DMY").when(F.col("mdy"), "MDY").otherwise(declared)
    source = F.when(both, "conflict").when(one, "file").otherwise("profile")
    return some.select(file, order.alias("date_order"), source.alias("source"), F.when(one, 0).otherwise(F.col("n")).alias("ambiguous_rows"))


def cell_shape(c: Column) -> Column:
    """currency, short, medium or long integer, decimal, date, text or other: what a cell looks like; null if it is blank."""
    text = F.trim(c)
    digits = text.rlike(r"^[0-9]+$")
    return (
        F.when(text == "", None)
        .when(text.rlike(r"^[A-Z]{3}$") | text.rlike(r"(?i)^(?:\$|US\$|USD|EUR|€)$"), "currency")
        .when(digits, F.when(F.length(text) <= 2, "short-integer").when(F.length(text) <= 4, "medium-integer").otherwise("long-integer"))
        .when(text.rlike(r"^[-+]?\$?\s*[0-9][0-9.,]*$") & text.rlike("[.,]"), "decimal")
        .when(parse_date(text)["error"].isNull(), "date")
        .when(text.rlike("[a-zA-Zà-ÿ]"), "text")
        .otherwise("other")
    )


def column_shapes(rows: DataFrame, file: str, column: str, cell: str) -> DataFrame:
    """(file, column, shape): what the cells of a column look like, ``mixed`` if they differ, ``empty`` if all are blank."""
    some = rows.select(file, column, cell_shape(F.col(cell)).alias("s")).groupBy(file, column).agg(F.min("s").alias("a"), F.max("s").alias("b"))
    return some.select(file, column, F.when(F.col("a").isNull(), "empty").when(F.col("a") == F.col("b"), F.col("a")).otherwise("mixed").alias("shape"))


def rectangular(rows: DataFrame) -> DataFrame:
    """Rows with as many cells as the widest of their sheet; those added are empty."""
    wide = rows.where("cells is not null").groupBy("file_hash", "sheet_index").agg(F.max(F.size("cells")).alias("__wide"))
    joined = rows.join(wide, ["file_hash", "sheet_index"])
    more = F.greatest(F.col("__wide") - F.size("cells"), F.lit(0))
    return joined.withColumn("cells", F.concat("cells", F.array_repeat(F.lit(""), more))).select(rows.columns)


def last_seen(rows: DataFrame, group: str, line: str, mark: Column) -> Column:
    """The last mark at or above each row of its group."""
    return F.last(mark, True).over(Window.partitionBy(group).orderBy(line).rowsBetween(Window.unboundedPreceding, 0))
