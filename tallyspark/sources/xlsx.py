"""Cells of XLSX workbooks as text, with the shape of each cell's number format. Standard library only."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from xml.etree import ElementTree as X
from xml.sax.saxutils import escape, quoteattr

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in formats that show dates, and those that show numbers.
_DATES = frozenset([*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)])
_BUILTIN = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 49: "@"}


def format_shape(code: str) -> str:
    """general, text, date, integer, decimal, grouped-integer, grouped-decimal, percent or unknown. Scaling commas are unknown."""
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.', "", code.split(";")[0]).strip()
    if bare in ("", "General"):
        return "general"
    if bare == "@":
        return "text"
    if re.search(r"[ymdhs]", bare, re.I):
        return "date"
    number = re.sub(r"[^#0?.,%]", "", bare)
    if not number or number.rstrip("%").endswith(","):
        return "unknown"
    if "%" in number:
        return "percent"
    whole, dot, _ = number.partition(".")
    return ("grouped-" if "," in whole else "") + ("decimal" if dot else "integer")


def _texts(element: X.Element) -> str:
    return "".join(t.text or "" for t in element.iter(_M + "t"))


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _shown(value: str, shape: str) -> str:
    if shape == "date":
        day = dt.datetime(1899, 12, 30) + dt.timedelta(days=float(value))
        return day.strftime("%Y-%m-%d" if day.time() == dt.time() else "%Y-%m-%d %H:%M:%S")
    number = float(value)
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)


def read_xlsx(content: bytes, most_rows: int) -> list[tuple[str, list[list[str]], list[list[str]]]]:
    """(name, rows of text, rows of format shapes) of every sheet; a row beyond ``most_rows`` is an error, nothing is cut off."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        read = lambda name: X.fromstring(z.read(name))
        names = set(z.namelist())
        shared = [_texts(s) for s in read("xl/sharedStrings.xml").iter(_M + "si")] if "xl/sharedStrings.xml" in names else []
        shapes = ["general"]
        if "xl/styles.xml" in names:
            styles = read("xl/styles.xml")
            codes = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(_M + "numFmt")}
            ids = [int(x.get("numFmtId", 0)) for xfs in styles.iter(_M + "cellXfs") for x in xfs]
            shapes = ["date" if i in _DATES else format_shape(codes.get(i, _BUILTIN.get(i, ""))) if i in codes or i in _BUILTIN else "unknown" for i in ids] or shapes
        links = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
        out = []
        for sheet in read("xl/workbook.xml").iter(_M + "sheet"):
            target = links[sheet.get(_R)].lstrip("/")
            target = target if target.startswith("xl/") else f"xl/{target}"
            rows: list[list[str]] = []
            kinds: list[list[str]] = []
            for row in read(target).iter(_M + "row"):
                at = int(row.get("r", len(rows) + 1)) - 1
                if at >= most_rows:
                    raise ValueError(f"sheet {sheet.get('name', '')}: row {at + 1} is beyond the limit of {most_rows} rows")
                while len(rows) <= at:
                    rows.append([])
                    kinds.append([])
                for i, cell in enumerate(row.iter(_M + "c")):
                    column = _column(cell.get("r")) if cell.get("r") else i
                    shape = shapes[min(int(cell.get("s", 0)), len(shapes) - 1)]
                    value = cell.findtext(_M + "v") or ""
                    kind = cell.get("t", "n")
                    if kind == "s":
                        text = shared[int(value)] if value else ""
                    elif kind == "inlineStr":
                        text = _texts(cell)
                    elif kind == "b":
                        text = "TRUE" if value == "1" else "FALSE"
                    else:
                        text = _shown(value, shape) if kind == "n" and value else value
                    for filled in (rows[at], kinds[at]):
                        filled.extend([""] * (column + 1 - len(filled)))
                    rows[at][column], kinds[at][column] = text.strip(), shape if kind == "n" else kind
            width = max((len(r) for r in rows), default=0)
            for r in (*rows, *kinds):
                r.extend([""] * (width - len(r)))
            while rows and not any(rows[-1]):
                rows.pop()
                kinds.pop()
            out.append((sheet.get("name", ""), rows, kinds))
        return out


def workbook(sheets: dict[str, list[list]], formats: list[int]) -> bytes:
    """A workbook with the given rows a sheet: numbers as numbers, in the built-in format of their column, texts as shared strings."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared: dict[str, int] = {}
    files, names, links = {}, "", ""
    for k, (name, rows) in enumerate(sheets.items(), 1):
        data = ""
        for r, row in enumerate(rows, 1):
            cells = ""
            for c, value in enumerate(row):
                at = f"{chr(65 + c)}{r}"  # up to 26 columns
                if isinstance(value, str):
                    cells += f'<c r="{at}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>'
                else:
                    cells += f'<c r="{at}" s="{c + 1}"><v>{value!r}</v></c>'
            data += f'<row r="{r}">{cells}</row>' if row else ""
        files[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet {main}><sheetData>{data}</sheetData></worksheet>"
        names += f'<sheet name={quoteattr(name)} sheetId="{k}" r:id="r{k}"/>'
        links += f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>'
    files["xl/workbook.xml"] = f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>'
    files["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>'
    files["xl/sharedStrings.xml"] = f"<sst {main}>{''.join(f'<si><t>{escape(t)}</t></si>' for t in shared)}</sst>"
    files["xl/styles.xml"] = f'<styleSheet {main}><cellXfs><xf numFmtId="0"/>{"".join(f"""<xf numFmtId="{f}"/>""" for f in formats)}</cellXfs></styleSheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name), text)  # no time of writing: equal rows give equal bytes
    return out.getvalue()
