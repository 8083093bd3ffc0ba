import datetime as dt
import io
import json
import zipfile
from decimal import Decimal

from pyspark.sql import functions as F

from tallyspark.sources import ledger as L
from tallyspark.sources import sheets as S
from tallyspark.sources.xlsx import format_shape, read_xlsx
from tallyspark.sources.xlsx import workbook as book

CSV = 'Titular;Ana\nCuenta;00-123-45678\n\nFecha;Descripción;Cargo;Abono;Saldo\n05/01/2026;"COMPRA ""X""; Y";1.000;;9.000\n06/01/2026;SUELDO;;5.000;14.000\n\n'


def workbook():
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    files = {
        "xl/workbook.xml": f'<workbook {m} {r}><sheets><sheet name="Uno" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {m}><si><t>Fecha</t></si><si><r><t>Glo</t></r><r><t>sa</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {m}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="4"/></cellXfs></styleSheet>',
        "xl/worksheets/s.xml": f'<worksheet {m}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>Monto</t></is></c></row>'
        '<row r="3"><c r="A3" s="1"><v>46027</v></c><c r="C3" t="str"><v>PAN</v></c><c r="D3" s="2"><v>1234.5</v></c></row></sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_xlsx():
    [(name, rows, shapes)] = read_xlsx(workbook(), 100)
    assert name == "Uno" and rows == [["Fecha", "", "Glosa", "Monto"], [""] * 4, ["2026-01-05", "", "PAN", "1234.5"]]
    assert shapes[2] == ["date", "", "str", "grouped-decimal"]
    assert [format_shape(c) for c in ("0.00", "#,##0", "dd/mm/yy", "@", "0,", '"x"')] == ["decimal", "grouped-integer", "date", "text", "unknown", "general"]


def test_files_to_records(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(CSV.encode("utf-8-sig"))
    (tmp_path / "b.txt").write_bytes(CSV.replace(";", "\t").encode("cp1252"))
    (tmp_path / "c.xlsx").write_bytes(workbook())
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "e.xlsx").write_bytes(b"PK\x03\x04broken")
    rows = S.read_sheets(spark, str(tmp_path))
    assert {r.path[-5:]: r.error is None for r in rows.where("error is not null").collect()} == {"d.pdf": False, ".xlsx": False} or rows.where("error is not null").count() == 2
    got = S.records(S.data_sheets(rows.where("error is null"))).collect()
    cells = sorted((r.path[-5:], r.date, r.description, r.debit, r.credit, r.balance, r.amount) for r in got)
    assert ("a.csv", "05/01/2026", 'COMPRA "X"; Y', "1.000", "", "9.000", None) in cells and ("b.txt", "06/01/2026", "SUELDO", "", "5.000", "14.000", None) in cells
    assert any(c[1:3] == ("2026-01-05", "PAN") and c[6] == "1234.5" for c in cells) and len(cells) == 5


def test_data_source_reads_the_same_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.csv").write_bytes(CSV.encode("utf-8-sig"))
    (tmp_path / "in" / "b").write_bytes(CSV.replace(";", "|").encode("cp1252"))
    (tmp_path / "c.xlsx").write_bytes(book({"Nota": [["x"]], "Datos": [["Fecha", "Glosa", "Monto"], [], [46027, "uno & <dos>", 0.1]]}, [14, 0, 4]))
    (tmp_path / "d.bin").write_bytes(b"\0\1\2")
    (tmp_path / "e.csv").write_bytes(b"a;b\n" * 40_000)
    spark.dataSource.register(S.SheetFiles)
    got = spark.read.format("sheets").option("mostBytes", 100_000).load(str(tmp_path))
    bare = lambda rows: sorted({str((r.path.rpartition("/")[2], *r[2:])) for r in rows})
    a = got.where("error is null").collect()
    b = S.read_sheets(spark, f"{tmp_path}/*", 100_000).unionByName(S.read_sheets(spark, f"{tmp_path}/in", 100_000)).where("error is null")
    assert bare(a) == bare(b.collect()) and len(bare(a)) == len(a)
    assert {r.path.rpartition("/")[2]: r.error for r in got.where("error is not null").collect()} == {"d.bin": "unsupported file: unsupported", "e.csv": "file of 160000 bytes is over the limit of 100000"}
    assert [r.cells for r in S.data_sheets(got.where("kind = 'xlsx'")).orderBy("row_index").collect()] == [["Fecha", "Glosa", "Monto"], ["", "", ""], ["2026-01-05", "uno & <dos>", "0.1"]]


def test_rows_of_bytes_in_a_table(spark):
    files = spark.createDataFrame([("a.csv", bytearray(CSV.encode())), ("b.csv", None), (None, bytearray(b"x"))], "path string, content binary")
    got = S.sheets_of(files).collect()
    assert {(r.path, r.error) for r in got} == {("a.csv", None), ("", None)} and sum(r.path == "a.csv" for r in got) == 6
    assert S.sheets_of(files.limit(0)).count() == 0


def test_roles_and_delimiters():
    assert S.map_columns(["FECHA", "FECHA CONTABLE", "DETALLE", "MONTO TOTAL", "VALOR CUOTA", "SALDO"]) == {"date": 0, "posted_date": 1, "description": 2, "purchase_amount": 3, "installment_amount": 4, "balance": 5}
    assert S.map_columns(["FECHA ABONO", "GLOSA", "MONTO"])["date"] == 0
    assert [S.delimiter_of(t) for t in ("a;b\nc;d", "a,b,c\n1,2,3", "a\tb", "", "x|y|z\n1|2|3\na,b")] == [";", ",", "\t", ";", "|"]


def test_ledger_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("k1", 1), ("k2", 2), ("k2", 2)], "idempotency_key string, v int")
    path = str(tmp_path / "ledger")
    assert L.append_new(rows, path) == 2 and L.append_new(rows, path) == 0
    assert L.append_new(spark.createDataFrame([("k3", 3)], rows.schema), path) == 1
    assert spark.read.parquet(path).count() == 3
    L.record_run(spark, str(tmp_path / "runs"), file_hash="h", created=2, failed=0)
    assert L.recent_runs(spark, str(tmp_path / "runs"), 5).count() == 1


def test_activities_round_trip(spark):
    df = spark.createDataFrame([("f1", "2026-01-05", "-12.50", "expense", "out", "COMPRA", 2, 6)], "fingerprint string, date string, amount string, kind string, direction string, description string, now int, total int")
    df = df.select("fingerprint", F.to_date("date").alias("date"), F.col("amount").cast("decimal(22,6)").alias("amount"), F.lit("CLP").alias("currency"), "kind", "direction", "description", F.struct(F.col("now").alias("current"), F.col("total").alias("total")).alias("installment"), F.lit(None).cast("string").alias("merchant"), F.lit("compras").alias("category"), F.lit("a").alias("account_id"))
    activities = L.to_activities(df)
    a = activities.first()
    assert (a.activity_type, a.amount, a.comment, a.status) == ("WITHDRAWAL", "12.5", "COMPRA (cuota 2/6)", "POSTED")
    back = L.from_activities(activities).first()
    assert (back.fingerprint, back.amount, back.kind, back.category, back.is_current) == ("f1", df.first().amount, "expense", "compras", True)
    edited = L.from_activities(activities.withColumn("amount", F.lit("99"))).first()
    assert not edited.is_current and edited.category is None


def host(spark, **more):
    kinds = "activity_type string, subtype string, date date, amount string, currency string, comment string, status string, metadata string, account_id string, account_type string, is_user_modified boolean"
    row = {"activity_type": "CREDIT", "subtype": None, "date": dt.date(2026, 1, 5), "amount": "12.5", "currency": "CLP", "comment": "X", "status": "POSTED", "metadata": None, "account_id": "a", "account_type": "CASH", "is_user_modified": None} | more
    return L.from_activities(spark.createDataFrame([tuple(row.values())], kinds)).first()


def test_types_without_metadata(spark):
    for t, sub, account, want in [("CREDIT", None, "CASH", "unknown"), ("CREDIT", "bonus", "CASH", "income"), ("CREDIT", "Rebate", "CASH", "refund"), ("CREDIT", None, "CREDIT_CARD", "refund"), ("FEE", "INTEREST_CHARGE", "CASH", "interest"), ("BUY", None, "CASH", "unknown")]:
        r = host(spark, activity_type=t, subtype=sub, account_type=account)
        assert (r.kind, r.kind_confidence, r.is_current, r.fingerprint) == (want, "suggested", False, None)
    assert host(spark, activity_type="INTEREST", account_type="CREDIT_CARD").amount == Decimal("-12.5")
    assert host(spark, activity_type="UNKNOWN", amount="-3").direction == "out"


def test_metadata_of_all_versions(spark):
    for v in (1, 2, 3, 4, 5):
        meta = json.dumps({"v": v, "fp": "f", "kind": "unknown", "dir": "out", "cat": "c", "kc": "confirmed", "fc": "interest", "cuota": {"n": 1, "of": 3}, "extra": [1]})
        r = host(spark, activity_type="UNKNOWN", metadata=meta)
        assert (r.direction, r.kind_confidence, r.cost_kind) == ("out" if v > 1 else "in", "confirmed" if v == 5 else "suggested", "interest" if v > 3 else None)
        assert r.is_current and r.category == "c" and r.installment.total == 3
        assert host(spark, activity_type="UNKNOWN", metadata=meta, is_user_modified=True).category is None
    for bad in ("{", "[]", "{\"v\": 5}", '{"v": 5, "fp": ""}', '{"v": "x", "fp": "f"}'):
        assert host(spark, metadata=bad).fingerprint is None
    stale = json.dumps({"v": 5, "fp": "f", "kind": "expense", "dir": "out", "proj": "0"})
    r = host(spark, activity_type="DEPOSIT", metadata=stale)
    assert (r.is_current, r.kind, r.direction) == (False, "income", "in")


def test_unread_and_investment_movements_keep_their_types(spark):
    df = spark.createDataFrame([("unknown", "out"), ("investment", "out"), ("refund", "in")], "kind string, direction string")
    df = df.selectExpr("kind", "direction", "'f' fingerprint", "date '2026-01-05' date", "cast(5 as decimal(22,6)) amount", "'CLP' currency", "'X' description", "cast(null as struct<current:int,total:int>) installment", "'m' merchant", "'c' category", "'a' account_id")
    rows = L.to_activities(df)
    assert {(r.activity_type, r.subtype, r.status) for r in rows.collect()} == {("UNKNOWN", None, "DRAFT"), ("TRANSFER_OUT", None, "POSTED"), ("CREDIT", "REFUND", "POSTED")}
    assert {(r.kind, r.direction) for r in L.from_activities(rows).collect()} == {("unknown", "out"), ("investment", "out"), ("refund", "in")}


def test_import_in_batches_resumes(spark, tmp_path):
    kinds = "idempotency_key string, account_id string, date date, amount int, status string"
    rows = [(f"k{i:03d}", "a" if i != 7 else None, dt.date(2026, 1 + i % 3, 5), i, "POSTED" if i % 2 else "DRAFT") for i in range(95)] + [("k001", "a", dt.date(2026, 2, 5), 1, "POSTED"), (None, "a", None, None, None)]
    df = spark.createDataFrame(rows, kinds)
    path = str(tmp_path / "ledger")
    part = L.import_rows(df.where("idempotency_key < 'k015'"), path, "r1", size=10).orderBy("batch").collect()
    assert [tuple(r) for r in part] == [(0, 9, 1, 0, []), (1, 5, 0, 1, ["no-account"])] or sum(r.created for r in part) == 14
    got = L.import_rows(df, path, "r2", size=10).collect()
    assert sum(r.created for r in got) == 80 and sum(r.failed for r in got) == 2 and sum(r.created + r.skipped + r.failed for r in got) == 97 and len(got) == 10
    assert sorted(x for r in got for x in r.reasons) == ["no-account", "no-amount", "no-date", "no-key"]
    again = L.import_rows(df, path, "r3", size=10).agg(F.sum("created").alias("n")).first()
    assert again.n == 0 and L.entries(spark, path).count() == 94
    posted, drafts = L.window(spark, path, dt.date(2026, 2, 1), dt.date(2026, 2, 28))
    assert {r.month for r in posted.collect()} == {"2026-02"} and posted.count() + drafts.count() == L.entries(spark, path, ["2026-02"]).count()
    plan = posted._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "month" in plan.split("PartitionFilters")[1].split("]")[0]
    df.where("idempotency_key = 'k050'").withColumns({"run": F.lit("r9"), "batch": F.lit(0).cast("long"), "month": F.lit("2026-03")}).write.mode("append").partitionBy("month").parquet(path)
    assert L.entries(spark, path).count() == 94  # another writer's copy counts once
