"""Large statement files lose no rows without a word."""

import pytest

from tallyspark.sources import sheets as S
from tallyspark.sources.xlsx import read_xlsx
from tests.finance.test_sources import workbook


def test_long_files_are_read_whole_and_large_ones_are_errors(spark, tmp_path):
    (tmp_path / "long.csv").write_text("Fecha;Glosa;Monto\n" + "05/01/2026;PAN;1\n" * 120_000 + "06/01/2026;LAST;2\n")
    (tmp_path / "large.csv").write_text("Fecha;Glosa;Monto\n" + "05/01/2026;PAN;1\n" * 130_000)
    (tmp_path / "small.csv").write_text("Fecha;Glosa;Monto\n05/01/2026;PAN;1\n")
    rows = S.read_sheets(spark, str(tmp_path), most_bytes=2_100_000).cache()
    [bad] = rows.where("error is not null").collect()
    assert bad.path.endswith("/large.csv") and "2210018" in bad.error and "2100000" in bad.error and bad.cells is None
    assert rows.where("path like '%/long.csv'").count() == 120_002 and rows.where("path like '%/small.csv'").count() == 2
    assert [r.row_index for r in rows.where("cells[1] = 'LAST'").collect()] == [120_001]


def test_rows_beyond_a_sheets_limit_are_an_error():
    with pytest.raises(ValueError, match="row 3 is beyond the limit of 2 rows"):
        read_xlsx(workbook(), 2)
