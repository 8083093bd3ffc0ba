from tallyspark.sources import sections as S


def test_lines_by_height_with_tolerance(spark):
    words = [("a", 0, 50.0, 700.0, "b"), ("a", 0, 10.0, 701.5, "a"), ("a", 0, 90.0, 698.5, "c"), ("a", 0, 10.0, 690.0, "next"), ("a", 1, 10.0, 700.0, "page"), ("a", 0, 10.0, 600.0, " "), ("a", 0, None, 600.0, "x"), ("a", 0, 20.0, 690.0, "next")]
    got = S.lines(spark.createDataFrame(words, "file string, page int, x double, y double, text string")).collect()
    assert sorted((r.page, r.line, r.text) for r in got) == [(0, 0, "a b c"), (0, 1, "next next"), (1, 0, "page")]


def test_the_last_section_named_owns_a_line(spark):
    move = "05/01/2026 PAN 12.500"
    lines = [("a", 0, 0, move), ("a", 0, 1, "Otros cargos"), ("a", 0, 2, move), ("a", 1, 0, move), ("a", 1, 1, "Emitido el 05/02/2026"), ("a", 1, 2, "COMPRAS NACIONALES"), ("a", 1, 3, "sin fecha 12.500"), ("b", 0, 0, move), (None, 0, 0, move)]
    got = {(r.file, r.section): (r.found, r.rows) for r in S.sections(spark.createDataFrame(lines, "file string, page int, line int, text string")).collect()}
    assert got["a", "OTROS"] == (True, 2) and got["a", "COMPRAS NACIONALES"] == (True, 0) and got["a", None] == (False, 1)
    assert got["b", None] == got[None, None] == (False, 1) and got["b", "OTROS"] == (False, 0) and len(got) == 15
