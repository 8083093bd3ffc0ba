"""Lines of laid-out pages and the sections they stand in, as counts alone.

Words have a place on a page. Words whose heights differ by no more than a tolerance from their neighbour's are a line; a line that
names a section owns what follows it in its file, over the ends of pages, until the next that does. Of every section it is told
whether it was found and how many lines look like a movement; of lines before any section, how many do. No text leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import normalize_description
from tallyspark.sources.sheets import last_seen

# The names of sections, and what a line of a movement holds.
SECTIONS = ("COMPRAS NACIONALES", "COMPRAS INTERNACIONALES", "OTROS", "CARGOS COMISIONES IMPUESTOS Y ABONOS")
DAY = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
MONEY = r"\b\d{1,3}(?:\.\d{3})+\b"


def lines(words: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """(file, page, line, text) of words (file, page, x, y, text), from the top (the largest y) down, words from left to right.

    Lines are islands between gaps in height; pages are bounded, so no window or line is more than a page. Words without text or place are
    left out; equal words are words of their own."""
    some = words.where("text is not null and trim(text) != '' and x is not null and y is not null")
    down = Window.partitionBy("file", "page").orderBy(F.desc("y"), "x", "text")
    gap = F.coalesce((F.lag("y").over(down) - F.col("y") > tolerance).cast("int"), F.lit(0))
    numbered = some.withColumn("gap", gap).withColumn("line", F.sum("gap").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda w: w["text"])
    return numbered.groupBy("file", "page", "line").agg(F.array_join(row, " ").alias("text"))


def section_of(text: Column, names: tuple[str, ...] = SECTIONS) -> Column:
    """The first of the names that a line mentions; null if none."""
    folded = normalize_description(text)
    return F.coalesce(*(F.when(folded.contains(n), n) for n in names))


def looks_like_movement(text: Column) -> Column:
    return text.rlike(DAY) & text.rlike(MONEY)


def sections(some: DataFrame, names: tuple[str, ...] = SECTIONS) -> DataFrame:
    """(file, section, found, rows) of lines (file, page, line, text): a row for each name and file, and one with a null section for lines
    before any. Files are bounded, so no window is more than a file."""
    order = F.struct("page", "line")
    marked = some.withColumns({"own": section_of(F.col("text"), names), "at": order})
    placed = marked.withColumn("section", last_seen(marked, "file", "at", F.col("own")))
    counts = placed.groupBy("file", "section").agg(F.coalesce(F.bool_or(F.col("own").isNotNull()), F.lit(False)).alias("found"), F.count_if(F.col("own").isNull() & looks_like_movement(F.col("text"))).alias("rows"))
    every = some.select("file").distinct().withColumn("section", F.explode(F.array(*map(F.lit, names), F.lit(None).cast("string"))))
    on = every["file"].eqNullSafe(counts["file"]) & every["section"].eqNullSafe(counts["section"])
    return every.join(counts, on, "left").select(every["file"], every["section"], F.coalesce(counts["found"], F.lit(False)).alias("found"), F.coalesce(counts["rows"], F.lit(0)).alias("rows"))
