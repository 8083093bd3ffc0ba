"""What statements of a parser look like, in counts alone: no text, name or amount of a movement is told.

A new layout is judged by these: how many decimals amounts have, which kinds wording gives, whether rows run up or down in time, and
in what way balances fail to follow from amounts (a wrong sign, a factor of 100 or 1000 from misread marks, or anything else).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import canonical

_MEASURES = ("scale", "kind", "flow", "confidence")


def mismatch_kind(expected: Column, actual: Column) -> Column:
    """sign, scale-100, scale-1000 or other: how a step between two balances differs from the sum of its amounts; within a hundredth."""
    ratio = F.when(actual == 0, 0.0).otherwise(F.abs(expected.cast("double") / actual.cast("double")))
    near = lambda x: F.abs(ratio - x) < x * 0.01
    return F.when((actual != 0) & (expected == -actual), "sign").when(near(100) | near(1 / 100), "scale-100").when(near(1000) | near(1 / 1000), "scale-1000").otherwise("other")


def steps(rows: DataFrame, file: str, line: str) -> DataFrame:
    """rows that carry a balance, but the first of each file, with ``mismatch``: null where the balance follows from the one before and
    the amounts since. Running sums in one window per file; files are bounded, so no window is."""
    w = Window.partitionBy(file).orderBy(line)
    marks = rows.withColumn("__sum", F.sum("amount").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("balance_after is not null")
    both = marks.withColumns({"__expected": F.col("balance_after") - F.lag("balance_after").over(w), "__actual": F.col("__sum") - F.lag("__sum").over(w)}).where("__expected is not null")
    return both.withColumn("mismatch", F.when(F.col("__expected") != F.col("__actual"), mismatch_kind(F.col("__expected"), F.col("__actual")))).drop("__sum", "__expected", "__actual")


def orders(rows: DataFrame, file: str, line: str) -> DataFrame:
    """(parser, file, order): ascending, descending, single-day or mixed."""
    w = Window.partitionBy(file).orderBy(line)
    some = rows.withColumn("__step", F.datediff("date", F.lag("date").over(w))).groupBy("parser", file).agg(F.coalesce(F.min("__step"), F.lit(0)).alias("low"), F.coalesce(F.max("__step"), F.lit(0)).alias("high"))
    order = F.when((F.col("low") == 0) & (F.col("high") == 0), "single-day").when(F.col("low") >= 0, "ascending").when(F.col("high") <= 0, "descending").otherwise("mixed")
    return some.select("parser", file, order.alias("order"))


def profile(rows: DataFrame, file: str = "file", line: str = "line") -> DataFrame:
    """(parser, measure, value, n) over typed rows (parser, file, line, date, amount, kind, kind_confidence, balance_after).

    Counts of rows by scale, kind, flow and confidence come from one pass over grouping sets; those of files by order, and of steps by
    mismatch (``none`` where balances agree), from the walks. Rows without an amount or kind count under null."""
    text = canonical(F.col("amount"))
    scale = F.when(text.isNotNull(), F.length(F.regexp_extract(text, r"\.(\d+)$", 1)))
    flow = F.when(F.col("amount") > 0, "in").when(F.col("amount") < 0, "out").when(F.col("amount") == 0, "zero")
    seen = rows.select("parser", scale.cast("string").alias("scale"), "kind", flow.alias("flow"), F.col("kind_confidence").alias("confidence"))
    sets = seen.groupingSets([[F.col("parser"), F.col(m)] for m in _MEASURES], F.col("parser"), *map(F.col, _MEASURES)).agg(F.count(F.lit(1)).alias("n"), *(F.grouping(m).alias(f"__{m}") for m in _MEASURES))
    pick = lambda of: F.coalesce(*(F.when(F.col(f"__{m}") == 0, of(m)) for m in _MEASURES))
    counted = sets.select("parser", pick(F.lit).alias("measure"), pick(F.col).alias("value"), "n")
    ordered = orders(rows, file, line).groupBy("parser", F.col("order").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    walked = steps(rows, file, line).groupBy("parser", F.coalesce("mismatch", F.lit("none")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    more = ordered.withColumn("measure", F.lit("order")).unionByName(walked.withColumn("measure", F.lit("mismatch")))
    return counted.unionByName(more)
