"""Checks of a statement's running balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ledger_order(rows: DataFrame, file: str = "file", line: str = "line", date: str = "date") -> DataFrame:
    """(file, order): ascending or descending by date, unknown where dates mix or are one."""
    w = Window.partitionBy(file).orderBy(line)
    step = rows.withColumn("__step", F.datediff(date, F.lag(date).over(w)))
    some = step.groupBy(file).agg(F.coalesce(F.min("__step"), F.lit(0)).alias("low"), F.coalesce(F.max("__step"), F.lit(0)).alias("high"))
    order = F.when((F.col("low") >= 0) & (F.col("high") > 0), "ascending").when((F.col("high") <= 0) & (F.col("low") < 0), "descending").otherwise("unknown")
    return some.select(file, order.alias("order"))


def walk(rows: DataFrame, file: str = "file", line: str = "line") -> DataFrame:
    """(file, steps, mismatches, systematic) of the balances that rows carry.

    Between two balances lie amounts whose sum must be the difference; systematic: of four steps or more half are off. The first
    balance opens the walk. Running sums in one window per file; files are bounded, so no window is.
    """
    w = Window.partitionBy(file).orderBy(line)
    sums = rows.withColumn("__sum", F.sum("amount").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    marks = sums.where(F.col("balance_after").isNotNull())
    expected = F.lag("balance_after").over(w) + F.col("__sum") - F.lag("__sum").over(w)
    steps = marks.withColumn("__off", expected != F.col("balance_after"))
    some = steps.groupBy(file).agg(F.count("__off").alias("steps"), F.count_if("__off").alias("mismatches"))
    return some.withColumn("systematic", (F.col("steps") >= 4) & (F.col("mismatches") * 2 >= F.col("steps")))


def totals(rows: DataFrame, statements: DataFrame, file: str = "file") -> DataFrame:
    """(file, difference): closing minus opening minus the sum of amounts, where both are declared and no row failed."""
    some = rows.groupBy(file).agg(F.sum("amount").alias("sum"))
    ok = statements.where("opening is not null and closing is not null and failed = 0")
    return ok.join(some, file, "left").select(file, (F.col("closing") - F.col("opening") - F.coalesce("sum", F.lit(0))).alias("difference"))


def example(facts: DataFrame) -> DataFrame:
    """Movements with a running balance on every other row, off by one on some: what the walk is tried on."""
    w = Window.partitionBy("account_id").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum("amount").over(w)
    off = F.when(F.col("row_id") % 10 == 0, 1).otherwise(0)
    return facts.select("account_id", F.col("row_id").alias("line"), "amount", F.when(F.col("row_id") % 2 == 0, run + off).alias("balance_after"))
