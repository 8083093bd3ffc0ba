"""Movements as streams: windows and sessions of money flows, repeats within a watermark, pairs of legs, and an idempotent sink.

Streams have a timestamp column (``at``); every state is bounded by the watermark ``late``. Rows with a null time are dropped by the
watermark's operators. Amounts are signed decimals, as in the batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspark.sources.ledger import append_new


def _flows() -> list:
    into = F.col("amount") > 0
    inflow, outflow = F.when(into, F.col("amount")), F.when(~into, -F.col("amount"))
    return [F.coalesce(F.sum(inflow), F.lit(0)).cast("decimal(32,6)").alias("inflow"), F.coalesce(F.sum(outflow), F.lit(0)).cast("decimal(32,6)").alias("outflow"), F.count(F.lit(1)).alias("n")]


def windowed_flows(movements: DataFrame, *, at: str = "ts", late: str = "1 day", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """(window_start, window_end, currency, inflow, outflow, n) of tumbling windows, or of sliding ones every ``slide``."""
    span = F.window(at, width, slide) if slide else F.window(at, width)
    flows = movements.withWatermark(at, late).groupBy(span.alias("span"), "currency").agg(*_flows())
    return flows.select(F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), "currency", "inflow", "outflow", "n")


def sessions(movements: DataFrame, *, at: str = "ts", late: str = "1 day", gap: str = "30 minutes") -> DataFrame:
    """(account_id, session_start, session_end, currency, inflow, outflow, n) of an account's movements less than ``gap`` apart."""
    flows = movements.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("span"), "account_id", "currency").agg(*_flows())
    return flows.select("account_id", F.col("span.start").alias("session_start"), F.col("span.end").alias("session_end"), "currency", "inflow", "outflow", "n")


def first_seen(movements: DataFrame, *, key: str = "fingerprint", at: str = "ts", late: str = "1 day") -> DataFrame:
    """Movements without those whose key came before within the watermark."""
    return movements.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def transfer_pairs(outgoing: DataFrame, incoming: DataFrame, *, at: str = "ts", days: int = 5, late: str = "1 day") -> DataFrame:
    """(o_leg, i_leg, currency, amount) of every out and in leg of one amount, in different accounts, at most ``days`` days apart."""

    def side(rows: DataFrame, p: str) -> DataFrame:
        return rows.withWatermark(at, late).select(F.col(at).alias(f"{p}_at"), F.col("fingerprint").alias(f"{p}_leg"), F.col("account_id").alias(f"{p}_account"), F.col("currency").alias(f"{p}_currency"), F.abs("amount").alias(f"{p}_amount"))

    o, i = side(outgoing, "o"), side(incoming, "i")
    same = (F.col("o_currency") == F.col("i_currency")) & (F.col("o_amount") == F.col("i_amount")) & (F.col("o_account") != F.col("i_account"))
    near = F.expr(f"i_at >= o_at - interval {int(days)} days and i_at <= o_at + interval {int(days)} days")
    return o.join(i, same & near).select("o_leg", "i_leg", F.col("o_currency").alias("currency"), F.col("o_amount").alias("amount"))


def into_ledger(movements: DataFrame, path: str, checkpoint: str, *, key: str = "idempotency_key") -> StreamingQuery:
    """Starts a query that appends what has arrived to the ledger; a batch that runs again after a failure adds nothing twice."""
    return movements.writeStream.foreachBatch(lambda rows, _: append_new(rows, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
