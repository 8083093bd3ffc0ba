import datetime as dt
import decimal

import pytest

from tallyspark.streaming import movements as M

SCHEMA = "ts timestamp, account_id string, currency string, amount decimal(22,6), fingerprint string"
DAY = dt.datetime(2026, 1, 5)


def row(minutes, account, amount, name, currency="CLP"):
    return (DAY + dt.timedelta(minutes=minutes), account, currency, decimal.Decimal(amount), name)


ROWS = [row(0, "a", -100, "f1"), row(10, "a", -50, "f2"), row(10, "a", -50, "f2"), row(300, "a", 70, "f3"), row(1500, "b", 100, "f4"), row(1510, "b", 5, "f5", "USD"), row(60 * 24 * 9, "b", 50, "f6")]


@pytest.fixture
def stream(spark, tmp_path):
    path = str(tmp_path / "in")
    for part in (ROWS[:4], ROWS[4:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).parquet(path)


def result(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_windows_and_sessions(spark, stream):
    got = {(r.window_start, r.currency): (int(r.inflow), int(r.outflow), r.n) for r in result(spark, M.windowed_flows(stream), "windows", "complete")}
    assert got[(DAY, "CLP")] == (70, 200, 4) and got[(DAY + dt.timedelta(days=1), "USD")] == (5, 0, 1) and len(got) == 4
    found = sorted((r.account_id, r.currency, r.n) for r in result(spark, M.sessions(stream), "sessions", "complete"))
    assert found == [("a", "CLP", 1), ("a", "CLP", 3), ("b", "CLP", 1), ("b", "CLP", 1), ("b", "USD", 1)]


def test_repeats_and_pairs(spark, stream):
    assert sorted(r.fingerprint for r in result(spark, M.first_seen(stream), "first")) == ["f1", "f2", "f3", "f4", "f5", "f6"]
    pairs = M.transfer_pairs(stream.where("amount < 0"), stream.where("amount > 0"))
    assert [(r.o_leg, r.i_leg) for r in result(spark, pairs, "pairs")] == [("f1", "f4")]


def test_sink_adds_nothing_twice(spark, stream, tmp_path):
    for k in range(2):  # the second query has lost its checkpoint and reads all again
        M.into_ledger(stream, str(tmp_path / "ledger"), str(tmp_path / f"state{k}"), key="fingerprint").awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 6
