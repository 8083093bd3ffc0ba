"""What matching leaves on disk: shuffles are deleted once their result is stored, and no leg is moved once for each day of its window."""

import datetime as dt
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import reconcile
from tallyspark.plans import registry
from tallyspark.session import stored
from tests.finance.test_large_joins import DIR, plan


def shuffled(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p.name for d in dirs for p in Path(d.getPath()).rglob("shuffle_*.data")}


def test_shuffles_of_stored_tables_are_deleted(spark):
    before = shuffled(spark)
    out = stored(spark.range(50_000).groupBy((F.col("id") % 5000).alias("k")).count(), "shuffled")
    until = time.monotonic() + 20
    while shuffled(spark) - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not shuffled(spark) - before
    assert out.agg(F.sum("count")).first()[0] == 50_000 and out.count() == 5000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.parametrize("name", ["ambiguous_transfers", "transfer_matches", "transfer_summary", "card_payments"])
def test_no_leg_is_repeated_by_day(spark, monkeypatch, name):
    plans, kept = [], reconcile.stored

    def noted(df, what):
        plans.append(plan(df))
        return kept(df, what)

    monkeypatch.setattr(reconcile, "stored", noted)
    plans.append(plan(registry.queries()[name](spark, DIR)))
    assert not [p for p in plans if "sequence(" in p]


def test_without_a_pair_no_leg_is_moved_to_find_it(spark, tmp_path):
    rows = [(n, dt.datetime(2024, 1, 10), n, "purchase", 12.5 + n) for n in range(9)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    df = registry.queries()["transfer_matches"](spark, str(tmp_path))
    assert "Exchange" not in plan(df) and df.count() == 0


def test_legs_beyond_the_first_three_owners_of_a_day_keep_their_knot(spark):
    """Six owners a day on each side, out on one day and in on the next, and a second group of which the least leg is in none of the
    pairs of first legs."""
    rows = [(f"o{k}", 0, 1, 0) for k in range(6)] + [(f"i{k}", 1, 1, 1) for k in range(6)] + [(f"{'a' if k == 5 else 'p'}{k}", 0, 2, 0) for k in range(6)] + [("q", 1, 2, 0)]
    owner = {"a5": "z"}
    open_ = spark.createDataFrame([(leg, side, "CLP", str(amount), day, owner.get(leg, leg)) for leg, side, amount, day in rows], "leg string, side int, currency string, amount_key string, day int, owner string")
    ties = reconcile._ties(open_, 5)
    assert ties.where("hung is not null").count() == 9
    assert {(r.leg, r.knot) for r in reconcile.knots(ties).collect()} == {(leg, "i0" if amount == 1 else "a5") for leg, _, amount, _ in rows}
