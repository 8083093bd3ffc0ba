"""Tables that grow with the input are merged: small files may hold many rows, which must not be copied through the driver."""

import pytest

from tallyspark.operators import reconcile
from tallyspark.plans import registry

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["transfer_matches", "ambiguous_transfers", "transfer_summary", "card_payments", "stamped_payments"])
def test_joins_of_legs_are_merged(spark, monkeypatch, name):
    plans, stored = [], reconcile.stored

    def noted(df, what):
        plans.append(plan(df))
        return stored(df, what)

    monkeypatch.setattr(reconcile, "stored", noted)
    plans.append(plan(registry.queries()[name](spark, DIR)))
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("BroadcastHashJoin" in p for p in plans)


@pytest.mark.parametrize("name", ["legacy_conflicts", "duplicates", "import_breakdown", "import_totals"])
def test_no_task_gets_all_rows_of_a_file_or_all_without_a_legacy_fingerprint(spark, name):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found = plan(registry.queries()[name](spark, DIR))
    finally:
        spark.conf.set(key, before)
    assert "hashpartitioning(fingerprint" in found
    assert "hashpartitioning(legacy_fingerprint" not in found and "hashpartitioning(source_file_hash" not in found
