"""Transfer candidates come from the whole production window."""

import datetime as dt

from tallyspark.plans import registry


def test_candidates_up_to_five_days_apart(spark, tmp_path):
    day = dt.datetime(2024, 1, 10, 12)
    rows = [(0, day, 1, "purchase", 12.5), *((n, day + dt.timedelta(days=n), 1 + n, "signup", 12.5) for n in range(1, 8))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r.gap_days for r in registry.queries()["transfer_candidates_all"](spark, str(tmp_path)).collect()) == [1, 2, 3, 4, 5]
