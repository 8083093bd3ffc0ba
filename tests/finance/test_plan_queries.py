"""Queries over instalment plans, against a plain version on a small table of lines."""

import datetime as dt
import math
from collections import defaultdict

import pytest

from tallyspark.plans import registry


@pytest.fixture(scope="module")
def lines(tmp_path_factory, spark):
    """Two suppliers, quantities of two bands, counters that repeat; part numbers of every last digit."""
    rows = [(i, i % 7 % 5 + 1, i % 2, i, dt.datetime(1997, 9, 1) + dt.timedelta(days=i * 5 % 120), float(i * 7 % 50)) for i in range(1, 61)]
    path = tmp_path_factory.mktemp("lines")
    schema = "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_shipdate timestamp, l_quantity double"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/lineitem.parquet")
    return str(path), rows


def plain_plans(rows):
    """(merchant, instalment amount, counters seen, first date) of each plan."""
    groups = defaultdict(list)
    for order, n, supplier, _, date, quantity in rows:
        groups[f"S{supplier}", math.floor(quantity / 25 + 1) * 1000].append((date.date(), f"{order:012d}-{n}", n))
    out = []
    for (merchant, amount), charges in groups.items():
        seen = []
        for date, _, n in sorted(charges):
            if not seen or n in seen:
                seen = []
                out.append((merchant, amount, seen, date))
            seen.append(n)
    return out


def test_plans_take_every_charge(spark, lines):
    path, rows = lines
    got = sorted((r.merchant, int(r.installment_amount), r.observed_installments) for r in registry.installment_plans(spark, path).collect())
    assert got == sorted((m, a, ",".join(map(str, sorted(seen)))) for m, a, seen, _ in plain_plans(rows))
    assert sum(len(x[2].split(",")) for x in got) == len(rows)


def test_outlook_takes_every_charge(spark, lines):
    path, rows = lines
    want = defaultdict(lambda: [0, 0])
    for _, amount, seen, date in plain_plans(rows):
        start = date.year * 12 + date.month - 1 - (min(seen) - 1)
        for i in range(max(seen), 9):
            if 1998 * 12 <= start + i < 1999 * 12:
                month = want[f"{(start + i) // 12}-{(start + i) % 12 + 1:02d}"]
                month[0] += amount
                month[1] += 1
    got = {r.month: [r.amount, r.plans] for r in registry.installment_outlook(spark, path).collect()}
    assert got == dict(want)
