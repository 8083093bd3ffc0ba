"""Pairs of transfer candidates: what is costly is read once a leg, and tasks stay many, as pairs grow faster than legs."""

import random
from datetime import date, timedelta

import pytest

from tallyspark.operators import reconcile as R
from tallyspark.plans import registry
from tests.finance.test_matching import TEXTS, rank
from tests.finance.test_operators import legs

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["transfer_candidates", "transfer_candidates_all"])
def test_texts_are_read_before_legs_meet_and_tasks_are_not_merged(spark, name):
    df = registry.queries()[name](spark, DIR)
    above, _, below = df._jdf.queryExecution().optimizedPlan().toString().partition("Join Inner")
    assert below and "RLIKE" in below and "RLIKE" not in above and "regexp_replace" not in above
    found = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in found and found.count("REPARTITION_BY_NUM") == 2


def test_evidence_of_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for k in range(200):
        text, bank, reference = rng.choice([*TEXTS, "PAGO A TERCEROS"]), rng.choice([*R.BANKS, "", "other", None]), rng.choice([None, None, "00123456", "7654321", "12", "000012"])
        rows.append((f"a{rng.randint(0, 6)}", str(date(2026, 1, 1) + timedelta(rng.randint(0, 25))), rng.choice([-1, 1]) * rng.choice([10, 20, 30]), f"f{k}", text, text, bank, reference))
    third = lambda t: t is not None and any(f" {w} " in f" {t} " for w in R.THIRD)
    want = {}
    for o in rows:
        for i in rows:
            gap = abs((date.fromisoformat(o[1]) - date.fromisoformat(i[1])).days)
            if o[2] == -i[2] < 0 and o[0] != i[0] and gap <= 5:
                want[o[3], i[3]] = (gap, rank(o, i), third(o[4]) or third(i[4]))
    df = R.candidates(legs(spark, [(r[0], r[1], r[2], r[3], r[4], r[6], r[7]) for r in rows]))
    got = df.collect()
    assert {(r.o_fingerprint, r.i_fingerprint): (r.gap_days, r["rank"], r.third_party) for r in got} == want and len(got) == len(want) > 500
    assert {r["rank"] for r in got} == {0, 1, 2, 3} and not any("says" in c or "banks" in c for c in df.columns)
