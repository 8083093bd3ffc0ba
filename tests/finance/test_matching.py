"""Matching without a table of pairs, against matching that lists them all, and where listing them could not end."""

import random
from collections import Counter
from datetime import date, timedelta

from tallyspark.operators import reconcile as R
from tests.finance.test_operators import legs

TEXTS = ["TRASPASO ENTRE CUENTAS", "TEF A TERCEROS", "ABONO", "TRASPASO BANCHILE", "TRANSFERENCIA FALABELLA", "COMPRA", None]


def rank(o, i):
    def says(words, *texts):
        return any(f" {w} " in f" {t} " for t in texts if t for w in words)

    long = lambda r: r is not None and len(r.strip().lstrip("0")) >= 6
    if long(o[7]) and o[7] == i[7]:
        return 3
    if not says(R.TRANSFER, o[5], i[5]):
        return 0
    named = says(R.BANKS.get(i[6], ()), o[5]) or says(R.BANKS.get(o[6], ()), i[5])
    return 2 if says(R.OWN, o[5], i[5]) or named else 1


def plain(rows, window):
    day = lambda r: date.fromisoformat(r[1])
    outs, ins = [r for r in rows if r[2] < 0], [r for r in rows if r[2] > 0]
    pairs = {(o, i): (rank(o, i), -abs((day(o) - day(i)).days)) for o in outs for i in ins if o[2] == -i[2] and o[0] != i[0] and abs((day(o) - day(i)).days) <= window}
    found = set()
    while True:
        best = {}
        for p, q in pairs.items():
            for leg in p:
                best.setdefault(leg, []).append((q, p))
        only = {leg: max(x)[1] for leg, x in best.items() if sum(q == max(x)[0] for q, _ in x) == 1}
        now = {p for p in pairs if only.get(p[0]) == p == only.get(p[1])}
        if not now:
            return {(o[3], i[3]) for o, i in found}, pairs
        found |= now
        used = {leg for p in now for leg in p}
        pairs = {p: q for p, q in pairs.items() if not used & set(p)}


def parts(pairs):
    """Legs of each connected component of pairs, as sets."""
    at = {}
    for o, i in pairs:
        both = at.get(o, {o}) | at.get(i, {i})
        at.update(dict.fromkeys(both, both))
    return {frozenset(f"{x[0]}:{x[3]}" for x in c) for c in at.values()}


def test_equals_matching_of_all_pairs(spark):
    for seed in range(4):
        rng = random.Random(seed)
        rows = []
        for k in range(260):
            text, bank = rng.choice(TEXTS), rng.choice([*R.BANKS, "", "other"])
            reference = rng.choice([None, None, "00123456", "7654321", "12", "000012"])
            rows.append((f"a{rng.randint(0, 4 + 8 * (seed % 2))}", str(date(2026, 1, 1) + timedelta(rng.randint(0, 40 // (seed + 1)))), rng.choice([-1, 1]) * rng.choice([10, 20, 30, 40, 50, 60]), f"f{k}", text, text, bank, reference))
        frame = legs(spark, [(r[0], r[1], r[2], r[3], r[4], r[6], r[7]) for r in rows])
        found, left = plain(rows, 5)
        matched, open_ = R.match_transfers(frame)
        got = matched.collect()
        assert {(r.o_fingerprint, r.i_fingerprint) for r in got} == found and len(got) == len(found)
        by = {r[3]: r for r in rows}
        assert all(r["rank"] == rank(by[r.o_fingerprint], by[r.i_fingerprint]) for r in got)
        knots = {}
        for r in R.knots(open_).collect():
            knots.setdefault(r.knot, set()).add(r.leg)
        assert {frozenset(x) for x in knots.values()} == parts(left)
        assert all(knot == min(x) for knot, x in knots.items())


def test_very_many_equal_legs_of_a_week(spark):
    """A hundred thousand legs of one amount in one week, which would be billions of pairs; beside them one pair that nothing rivals."""
    n = 100_000
    many = spark.range(n).selectExpr("concat('a', id % 500) account_id", "date_add(date '2026-01-01', cast(id % 7 as int)) date", "cast(if(id % 3 = 0, -1000, 1000) as decimal(22,6)) amount", "'CLP' currency", "if(id % 3 = 0, 'out', 'in') direction", "concat('f', id) fingerprint", "'X' description", "'b' institution", "cast(null as string) reference")
    pair = spark.createDataFrame([("p", "2026-01-01", -1000, "x", "00999999"), ("q", "2026-01-03", 1000, "y", "00999999")], "account_id string, date string, amount int, fingerprint string, reference string").selectExpr("account_id", "cast(date as date) date", "cast(amount as decimal(22,6)) amount", "'CLP' currency", "if(amount < 0, 'out', 'in') direction", "fingerprint", "'X' description", "'b' institution", "reference")
    matched, open_ = R.match_transfers(many.unionByName(pair))
    assert [(r.o_fingerprint, r.i_fingerprint) for r in matched.collect()] == [("x", "y")]
    assert open_.count() <= n * 11 * 3
    knots = R.knots(open_)
    assert Counter(r.knot for r in knots.collect()) == {"a0:f0": n}


def test_card_payments_of_very_many_equal_amounts(spark):
    n = 20_000
    facts = spark.range(n).selectExpr("concat(if(id % 2 = 0, 'cash', 'card'), id % 40) account_id", "date_add(date '2026-01-01', cast(id % 6 as int)) date", "cast(if(id % 2 = 0, -70, 70) as decimal(22,6)) amount", "'CLP' currency", "if(id % 2 = 0, 'out', 'in') direction", "concat('f', id) fingerprint", "if(id % 2 = 0, 'PAGO TARJETA', 'PAGO RECIBIDO') description", "'b' institution", "cast(null as string) reference", "id % 2 = 1 is_card")
    got = R.match_card_payments(facts)
    assert {(r.reason, r.rivals, r["count"]) for r in got.groupBy("reason", "rivals").count().collect()} == {("equal-rivals", n // 2, n // 2)}
