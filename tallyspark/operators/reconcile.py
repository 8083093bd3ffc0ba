"""Pairing the two legs of transfers, and card payments with the card's credits.

A pair is taken if it is the only best of both its legs; a tie is no answer. Taking pairs may settle others, so rounds follow until
nothing changes. Matching never lists pairs. Legs that no other leg can tell apart (equal in side, currency, amount, day and wording, or
day and reference; in account too, if that has legs of the amount on both sides) are one counted spot. A spot meets the counts of the
spots of the other side, less those of its own account: the best of these, how many legs share it and, if one does, which (exclusive
or of numbers of legs, which leaves the only one) is all that a round asks. Rows grow with the legs, also where very many have one
amount in one week. Rounds are DataFrame joins whose state is stored, step by step, so that no more is on disk than a step's shuffle
and its inputs: no group is collected into one task. ``candidates`` lists pairs for whoever wants to see them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import canonical
from tallyspark.functions.text import normalize_description
from tallyspark.operators.enrich import CARD_SIDE, CASH_SIDE, begins, card_inflow
from tallyspark.session import discard, stored

# Wording of transfers, own accounts and third parties, and names of banks.
TRANSFER = ("TRANSFERENCIA", "TRASPASO", "TRANSF", "TEF", "ABONO TRANSFERENCIA", "CARGO TRANSFERENCIA", "ENTRE CUENTAS", "CUENTA PROPIA")
OWN = ("CUENTA PROPIA", "ENTRE CUENTAS", "MIS CUENTAS", "TRASPASO")
THIRD = ("A TERCEROS", "DE TERCEROS", "TERCEROS", "TERCERO")
BANKS = {
    "banco-chile": ("BANCO DE CHILE", "BCH", "BANCHILE", "EDWARDS"),
    "banco-estado": ("BANCOESTADO", "BANCO ESTADO", "ESTADO", "CUENTARUT"),
    "banco-falabella": ("FALABELLA", "CMR"),
}
LEAST_REFERENCE = 6


def _says(text: Column, markers: tuple[str, ...]) -> Column:
    return text.rlike(rf"(?:^| )(?:{'|'.join(markers)})(?: |$)")


def _merge(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the legs: never by a copy of one of them in the driver and on every executor, as Spark would
    plan from the size of a well compressed file."""
    return left.join(right.hint("merge"), on, how)


def legs(facts: DataFrame, *more: str) -> DataFrame:
    """One row per leg, with columns named in ``more``: repeats of an account's fingerprint are one."""
    key = F.concat_ws(":", F.col("account_id").cast("string"), "fingerprint")
    text = normalize_description(F.col("description"))
    return facts.select(
        key.alias("leg"), "account_id", "date", "direction", "currency", canonical(F.abs("amount")).alias("amount_key"), text.alias("text"), F.coalesce("institution", F.lit("")).alias("institution"), "reference", "fingerprint", *more
    ).dropDuplicates(["leg"])


def _band(left: DataFrame, right: DataFrame, window: int, extra: Column) -> DataFrame:
    """Pairs with equal currency and amount at most ``window`` days apart; each right row goes to the bins it can reach.

    Pairs are far more than legs, so the number of tasks is given: Spark, which goes by bytes read, would merge them to a few long ones."""
    width = window + 1
    session = left.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 3 * session.sparkContext.defaultParallelism)
    day = lambda c: F.unix_date(c)
    a = left.withColumn("__bin", F.floor(day(F.col("o_date")) / width))
    b = right.withColumn("__bin", F.explode(F.array_distinct(F.array(*(F.floor((day(F.col("i_date")) + d) / width) for d in (-window, 0, window))))))
    a, b = a.repartition(tasks, "o_currency", "o_amount_key", "__bin"), b.repartition(tasks, "i_currency", "i_amount_key", "__bin")
    gap = F.abs(F.datediff("o_date", "i_date"))
    on = (F.col("o_currency") == F.col("i_currency")) & (F.col("o_amount_key") == F.col("i_amount_key")) & (a["__bin"] == b["__bin"]) & (gap <= window) & extra
    return _merge(a, b, on).drop("__bin").withColumn("gap_days", gap)


_TOLD = ["says_transfer", "says_own", "says_third", "bank", "banks", "long_reference"]


def _told(df: DataFrame, p: str = "") -> DataFrame:
    """Adds what the text, bank and reference of a leg tell (``_TOLD``; columns begin with p): its wordings, its bank and the banks it
    names as bits, and its reference if that is long enough. Read once a leg, as a leg may be in very many pairs."""
    text, institution, reference = (F.col(f"{p}{c}") for c in ("text", "institution", "reference"))
    bank = banks = F.lit(0)
    for k, (name, words) in enumerate(BANKS.items()):
        bank = F.when(institution == name, 1 << k).otherwise(bank)
        banks = banks + F.when(_says(text, words), 1 << k).otherwise(0)
    told = (_says(text, TRANSFER), _says(text, OWN), _says(text, THIRD), bank, banks, F.when(_long(reference), reference))
    return df.withColumns({f"{p}{name}": c for name, c in zip(_TOLD, told, strict=True)})


def _evidence(pairs: DataFrame) -> DataFrame:
    """Pairs (o_ and i_ columns, told) with the gap, the evidence and its rank."""
    o, i = (lambda name: F.col(f"o_{name}")), (lambda name: F.col(f"i_{name}"))
    pairs = pairs.withColumns(
        {
            "gap_days": F.abs(F.datediff("o_date", "i_date")),
            "transfer_wording": o("says_transfer") | i("says_transfer"),
            "own_account": o("says_own") | i("says_own"),
            "bank_named": (o("banks").bitwiseAND(i("bank")) != 0) | (i("banks").bitwiseAND(o("bank")) != 0),
            "shared_reference": F.coalesce(o("long_reference") == i("long_reference"), F.lit(False)),
            "third_party": o("says_third") | i("says_third"),
        }
    ).drop(*(f"{p}_{name}" for p in "oi" for name in _TOLD))
    strong = F.col("transfer_wording") & (F.col("own_account") | F.col("bank_named"))
    return pairs.withColumn("rank", F.when(F.col("shared_reference"), 3).when(strong, 2).when(F.col("transfer_wording"), 1).otherwise(0))


def _long(reference: Column) -> Column:
    return F.length(F.regexp_replace(F.trim(reference), "^0+", "")) >= LEAST_REFERENCE


def candidates(facts: DataFrame, window: int = 5) -> DataFrame:
    """Every outflow and inflow of one amount in different accounts within the window, with the evidence and its rank."""
    some = _told(legs(facts))
    side = lambda p, d: some.where(F.col("direction") == d).select([F.col(c).alias(f"{p}_{c}") for c in some.columns])
    return _evidence(_band(side("o", "out"), side("i", "in"), window, F.col("o_account_id") != F.col("i_account_id")))


_AMOUNT = ["currency", "amount_key"]
_KEYS = ["side", *_AMOUNT, "date", "owner", "wording", "reference_key"]
_SPOT = ["side", *_AMOUNT, "band", "day", "wording", "owner"]


def _wording(text: Column, institution: Column) -> Column:
    """What of a leg's text and bank decides the rank of its pairs, as one number: bit 0 a transfer's wording, bit 1 an own account,
    bits 2 and 3 its bank, from bit 4 on the banks it names."""
    bit = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    out = bit(_says(text, TRANSFER)) + bit(_says(text, OWN)) * 2
    for k, (bank, words) in enumerate(BANKS.items()):
        out = out + bit(institution == bank) * 4 * (k + 1) + bit(_says(text, words)) * 16 * 2**k
    return out


def _wording_rank(a: Column, b: Column) -> Column:
    either, bank = a.bitwiseOR(b), lambda c: F.shiftright(c, 2).bitwiseAND(3)
    names = lambda x, y: (bank(y) > 0) & (F.call_function("shiftright", x, bank(y) + 3).bitwiseAND(1) == 1)
    return F.when(either.bitwiseAND(1) == 0, 0).when((either.bitwiseAND(2) > 0) | names(a, b) | names(b, a), 2).otherwise(1)


def _numbered(df: DataFrame, what: str) -> DataFrame:
    """df stored, with a number for each row (``id``): what rounds carry instead of texts."""
    return stored(df.withColumn("id", F.monotonically_increasing_id()), what)


def _width(window: int) -> int:
    return 4 * window + 2


def _bin(day: Column, window: int) -> Column:
    return F.floor(day / _width(window)).cast("int")


def _bins(day: Column, window: int) -> Column:
    """The bins, two at most, whose days are within the window of day."""
    return F.explode(F.array_distinct(F.array(_bin(day - window, window), _bin(day + window, window))))


def _sided(some: DataFrame) -> DataFrame:
    """What rounds need of each leg. Its owner counts only if it has legs of the amount on both sides; else it is empty, as then nothing
    has to be left out."""
    on = [*_AMOUNT, "owner"]
    both = some.groupBy(*on).agg(F.min("side").alias("low"), F.max("side").alias("high")).where("low < high")
    both = stored(both.select(*on, F.lit(True).alias("both")), "owners")
    one = some.select("id", "side", *_AMOUNT, F.unix_date("date").alias("day"), "wording", "reference_key", "owner")
    out = stored(_merge(one, both, on, "left").withColumn("owner", F.when(F.col("both"), F.concat(F.lit("="), "owner")).otherwise("")).drop("both"), "sided")
    discard(both)
    return out


def _spots(sided: DataFrame) -> DataFrame:
    """Legs counted by spot: each is in the spot of its wording (band empty) and, if it has one, in that of its reference."""
    bands = F.explode(F.array_compact(F.array(F.lit(""), F.when(F.col("reference_key") != "", F.col("reference_key")))))
    banded = sided.withColumn("band", bands).withColumn("wording", F.when(F.col("band") == "", F.col("wording")).otherwise(-1))
    return banded.groupBy(*_SPOT).agg(F.count(F.lit(1)).alias("legs"), F.bit_xor("id").alias("which"))


def _best(met: Column, window: int) -> Column:
    """Of the counts that a spot meets (own ones are negative): the best quality that some leg is left of, how many, and which."""
    gap = lambda e: F.abs(e["day"] - F.col("day"))
    rank = lambda e: F.when(F.col("band") != "", 3).otherwise(_wording_rank(F.col("wording"), e["wording"]))
    near = F.transform(F.filter(met, lambda e: gap(e) <= window), lambda e: F.struct((rank(e) * (window + 1) + window - gap(e)).alias("quality"), e["legs"].alias("legs"), e["which"].alias("which")))
    first = F.struct(F.lit(-1).alias("quality"), F.lit(0).cast("bigint").alias("legs"), F.lit(0).cast("bigint").alias("which"))
    add = lambda a, e: F.struct(e["quality"].alias("quality"), (a["legs"] + e["legs"]).alias("legs"), a["which"].bitwiseXOR(e["which"]).alias("which"))
    return F.aggregate(F.sort_array(near, asc=False), first, lambda a, e: F.when(a["quality"] == e["quality"], add(a, e)).when(a["legs"] > 0, a).otherwise(e))


def _bests(spots: DataFrame, window: int) -> DataFrame:
    """(spot, partner) of every spot that has a pair; partner is the only leg of the best quality, or null if several share it.

    Counts of the other side are gathered by bins of days: at most so many as there are days and wordings."""
    entry = F.struct("day", "wording", "legs", "which")
    total = spots.groupBy((1 - F.col("side")).alias("side"), *_AMOUNT, "band", "day", "wording").agg(F.sum("legs").alias("legs"), F.bit_xor("which").alias("which"))
    on = ["side", *_AMOUNT, "band", "bin"]
    total = stored(total.withColumn("bin", _bins(F.col("day"), window)).groupBy(*on).agg(F.collect_list(entry).alias("met")), "counts")
    own = spots.where("owner != ''").withColumns({"side": 1 - F.col("side"), "legs": -F.col("legs"), "bin": _bins(F.col("day"), window)})
    own = own.groupBy(*on, "owner").agg(F.collect_list(entry).alias("own"))
    spots = spots.drop("legs", "which").withColumn("bin", _bin(F.col("day"), window))
    owned = _merge(spots.where("owner != ''"), own, [*on, "owner"], "left")
    plain = spots.where("owner = ''").withColumn("own", F.lit(None).cast(own.schema["own"].dataType))
    met = _merge(plain.unionByName(owned), total, on)
    best = met.select(*_SPOT, _best(F.when(F.col("own").isNull(), F.col("met")).otherwise(F.concat("met", "own")), window).alias("best"))
    out = stored(best.where("best.legs > 0").select(*_SPOT, F.when(F.col("best.legs") == 1, F.col("best.which")).alias("partner")), "bests")
    discard(total)
    return out


def _paired(sided: DataFrame, bests: DataFrame) -> DataFrame:
    """The legs that have a pair, with the partner of their best one, or null; a pair by reference is better than any other."""
    spot = [c for c in _SPOT if c != "band"]
    worded = bests.where("band = ''").drop("band")
    plain = _merge(sided.where("reference_key = ''"), worded, spot)
    by_reference = bests.where("band != ''").select("side", *_AMOUNT, F.col("band").alias("reference_key"), "day", "owner", F.struct("partner").alias("best"))
    some = _merge(sided.where("reference_key != ''"), worded.select(*spot, F.struct("partner").alias("next")), spot, "left")
    some = _merge(some, by_reference, ["side", *_AMOUNT, "reference_key", "day", "owner"], "left").where("best is not null or next is not null")
    return plain.unionByName(some.withColumn("partner", F.coalesce("best", "next")["partner"]).drop("best", "next"))


def _ends(settled: DataFrame) -> DataFrame:
    """(id, pair, side): both legs of each pair, which is named by its outgoing one."""
    end = lambda c, side: F.struct(F.col(c).alias("id"), F.col("o_id").alias("pair"), F.lit(side).alias("side"))
    return settled.select(F.explode(F.array(end("o_id", 0), end("i_id", 1))).alias("end")).select("end.*")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionAll(more)
    return out


def _rounds(some: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(settled o_id and i_id, id of what is left and still has a pair), by rounds of unique mutual bests until a round settles none.
    some: see ``settle``, with id."""
    sided, rounds, still = _sided(some), [], []
    while True:
        spots = stored(_spots(sided), "spots")
        bests = _bests(spots, window)
        discard(spots)
        paired = stored(_paired(sided, bests), "paired")
        discard(sided, bests)
        sure = paired.where("partner is not null")
        a, b = sure.where("side = 0").select(*_AMOUNT, F.col("id").alias("o_id"), F.col("partner").alias("i_id")), sure.where("side = 1").select(F.col("partner").alias("o_id"), F.col("id").alias("i_id"))
        now = stored(_merge(a, b, ["o_id", "i_id"]), "settled")
        rounds.append(now.select("o_id", "i_id"))
        if now.isEmpty():
            still.append(paired.select("id"))
            # the last round is empty: said so, or Spark would move all legs before it finds that no pair asks for them
            return _union(rounds[:-1] or [now.select("o_id", "i_id").limit(0)]), _union(still)
        # pairs are of one amount: where none was settled, all is as it was, and a leg without a pair never gets one
        moved = now.select(*_AMOUNT).distinct()
        still.append(stored(_merge(paired, moved, _AMOUNT, "left_anti").select("id"), "open"))
        sided = _merge(_merge(paired.drop("partner"), moved, _AMOUNT, "left_semi"), _ends(now).select("id"), "id", "left_anti")
        sided = stored(sided, "sided")
        discard(paired)


def _known(some: DataFrame) -> DataFrame:
    return some.where(" and ".join(f"{c} is not null" for c in _KEYS))


def settle(some: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(settled o_leg and i_leg, what is left of ``some``, what is left and still has a pair), by rounds of unique mutual bests until a
    round settles none.

    some: leg, side (0 out, 1 in), currency, amount_key, date, owner (legs of one owner make no pair), wording, reference_key."""
    some = _numbered(_known(some), "numbered")
    settled, still = _rounds(some, window)
    ends = stored(_merge(_ends(settled), some.select("id", "leg"), "id"), "ends")
    leg = lambda name, side: F.max(F.when(F.col("side") == side, F.col("leg"))).alias(name)
    named = ends.groupBy("pair").agg(leg("o_leg", 0), leg("i_leg", 1)).drop("pair")
    return named, _merge(some, ends.select("id"), "id", "left_anti").drop("id"), _merge(some, still, "id", "left_semi").drop("id")


def _ties(open_: DataFrame, window: int) -> DataFrame:
    """(o_leg, i_leg, hung): of the pairs among open legs as many as hold together what all of them hold together; hung, 0 out, 1 in, is
    the side of a leg that is in no other of them.

    The first leg of each of the three first owners of a side and day meets those of the other side; every other leg meets one of them
    that its owner lets it meet. Two legs that meet a day of three owners share one of these, so a leg beyond the first three owners
    meets by any one of its pairs all that it meets."""
    day = ["side", *_AMOUNT, "day"]
    first = open_.groupBy(*day, "owner").agg(F.min("leg").alias("leg"))
    three = stored(first.withColumn("place", F.row_number().over(Window.partitionBy(*day).orderBy("owner"))).where("place <= 3").drop("place"), "three")
    on = [*_AMOUNT, "bin"]
    met = three.withColumn("bin", _bins(F.col("day"), window)).groupBy(*on).agg(F.collect_list(F.struct("side", "day", "owner", "leg")).alias("met"))
    legs_ = _merge(open_.withColumn("bin", _bin(F.col("day"), window)), stored(met, "met"), on)
    is_first = F.exists("met", lambda e: (e["side"] == F.col("side")) & (e["day"] == F.col("day")) & (e["leg"] == F.col("leg")))
    others = F.filter("met", lambda e: (e["side"] != F.col("side")) & (F.abs(e["day"] - F.col("day")) <= window) & (e["owner"] != F.col("owner")))
    # pairs of two firsts are listed by the outgoing one
    legs_ = legs_.select("side", "leg", is_first.alias("is_first"), F.transform(others, lambda e: e["leg"]).alias("others")).where("not is_first or side = 0")
    pairs = legs_.select("side", "leg", F.when(~F.col("is_first"), F.col("side")).alias("hung"), F.explode(F.when(F.col("is_first"), F.col("others")).otherwise(F.slice("others", 1, 1))).alias("other"))
    leg = lambda side: F.when(F.col("side") == side, F.col("leg")).otherwise(F.col("other"))
    return pairs.select(leg(0).alias("o_leg"), leg(1).alias("i_leg"), "hung")


def transfers(facts: DataFrame, window: int = 5, confirm_window: int = 2) -> tuple[DataFrame, DataFrame]:
    """(matches with confidence and reason, the open legs)."""
    some = _numbered(legs(facts), "legs")
    reference = F.when(F.coalesce(_long(F.col("reference")), F.lit(False)), F.col("reference")).otherwise("")
    side, owner = (F.col("direction") == "in").cast("int").alias("side"), F.col("account_id").cast("string").alias("owner")
    sided = some.where(F.col("direction").isin("out", "in"))
    settled, still = _rounds(_known(sided.select("id", side, *_AMOUNT, "date", owner, _wording(F.col("text"), F.col("institution")).alias("wording"), reference.alias("reference_key"))), window)
    open_ = _merge(sided.select("id", "leg", side, *_AMOUNT, F.unix_date("date").alias("day"), owner), still, "id", "left_semi").drop("id")
    # the legs of a pair are sought at once: all legs move once
    found, columns = _merge(_ends(settled), some, "id"), [c for c in some.columns if c != "id"]
    leg = lambda p, k: F.first(F.when(F.col("side") == k, F.struct(*columns)), ignorenulls=True).alias(p)
    pairs = found.groupBy("pair").agg(leg("o", 0), leg("i", 1))
    matched = _evidence(_told(_told(pairs.select(*(F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "oi" for c in columns)), "o_"), "i_"))
    strong = F.col("shared_reference") | F.col("transfer_wording") & (F.col("own_account") | F.col("bank_named"))
    confidence = F.when(~F.col("third_party") & strong & (F.col("gap_days") <= confirm_window), "confirmed").otherwise("suggested")
    reason = F.concat(
        F.concat_ws(
            "; ",
            F.when(F.col("gap_days") == 0, "Mismo día").otherwise(F.concat("gap_days", F.lit(" día(s) de diferencia"))),
            F.lit("mismo monto en cuentas distintas"),
            F.when(F.col("shared_reference"), "misma referencia bancaria"),
            F.when(F.col("transfer_wording"), "la glosa menciona una transferencia"),
            F.when(F.col("own_account"), "la glosa indica cuenta propia"),
            F.when(F.col("bank_named"), "la glosa nombra al otro banco"),
            F.when(F.col("third_party"), "pero la glosa menciona a un tercero, así que no se confirma sola"),
        ),
        F.lit("."),
    )
    return matched.withColumns({"confidence": confidence, "reason": reason}), open_


def match_transfers(facts: DataFrame, window: int = 5, confirm_window: int = 2) -> tuple[DataFrame, DataFrame]:
    """(matches with confidence and reason, pairs that hold the open legs together)."""
    matched, open_ = transfers(facts, window, confirm_window)
    return matched, _ties(stored(open_, "open"), window)


def knots(ambiguous: DataFrame) -> DataFrame:
    """(leg, knot): the open legs by connected component, named by the least leg; labels spread until they settle. Legs of one pair wait
    and take what the other leg got."""
    pairs = stored(ambiguous, "pairs")
    leg = lambda out, name: F.when(out, F.col("o_leg")).otherwise(F.col("i_leg")).alias(name)
    alone = pairs.where("hung is not null").select(leg(F.col("hung") == 0, "leg"), leg(F.col("hung") == 1, "one"))
    edges = pairs.where("hung is null").select(F.col("o_leg").alias("a"), F.col("i_leg").alias("b"))
    edges = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    some = edges.unionAll(alone.select(F.col("one").alias("a"), F.col("leg").alias("b"))).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("one"))
    some = stored(some.select(F.col("a").alias("leg"), "n", "one", F.least("a", "one").alias("knot")), "legs")
    many = some.where("n > 1").select("leg")
    inner = _merge(_merge(edges, many.select(F.col("leg").alias("a")), "a", "left_semi"), many.select(F.col("leg").alias("b")), "b", "left_semi")
    inner, new = stored(inner, "inner"), stored(some.where("n > 1").select("leg", "knot"), "labels")
    while True:
        before, labels = new, new.select("leg", "knot")
        near = _merge(inner, labels, F.col("b") == F.col("leg")).groupBy("a").agg(F.min("knot").alias("other"))
        hop = labels.select(F.col("leg").alias("at"), F.col("knot").alias("further"))
        new = _merge(labels, near, F.col("leg") == F.col("a"), "left").select("leg", F.least("knot", "other").alias("knot"), F.col("knot").alias("old"))
        new = _merge(new, hop, F.col("knot") == F.col("at"), "left").select("leg", F.least("further", "knot").alias("knot"), "old")
        new = stored(new, "labels")
        labels = new.select("leg", "knot")
        discard(before)
        if new.where("knot != old").isEmpty():
            break
    discard(inner)
    # of a pair that has nothing else, each leg is the other's only one
    named = labels.select(F.col("leg").alias("at"), F.col("knot").alias("got"))
    alone = some.where("n = 1").select("leg", "one", "knot").unionAll(alone.select("leg", "one", F.lit(None).cast("string").alias("knot")))
    hung = _merge(alone, named, F.col("one") == F.col("at"), "left").select("leg", F.coalesce("got", "knot").alias("knot"))
    return labels.unionAll(hung)


def _within(some: DataFrame, others: DataFrame, window: int) -> DataFrame:
    """(leg, rivals): how many of ``others`` have the amount of a leg of ``some`` within the window; legs without any are left out."""
    on = [*_AMOUNT, "bin"]
    counts = others.groupBy(*_AMOUNT, F.unix_date("date").alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("bin", _bins(F.col("day"), window))
    met = some.withColumn("day", F.unix_date("date")).withColumn("bin", _bin(F.col("day"), window))
    met = _merge(met, counts.groupBy(*on).agg(F.collect_list(F.struct("day", "n")).alias("near")), on)
    rivals = F.aggregate(F.filter("near", lambda e: F.abs(e["day"] - F.col("day")) <= window), F.lit(0).cast("bigint"), lambda n, e: n + e["n"])
    return met.select("leg", rivals.alias("rivals")).where("rivals > 0")


def match_card_payments(facts: DataFrame, window: int = 5) -> DataFrame:
    """Card payments of cash accounts with the card's credit where one is nearest and the only one; then payments without (``rivals``:
    credits left open in their window), and credits worded as payments that no payment could be paired with. facts need is_card."""
    some = stored(legs(facts, "is_card"), "legs")
    out = some.where((F.col("direction") == "out") & ~F.col("is_card") & begins(F.col("text"), CASH_SIDE))
    credit = some.where((F.col("direction") == "in") & F.col("is_card") & (card_inflow(F.col("text")) != "reversal"))
    sided = lambda df, k: df.select("leg", F.lit(k).alias("side"), *_AMOUNT, "date", F.lit(str(k)).alias("owner"), F.lit(0).alias("wording"), F.lit("").alias("reference_key"))
    both = stored(sided(out, 0).unionAll(sided(credit, 1)), "payments")
    matched, left, _ = settle(both, window)
    found = matched.select(F.col("o_leg").alias("payment"), F.col("i_leg").alias("credit"), F.lit("confirmed").alias("confidence"), F.lit("paired").alias("reason"), F.lit(0).cast("bigint").alias("rivals"))
    rivals = _within(left.where("side = 0"), left.where("side = 1"), window)
    open_ = _merge(_merge(out.select("leg"), matched.select(F.col("o_leg").alias("leg")), "leg", "left_anti"), rivals, "leg", "left")
    none = F.lit(None).cast("string")
    open_ = open_.select(F.col("leg").alias("payment"), none.alias("credit"), F.lit("suggested").alias("confidence"), F.when(F.col("rivals") > 0, "equal-rivals").otherwise("statement-missing").alias("reason"), F.coalesce("rivals", F.lit(0)).alias("rivals"))
    paired = _within(both.where("side = 1"), both.where("side = 0"), window)
    lone = _merge(credit.where(begins(F.col("text"), CARD_SIDE)).select("leg"), paired, "leg", "left_anti")
    lone = lone.select(F.col("leg").alias("payment"), none.alias("credit"), F.lit("suggested").alias("confidence"), F.lit("charge-missing").alias("reason"), F.lit(0).cast("bigint").alias("rivals"))
    return found.unionByName(open_).unionByName(lone)


def stamp(facts: DataFrame, matches: DataFrame, kind: str = "internal_transfer") -> DataFrame:
    """Facts with kind, confidence and counterpart set on both legs of each match."""
    end = lambda a, b: F.struct(F.col(f"{a}_leg").alias("leg"), F.col(f"{b}_fingerprint").alias("counterpart_fingerprint"), F.col("confidence").alias("__sure"))
    both = stored(matches.select(F.explode(F.array(end("o", "i"), end("i", "o"))).alias("end")).select("end.*"), "stamps")
    out = _merge(facts.withColumn("leg", F.concat_ws(":", F.col("account_id").cast("string"), "fingerprint")), both, "leg", "left")
    hit = F.col("__sure").isNotNull()
    return out.withColumns({"kind": F.when(hit, kind).otherwise(F.col("kind")), "kind_confidence": F.coalesce("__sure", "kind_confidence")}).drop("leg", "__sure")


def stamp_payments(facts: DataFrame, paid: DataFrame) -> DataFrame:
    """Facts with both legs of each paired card payment marked as one, with the other's fingerprint. paid: ``match_card_payments``."""
    named = lambda side, leg: legs(facts).select(F.col("leg").alias(leg), F.col("fingerprint").alias(f"{side}_fingerprint"))
    pairs = paid.where("credit is not null").select(F.col("payment").alias("o_leg"), F.col("credit").alias("i_leg"), "confidence")
    return stamp(facts, _merge(_merge(pairs, named("o", "o_leg"), "o_leg"), named("i", "i_leg"), "i_leg"), "credit_card_payment")


def window(facts: DataFrame, start: str, end: str) -> DataFrame:
    """Movements of the days from start to end, both included."""
    return facts.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def reconcile(facts: DataFrame, start: str, end: str, days: int = 5) -> dict[str, DataFrame]:
    """Transfers (confirmed and suggested), knots of ambiguous ones, card payments, and every leg that found its other, in one window
    of time; ``days`` holds for transfers and card payments alike. facts need is_card."""
    some = window(facts, start, end)
    matched, ambiguous = match_transfers(some, days)
    paid = match_card_payments(some, days)
    legs_of = lambda df, *columns: [df.select(F.col(c).alias("leg")) for c in columns]
    sides = [*legs_of(matched, "o_leg", "i_leg"), *legs_of(paid.where("credit is not null"), "payment", "credit")]
    found = sides[0]
    for more in sides[1:]:
        found = found.unionByName(more)
    sure = F.col("confidence") == "confirmed"
    return {"confirmed": matched.where(sure), "suggested": matched.where(~sure), "ambiguous": knots(ambiguous), "card_payments": paid, "matched_legs": found.distinct()}


def with_account_type(facts: DataFrame, accounts: DataFrame) -> DataFrame:
    """Adds account_type from accounts (id, account_type); null where the account isn't known."""
    return facts.join(accounts.select(F.col("id").alias("__id"), "account_type").dropDuplicates(["__id"]), F.col("account_id") == F.col("__id"), "left").drop("__id")


def ordered(matches: DataFrame) -> DataFrame:
    """Matches by the day of the outgoing leg."""
    return matches.orderBy("o_date", "o_leg", "i_leg")
