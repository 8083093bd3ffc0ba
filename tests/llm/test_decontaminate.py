import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import decontaminate as D


def plain_nearest(item, text):
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        row = [i]
        for j, x in enumerate(text, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (c != x)))
        prev = row
    return min(prev)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=90), st.text("abc", max_size=60))
def test_myers_equals_dynamic_programming(item, text):
    assert D.nearest(item, text)[0] == min(len(item), plain_nearest(item, text))


def edit(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("abcdefgh") + text[i:], text[:i] + rng.choice("abcdefgh") + text[i + 1 :]])
    return text


def test_finds_all_within_budget_and_nothing_else(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randint(12, 40))) for i in range(30)]
    rows, want = [], set()
    for d in range(200):
        text = say(60)
        if d % 3 == 0:
            i, item = items[d % 30]
            n = rng.choice([0, 1, int(len(item) * 0.05)])
            text = f"{say(5)}. {edit(rng, item, n).upper()} -- {say(9)}"
        rows.append((d, text))
    for d, text in rows:
        for i, item in items:
            a, b = D.normal(item), D.normal(text)
            if plain_nearest(a, b) <= int(len(a) * 0.06):
                want.add((d, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) >= 60
    in_blocks = D.leaks(docs, bench, block_chars=500).collect()
    assert {(r.doc_id, r.item_id) for r in in_blocks} == want


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "So: That IT. x", 0), (4, "xthat itx", 0), (5, "that it that it", 0), (5, "that it that it", 0)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, "That it."), (8, "that   it"), (9, None), (None, "..."), (10, "")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.start) for r in D.leaks(docs, bench).collect())
    assert got == [(0, 7, 3), (0, 8, 3)] + [(5, i, s) for i in (7, 8) for s in (0, 8) for _ in range(2)]
    assert D.leaks(docs.limit(0), bench).count() == 0 and D.leaks(docs, bench.limit(0)).count() == 0


def test_short_items_have_their_budget_too(spark):
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    items = [(i, f"{say(6)} {say(7)} {say(n)}"[: 17 + i]) for i, n in enumerate([9] * 16)]
    rows, want = [], set()
    for d in range(160):
        i, item = items[d % 16]
        rows.append((d, f"{say(4)} {edit(rng, item, d // 16 % 3)} {say(5)}"))
    for d, text in rows:
        for i, item in items:
            if plain_nearest(D.normal(item), D.normal(text)) <= int(len(D.normal(item)) * 0.06):
                want.add((d, i))
    got = D.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 80


def test_equal_items_and_one_larger_than_a_block(spark):
    long = " ".join(f"w{i}" for i in range(400))
    items = [(i, "the very same question asked again") for i in range(500)] + [(900, long)]
    docs = spark.createDataFrame([(1, "so the very same question asked again it is"), (2, "x " + long)], "doc_id long, text string")
    got = D.leaks(docs, spark.createDataFrame(items, "item_id long, text string"), block_chars=300).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, i) for i in range(500)] + [(2, 900)]
