import re
from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.llm import fill_middle as M


def units(text):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="abZ \n\0<P>SM9é😀Ωk[`{@?", max_size=40), st.sampled_from([1, 2, 3, 1 << 22]))
def test_every_rank_is_found_from_events(text, chunk):
    M._CHUNK = chunk
    changes, marked = M.events(text)
    ranks, all_units = M.Ranks(text, changes), units(text)
    M._CHUNK = 1 << 22
    assert marked == any(s in text for s in M.SENTINELS)
    assert [ranks.place(k) for k in range(ranks.n + 1)] == [len("".join(all_units[:k])) for k in range(len(all_units) + 1)]


def plain(id_, text):
    text = text or ""
    u, digest = units(text), sha256(f"1:{'' if id_ is None else id_}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    prefix, middle, suffix = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(s in text for s in M.SENTINELS) or h[2] % 100 >= 90:
        return (id_, len(u), "plain", None, None, text)
    if h[3] % 100 < 20:
        return (id_, len(u), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (id_, len(u), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


def test_rows_equal_the_plain_version_and_come_back(spark):
    texts = [None, "", "a", " ", "é", "one two, three!", "<P> held", "a <S", "P>S>M>", "<<P<<", "word " * 60000, "ж" * 5000 + "a", "a\n\nb\0c"]
    rows = [(k, texts[k % len(texts)], "x", "n") for k in range(130)] + [(3, "twice over", "x", "n")] * 2 + [(None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n string")
    out = M.fill_in_middle(docs)
    back = out.select("*", M.restored(F.col("output"), F.col("form")).alias("back")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted([tuple(r)[:6] for r in back], key=key) == sorted([plain(i, t) for i, t, *_ in rows], key=key)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    given = sorted((t or "") for _, t, *_ in rows)
    assert sorted(r.back for r in back) == given


def test_empty_table(spark):
    assert M.fill_in_middle(spark.createDataFrame([], "doc_id string, text string")).collect() == []
