from hashlib import sha256
from itertools import groupby
from zlib import crc32

from pyspark.sql import functions as F

from tallyspark.llm import merkle as M


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(nodes, fanout):
    """Root, and for each node the siblings' digests of its path."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // fanout * fanout :][:fanout]
            proofs[k] += run[: i % fanout] + run[i % fanout + 1 :]
        nodes, at = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)], [i // fanout for i in at]
    return nodes[0], proofs


def plain(rows, fanout=8):
    key = lambda r: (r[2] is not None, (r[2] or "").encode())
    groups = [sorted(((r[0], leaf(*r)) for r in g), key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for _, g in groupby(sorted(rows, key=key), key)]
    trees = [tree([h for _, h in g], fanout) for g in groups]
    root, over = tree([t[0] for t in trees], fanout)
    return sorted((str(i), h, t[0], root, H(*p, *o)) for g, t, o in zip(groups, trees, over, strict=True) for (i, h), p in zip(g, t[1], strict=True))


def rows_of(n):
    langs = [None, "", "en", "en", "en", "en", "en", "é", "zz"]
    out = [(k, "s" if k % 3 else None, langs[k * k % 9], k, f"Text {k}é" if k % 5 else None) for k in range(n)]
    return out + [(None, None, "en", None, "No Id"), (None, None, "en", None, None), (7, "x", "en", 1, "same"), (7, "x", "en", 1, "same"), (7, "x", "en", 1, "Other"), (n, None, "alone", None, "x")]


def found(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, rank string")
    fields = [F.col(c) for c in docs.columns[:5]]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, M.ascii_lower(F.col("text"))).otherwise(F.col("text"))
    out = M.manifest(docs, fields, claimed=M.leaf(*fields[:4], changed), **how)
    return out.select("*", M.siblings_digest(F.col("proof")).alias("digest"), M.folded(F.col("claimed"), F.col("proof")).alias("back"), M.folded(F.col("leaf"), F.col("proof")).alias("own")).collect()


def test_equal_to_plain_trees_over_several_rounds(spark):
    rows = rows_of(700)
    for how in ({}, {"fanout": 2, "levels": 3}, {"fanout": 8, "levels": 1}):
        got = found(spark, rows, **how)
        assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.digest) for r in got) == plain(rows, how.get("fanout", 8))
        assert all(r.own == r.root for r in got)


def test_tampered_rows_do_not_verify(spark):
    rows = rows_of(60)
    texts = {leaf(*r): (r[0], r[4]) for r in rows}
    for r in found(spark, rows):
        id_, text = texts[r.leaf]
        changed = id_ is not None and crc32(str(id_).encode()) % 3 == 0 and text is not None and any("A" <= c <= "Z" for c in text)
        assert (r.back == r.root) != changed


def test_one_row_and_none(spark):
    (one,) = found(spark, [(1, None, None, 2, "x")])
    assert one.leaf == one.subroot == one.root == leaf(1, None, None, 2, "x") and one.proof == [] and one.digest == H()
    assert found(spark, []) == []
