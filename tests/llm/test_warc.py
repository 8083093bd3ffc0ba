import gzip
import hashlib
import io

from tallyspark.llm import warc as W
from tallyspark.llm.common import shared_path, stored


def round_trip(spark, df):
    folder = shared_path(spark, "warc")
    manifest = stored(W.write_archives(df, folder, archive_bytes=2000), "manifest")
    return W.read_archives(manifest, tasks=3).collect()


def test_round_trip(spark):
    big = "é" * 80
    rows = [(5, "http://a/ b\n", big), (3, None, big), (9, "u", big), (1, "u", "x"), (2, "u", "x"), (4, "u", None), (None, "u", big), (3, None, big), (8, "u", "WARC/1.1\r\n\r\n" * 20)]
    got = round_trip(spark, spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int"))
    assert all(r.kind == "record" for r in got) and len(got) == len(rows)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        kind = "revisit" if html == big and page != 3 else "response"
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), kind, 3 if kind == "revisit" else None))
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")) == []


def of(i, text):
    data = text.encode()
    return W.record(i, f"u{i}", data, hashlib.sha256(data).hexdigest(), None, "2024-01-01T00:00:00Z")


def test_salvage_of_damaged_archives():
    members = [gzip.compress(of(i, f"page {i} " * 50)) for i in range(6)]
    starts = [sum(map(len, members[:i])) for i in range(6)]
    data = bytearray(b"".join(members))
    data[starts[1] + 40] ^= 255
    data[starts[3] : starts[3] + 3] = b"xyz"
    got = list(W.salvage(io.BytesIO(data), len(data)))
    assert [r["page_id"] for r in got if r["kind"] == "record"] == [0, 2, 4, 5]
    assert [(r["offset"], r["length"]) for r in got if r["kind"] == "gap"] == [(starts[1], len(members[1])), (starts[3], len(members[3]))]
    cut = bytes(data[: starts[5] + 30])
    last = list(W.salvage(io.BytesIO(cut), len(cut)))[-1]
    assert (last["kind"], last["offset"], last["length"]) == ("gap", starts[5], 30)


def test_salvage_of_plain_records_and_bad_digests():
    parts = [of(0, "a" * 400_000), of(1, "bbbb"), of(2, "cccc"), b"junk\x1f\x8b\x08junk", gzip.compress(of(3, "d") + of(4, "e"))]
    parts[1] = parts[1].replace(b"bbbb", b"bbbx")
    data = b"".join(parts)
    got = list(W.salvage(io.BytesIO(data), len(data)))
    assert [r["page_id"] for r in got if r["kind"] == "record"] == [0, 2, 3, 4]
    assert [r["reason"] for r in got if r["kind"] == "gap"] == ["payload digest", "no version line"]
    assert sum(r["length"] for r in got if r["kind"] == "gap") == len(parts[1]) + len(parts[3])
    assert list(W.salvage(io.BytesIO(b""), 0)) == []
