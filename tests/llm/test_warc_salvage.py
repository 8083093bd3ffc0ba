"""What the salvage reader keeps of damaged members, long headers and revisits without a response."""

import gzip
import hashlib
import io
import zlib

from tallyspark.llm import warc as W
from tallyspark.llm.common import shared_path, stored
from tests.llm.test_warc import of


def read(data):
    return list(W.salvage(io.BytesIO(data), len(data)))


def ids(rows):
    return [r["page_id"] for r in rows if r["kind"] == "record"]


def test_one_damaged_of_ten_in_a_member():
    parts = [of(i, f"page {i} " * 30) for i in range(10)]
    parts[4] = parts[4].replace(b"page 4", b"page X", 1)
    got = read(gzip.compress(b"".join(parts)) + gzip.compress(of(10, "end")))
    assert ids(got) == [0, 1, 2, 3, 5, 6, 7, 8, 9, 10]
    assert len([r for r in got if r["kind"] == "gap"]) == 1


def test_cut_member_and_bad_crc_keep_what_has_its_digest():
    parts = [of(i, hashlib.sha256(str(i).encode()).hexdigest() * 40) for i in range(10)]
    whole = gzip.compress(b"".join(parts))
    got = read(whole[: len(whole) * 6 // 10])
    assert ids(got) == list(range(len(ids(got)))) and 3 <= len(ids(got)) <= 6
    assert got[-1] == {"kind": "gap", "offset": 0, "length": len(whole) * 6 // 10, "reason": "cut member"}
    bad = bytearray(whole)
    bad[-8] ^= 1  # the CRC
    got = read(bytes(bad) + gzip.compress(of(10, "end")))
    assert ids(got) == list(range(11)) and got[0]["reason"].startswith("kept by its payload digest")
    assert [(r["offset"], r["length"]) for r in got if r["kind"] == "gap"] == [(0, len(bad))]


def test_long_headers(spark):
    url = "http://a/" + "x" * 1_500_000
    df = spark.createDataFrame([(1, url, "a" * 200), (2, None, "b")], "page_id long, url string, html string")
    manifest = stored(W.write_archives(df, shared_path(spark, "warc")), "manifest")
    got = W.read_archives(manifest, tasks=2).collect()
    assert sorted((r.kind, r.page_id, len(r.url or "")) for r in got) == [("record", 1, len(url)), ("record", 2, 0)]


def test_members_larger_than_a_piece():
    rng = hashlib.sha256()
    text = "".join((rng.update(b"x"), rng.hexdigest())[1] for _ in range(20_000))
    data = gzip.compress(of(0, text) + of(1, "z" * 3_000_000) + of(2, text[:1000])) + of(3, text) + gzip.compress(of(4, text))
    got = read(data)
    assert ids(got) == [0, 1, 2, 3, 4] and all(r["kind"] == "record" for r in got)
    assert got[1]["payload_bytes"] == 3_000_000


def test_lying_lengths_and_empty_members():
    lying = of(0, "abc").replace(b"Content-Length: ", b"Content-Length: 99999999", 1)
    empty = gzip.compress(b"")
    got = read(lying + empty + gzip.compress(lying) + of(1, "d"))
    assert ids(got) == [1] and got[0]["length"] == len(lying) + len(empty) + len(gzip.compress(lying))


def test_revisits_are_checked_against_their_response(spark, tmp_path):
    digest = hashlib.sha256(b"p" * 200).hexdigest()
    there = of(1, "p" * 200)
    good = W.record(2, "u", b"p" * 200, digest, 1, "d")
    dangling = W.record(3, "u", b"q" * 200, hashlib.sha256(b"q" * 200).hexdigest(), 9, "d")
    wrong = W.record(4, "u", b"p" * 200, digest, 1, "d").replace(f"Payload-Digest: sha256:{digest}".encode(), b"Payload-Digest: sha256:" + b"0" * 64)
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(gzip.compress(x) for x in (good, dangling, there, wrong)))
    manifest = spark.createDataFrame([(f"file://{path}",)], "path string")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes, r.payload_digest == digest, r.reason) for r in W.resolved(W.read_archives(manifest, tasks=1)).collect()}
    assert got == {
        1: ("response", None, 200, True, None),
        2: ("revisit", 1, 200, True, None),
        3: ("revisit", None, 200, False, "no response"),
        4: ("revisit", 1, 200, True, "payload digest of the response"),
    }


def test_flipped_bytes_lose_little():
    members = [gzip.compress(of(i, f"text {i} " * 200), compresslevel=1) for i in range(30)]
    data = b"".join(members)
    for seed in range(40):
        k = zlib.crc32(bytes([seed])) % len(data)
        hurt = bytearray(data)
        hurt[k] ^= 0x55
        assert len(set(ids(read(bytes(hurt))))) >= 29
