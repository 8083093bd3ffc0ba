"""A bad record costs a member of several records nothing but itself."""

import gzip
import io

from tallyspark.llm import warc as W
from tests.llm.test_warc import of


def test_bad_record_inside_a_member():
    parts = [of(0, "aaaa"), of(1, "bbbb").replace(b"bbbb", b"bbbx"), of(2, "cccc"), b"junk"]
    data = gzip.compress(b"".join(parts)) + gzip.compress(of(3, "dddd"))
    got = list(W.salvage(io.BytesIO(data), len(data)))
    assert [r["page_id"] for r in got if r["kind"] == "record"] == [0, 2, 3]
    member = len(gzip.compress(b"".join(parts)))
    place = lambda i: f"in the unpacked member at {sum(map(len, parts[:i]))}, {len(parts[i])} bytes"
    assert [(r["offset"], r["length"], r["reason"]) for r in got if r["kind"] == "gap"] == [(0, member, f"payload digest, {place(1)}"), (0, member, f"no version line, {place(3)}")]
