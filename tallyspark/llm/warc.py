"""WARC archives: writing pages with revisit records, and a salvage reader.

``write_archives`` writes gzip archives, one member per record, into a folder that all executors share, and returns a
manifest of the files that successful tasks wrote (a lost or repeated task leaves files that no manifest names). Of records
with equal payloads of at least ``least`` bytes the one with the smallest page id is a response, the others are revisits of it.
A record's id follows from its page and payload, so that a revisit names its response without looking it up; repeated rows of a
response repeat the record with its id. The folder is qualified as Spark does it (``fs.defaultFS`` for a path without scheme).

``read_archives`` reads any WARC files, gzip or plain, a block at a time; of a record, only its own bytes are held. Where a check
fails (gzip CRC, version line, headers, length, record end, payload digest) it searches for the next valid member or version
line, goes on from there, and returns the skipped bytes as a ``gap`` row with file, offset, length and reason. Inside a member of
several records it does the same: such a gap has the member's offset and length, and its place in the unpacked member in the
reason. Of a member that can't be unpacked to its end or fails its CRC, the responses whose payloads have their digests are kept,
with the fault as their reason; the member is a gap all the same.

``resolved`` checks revisits against their responses: size, digest and page come from the response that WARC-Refers-To names.

Null html is an empty payload. Null and repeated page ids are kept: repeated rows of a response are all responses, a null id
is the largest. Only page_id, url and html are read of a table. An empty table gives an empty manifest.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records bigint, bytes bigint"
RECORDS = (
    "kind string, path string, offset bigint, length bigint, reason string, page_id bigint, url string, "
    "record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, record_id string, refers_to_record string"
)
_ARROW = pa.schema(
    [("kind", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()), ("page_id", pa.int64()), ("url", pa.string())]
    + [("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("record_id", pa.string()), ("refers_to_record", pa.string())]
)


def record_id(page_id: int | None, digest: str) -> str:
    """The id of the response with this page and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'response:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    own = record_id(page_id, digest) if refers_to is None else f"<urn:uuid:{uuid.uuid4()}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}"]
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-Id: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark takes it to have."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _filesystem(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def write_archives(pages: DataFrame, folder: str, *, least: int = 100, archive_bytes: int = 32 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives when the returned manifest (path, records, bytes) is computed; store it before reading."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"))
    first = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.where((F.col("n") > 1) & F.col("first").isNotNull()).select(F.col("digest").alias("of"), "first")
    rows = rows.join(first, F.col("digest") == F.col("of"), "left")
    refers_to = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to")
    return rows.select("page_id", "url", "payload", "digest", refers_to).mapInArrow(_writing(qualified(pages.sparkSession, folder), archive_bytes, date), MANIFEST)


def _writing(folder: str, archive_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(folder)
        system.create_dir(base, recursive=True)
        out, name, records, size, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out, records, size = system.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                packer = zlib.compressobj(4, wbits=31)
                member = packer.compress(record(page_id, url, payload, digest, refers_to, date)) + packer.flush()
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["path", "records", "bytes"])

    return run


class Broken(ValueError):
    pass


_END, _GZIP, _VERSION = b"\r\n\r\n", b"\x1f\x8b\x08", b"WARC/1."
_PIECE = 1 << 16


class Window:
    """A file's bytes by place; a block is read at a time and kept for the next call."""

    def __init__(self, file, size: int, block: int = 1 << 20) -> None:
        self.file, self.size, self.block = file, size, block
        self.at, self.held = 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.held) and at < self.size:
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, self.block))
        return self.held[at - self.at : at - self.at + n]


class Plain:
    """Bytes of the file from a place on."""

    def __init__(self, window: Window, at: int) -> None:
        self.window, self.at = window, at

    def piece(self) -> bytes:
        data = self.window.read(self.at, _PIECE)
        self.at += len(data)
        return data


class Member:
    """Bytes of the gzip member at a place, unpacked piece by piece; none at its end, where the CRC has been checked.

    careful: of a damaged member, all that can be unpacked before the damage."""

    def __init__(self, window: Window, at: int, careful: bool = False) -> None:
        self.window, self.at, self.unpack, self.careful = window, at, zlib.decompressobj(wbits=31), careful

    def piece(self) -> bytes:
        while not self.unpack.eof:
            data = self.unpack.unconsumed_tail
            if not data:
                data = self.window.read(self.at, _PIECE)
                self.at += len(data)
            if not data:
                raise Broken("cut member")
            before = self.unpack.copy() if self.careful else None
            try:
                out = self.unpack.decompress(data, 4 * _PIECE)
            except zlib.error as e:
                if before is None:
                    raise Broken("gzip") from e
                return self.last(before, data)
            if out:
                return out
        return b""

    def last(self, unpack, data: bytes) -> bytes:
        """What comes before the fault in a piece; nothing is read after it."""
        out = bytearray()
        try:
            for i in range(len(data)):
                out += unpack.decompress(data[i : i + 1])
        except zlib.error:
            pass
        self.unpack, self.careful = zlib.decompressobj(wbits=31), False
        self.at = self.window.size
        return bytes(out)

    def checked(self) -> tuple[int, str]:
        """How many bytes it unpacks to, and what is wrong with it, if anything. Nothing is kept."""
        total = 0
        try:
            while data := self.piece():
                total += len(data)
        except Broken as e:
            return total, str(e)
        return total, ""

    def end(self) -> int:
        return self.at - len(self.unpack.unused_data)


class Reader:
    """The bytes of a source by place, counted from ``base``; those before ``drop`` are forgotten."""

    def __init__(self, source: Plain | Member, base: int, total: int) -> None:
        self.source, self.base, self.total, self.held, self.ended = source, base, total, bytearray(), False

    def more(self) -> bool:
        if not self.ended:
            try:
                data = self.source.piece()
            except Broken:
                data = b""  # the caller knows from ``checked``
            self.held += data
            self.ended = not data
        return not self.ended

    def stop(self) -> int:
        return self.base + len(self.held)

    def cut(self, a: int, b: int) -> bytes:
        """The bytes from a to b, fewer where the source ends; nothing is read of a source known to be shorter."""
        if b <= self.total:
            while self.stop() < b and self.more():
                pass
        return bytes(self.held[a - self.base : b - self.base])

    def find(self, mark: bytes, at: int) -> int:
        while True:
            if (i := self.held.find(mark, at - self.base)) >= 0:
                return self.base + i
            at = max(at, self.stop() - len(mark) + 1)
            if not self.more():
                return -1

    def drop(self, to: int) -> None:
        del self.held[: to - self.base]
        self.base = to


def _parse(reader: Reader, at: int) -> tuple[dict, int]:
    """The record that begins at ``at``, and where the next begins."""
    if reader.cut(at, at + len(_VERSION)) != _VERSION:
        raise Broken("no version line")
    fields, line_at = {}, at
    while True:
        if (to := reader.find(b"\r\n", line_at)) < 0:
            raise Broken("no end of headers")
        if to == line_at:
            break
        if line_at > at:
            name, colon, value = reader.cut(line_at, to).partition(b":")
            if not colon:
                raise Broken("bad header")
            fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        line_at = to + 2
    length = fields.get("content-length", "")
    if not re.fullmatch(r"\d{1,15}", length):
        raise Broken("bad length")
    begin, end = to + 2, to + 2 + int(length)
    if end + 4 > reader.total or reader.cut(end, end + 4) != _END:
        raise Broken("no record end")
    head, _, payload = reader.cut(begin, end).partition(_END)
    http = re.search(rb"(?im)^content-length:[ \t]*(\d+)\r?$", head)
    kind, digest = fields.get("warc-type", ""), fields.get("warc-payload-digest", "").removeprefix("sha256:")
    sure = False
    if kind == "response":
        found = hashlib.sha256(payload).hexdigest()
        if re.fullmatch("[0-9a-f]{64}", digest):
            if digest != found:
                raise Broken("payload digest")
            sure = True
        size, digest = len(payload), found
    else:
        size, payload = int(http[1]) if http else None, None
    number = lambda x: int(x) if re.fullmatch(r"-?\d{1,19}", x) else None
    out = {"page_id": number(fields.get("page-id", "")), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": number(fields.get("refers-to-page-id", ""))}
    out |= {"record_id": fields.get("warc-record-id"), "refers_to_record": fields.get("warc-refers-to"), "payload_bytes": size, "payload_digest": digest or None, "payload": payload}
    return out | {"sure": sure}, end + 4


def _inside(reader: Reader) -> Iterator[dict]:
    """Records of an unpacked member, and gaps up to the next version line that begins a record."""
    k, gap, why = 0, None, ""
    skipped = lambda to: {"kind": "gap", "reason": f"{why}, in the unpacked member at {gap}, {to - gap} bytes"}
    while reader.stop() > k or reader.more():
        try:
            row, end = _parse(reader, k)
        except Broken as e:
            if gap is None:
                gap, why = k, str(e)
            if (k := reader.find(_VERSION, k + 1)) < 0:
                k = reader.stop()
        else:
            if gap is not None:
                yield skipped(k)
                gap = None
            yield {"kind": "record"} | row
            k = end
        reader.drop(k)
    if gap is not None:
        yield skipped(k)


def _next(window: Window, at: int, step: int = 1 << 20) -> int:
    """The next place from ``at`` on where a member or a version line may begin."""
    while at < window.size:
        data = window.read(at, step + 7)
        places = [i for mark in (_GZIP, _VERSION) if (i := data.find(mark)) >= 0]
        if places:
            return at + min(places)
        at += step
    return window.size


def salvage(file, size: int) -> Iterator[dict]:
    """Records and gaps of a WARC file, in order."""
    window = Window(file, size)
    at, gap, why, plain = 0, None, "", None
    while at < size:
        fault, rows, end = "", iter(()), at
        if window.read(at, 3) == _GZIP:
            member = Member(window, at)
            total, fault = member.checked()
            end = member.end()
            rows = _inside(Reader(Member(window, at, careful=bool(fault)), 0, window.size << 11 if fault else total))
            if fault:
                rows = ({"reason": f"kept by its payload digest: {fault}"} | row for row in rows if row.get("sure"))
            else:  # gaps before the first record wait for it: a member without any is broken
                early = []
                for row in rows:
                    early.append(row)
                    if row["kind"] == "record":
                        break
                else:
                    fault, early = early[0]["reason"].partition(",")[0] if early else "no version line", []
                rows = chain(early, rows)
        else:
            if plain is None or not plain.base <= at <= plain.stop():
                plain = Reader(Plain(window, at), at, size)
            plain.drop(at)
            try:
                row, end = _parse(plain, at)
                rows = iter([{"kind": "record"} | row])
            except Broken as e:
                fault = str(e)
        for row in rows:
            if gap is not None:
                yield {"kind": "gap", "offset": gap, "length": at - gap, "reason": why}
                gap = None
            row.pop("sure", None)
            yield {"offset": at, "length": None if fault else end - at} | row
        if not fault:
            at = end
            continue
        if gap is None:
            gap, why = at, fault
        at = _next(window, at + 1)
    if gap is not None:
        yield {"kind": "gap", "offset": gap, "length": size - gap, "reason": why}


def read_archives(manifest: DataFrame, *, tasks: int, with_payload: bool = True) -> DataFrame:
    """Rows of kind record or gap from the files that ``manifest`` names in its column path, dealt to ``tasks`` tasks."""
    return manifest.select("path").repartition(max(1, tasks)).mapInArrow(_reading(with_payload), RECORDS)


def _reading(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = _filesystem(path)
                with system.open_input_file(name) as file:
                    rows, held = [], 0
                    for row in salvage(file, file.size()):
                        if not with_payload:
                            row.pop("payload", None)
                        rows.append(row | {"path": path})
                        held += len(row.get("payload") or b"")
                        if len(rows) >= 2000 or held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return run


def resolved(read: DataFrame, *, salts: int = 32) -> DataFrame:
    """The records among the rows of ``read_archives`` (read twice: store them), revisits with page, size and digest of the
    response they refer to. A revisit without such a response keeps what it says of itself, refers to nothing, and has a reason,
    as has one whose own digest differs from the response's. Revisits of one response are dealt to ``salts`` parts."""
    records = read.where("kind = 'record'").drop("kind", "payload")
    revisits = records.where("record_type = 'revisit'").withColumn("__salt", F.pmod(F.xxhash64("path", "offset"), F.lit(salts)).cast("int"))
    asked = revisits.select(F.col("refers_to_record").alias("__id")).distinct()
    told = records.where("record_type = 'response'").join(asked, F.col("record_id") == F.col("__id"), "left_semi")
    told = told.groupBy(F.col("record_id").alias("__id")).agg(F.min(F.struct(F.col("page_id").alias("page"), F.col("payload_bytes").alias("size"), F.col("payload_digest").alias("digest"))).alias("__of"))
    told = told.select("__id", "__of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__part"))
    joined = revisits.join(told, (F.col("refers_to_record") == F.col("__id")) & (F.col("__salt") == F.col("__part")), "left")
    reason = F.when(F.col("__of").isNull(), F.lit("no response")).when(F.col("payload_digest") != F.col("__of.digest"), F.lit("payload digest of the response")).otherwise(F.col("reason"))
    known = {"refers_to": F.col("__of.page"), "payload_bytes": F.coalesce("__of.size", "payload_bytes"), "payload_digest": F.coalesce("__of.digest", "payload_digest"), "reason": reason}
    return records.where("record_type is distinct from 'revisit'").unionByName(joined.select(*(known.get(c, F.col(c)).alias(c) for c in records.columns)))
