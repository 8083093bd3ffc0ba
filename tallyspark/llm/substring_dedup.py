"""Removing repeated substrings by prefix-free parsing.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier in the corpus (a smaller id, or the same document
at an earlier place). Texts are parsed into phrases at rolling-hash triggers: of each ``length`` bytes, the place with the least
hash of the ``gram`` bytes there is a trigger, so equal strings have their trigger at the same place. The strings that share a
trigger form a phrase: the stretch from the first of them to the end of the last. A text is the sequence of its phrases.

The dictionary keeps each distinct phrase once, at its first place in the corpus; all strings of its later places are repeats,
without being looked at one by one. Equal suffixes of ``length`` bytes lie in phrases with one trigger, so the dictionary falls
into parts by trigger, and parts are sorted in different tasks: each gets the suffix array of its phrases, by prefix doubling up to
``length`` bytes. Neighbours of equal rank share at least that many bytes; put back into corpus order by the places of their
phrases in the parse, all but the first are repeats. The order of suffixes beyond ``length`` bytes, for which the parse would have
to be sorted as well, is never asked for, so no suffix array of the parse is built.

Tasks drop what repeats among their own phrases before anything is shuffled. A part of more than ``group_bytes`` bytes is not
sorted in one task: its strings are shuffled one by one, named by 128 bits of hash. Phrases are named by 128 bits, 64 of the
trigger and 64 of the content.

Null texts are empty. Null ids come last. A document is an id and a text: repeated rows are one document, and come back as often as
they occur; documents with equal ids, or without, are not earlier than each other, so nothing of one goes because of another. (The
largest possible id ranks with the null ones.) Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import slices, stored, utf8_bytes
from tallyspark.llm.shingles import BYTES, _POWERS, mix, prefix_hashes, stretch

_LAST = (1 << 63) - 1
#: A phrase has a trigger k and content f, a range has neither; doc and sub, its id and the hash of its text, tell a document;
#: lo and hi are the first and last start of its strings.
_ROWS = "k bigint, f bigint, doc bigint, sub bigint, lo bigint, hi bigint"
_NAMES = ["k", "f", "doc", "sub", "lo", "hi"]


def _batch(k, f, doc, sub, lo, hi, ranges: bool = False) -> pa.RecordBatch:
    number = lambda x: pa.nulls(len(doc)).cast(pa.int64()) if ranges else pa.array(x.view(np.int64))
    return pa.RecordBatch.from_arrays([number(k), number(f), *(pa.array(np.asarray(x, np.int64)) for x in (doc, sub, lo, hi))], _NAMES)


def phrases(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, trigger hash, content hash, first start, last start) of all phrases, starts counted in the text."""
    n, w = len(data), length - gram + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    if n < length:
        return none
    _, down = _POWERS.to(n)
    sums = prefix_hashes(BYTES[data])
    m = n - gram + 1
    grams = (sums[gram:] - sums[:m]) * down[:m]
    low = np.uint64(30)
    keyed = ((grams >> low) << low) | np.arange(m, dtype=np.uint64)
    # The least of every w in a row, from running minima of blocks of w from both sides.
    full = np.full(-(-m // w) * w, ~np.uint64(0))
    full[:m] = keyed
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    starts = n - length + 1
    least = np.minimum(back[:starts], ahead[w - 1 : w - 1 + starts])
    # Strings within one text: all starts but the last length - 1 of each.
    counts = np.maximum(np.diff(ends) - length + 1, 0)
    total = int(counts.sum())
    if not total:
        return none
    first = np.cumsum(counts) - counts
    at = np.arange(total) + np.repeat(ends[:-1] - first, counts)
    chosen = least[at]
    new = np.ones(total, bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], total) - 1
    lo, hi = at[begin], at[stop]
    text = np.searchsorted(first, begin, "right") - 1
    # Texts without strings share their place with the one after; the last of these is meant.
    trigger = (chosen[begin] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    k = mix(grams[trigger])
    f = stretch(sums, lo, hi + length)
    return text, k, f, lo - ends[text], hi - ends[text]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """In ordered rows, which differ from the row before in one of the columns; the first does."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for x in columns:
            new[1:] |= x[1:] != x[:-1]
    return new


def _placed(content: np.ndarray, doc: np.ndarray, sub: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In rows ordered by content, doc, sub and place, where ``content`` marks the first of each content: which begin a document
    that no smaller id comes before, and which stand later than another place of their content. The same place twice is a
    document that comes in several rows."""
    row = np.arange(len(content))
    first = np.maximum.accumulate(np.where(content, row, 0))
    begins = content | _changes(doc, sub)
    own = np.maximum.accumulate(np.where(begins, row, 0))
    behind = doc != doc[first]
    return begins & ~behind, behind | (at != at[own])


def _repeats(doc: np.ndarray, sub: np.ndarray, at: np.ndarray, *content: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by content and place, and in that order which rows are first, and which are later places, of their content."""
    order = np.lexsort((at, sub, doc, *reversed(content)))
    new = _changes(*(x[order] for x in content))
    return order, *_placed(new, doc[order], sub[order], at[order])


def _merged(doc: np.ndarray, sub: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of starts with those that follow on each other joined."""
    order = np.lexsort((lo, sub, doc))
    doc, sub, lo, hi = doc[order], sub[order], lo[order], hi[order]
    new = _changes(doc, sub)
    new[1:] |= lo[1:] > hi[:-1] + 1
    begin = np.flatnonzero(new)
    return doc[begin], sub[begin], lo[begin], np.maximum.reduceat(hi, begin) if len(begin) else hi


def _parse(length: int, gram: int, most: int):
    """First places of distinct phrases of this task, and merged ranges of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            doc, sub, k, f, lo, hi = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, first, later = _repeats(doc, sub, lo, k, f)
            if later.any():
                yield _batch(None, None, *_merged(*(x[order[later]] for x in (doc, sub, lo, hi))), ranges=True)
            own = order[first]
            yield _batch(*(x[own] for x in (k, f, doc, sub, lo, hi)))

        for batch in batches:
            for part in slices(batch, "text"):
                data, ends = utf8_bytes(part.column(1))
                text, k, f, lo, hi = phrases(data, ends, length, gram)
                if len(text):
                    held.append((np.asarray(part.column(0))[text], np.asarray(part.column(2))[text], k, f, lo, hi))
                    size += len(text)
                if size >= most:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by k, f, doc, sub and place. Repeats become ranges; first places of phrases that share their trigger with others
    come back as they are; the rest needs no more."""
    known: list[np.ndarray] | None = None  # the first row of the content at hand, and the first row of its last document
    before = None  # the last first place, and whether it has been given out
    for batch in batches:
        ranges = np.asarray(batch.column(0).is_null())
        if ranges.any():
            yield batch.filter(pa.array(ranges))
            batch = batch.filter(pa.array(~ranges))
        if not batch.num_rows:
            continue
        columns = [np.asarray(c) for c in batch.columns]
        skip = 0
        if known is not None:
            columns, skip = [np.concatenate([a, b]) for a, b in zip(known, columns, strict=True)], 2
        k, f, doc, sub, lo, hi = columns
        content = _changes(k, f)
        first, later = _placed(content, doc, sub, lo)
        row = np.arange(len(k))
        at = [int(row[content][-1]), int(row[content | _changes(doc, sub)][-1])]
        known = [x[at] for x in columns]
        first[:skip] = later[:skip] = False
        if later.any():
            yield _batch(None, None, doc[later], sub[later], lo[later], hi[later], ranges=True)
        own = np.flatnonzero(first)
        if not len(own):
            continue
        follows = np.append(before is not None and k[own[0]] == before[0][0], k[own[1:]] == k[own[:-1]])  # others with this trigger came before
        leads = np.append(follows[1:], False)
        if before is not None and follows[0] and not before[1]:
            yield _batch(*(np.array([x]) for x in before[0]))
        give = own[follows | leads]
        if len(give):
            yield _batch(*(x[give] for x in columns))
        before = (tuple(x[own[-1]] for x in columns), bool(follows[-1] or leads[-1]))


def _cutting(length: int):
    """The bytes of each listed phrase of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, ends = utf8_bytes(part.column(1))
                rows = []
                for i, (doc, sub, listed) in enumerate(zip(*(part.column(c).to_pylist() for c in (0, 2, 3)), strict=True)):
                    raw = data[ends[i] : ends[i + 1]].tobytes()
                    rows += [(x["k"], doc, sub, x["lo"], x["hi"], raw[x["lo"] : x["hi"] + length]) for x in listed]
                if rows:
                    kinds = [*[pa.int64()] * 5, pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["k", "doc", "sub", "lo", "hi", "bytes"])

    return run


def suffix_ranks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Ranks, in lexical order, of the ``length`` bytes from each start on; equal strings have equal ranks. Prefix doubling."""
    width = 1
    while 2 * width <= min(length, 8):
        width *= 2
    n = len(data) - width + 1
    rank = np.zeros(max(n, 0), np.uint64)
    for i in range(width):
        rank = (rank << np.uint64(8)) | data[i : i + n]
    while 2 * width <= length:
        rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
        n -= width
        rank = rank[:n] * np.uint64(len(data)) + rank[width : width + n]
        width *= 2
    if len(starts) == 0:
        return np.zeros(0, np.int64)
    rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
    return np.unique(rank[starts] * np.uint64(len(data)) + rank[starts + (length - width)], return_inverse=True)[1]


def _strings(rows: pa.Table, length: int) -> tuple[np.ndarray, ...]:
    """The bytes of the phrases, one after the other, and of each of their strings the phrase, place in the bytes, and start."""
    column = rows.column("bytes").combine_chunks().cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    counts = np.maximum(np.diff(ends) - length + 1, 0)
    of = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(of)) + np.repeat(ends[:-1] - np.cumsum(counts) + counts, counts)
    return data, of, at, rows.column("lo").to_numpy()[of] + at - ends[of]


def _sorting(length: int, group_bytes: int):
    """Rows come by k. Ranges of the strings that stood before in their group; strings of too large groups by their hashes."""

    def done(parts: list[pa.Table], whole: bool) -> pa.RecordBatch:
        rows = pa.concat_tables(parts)
        data, of, at, start = _strings(rows, length)
        doc, sub = (rows.column(c).to_numpy()[of] for c in ("doc", "sub"))
        if not whole:
            names = [stretch(prefix_hashes(x), at, at + length) for x in (BYTES[data], mix(BYTES[data]))]
            return _batch(*names, doc, sub, start, start)
        order, _, later = _repeats(doc, sub, start, suffix_ranks(data, at, length))
        same = order[later]
        return _batch(None, None, *_merged(doc[same], sub[same], start[same], start[same]), ranges=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # whole groups, then the beginning of the group that may go on
        size, large = 0, None
        for batch in batches:
            for part in slices_of(batch):
                k = np.asarray(part.column(0))
                if large is not None:
                    cut = int(np.searchsorted(k, large, "right"))
                    if cut:
                        yield done([pa.Table.from_batches([part.slice(0, cut)])], False)
                    if cut == len(k):
                        continue
                    part, k, large = part.slice(cut), k[cut:], None
                held.append(pa.Table.from_batches([part]))
                size += part.nbytes
                if size < group_bytes:
                    continue
                every = pa.concat_tables(held)
                k = every.column("k").to_numpy()
                cut = int(np.searchsorted(k, k[-1], "left"))
                if cut:
                    yield done([every.slice(0, cut)], True)
                    held = [every.slice(cut)]
                    size = sum(len(x) for x in held) * max(1, every.nbytes // max(1, len(every)))
                else:
                    yield done([every], False)
                    held, size, large = [], 0, k[-1]
        if held:
            yield done(held, True)

    def slices_of(batch: pa.RecordBatch, rows: int = 4000) -> Iterator[pa.RecordBatch]:
        return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))

    return run


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept string, kept_sha256 string"


def _removing(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, ends = utf8_bytes(part.column(1))
                rows = []
                for i, (key, listed) in enumerate(zip(part.column(0).to_pylist(), part.column(2), strict=True)):
                    raw = data[ends[i] : ends[i + 1]].tobytes()
                    n, spans = len(raw), []
                    if listed.is_valid:
                        lo, hi = (listed.values.field(c).to_numpy() for c in ("lo", "hi"))
                        order = np.argsort(lo, kind="stable")
                        lo, to = lo[order], np.minimum(np.maximum.accumulate(hi[order]) + length, n)
                        new = np.ones(len(lo), bool)
                        new[1:] = lo[1:] > to[:-1]
                        begin = np.flatnonzero(new)
                        stop = to[np.append(begin[1:], len(lo)) - 1]
                        spans = [(a, b) for a, b in zip(lo[begin].tolist(), stop.tolist(), strict=True) if a < b]
                    edges = [0, *(x for s in spans for x in s), n]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if spans else raw
                    rows.append((key, n, n - len(kept), len(spans), kept.decode("utf-8", "replace") if with_text else None, hashlib.sha256(kept).hexdigest()))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def remove_repeats(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 100, gram: int = 32, phrases_at_once: int = 500_000, group_bytes: int = 4 << 20, with_text: bool = True
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256) of every row. kept: the text left; where a cut splits a
    character, its remains are shown as U+FFFD, while kept_sha256 is that of the bytes. Null without ``with_text``."""
    gram = min(gram, length)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("sub"), "text")
    document = (F.col("doc") == F.col("of")) & (F.col("sub") == F.col("of_sub"))
    of = (F.col("doc").alias("of"), F.col("sub").alias("of_sub"))

    def gathered(parsed: DataFrame, what: str) -> DataFrame:
        dealt = parsed.repartition(F.coalesce("k", F.xxhash64("doc", "lo"))).sortWithinPartitions("k", "f", "doc", "sub", "lo")
        return stored(dealt.mapInArrow(_gathered, _ROWS), what)

    parsed = rows.select("doc", "text", "sub").mapInArrow(_parse(length, gram, phrases_at_once), _ROWS)
    first = gathered(parsed, "phrases")
    listed = first.where("k is not null").groupBy(*of).agg(F.collect_set(F.struct("k", "lo", "hi")).alias("listed"))
    cut = rows.join(listed, document).select("doc", "text", "sub", "listed").mapInArrow(_cutting(length), "k bigint, doc bigint, sub bigint, lo bigint, hi bigint, bytes binary")
    sorted_ = cut.repartition("k").sortWithinPartitions("k", "doc", "sub", "lo").mapInArrow(_sorting(length, group_bytes), _ROWS)
    second = stored(sorted_, "strings")
    third = gathered(second.where("k is not null"), "strings")

    ranges = first.where("k is null").unionAll(second.where("k is null")).unionAll(third.where("k is null"))
    gone = ranges.groupBy(*of).agg(F.collect_list(F.struct("lo", "hi")).alias("gone"))
    return rows.join(gone, document, "left").select("doc_id", "text", "gone").mapInArrow(_removing(length, with_text), _RESULT)
