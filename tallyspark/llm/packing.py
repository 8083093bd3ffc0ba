"""Packing token sequences into windows by best-fit decreasing.

``tokenize_windows`` turns each text into token ids and cuts overlong documents into full windows;
``pack_windows`` places the pieces into windows: the longest first, each into the open window with the
least room that still holds it, which a segment tree indexed by remaining capacity finds.

Rows are packed in shards of some thousand pieces. Pieces are written once with a number each, counted, and dealt by a hash of
that number, so that repeated rows and null ids spread like all others; only numbers and lengths go to the tasks that pack, and
their places are joined back to the pieces by number. So no task ever holds more than a shard of numbers, however long documents
are; at that size the padding is within a fraction of a percent of what one global packing leaves. Nulls: a null text is an empty
document, which holds just the end id. A null id is kept as it is. Repeated rows are packed as often as they occur. Other columns
are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import fresh, slices, stored, utf8_bytes

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


class Numbered(dict):
    """Numbers keys as they come; ``fresh`` are those not yet dealt with."""

    def __init__(self) -> None:
        self.fresh: list = []

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


class Runs:
    """Many short arrays of ids in one."""

    def __init__(self) -> None:
        self.offset = self.length = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint16)

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.offset = np.concatenate([self.offset, len(self.flat) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.flat = np.concatenate([self.flat, flat])

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the arrays with these numbers, one after the other, and the number of ids of each."""
        lengths = self.length[numbers]
        at = np.arange(int(lengths.sum())) + np.repeat(self.offset[numbers] - np.cumsum(lengths) + lengths, lengths)
        return self.flat[at], lengths


class WordIds:
    """Ids of words by a tokenizer that never joins across ASCII white space, each word encoded once.

    The tokenizer lower-cases, splits words into runs of letters, single digits and runs of other signs, and marks
    the last id of each such part; so new words are split into parts, and new parts are encoded many at a time.
    Words with other than simple Latin characters, and words of which this isn't sure, are encoded by themselves.
    """

    SIMPLE = re.compile(r"[!-&(-~\xa1-\u012f\u0131-\u017f]+")
    PART = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str, most: int = 150_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.last = np.zeros(1 << 16, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.last[i] = token.endswith("</w>")
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.words, self.runs = Numbered(), Runs()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for x in got for i in x), np.uint16, int(lengths.sum())), lengths

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, _ = self.encode([" ".join(parts[i : i + 500]) for i in range(0, len(parts), 500)])
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) != len(parts):
            return self.encode(parts)
        return flat, np.diff(ends, prepend=0)

    def learn(self, words: list[bytes]) -> None:
        """Adds the words' ids: words of simple letters as one part, other simple words as several, the rest whole."""
        whole, parts, odd = [], [], []
        rank = np.zeros(len(words), np.int64)
        counts = []
        for i, w in enumerate(words):
            if w.isalpha():
                whole.append(w.decode())
            elif self.SIMPLE.fullmatch(t := w.decode()) is None or "<|" in t:
                rank[i] = 2
                odd.append(t)
            elif t.isalpha():
                whole.append(t.lower())
            else:
                rank[i] = 1
                parts += (found := self.PART.findall(t.lower()))
                counts.append(len(found))
        got = Runs()
        if whole:
            got.add(*self.encode_parts(whole))
        if parts:
            flat, lengths = self.encode_parts(parts)
            got.add(flat, np.add.reduceat(lengths, np.cumsum(counts) - counts))
        if odd:
            got.add(*self.encode(odd))
        place = np.empty(len(words), np.int64)
        place[np.argsort(rank, kind="stable")] = np.arange(len(words))
        self.runs.add(*got.take(place))

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids one after the other, and the number of ids of each word."""
        if len(self.words) > self.most:
            self.forget()
        numbers = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if self.words.fresh:
            self.learn(self.words.fresh)
            self.words.fresh = []
        return self.runs.take(numbers)


_known: dict[str, WordIds] = {}


def vocabulary(path: str) -> WordIds:
    """One for each Python worker, which keeps what it has met from task to task."""
    if path not in _known:
        _known[path] = WordIds(path)
    return _known[path]


#: A stop after a letter is a part of its own; apart from the word, both are met more often.
_STOP = re.compile(rb"(?<=[a-z])([.,])(?=\s)")


def _words(data: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text; those of a long one in several lists, cut at white space."""
    if b"<|" not in data:
        data = _STOP.sub(rb" \1", data.lower())
    at = 0
    while len(data) - at > most:
        cut = max(data.rfind(x, at, at + most) for x in (b" ", b"\n", b"\t"))
        if cut <= at and (cut := min((i for x in (b" ", b"\n", b"\t") if (i := data.find(x, at + most)) >= 0), default=-1)) < 0:
            break
        yield data[at:cut].split()
        at = cut
    yield data[at:].split()


def tokenize_windows(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", window: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, ids) of every document.

    ids: little-endian unsigned 32-bit ids. A document is its text's ids and ``end_id``; it is cut after
    every ``window`` ids. tokenizer: path of a tokenizers file that splits at ASCII white space and lower-cases.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, ends = utf8_bytes(part.column(1))
                raw = data.tobytes()
                rows: list[tuple] = []
                lists = [list(_words(raw[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                if len(lists) > 1:  # short texts: all at once
                    flat = [w for x in lists for y in x for w in y]
                    counts = np.array([sum(map(len, x)) for x in lists])
                    every, lengths = known.ids(flat)
                    to = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
                    found = (every[a:b] for a, b in zip(to[:-1], to[1:], strict=True))
                else:
                    found = (np.concatenate([known.ids(y)[0] for y in x]) for x in lists)
                for key, ids in zip(part.column(0).to_pylist(), found, strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    rows += [(key, at, min(window, len(ids) - at), len(ids), ids[at : at + window].tobytes()) for at in range(0, len(ids), window)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECES)


class OpenWindows:
    """Open windows by room left; a segment tree over the room finds the tightest fit."""

    def __init__(self, window: int) -> None:
        self.base = 1 << (window + 1).bit_length()
        self.tree = bytearray(2 * self.base)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, window: int) -> None:
        self.at[room].append(window)
        i = self.base + room
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``need``, taken out, and its room."""
        tree, i = self.tree, self.base + need
        if i >= 2 * self.base:
            return None
        while not tree[i]:
            while i & 1:
                i >>= 1
            if i == 0:
                return None
            i += 1
        while i < self.base:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - self.base
        window = self.at[room].pop()
        if not self.at[room]:
            tree[i] = 0
            i >>= 1
            while i and not (tree[2 * i] or tree[2 * i + 1]):
                tree[i] = 0
                i >>= 1
        return window, room


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; pieces of equal length in the given order."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_windows, count = OpenWindows(window), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        if need < window and (found := open_windows.take(need)):
            w, room = found
        else:
            w, room, count = count, window, count + 1
        where[k], offset[k] = w, window - room
        if room > need:
            open_windows.put(room - need, w)
    return where, offset


def pack_windows(pieces: DataFrame, *, window: int = 4096, shards: int | None = None, per_shard: int = 8192) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ...); all other columns are kept.

    Lengths are 1 to ``window``. Sequence ids are unique over all shards, of about ``per_shard`` pieces unless ``shards`` is given.
    """
    piece, at = fresh(pieces, "piece", "at")
    kept = stored(pieces.withColumn(piece, F.monotonically_increasing_id()), "pieces")
    shards = shards or shards_for(kept.count(), per_shard)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "piece"], kind="stable", ignore_index=True)
        where, offset = best_fit_decreasing(rows["length"].to_numpy(np.int64), window)
        return pd.DataFrame({at: rows["piece"], "sequence_id": (int(key[0]) << 32) + where, "offset": offset})

    shard = F.pmod(F.xxhash64(piece), F.lit(max(1, shards)))
    dealt = kept.select(F.col(piece).alias("piece"), "doc_id", "start", "length", shard.alias("shard"))
    places = dealt.groupBy("shard").applyInPandas(run, f"{at} bigint, sequence_id bigint, offset bigint")
    return kept.join(places, F.col(piece) == F.col(at)).drop(piece, at)


def shards_for(n_pieces: int, per_shard: int = 8192) -> int:
    return max(1, -(-n_pieces // per_shard))
