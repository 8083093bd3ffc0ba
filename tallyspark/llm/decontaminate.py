"""Benchmark decontamination by pigeonhole edit matching.

An item leaks into a document if some stretch of the document is within ``error_rate`` edits per character of it, both
brought to lower-case words with single spaces. With an error budget of k the item is split into k + 1 pieces: a stretch
within k edits must hold at least one piece unchanged, at most k characters away from its place. All pieces of all items
are searched at once (Aho-Corasick), and each hit's surroundings are verified with Myers' bit-parallel edit distance.

Documents stay where they are: nothing of them is shuffled. Items are few beside documents; they are taken in blocks of
at most ``block_chars`` characters (an item longer than that is a block of its own), each of which goes to all executors, so any
number of items works, at one pass over the documents for each block. A block holds distinct texts; ids are joined to what was
found. The budget is the whole part of ``error_rate`` times the item's length, at every length; an item so short that it has none
must stand between word ends.

Null texts hold nothing; null, empty and wordless items match nothing. Equal items are searched once and reported under each
id. Repeated rows are searched as often as they occur. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import slices, stored

_GAP = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower-case words with one space between."""
    return _GAP.sub(" ", (text or "").lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length, with their places."""
    ends = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def nearest(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``item`` to any stretch of ``text``, and the end of the first such stretch.

    Myers' recurrence; the item's characters are the bits of Python integers, so its length is not limited.
    """
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    all_ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = all_ones, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (all_ones & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & all_ones
        mh = (mh << 1) & all_ones
        plus = mh | (all_ones & ~(xv | ph))
        minus = ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Items:
    """A block of items ready to be searched for."""

    def __init__(self, items: list[tuple[object, str]], error_rate: float) -> None:
        import ahocorasick

        self.ids: dict[str, list] = {}
        for key, text in items:
            if word := normal(text):
                self.ids.setdefault(word, []).append(key)
        self.items = sorted(self.ids)
        self.budget = [int(len(x) * error_rate) for x in self.items]
        hits: dict[str, list[tuple[int, int]]] = {}
        for k, (item, budget) in enumerate(zip(self.items, self.budget, strict=True)):
            for at, piece in pieces(item, budget):
                hits.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in hits.items():
            self.automaton.add_word(piece, (len(piece), where))
        if hits:
            self.automaton.make_automaton()

    def leaks(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item, start, end, distance) of the leaks in a normalised text; overlapping finds of an item are one."""
        done: dict[int, int] = {}
        if not self.items:
            return
        for last, (length, where) in self.automaton.iter(text):
            for k, at in where:
                start = last + 1 - length - at
                if start < done.get(k, -1):
                    continue  # inside what was found or looked at before
                item, budget = self.items[k], self.budget[k]
                m = len(item)
                if text.startswith(item, max(start, 0)) and start >= 0:
                    if not budget and not ((start == 0 or text[start - 1] == " ") and text[start + m : start + m + 1] in ("", " ")):
                        continue
                    done[k] = start + m
                    yield k, start, start + m, 0
                elif budget:
                    low = max(0, start - budget)
                    distance, end = nearest(item, text[low : start + m + budget])
                    if distance <= budget:
                        done[k] = low + end
                        yield k, max(0, low + end - m), low + end, distance


def leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", error_rate: float = 0.06, block_chars: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, start, end, distance) of every leak; places count in the document's normalised text."""
    spark = docs.sparkSession
    named = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    named = named.select("item_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("name"))
    some = named.select("name", "text").distinct()
    total = some.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_chars)) if total > block_chars else 1
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for b in range(blocks):
        block = some if blocks == 1 else some.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        held = spark.sparkContext.broadcast([(r.name, r.text) for r in block.collect()])
        found = rows.mapInArrow(_searching(held, error_rate, kind), f"doc_id {kind.simpleString()}, of string, start bigint, end bigint, distance bigint")
        if blocks > 1:  # one block at a time is with the driver
            found = stored(found, "leaks")
            held.destroy()
        out = found if out is None else out.unionAll(found)
    return out.join(named, F.col("of") == F.col("name")).select("doc_id", "item_id", "start", "end", "distance")


def _searching(held, error_rate: float, kind):
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(kind), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "of", "start", "end", "distance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(held.value, error_rate)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for k, start, end, distance in items.leaks(normal(text)) if text else ():
                        rows += [(key, item, start, end, distance) for item in items.ids[items.items[k]]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run
