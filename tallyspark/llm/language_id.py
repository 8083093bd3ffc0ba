"""Language identification by prediction by partial matching (PPM).

For each language a variable-order tree of byte contexts holds how often each byte followed. A text's code length under
a language is the sum over its bytes of -log2 p, where p comes from the longest context in the tree that the language
has seen, with an escape (method C: distinct / (total + distinct)) for each step to a shorter context; under no context
all 256 bytes are alike. Statistics are frozen when the model is made, so the code lengths of all (context, byte) pairs
are tables, and scoring is a walk from each byte into its past.

The model is fitted on a bounded sample of labelled rows: at most ``per_language`` whole documents of each language, those
with the smallest hash of id and text, however short; rows equal in these count once. All their bytes are counted, those at the
beginning of a text under the shorter contexts that they have; every context met is a node (``floor`` can ask for more meetings),
without any cap on their number. Shorter contexts have a row of code lengths for all bytes; the many longest ones keep those of
the bytes that followed, and an escape to the row of the next shorter context for all others. Everything else runs over all rows
and whole texts.

Null texts and texts without any letter get ``und``. Ties go to the language that sorts first. With no labelled rows every
text gets ``und``. Repeated rows come back as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import slices, utf8_bytes

UNKNOWN = "und"


@dataclass
class Model:
    """symbol: byte to symbol, the last of which stands for bytes never met. child: node and symbol before it to the
    longer context's node, or -1. bits: node and symbol to code lengths by language.

    Nodes of the longest contexts are numbered after all others and have no rows in child and bits: parent and escape are theirs,
    and seen has code lengths by ``met``, the ascending numbers of node and symbol."""

    languages: list[str]
    order: int
    symbol: np.ndarray
    child: np.ndarray
    bits: np.ndarray
    parent: np.ndarray
    escape: np.ndarray
    met: np.ndarray
    seen: np.ndarray

    def _bits(self, node: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Code lengths of symbols after nodes."""
        width, m = self.child.shape[1], len(self.child)
        longest = np.flatnonzero(node >= m)
        if not len(longest):
            return self.bits[node * np.int64(width) + symbols]
        top, after = node[longest] - m, symbols[longest]
        row = node.astype(np.int64)
        row[longest] = self.parent[top]
        out = self.bits[row * width + symbols]
        key = top * np.int64(width) + after
        at = np.searchsorted(self.met, key).clip(max=len(self.met) - 1)
        hit = self.met[at] == key
        out[longest[hit]] = self.seen[at[hit]]
        out[longest[~hit]] += self.escape[top[~hit]]
        return out

    def code_lengths(self, data: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> np.ndarray:
        """Bits of each text (rows) under each language (columns); ``most`` bytes at a time, with those before them as context."""
        out = np.zeros((len(ends) - 1, len(self.languages)))
        if not self.languages:
            return out
        width, child = self.child.shape[1], self.child.ravel()
        for a in range(0, len(data), most):
            b, low = min(len(data), a + most), max(0, a - self.order)
            symbols = self.symbol[data[low:b]]
            n = b - low
            place = np.arange(low, b)
            age = place - ends[np.searchsorted(ends, place, "right") - 1]
            node = np.zeros(n, np.int32)
            alive = np.ones(n, bool)
            for k in range(1, min(self.order, n - 1) + 1):
                alive &= age >= k
                to = child[node[k:] * width + symbols[:-k]]
                alive[:k] = False
                alive[k:] &= to >= 0
                node[k:] = np.where(alive[k:], to, node[k:])
            bits = self._bits(node[a - low :], symbols[a - low :])
            first, last = np.searchsorted(ends, a, "right") - 1, np.searchsorted(ends, b, "left")
            bounds = np.clip(ends[first : last + 1], a, b)
            full = np.flatnonzero(np.diff(bounds))
            out[first + full] += np.add.reduceat(bits, bounds[:-1][full] - a, axis=0, dtype=np.float64)
        return out


def _grams(docs: DataFrame, order: int) -> DataFrame:
    """How often each byte occurs by language under the ``past`` bytes before it: ``order`` of them, fewer at the beginning of a text.

    gram: the past bytes and the byte, as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, ends = utf8_bytes(part.column(1))
                langs = np.array(part.column(0).to_pylist(), object)
                for lang in sorted(set(langs)):
                    found: list[list[np.ndarray]] = [[] for _ in range(order + 1)]
                    for r in np.flatnonzero(langs == lang):
                        x = data[ends[r] : ends[r + 1]].astype(np.int64)
                        for past in range(min(order, len(x))):
                            found[past].append(np.array([sum(int(x[i]) << (8 * (past - i)) for i in range(past + 1))]))
                        if len(x) > order:
                            found[order].append(sum(x[i : len(x) - order + i] << (8 * (order - i)) for i in range(order + 1)))
                    for past, grams in enumerate(found):
                        if grams:
                            gram, n = np.unique(np.concatenate(grams), return_counts=True)
                            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(np.full(len(gram), past, np.int32)), pa.array(gram), pa.array(n)], ["lang", "past", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, past int, gram bigint, n bigint").groupBy("lang", "past", "gram").agg(F.sum("n").alias("n"))


def sample(labelled: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 600) -> DataFrame:
    """(lang, text) of at most ``per_language`` distinct rows of each language: those with the smallest hash of id and text.

    Hashes alone thin out each language to about twice the number first, so that what is then put in order is bounded too; equal rows
    become one before they move."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return rows.select("lang", "text").limit(0)
    shares = F.create_map(*(F.lit(x) for name, n in sorted(sizes.items()) for x in (name, min(1.0, 2 * per_language / n))))
    drawn = rows.withColumn("h", F.xxhash64("doc_id", "text")).where(F.pmod("h", F.lit(1 << 30)) < shares[F.col("lang")] * (1 << 30))
    once = drawn.groupBy("lang", "h").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    return once.withColumn("place", place).where(F.col("place") <= per_language).select("lang", "text")


def fit(labelled: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 600, order: int = 3, floor: int = 1) -> Model:
    """A model from (id, text, language) rows; rows with a null text or language are passed over."""
    got = _grams(sample(labelled, doc_id=doc_id, text=text, lang=lang, per_language=per_language), order).toPandas()
    languages = sorted(set(got["lang"]))
    if not languages:
        none = np.zeros((0, 0), np.float32)
        return Model([], order, np.zeros(256, np.int32), np.full((1, 1), -1, np.int32), np.zeros((1, 0), np.float32), none, none, none, none)
    # Runs order, then language, then number: the sums below don't depend on how rows were dealt out.
    got = got.sort_values(["lang", "past", "gram"], ignore_index=True)
    which = got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    gram, count, past = got["gram"].to_numpy(np.int64), got["n"].to_numpy(np.int64), got["past"].to_numpy(np.int64)

    met = np.unique(np.concatenate([((gram >> (8 * i)) & 255)[past >= i] for i in range(order + 1)]))
    other = len(met)
    symbol = np.full(256, other, np.int32)
    symbol[met] = np.arange(other)
    width, last = other + 1, symbol[gram & 255]

    levels, first = [np.zeros(1, np.int64)], [0, 1]  # contexts of each length, ascending, and the number of the first
    for k in range(1, order + 1):
        context, at = np.unique((gram[past >= k] >> 8) & ((1 << (8 * k)) - 1), return_inverse=True)
        context = context[np.bincount(at, count[past >= k], len(context)) >= floor]
        levels.append(context[np.isin(context & ((1 << (8 * (k - 1))) - 1), levels[-1])])
        first.append(first[-1] + len(levels[-1]))
    rows = first[order]  # numbers below this have rows of their own
    child = np.full((rows, width), -1, np.int32)
    bits = np.zeros((rows, width, len(languages)), np.float32)
    bits[0] = 8.0
    parent, escape = np.zeros(0, np.int64), np.zeros((0, len(languages)), np.float32)
    known, seen = np.zeros(0, np.int64), np.zeros((0, len(languages)), np.float32)
    for k, keys in enumerate(levels):
        if not len(keys):
            continue
        ids = first[k] + np.arange(len(keys))
        if k:
            up = first[k - 1] + np.searchsorted(levels[k - 1], keys & ((1 << (8 * (k - 1))) - 1))
            child[up, symbol[keys >> (8 * (k - 1))]] = ids
        context = (gram >> 8) & ((1 << (8 * k)) - 1)
        at = np.searchsorted(keys, context).clip(max=len(keys) - 1)
        here = np.flatnonzero((keys[at] == context) & (past >= k))
        pairs, of = np.unique(at[here] * np.int64(width) + last[here], return_inverse=True)
        node, after = pairs // width, pairs % width
        n = np.zeros((len(pairs), len(languages)))
        np.add.at(n, (of, which[here]), count[here])
        total, kinds = np.zeros((len(keys), len(languages))), np.zeros((len(keys), len(languages)))
        np.add.at(total, node, n)
        np.add.at(kinds, node, n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            own, away = -np.log2(n / (total + kinds)[node]), np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
        if k < order:
            if k:
                bits[ids] = bits[up]
            bits[ids] += away[:, None, :]
            bits[first[k] + node, after] = np.where(n > 0, own, bits[first[k] + node, after])
        else:
            parent, escape, known = up, away.astype(np.float32), pairs
            seen = np.where(n > 0, own, bits[up[node], after] + away[node]).astype(np.float32)
    return Model(languages, order, symbol, child, bits.reshape(-1, len(languages)), parent, escape, known, seen)


def predict(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) of every row.

    score: the language's share when each has probability 2 ** -bits, from 0 to 1. bits_per_byte: code length under it.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        _predicting(held), T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *_OUT.fields])
    )


def identified(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that ``predict`` gives a language: all but those it calls ``und``.

    Without any language in the model, rows whose text has a letter. Rows go through one pass of Arrow batches, nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                data, ends = utf8_bytes(part.column(at))
                keep = _best(held.value, data, ends)[0] != UNKNOWN if held.value.languages else _letters(data, ends)
                if keep.any():
                    yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


_OUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])


def _letters(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    to = np.concatenate([[0], np.cumsum(ascii_letter)])
    has = to[ends[1:]] > to[ends[:-1]]
    for i in np.flatnonzero(~has):
        has[i] = any(c.isalpha() for c in data[ends[i] : ends[i + 1]].tobytes().decode())
    return has


def _best(model: Model, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, score and bits per byte of each text's best language."""
    lengths, ok = model.code_lengths(data, ends), _letters(data, ends)
    n = len(ends) - 1
    if model.languages:
        best = lengths.argmin(1)
        least = lengths[np.arange(n), best]
        score = 1 / np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(1)
        names = np.array(model.languages, object)[best]
        names[~ok] = UNKNOWN
    else:
        names, least, score = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n)
    per_byte = least / np.maximum(np.diff(ends), 1)
    return names, np.where(ok, score, 0.0), np.where(ok, per_byte, 0.0)


def _predicting(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                names, score, per_byte = _best(model, *utf8_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(per_byte)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return run


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
