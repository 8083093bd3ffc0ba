"""Fill-in-the-middle: a text is cut at two unit boundaries and its parts are put in another order, between sentinels.

A unit is a run of ASCII letters, or any other single character. Boundaries are found without listing units: one Aho-Corasick
automaton reads the text, its characters first reduced to those that it tells apart, and reports only events: the ASCII
characters at which the class changes between letter and non-letter, and whole sentinels. Between two events the class stays the same, so that a gap holds one unit (letters) or as many
as it has characters (others); sums over the gaps give the rank of every event, and the place of any rank is a binary search
among the events and one addition. Characters beyond ASCII are no letters and are read as ``?``, one for one.

Defined results: a null or empty text is ``plain`` with no units and an empty output; a text that holds a sentinel is ``plain``
whatever is drawn; a null id draws as the empty id does; repeated rows give repeated rows; columns of docs besides those named
play no part; an empty table gives none. One text is held at a time, with a number for each event in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tallyspark.llm.common import slices

SENTINELS = ("<P>", "<S>", "<M>")
#: Characters that the automaton tells apart: any letter is ``a``, any other ``?``, but for those of sentinels.
_LETTERS, _OTHERS = "aPSM", "?<>"
_REDUCED = bytes(c if chr(c) in "PSM<>" else ord("a" if chr(c).isalpha() else "?") for c in range(128)) + b"?" * 128
#: Characters given to the automaton at a time.
_CHUNK = 1 << 22


@cache
def _automaton() -> ahocorasick.Automaton:
    """Finds changes of class (1), by the two characters at which they stand, and sentinels (0)."""
    out = ahocorasick.Automaton()
    for a in _LETTERS:
        for b in _OTHERS:
            out.add_word(a + b, 1)
            out.add_word(b + a, 1)
    for s in SENTINELS:
        out.add_word(s, 0)
    out.make_automaton()
    return out


def events(text: str) -> tuple[np.ndarray, bool]:
    """Places at which the class changes, ascending, and whether the text holds a sentinel."""
    reduced = text.encode("ascii", "replace").translate(_REDUCED).decode("ascii")
    found, marked, reader = [], False, _automaton().iter("")
    for at in range(0, len(reduced), _CHUNK):
        reader.set(reduced[at : at + _CHUNK])
        hits = np.fromiter(chain.from_iterable(reader), np.int64).reshape(-1, 2)
        changes = hits[:, 1] == 1
        marked |= not changes.all()
        found.append(hits[changes, 0])
    return np.concatenate(found) if found else np.zeros(0, np.int64), marked


class Ranks:
    """Units of a text by rank, from its events."""

    def __init__(self, text: str, changes: np.ndarray):
        self.at = np.concatenate([[0], changes])
        gaps = np.diff(np.append(self.at, len(text)))
        letters = text[:1].isascii() and text[:1].isalpha()
        gaps[0 if letters else 1 :: 2] = 1  # runs of letters, every other gap
        self.rank = np.concatenate([[0], np.cumsum(gaps)]) if text else np.zeros(1, np.int64)
        self.n, self.end = int(self.rank[-1]), len(text)

    def place(self, rank: int) -> int:
        """Characters before the unit of that rank; all, for the number of units."""
        if rank >= self.n:
            return self.end
        gap = int(np.searchsorted(self.rank, rank, "right")) - 1
        return int(self.at[gap] + rank - self.rank[gap])


def rearranged(text: str, h: tuple[int, int, int, int], rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, characters of prefix and middle, output."""
    changes, marked = events(text)
    units = Ranks(text, changes)
    if not text or marked or h[2] % 100 >= rate:
        return units.n, "plain", None, None, text
    a, b = sorted((h[0] % (units.n + 1), h[1] % (units.n + 1)))
    a, b = units.place(a), units.place(b)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = SENTINELS
    if h[3] % 100 < spm:
        return units.n, "spm", len(prefix), len(middle), f"{s}{suffix}{p}{prefix}{m}{middle}"
    return units.n, "psm", len(prefix), len(middle), f"{p}{prefix}{s}{suffix}{m}{middle}"


def draws(id_: Column, seed: str = "1") -> list[Column]:
    """Four numbers of 32 bits, from the SHA-256 of seed, colon and decimal id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: str = "1", rate: int = 90, spm: int = 20) -> DataFrame:
    """For each row its id, ``n`` units, ``form``, ``prefix_chars`` and ``middle_chars`` (null if plain), and ``output``.

    ``rate`` of a hundred texts are cut, and of these ``spm`` of a hundred get suffix, prefix, middle, others prefix, suffix, middle.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                own, texts, *drawn = (batch.column(k) for k in range(6))
                rows = [rearranged(t or "", h, rate, spm) for t, *h in zip(texts.to_pylist(), *(x.to_pylist() for x in drawn), strict=True)]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([own, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())], names=names)

    rest = "n long, form string, prefix_chars long, middle_chars long, output string"
    schema = StructType([StructField(id, docs.schema[id].dataType), *StructType.fromDDL(rest).fields])
    names = schema.names
    given = docs.select(F.col(id).alias("own"), F.col(text).alias("text"), *(h.alias(f"h{k}") for k, h in enumerate(draws(F.col(id), seed))))
    return given.mapInArrow(cut, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that the output was made of. Cut texts hold no sentinel, and none can arise where parts meet."""
    parts = F.split(output, "<[PSM]>", -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
