"""Text folding and comparison as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space including no-break and other Unicode spaces, which Java's \s leaves out.
SPACE = r"[\t\n\x0B\f\r    -     　﻿]"


def _accents() -> tuple[str, str]:
    """Accented Latin letters with the letters below their marks, then the marks themselves, which have none."""
    pairs = []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
#: Texts of Latin-1 but for two letters that have no capital there, of punctuation and currency signs; what becomes of their letters.
_FOLDABLE = r"\A[\x00-\xb4\xb6-\xde\xe0-\xff\u2010-\u2027\u20a0-\u20bf]*\z"
_SMALL = "".join(c for c in map(chr, range(0x100)) if c not in "µß" and (c in ACCENTED or c.upper() != c))
_LARGE = "".join(dict(zip(ACCENTED, PLAIN)).get(c, c).upper() for c in _SMALL)
_LATIN = "".join(c for c in map(chr, range(0xC0, 0xDF)) if c != "×")


def fold_case(c: Column) -> Column:
    """Upper case without accents. Most texts do without F.upper: where it is interpreted, as in lambdas, Spark asks for its settings
    each time, which takes far longer than the text."""
    return F.when(c.rlike(_FOLDABLE), F.translate(c, _SMALL, _LARGE)).otherwise(F.upper(F.translate(c, ACCENTED, PLAIN)))


def may_hold(c: Column, words: Iterable[str]) -> Column:
    """Whether one of these words, folded, may be in c once it is folded: true for sure of texts that hold one and of uncommon texts.
    Far cheaper than folding, for passing over most rows."""
    folded = dict(zip(_SMALL, _LARGE))
    like = lambda letter: f"[{letter}{''.join(c for c in _SMALL if folded[c] == letter)}]"
    return ~c.rlike(_FOLDABLE) | c.rlike("|".join("".join(map(like, w)) for w in words))


def lower(c: Column) -> Column:
    """F.lower, for where it is interpreted (see ``fold_case``)."""
    large = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _LATIN
    return F.when(c.rlike(r"\A[\x00-\xff]*\z"), F.translate(c, large, large.lower())).otherwise(F.lower(c))


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"{SPACE}+", " "), "^ | $", "")


def normalize_description(c: Column) -> Column:
    """Folded, with anything but letters, digits and ``/.-*`` as one space."""
    return F.regexp_replace(F.regexp_replace(fold_case(F.coalesce(c, F.lit(""))), r"[^A-Z0-9/.\-*]+", " "), "^ | $", "")


def description_key(c: Column) -> Column:
    """What is left of a description for comparing: no digits, signs or single letters."""
    return key_of_normalized(normalize_description(c))


def key_of_normalized(normalized: Column) -> Column:
    words = F.regexp_replace(F.regexp_replace(normalized, "[0-9]+", " "), r"[/.\-*]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(words, r"\b[A-Z]\b", " "), " +", " "), "^ | $", "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, from 0 to 1; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, r"[\s/.\-*]+"), lambda x: x != "")


def contains_folded(haystack: Column, needle: str) -> Column:
    return fold_case(haystack).contains(fold_case(F.lit(needle)))


def truncate(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(max(0, most - 1))), F.lit("…")))


def any_of(c: Column, tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out
