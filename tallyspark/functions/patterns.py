"""Which patterns may take time exponential in a text: those that can repeat one stretch in several ways."""

from __future__ import annotations

from re import _constants as K
from re import _parser

#: Signs that sets are told apart by: all of one byte, and one that stands for the rest.
_SIGNS = frozenset(range(257))
_REPEATS = (K.MAX_REPEAT, K.MIN_REPEAT)
_WORDS = frozenset(c for c in range(256) if chr(c).isalnum() or c == 95)
_KINDS = {
    K.CATEGORY_DIGIT: frozenset(range(48, 58)), K.CATEGORY_SPACE: frozenset((9, 10, 11, 12, 13, 32)), K.CATEGORY_WORD: _WORDS,
    K.CATEGORY_NOT_DIGIT: _SIGNS - frozenset(range(48, 58)), K.CATEGORY_NOT_SPACE: _SIGNS - frozenset((9, 10, 11, 12, 13, 32)), K.CATEGORY_NOT_WORD: _SIGNS - _WORDS,
}


def _cased(signs: frozenset[int]) -> frozenset[int]:
    """Rules match without regard to case."""
    return signs | {ord(x) for c in signs if c < 256 for x in (chr(c).lower(), chr(c).upper()) if len(x) == 1 and ord(x) < 256}


def _one(op, value) -> frozenset[int]:
    """The signs that a node of one sign takes."""
    near = lambda c: min(c, 256)
    if op is K.LITERAL:
        return _cased(frozenset((near(value),)))
    if op is K.NOT_LITERAL:
        return _SIGNS - {near(value)} | {256}
    if op is K.ANY:
        return _SIGNS
    if op is K.CATEGORY:
        return _KINDS.get(value, _SIGNS)
    out: frozenset[int] = frozenset()
    for kind, x in value:
        if kind is K.RANGE:
            out |= frozenset(range(near(x[0]), near(x[1]) + 1))
        elif kind is not K.NEGATE:
            out |= _one(kind, x)
    return _SIGNS - out | {256} if value[0][0] is K.NEGATE else _cased(out)


def _inside(op, value) -> list:
    """The sequences within a node."""
    if op in (*_REPEATS, K.POSSESSIVE_REPEAT):
        return [value[2]]
    if op is K.SUBPATTERN:
        return [value[-1]]
    if op is K.BRANCH:
        return list(value[1])
    if op in (K.ASSERT, K.ASSERT_NOT):
        return [value[1]]
    return [value] if op is K.ATOMIC_GROUP else []


def _first(sequence) -> tuple[frozenset[int], bool]:
    """The signs that a match can begin with, and whether it can be empty."""
    out: frozenset[int] = frozenset()
    for op, value in sequence:
        if op in (K.LITERAL, K.NOT_LITERAL, K.ANY, K.IN, K.CATEGORY):
            return out | _one(op, value), False
        if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
            continue
        parts = [_first(x) for x in _inside(op, value)]
        if not parts:  # a reference to a group, or what else there is: anything
            return _SIGNS, True
        out |= frozenset().union(*(p for p, _ in parts))
        if not any(empty for _, empty in parts) and not (op in (*_REPEATS, K.POSSESSIVE_REPEAT) and value[0] == 0):
            return out, False
    return out, True


def _ambiguous(sequence, follow: frozenset[int], top: bool = True) -> bool:
    """Whether what is repeated can match one stretch in several ways: it is or holds something empty, repeats without bound inside,
    or has alternatives that begin alike."""
    for op, value in sequence:
        if op in _REPEATS and value[1] > 1 and not (value[0] == value[1] and not _first(value[2])[1]):
            if value[1] is K.MAXREPEAT or value[1] > 10 or _first(value[2])[0] & follow:
                return True
        if op is K.BRANCH:
            starts = [s | follow if empty else s for s, empty in map(_first, value[1])]
            if any(a & b for i, a in enumerate(starts) for b in starts[:i]):
                return True
        if any(_ambiguous(x, follow, False) for x in _inside(op, value) if op is not K.POSSESSIVE_REPEAT):
            return True
    return False


def _kept_apart(pattern: str) -> str:
    """The pattern with an empty look-ahead after every bar: without it the parser makes one set of alternatives of one sign, which the
    engine that runs the pattern does not."""
    out, at, in_set = "", 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out, at = out + pattern[at : at + 2], at + 2
            continue
        if in_set:
            in_set = c != "]"
        elif c == "[":
            in_set = True
            more = 2 if pattern[at + 1 : at + 2] == "^" else 1
            if pattern[at + more : at + more + 1] == "]":  # a bracket that stands first is a sign
                out, at = out + pattern[at : at + more], at + more
                c = pattern[at]
        out, at = out + (f"{c}(?=)" if c == "|" and not in_set else c), at + 1
    return out


def _single(sequence) -> frozenset[int] | None:
    """The signs of a sequence that takes one sign, whatever groups it is in."""
    rest = [x for x in sequence if x[0] is not K.ASSERT]
    if len(rest) != 1:
        return None
    op, value = rest[0]
    if op in (K.LITERAL, K.NOT_LITERAL, K.ANY, K.IN):
        return _one(op, value)
    parts = [_single(x) for x in _inside(op, value)] if op in (K.BRANCH, K.SUBPATTERN) else [None]
    return None if None in parts else frozenset().union(*parts)


def _alike(sequence) -> bool:
    """Whether any alternatives of one sign share one."""
    for op, value in sequence:
        if op is K.BRANCH:
            signs = [x for x in map(_single, value[1]) if x is not None]
            if any(a & b for i, a in enumerate(signs) for b in signs[:i]):
                return True
        if any(_alike(x) for x in _inside(op, value)):
            return True
    return False


def runs_away(pattern: str) -> bool:
    """Whether a repetition (of more than ten times) in the pattern, a valid one, is over something ambiguous."""

    def bad(sequence, ambiguous) -> bool:
        for op, value in sequence:
            if op in _REPEATS and value[1] > 10 and ambiguous(value[2]):
                return True
            if any(bad(x, ambiguous) for x in _inside(op, value)):
                return True
        return False

    def several(sequence) -> bool:
        starts, empty = _first(sequence)
        return empty or _ambiguous(sequence, starts)

    return bad(_parser.parse(pattern), several) or bad(_parser.parse(_kept_apart(pattern)), _alike)
