import re
import time

import pytest

from tallyspark.functions.patterns import runs_away
from tallyspark.operators.rules import BUILTIN, valid_pattern

BAD = ["(a+)+", "(a|a)*b", "((a+b)?)*c", "(a*)*", "(a?)*b", "(a|aa)+$", "(.*a){20}x", "(\\w+\\s?)*!", "([a-z]+)*\\d", "(x|[a-z])+y", "(?:a+){2,}", "(A|a)+$", "((ab)*)*", "(?:(?:a|b)|a)*c", "(\\d{1,20})*x"]
GOOD = ["TIN$", r"\bUBER\b.*EATS", "(ab|ac)*d", "(a|b)+c", "[a-z]+ [0-9]+", r"(\d{3}\.)*\d{3}", "(?:LIDER|JUMBO|TOTTUS)", "(a|ab)*c", "COMPRA( EN)? .+", r"\d{1,3}(\.\d{3})+", "(x{3})*y", "a{2,5}b"]


@pytest.mark.parametrize("pattern", BAD)
def test_ambiguous_repetition_is_refused(pattern):
    assert runs_away(pattern) and not valid_pattern(pattern)


@pytest.mark.parametrize("pattern", GOOD)
def test_plain_repetition_is_taken(pattern):
    assert not runs_away(pattern) and valid_pattern(pattern)
    began = time.perf_counter()
    for text in ("a" * 2000 + "!", "ab" * 1000, "123." * 500, "x" * 3000):
        re.search(pattern, text, re.I)
    assert time.perf_counter() - began < 5


def test_length_and_syntax():
    assert not valid_pattern("(") and not valid_pattern("a" * 201) and valid_pattern("a" * 200)


def test_built_in_rules_have_safe_patterns():
    patterns = [str(c.value) for r in BUILTIN for c in r.conditions if c.operator == "matches"]
    assert all(not runs_away(p) for p in patterns)
