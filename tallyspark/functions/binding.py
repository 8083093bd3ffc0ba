"""Values that several parts of an expression share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is named, not repeated: without it an expression built in stages doubles with each stage."""
    return F.transform(F.array(value), body)[0]
