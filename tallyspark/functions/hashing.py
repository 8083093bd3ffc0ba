"""Content hashes of fields and movements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.money import canonical
from tallyspark.functions.text import description_key

VERSION = "v1"


def hash_fields(*fields: Column) -> Column:
    """SHA-256 of the fields with U+001F between; null fields are left out."""
    return F.sha2(F.concat_ws("\x1f", *fields), 256)


def fingerprint(account: Column, date: Column, amount: Column, currency: Column, description: Column, reference: Column, remaining: Column | None = None) -> Column:
    """Names a movement: the same wherever it was read from."""
    more = [] if remaining is None else [remaining.cast("string")]
    return hash_fields(F.lit(VERSION), account, date.cast("string"), canonical(amount), currency, description_key(description), F.coalesce(reference, F.lit("")), *more)


def weak_fingerprint(account: Column, date: Column, amount: Column, currency: Column) -> Column:
    """Names a movement's account, day and amount only."""
    return hash_fields(F.lit(VERSION), F.lit("weak"), account, date.cast("string"), canonical(amount), currency)


def _with_scale(amount: Column, scale: Column) -> Column:
    """The amount's text with exactly ``scale`` decimals."""
    text = amount.cast("decimal(22,6)").cast("string")
    return F.left(text, F.length(text) - 6 + scale - F.when(scale == 0, 1).otherwise(0))


def legacy_fingerprints(account: Column, date: Column, amount: Column, scale: Column, currency: Column, description: Column, reference: Column) -> tuple[Column, Column]:
    """The two names that older rows carry, which kept trailing zeros; null where they would not differ."""
    text = _with_scale(amount, scale)
    differs = text != canonical(amount)
    strong = hash_fields(F.lit(VERSION), account, date.cast("string"), text, currency, description_key(description), F.coalesce(reference, F.lit("")))
    weak = hash_fields(F.lit(VERSION), F.lit("weak"), account, date.cast("string"), text, currency)
    return F.when(differs, strong), F.when(differs, weak)
