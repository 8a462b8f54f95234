"""Deterministic stand-ins for personal values: Column expressions over a SHA-256 of value and seed. Null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# These lists decide results and must stay as they are, in this order.
EMAIL_FIRST = "alice bob carol david emma frank grace henry iris jack".split()
EMAIL_LAST = "smith jones wilson taylor brown davies evans thomas johnson roberts".split()
EMAIL_DOMAINS = "example.com test.org sample.net".split()
FIRST_NAMES = "Alice Bob Carol David Emma Frank Grace Henry Iris Jack Karen Leo Mia Noah Olivia".split()
LAST_NAMES = "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Wilson Anderson Taylor Thomas Moore".split()


def _digest(value: Column, seed: str) -> Column:
    return F.sha2(F.concat(value.cast("string"), F.lit(seed)), 256)


def _pick(values: list[str], digest: Column, start: int) -> Column:
    """An entry by the number that eight hex digits from ``start`` write."""
    number = F.conv(F.substring(digest, start, 8), 16, 10).cast("long")
    return F.when(digest.isNotNull(), F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int")))


def fake_email(value: Column, seed: str) -> Column:
    d = _digest(value, seed)
    return F.concat(_pick(EMAIL_FIRST, d, 1), F.lit("."), _pick(EMAIL_LAST, d, 9), F.lit("."), F.substring(d, 25, 4), F.lit("@"), _pick(EMAIL_DOMAINS, d, 17))


def fake_name(value: Column, seed: str) -> Column:
    d = _digest(value, seed)
    return F.concat(_pick(FIRST_NAMES, d, 1), F.lit(" "), _pick(LAST_NAMES, d, 9))


def fake_first_name(value: Column, seed: str) -> Column:
    return _pick(FIRST_NAMES, _digest(value, seed), 1)


def fake_last_name(value: Column, seed: str) -> Column:
    return _pick(LAST_NAMES, _digest(value, seed), 1)


def fake_uuid(value: Column, seed: str) -> Column:
    d = _digest(value, seed)
    part = lambda a, n: F.substring(d, a, n)
    dashed = F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("4"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12))
    return F.when(value.isNotNull(), dashed)


def redact(value: Column, seed: str = "") -> Column:
    """ASCII letters become X and digits 9; all else, blanks included, stays."""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), "[a-zA-Z]", "X"), "[0-9]", "9")


STRATEGIES = {
    "fake_email": fake_email, "fake_name": fake_name, "fake_first_name": fake_first_name, "fake_last_name": fake_last_name, "fake_uuid": fake_uuid, "redact": redact,
}


def strategy(name: str, column: Column, data_type: str, seed: str) -> Column:
    """The expression of a named strategy for a column of a type; an unknown name raises ValueError."""
    if name == "preserve":
        return column
    if name == "null":
        return F.lit(None).cast(data_type)
    if name == "zero":
        return F.lit(0).cast(data_type)
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; known: preserve, null, zero, {', '.join(STRATEGIES)}")
    return STRATEGIES[name](column, seed)
