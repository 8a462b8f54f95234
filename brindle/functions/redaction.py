"""Redaction of SQL text and connection strings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of redacted SQL that are kept.
KEPT = 200
#: What a connection string without scheme becomes if it may hold a password.
HIDDEN = "***REDACTED***"
_SCHEME = "[A-Za-z][A-Za-z0-9+.-]*://"
#: Up to the query, with a password that holds a question mark or a number sign.
_ODD = "[^:/?#@]*:(?![0-9]*[?#])[^@/]*[?#][^@/]*@[^?#]*"


def redact_sql(text: Column) -> Column:
    """Single-quoted literals ('' inside, unclosed ones too) become '...'; longer than KEPT is cut and marked."""
    plain = F.regexp_replace(text, "'[^']*+(?:''[^']*+)*+(?:'|$)", "'...'")
    return F.when(F.length(plain) > KEPT, F.concat(F.left(plain, F.lit(KEPT)), F.lit("..."))).otherwise(plain)


def redact_dsn(text: Column) -> Column:
    """The password becomes ***; the query string and the fragment go, whatever they hold.

    A password begins after the first colon behind ``scheme://`` and reaches to the last @ before the query, so that an @, a slash or
    a line feed inside it leaves nothing behind. A question mark in a password is known by what stands before it, which is no port. A
    text without scheme loses the values of its ``password=`` words, and is hidden whole if it has an @. Each step stands
    in the expression once: Spark evaluates anew what stands in several branches.
    """
    shown = F.regexp_extract(text, f"(?s)^({_SCHEME}(?:{_ODD}|[^?#]*))", 1)
    hidden = F.regexp_replace(shown, f"(?s)^({_SCHEME}[^:@/]*):.*@", "$1:***@")
    words = F.regexp_replace(F.regexp_extract(text, r"(?s)^([^?]*)", 1), r"(?i)(password\s*=\s*)('(?:[^'\\]|\\.)*'?|\S+)", "$1***")
    bare = F.when(F.contains(text, F.lit("@")), F.lit(HIDDEN)).otherwise(words)
    return F.when(text.rlike(f"^{_SCHEME}"), hidden).otherwise(bare)
