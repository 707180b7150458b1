"""Scalar functions on text and vectors, as Spark columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

IDENTIFIER = "^[A-Z]{8}[0-9]{12}$"
VERB = "^[a-z][a-z0-9_]*$"
#: What Python's str.strip() takes for white space, and the horizontal spaces that runs of become one space.
STRIP = "[\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
HORIZONTAL = "[ \\t\\u00a0\\u202f\\u2000-\\u200a\\u205f\\u3000]+"
ZERO_WIDTH = "[\\u200b\\u200c\\u200d\\ufeff\\u00ad]"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode's canonical composition, for which Spark has no function."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^{STRIP}+|{STRIP}+\\z", "")


def normalize_composed(text: Column) -> Column:
    """normalize_text() for texts that are in NFC already: no Python."""
    t = F.coalesce(text, F.lit(""))
    for pattern, put in (("<[^>]+>", " "), (ZERO_WIDTH, ""), (HORIZONTAL, " "), ("\\n{3,}", "\n\n")):
        t = F.regexp_replace(t, pattern, put)
    return strip(F.array_join(F.transform(F.split(t, "\n"), strip), "\n"))


def normalize_text(text: Column) -> Column:
    """NFC, tags to spaces, no zero-width characters, single spaces, at most one blank line, lines and whole stripped. Null gives ''."""
    composed = nfc(F.when(text.rlike("[^\\x00-\\x7F]"), text))  # ASCII is composed: it does not go through Python
    return normalize_composed(F.coalesce(composed, text))


def is_identifier(text: Column) -> Column:
    """Eight capitals and twelve digits; null is none."""
    return F.coalesce(text.rlike(IDENTIFIER), F.lit(False))


def verb_of(raw: Column) -> Column:
    """Lower-cased and trimmed if that is a valid verb, else null."""
    low = F.lower(strip(raw))
    return F.when(low.rlike(VERB), low)


def chunk_id(identifier: Column, ordinal: Column) -> Column:
    """Four digits at least."""
    return F.format_string("%s_%04d", identifier, ordinal)


def point_id(text: Column) -> Column:
    """SHA-256 modulo 2**63, as a long."""
    low = F.conv(F.substring(F.sha2(text, 256), 49, 16), 16, -10).cast("long")
    return low.bitwiseAND(F.lit((1 << 63) - 1))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def utf16_range(content: Column, start: Column, end: Column) -> Column:
    """struct(start, end) in UTF-16 units of a range in code points; null unless 0 <= start < end <= length."""
    fine = (start >= 0) & (start < end) & (end <= F.char_length(content))
    one = F.lit(1)
    return F.when(fine, F.struct(utf16_length(F.substring(content, one, start)).alias("start"), utf16_length(F.substring(content, one, end)).alias("end")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero, as vector stores have it."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def first_non_empty(*columns: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def percent(score: Column) -> Column:
    return F.round(score * 100).cast("int")


def type_label(document_type: Column, nature: Column) -> Column:
    """As in `Texte · LOI`."""
    return F.concat_ws(" · ", F.initcap(document_type), nature)
