"""Scalar functions over texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / F.lit(4.0)).cast("long")


def lines(text: Column) -> Column:
    """The lines of a text; a final line end opens no further line, and the empty text has none."""
    parts = F.split(text, "\n", -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(whole)


def entropy(token: Column) -> Column:
    """Shannon entropy in bits a character; 0 for the empty string. A character is counted by what its removal takes off."""
    n = F.length(token)
    part = lambda c: (n - F.length(F.replace(token, c, F.lit("")))) / n
    return F.aggregate(F.filter(F.array_distinct(F.split(token, "")), lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - part(c) * F.log2(part(c)))


def mime(text: Column) -> Column:
    """JSON where the first 512 characters begin, white space aside, with a brace or bracket; else plain text."""
    return F.when(F.regexp_replace(F.substring(text, 1, 512), r"^\s+", "").rlike(r"^[\{\[]"), "application/json").otherwise("text/plain")


def single_line(text: Column) -> Column:
    """White space around line ends becomes one space."""
    return F.regexp_replace(text, r"\s*\n\s*", " ")


def escape_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_newlines(text: Column) -> Column:
    """The inverse of escape_newlines: a pair of backslashes is one, a backslash and n a line end; in one pass."""
    pairs, between = F.regexp_extract_all(text, F.lit(r"\\\\|\\n"), 0), F.split(text, r"\\\\|\\n", -1)
    return F.array_join(F.zip_with(between, pairs, lambda b, p: F.concat(b, F.when(p == "\\n", "\n").when(p.isNotNull(), "\\").otherwise(""))), "")


def quoted(text: Column) -> Column:
    """A text as a regular expression that matches it."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def bullets(items: Column) -> Column:
    """A Markdown list."""
    return F.when(F.size(items) == 0, "- (none)").otherwise(F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))


def is_address(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\Aartifact://sha256/[0-9a-f]{64}\z"), F.lit(False))


def digest_of(address: Column) -> Column:
    return F.when(is_address(address), F.substring(address, 19, 64))


def address_of(digest: Column) -> Column:
    """The address of a digest in lower-case hex; others are an error."""
    return F.when(digest.rlike(r"\A[0-9a-f]{64}\z"), F.concat(F.lit("artifact://sha256/"), digest)).otherwise(F.raise_error(F.concat(F.lit("no digest: "), digest)).cast("string"))
