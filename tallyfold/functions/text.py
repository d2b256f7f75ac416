"""Unicode-aware text helpers. Classes are spelled out because Java's ``\\s`` and ``\\w`` are ASCII-only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


def strip(text: Column) -> Column:
    """Remove white space at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def unix_newlines(text: Column) -> Column:
    """Turn ``\\r\\n`` and lone ``\\r`` into ``\\n``."""
    return F.regexp_replace(text, "\r\n?", "\n")


def starts_upper(text: Column) -> Column:
    """The first character is an upper-case letter."""
    return text.rlike(r"^\p{IsUppercase}")


def has_upper(text: Column) -> Column:
    return text.rlike(r"\p{IsUppercase}")


def is_upper(text: Column) -> Column:
    """At least one cased character, and none that is lower or title case."""
    return has_upper(text) & ~text.rlike(r"[\p{IsLowercase}\p{Lt}]")


def captures(text: Column, pattern: str, group: int = 1) -> Column:
    """All captures of one group, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def matches_with_lines(text: Column, pattern: str, with_context: bool = True) -> Column:
    """All matches in order as ``array<struct<match, line[, context]>>``.

    ``line`` counts from 1 and is where the match starts; ``context`` is that whole line, repeated for
    each of its matches, so leave it out where nothing reads it. A mark is put
    in front of every match; as marks add no line breaks, the marked and plain lines pair up, and the
    difference of their lengths is the number of matches starting there. Linear in the text, no join.
    """
    plain = F.split(text, "\n", -1)
    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit("\x01$0")), "\n", -1)
    numbered = F.transform(marked, lambda line, i: F.struct(line.alias("marked"), (i + 1).alias("line")))

    def start(line: Column, number: Column) -> Column:
        return F.struct(number.alias("line"), *([line.alias("context")] if with_context else []))

    def starts_in(line: Column, n: Column) -> Column:
        return F.array_repeat(start(line, n["line"]), F.length(n["marked"]) - F.length(line))

    def found(match: Column, at: Column) -> Column:
        context = [at["context"].alias("context")] if with_context else []
        return F.struct(match.alias("match"), at["line"].alias("line"), *context)

    return F.zip_with(captures(text, pattern, 0), F.flatten(F.zip_with(plain, numbered, starts_in)), found)
