"""String expressions: trimming, cleaning, words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The characters counted as white space when a cell is trimmed.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# What cleaning turns into a space.
URL = r"https?://[^\s\p{Z}]+|www\.[^\s\p{Z}]+"
TAG = r"<[^>]+>"
NOT_ASCII_WORD = r"[^a-z0-9]+"
NOT_UNICODE_WORD = r"[^\p{L}\p{N}]+"


def strip(value: Column) -> Column:
    return F.trim(value, F.lit(WHITE_SPACE))


def is_blank(value: Column) -> Column:
    return F.coalesce(F.length(value), F.lit(0)) == 0


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once per row.

    A lambda variable is a value, whereas an expression named in a lambda is
    worked out again for every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_text(raw: Column, ascii_only: bool = True) -> Column:
    """Lower case, without links, tags and punctuation, words one space apart.

    Each run of other characters becomes one space, which also squeezes
    spaces. Most texts hold neither link nor tag, and a plain search tells so
    faster than the pattern. ``ascii_only=False`` keeps letters and digits of
    every script.
    """
    other = NOT_ASCII_WORD if ascii_only else NOT_UNICODE_WORD

    def without_links(t: Column) -> Column:
        found = F.contains(t, F.lit("http")) | F.contains(t, F.lit("www."))
        return F.when(found, F.regexp_replace(t, URL, " ")).otherwise(t)

    def without_tags(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("<")), F.regexp_replace(t, TAG, " ")).otherwise(t)

    return let(
        F.lower(raw),
        lambda low: let(
            without_links(low), lambda plain: F.trim(F.regexp_replace(without_tags(plain), other, " "))
        ),
    )


def words(cleaned: Column) -> Column:
    """Words of a cleaned text, an empty array for an empty text."""
    none = F.array().cast("array<string>")
    return let(cleaned, lambda c: F.when(c == "", none).otherwise(split_words(c)))


def split_words(cleaned: Column) -> Column:
    """Words of a cleaned text known to hold one; without a lambda, so explodes of it compile."""
    return F.split(cleaned, " ")


def word_count(text: Column) -> Column:
    """Number of words of any text."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def cleaned_word_count(cleaned: Column) -> Column:
    """Number of words of a cleaned, non-empty text: one more than its spaces."""
    return (F.length(cleaned) - F.length(F.replace(cleaned, F.lit(" "), F.lit(""))) + 1).cast("long")


def if_kept(value: Column, test: Callable[[Column], Column]) -> Column:
    """``value`` as an array of one where ``test`` holds, else an empty array.

    Exploding it filters rows by a costly value that is worked out once. A
    plain filter on such a column is pushed down as a second copy of it.
    """
    return F.filter(F.array(value), test)


def truncate(text: Column, limit: int = 40) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit), F.lit("..."))
    )


def title_case(text: Column) -> Column:
    """First letter of every word in upper case, words ending at any non-letter."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.initcap(p)), "")
