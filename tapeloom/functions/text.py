"""Text helpers as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space when stripping and
# splitting Unicode text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Length limit, marker and fallback of a notes summary, the title
# of a notes document and the text of a placeholder transcript.
SUMMARY_CHARS = 280
SUMMARY_MARK = "..."
SUMMARY_FALLBACK = "No transcript available."
NOTES_TITLE = "Notes for %s"
PLACEHOLDER_TEXT = (
    "Dummy transcript for session '%s' from %s. Replace with a real transcription backend."
)


def strip(text: Column) -> Column:
    """Remove white space at both ends; Spark's ``trim`` would take spaces only."""
    return F.btrim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE))


def words(text: Column) -> Column:
    """Tokens between runs of Unicode white space; none for blank text."""
    # One plain separator first: a regular expression over the whole table of
    # white space takes four times as long.
    spaced = F.translate(text, WHITESPACE, " " * len(WHITESPACE))
    return F.array_remove(F.split(spaced, " "), F.lit(""))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def preview_sentence(text: Column) -> Column:
    """Text before the first ``". "``, stripped; NULL when nothing is left."""
    return F.nullif(strip(F.substring_index(text, ". ", 1)), F.lit(""))


def file_name(path: Column) -> Column:
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def path_stem(path: Column) -> Column:
    """File name without its last suffix; a leading or final dot starts none."""
    name = file_name(path)
    left = F.length(name) - F.length(F.substring_index(name, ".", -1)) - 1
    has_suffix = (left > 0) & (left < F.length(name) - 1)
    return F.when(has_suffix, F.substring(name, F.lit(1), left)).otherwise(name)


def summarise(combined: Column) -> Column:
    """First 280 code points, marked when cut; fallback only for exactly ``''``."""
    cut = F.when(
        F.length(combined) > SUMMARY_CHARS,
        F.concat(F.substring(combined, 1, SUMMARY_CHARS), F.lit(SUMMARY_MARK)),
    ).otherwise(combined)
    return F.when(combined == "", F.lit(SUMMARY_FALLBACK)).otherwise(cut)


def notes_title(session_name: Column) -> Column:
    return F.format_string(NOTES_TITLE, session_name)


def placeholder_text(session_name: Column, path: Column) -> Column:
    return F.format_string(PLACEHOLDER_TEXT, session_name, file_name(path))


def fixed_two(value: Column) -> Column:
    """A number with two decimals, rounded on its exact binary value, ties to even.

    The fraction is cut into two halves of 26 bits, so that a hundred times each
    half is exact and the distance to the rounding tie has the right sign.
    """
    size = F.abs(value)
    whole = F.floor(size)
    fraction = size - whole
    high = F.floor(fraction * 2.0**26) / F.lit(2.0**26)
    scaled, rest = high * 100, (fraction - high) * 100
    below = F.floor(scaled + rest)
    past_tie = (scaled - below - 0.5) + rest
    up = F.when((past_tie > 0) | ((past_tie == 0) & (F.pmod(below, F.lit(2)) == 1)), 1).otherwise(0)
    cents = whole * 100 + below + up
    return F.concat(
        F.when(value < 0, F.lit("-")).otherwise(F.lit("")),
        F.floor(cents / 100).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad(F.pmod(cents, F.lit(100)).cast("bigint").cast("string"), 2, "0"),
    )


def seconds(value: Column) -> Column:
    """Two decimals, right-aligned to six characters (wider values keep all digits)."""
    text = fixed_two(value)
    return F.when(F.length(text) < 6, F.lpad(text, 6, " ")).otherwise(text)
