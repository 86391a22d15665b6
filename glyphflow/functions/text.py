"""Characters and white space as the operators count them: code points, with Unicode white space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.split sees it, for use inside a character class.
SPACES = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Devanagari, its extension, and the Vedic extensions, for use inside a character class.
DEVANAGARI = r"\x{900}-\x{97f}\x{a8e0}-\x{a8ff}\x{1cd0}-\x{1cff}"


def count_in(text: Column, characters: str) -> Column:
    """How many characters of the class a text has: what is lost by deleting them."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]+", ""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+\\z", "")


def is_blank(text: Column) -> Column:
    """Whether a text is null, empty or white space: the search ends at the first other character."""
    return ~F.coalesce(text.rlike(f"[^{SPACES}]"), F.lit(False))


def words(text: Column) -> Column:
    """The words between white space; none in blank text."""
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def where(text: Column, needed: Callable[[Column], Column], use: Callable[[Column], Column]) -> Column:
    """use(text) for the texts that need it; the others are left alone."""
    return once(text, lambda t: F.when(needed(t), use(t)).otherwise(t))


#: What sets a terminal's colours.
ANSI = r"\x1b\[[0-9;]*m"


def strip_ansi(text: Column) -> Column:
    """A terminal's output without its colours."""
    return F.regexp_replace(text, ANSI, "")


def preview(text: Column, most: int = 50) -> Column:
    """The beginning of a text, with three dots where it goes on."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def characters(text: Column) -> Column:
    """The code points of a text."""
    return F.filter(F.split(text, ""), lambda c: c != "")
