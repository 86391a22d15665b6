"""Chunks, wrapped lines, font sizes that fit, and page markers: folds over arrays, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES, is_blank, once, strip, words

CHUNK = 2000
#: What ends a sentence.
ENDS = r"\x{964}\x{965}.!?"
MARKER = r"---\s*Page\s+(\d+)\s*---"
TEXTS = "array<string>"


def _none() -> Column:
    return F.array().cast(TEXTS)


def _state(done: Column, held: Column) -> Column:
    return F.struct(done.alias("done"), held.alias("held"))


def _put(at: Column) -> Column:
    """What is done, with what is held if there is any."""
    return F.when(at["held"] != "", F.array_append(at["done"], at["held"])).otherwise(at["done"])


def sentences(text: Column) -> Column:
    """A text cut behind its sentence ends and the white space after them; the pieces join to the text."""
    lead = lambda p: F.regexp_extract(p, f"^[{SPACES}]*", 0)

    def joined(pieces: Column) -> Column:
        """Pieces end at sentence ends; the white space that the next one begins with is given back."""

        def whole(p: Column, i: Column) -> Column:
            own = F.when(i == 0, p).otherwise(F.substring(p, F.length(lead(p)) + 1, F.length(p)))
            return F.concat(own, F.coalesce(lead(F.get(pieces, i + 1)), F.lit("")))

        return F.filter(F.transform(pieces, whole), lambda s: s != "")

    return once(F.split(text, f"(?<=[{ENDS}])(?![{ENDS}])"), joined)


def chunks(text: Column, size: int = CHUNK) -> Column:
    """Chunks of at most ``size`` characters, at paragraphs or else sentences; a longer sentence stays whole."""

    def add_sentence(at: Column, s: Column) -> Column:
        joined = _state(at["done"], F.concat(at["held"], s))
        return F.when(F.length(at["held"]) + F.length(s) <= size, joined).otherwise(_state(_put(at), s))

    def add_paragraph(at: Column, p: Column) -> Column:
        joined = _state(at["done"], F.when(at["held"] != "", F.concat(at["held"], F.lit("\n\n"), p)).otherwise(p))
        split = F.aggregate(sentences(p), _state(_put(at), F.lit("")), add_sentence)
        return F.when(F.length(at["held"]) + F.length(p) + 2 <= size, joined).when(F.length(p) <= size, _state(_put(at), p)).otherwise(split)

    packed = F.aggregate(F.split(text, "\n\n"), _state(_none(), F.lit("")), add_paragraph, _put)
    return F.when(F.length(text) <= size, F.array(text)).otherwise(packed)


def slices(text: Column, size: int = 500) -> Column:
    """Pieces of ``size`` characters."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def _fold_words(text: Column, start: Column, step) -> Column:
    def of_paragraph(p: Column) -> Column:
        lines = F.aggregate(words(p), start, step, _put)
        return F.when(is_blank(p), F.array(F.lit(""))).otherwise(lines)

    return F.flatten(F.transform(F.split(text, "\n"), of_paragraph))


def wrap(text: Column, width: Column | int = 80) -> Column:
    """Lines of words by character count.  A word that stays counts its space too, one that begins a line does not."""
    width = F.lit(width) if isinstance(width, int) else width

    def state(done: Column, held: Column, used: Column) -> Column:
        return F.struct(done.alias("done"), held.alias("held"), used.alias("used"))

    def step(at: Column, w: Column) -> Column:
        longer = F.when(at["held"] != "", F.concat(at["held"], F.lit(" "), w)).otherwise(w)
        stays = at["used"] + F.length(w) + 1 <= width
        return F.when(stays, state(at["done"], longer, at["used"] + F.length(w) + 1)).otherwise(state(_put(at), w, F.length(w)))

    return _fold_words(text, state(_none(), F.lit(""), F.lit(0)), step)


def wrap_to_width(text: Column, width: Column | float, size: Column | float) -> Column:
    """Lines of words by estimated width: half the font size a character, a quarter a space."""
    lit = lambda x: F.lit(float(x)) if isinstance(x, (int, float)) else x
    width, size = lit(width), lit(size)

    def state(done: Column, held: Column, used: Column) -> Column:
        return F.struct(done.alias("done"), held.alias("held"), used.alias("used"))

    def step(at: Column, w: Column) -> Column:
        own = F.length(w) * size * 0.5
        first = at["held"] == ""
        used = at["used"] + F.when(first, F.lit(0.0)).otherwise(size * 0.25) + own
        longer = F.when(first, w).otherwise(F.concat(at["held"], F.lit(" "), w))
        return F.when(used <= width, state(at["done"], longer, used)).otherwise(state(_put(at), w, own))

    return _fold_words(text, state(_none(), F.lit(""), F.lit(0.0)), step)


def _lengths(text: Column) -> Column:
    """Of each paragraph the lengths of its words; none for a blank one."""
    return F.transform(F.split(text, "\n"), lambda p: F.transform(words(p), F.length))


def _count_lines(lengths: Column, step) -> Column:
    """How many lines a fold over the words' lengths has begun; a blank paragraph is one."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("used"))
    of_paragraph = lambda p: F.greatest(F.lit(1), F.aggregate(p, start, step, lambda at: at["n"]))
    return F.aggregate(F.transform(lengths, of_paragraph), F.lit(0), lambda n, m: n + m)


def _line(n: Column, used: Column) -> Column:
    return F.struct(n.alias("n"), used.cast("double").alias("used"))


def _count_wrapped(lengths: Column, width: Column | int) -> Column:
    """The number of lines of ``wrap``."""
    width = F.lit(width) if isinstance(width, int) else width

    def step(at: Column, w: Column) -> Column:
        used = at["used"] + w + 1
        return F.when(used <= width, _line(F.greatest(at["n"], F.lit(1)), used)).otherwise(_line(at["n"] + 1, w))

    return _count_lines(lengths, step)


def _count_to_width(lengths: Column, width: Column, size: Column) -> Column:
    """The number of lines of ``wrap_to_width``, by the same sums in the same order."""

    def step(at: Column, w: Column) -> Column:
        own = w * size * 0.5
        used = at["used"] + F.when(at["n"] == 0, F.lit(0.0)).otherwise(size * 0.25) + own
        return F.when(used <= width, _line(F.greatest(at["n"], F.lit(1)), used)).otherwise(_line(at["n"] + 1, own))

    return _count_lines(lengths, step)


def lines_to_width(text: Column, width: Column, size: float) -> Column:
    """How many lines wrap_to_width gives."""
    return once(_lengths(text), lambda x: _count_to_width(x, width, F.lit(float(size))))


def sizes_down(start: float, least: float) -> list[float]:
    """The font sizes tried, each nine tenths of the one before."""
    out = []
    while start >= least:
        out.append(start)
        start *= 0.9
    return out


#: What sums of doubles may be off by, and more.
SLACK = 1e-9


def _first_fit(text: Column, sizes: list[float], least: float, height: Column, step: float, width, count) -> Column:
    """The first of some sizes at which a text's lines, each ``step`` sizes high, are not higher than height.

    width: by size, what a line of words and nothing else may hold at most, in half sizes.  Words, cut once, of more than
    so many lines cannot fit; words that are no wider than a line are one; only what lies between is wrapped.
    """

    def tried(x: Column) -> Column:
        one = F.size(x["lengths"]) == 1

        def fits(s: float) -> Column:
            w = width(s)
            fewest = F.when((w > 0) & (x["widest"] <= w * (1 - SLACK)), F.ceil(x["total"] / w * (1 - SLACK))).otherwise(F.size(x["lengths"]))
            most = F.lit(s * step)
            short = one & (x["total"] + x["n"] + 1 <= w * (1 - SLACK))  # a space is one half size at most
            n = F.when(short, F.lit(1)).otherwise(count(x["lengths"], s))
            return F.when(F.greatest(F.lit(1), fewest) * most > height, F.lit(False)).otherwise(n * most <= height)

        return F.coalesce(*[F.when(fits(s), F.lit(s)) for s in sizes], F.lit(least))

    def summed(lengths: Column) -> Column:
        return once(F.flatten(lengths), lambda f: F.struct(lengths.alias("lengths"), F.coalesce(F.array_max(f), F.lit(0)).alias("widest"), F.size(f).alias("n"), F.aggregate(f, F.lit(0), lambda a, w: a + w).alias("total")))

    return once(once(_lengths(text), summed), tried)


def fit_font_size(text: Column, width: float, height: float, margin: float = 0.0, start: float = 11.0, least: float = 6.0) -> Column:
    """The largest size tried at which the wrapped text is not higher than the page."""
    w, h = width - 2 * margin, height - 2 * margin
    of_size = lambda s: int(w / (s * 0.5))
    return _first_fit(text, sizes_down(start, least), least, F.lit(h), 1.4, lambda s: F.lit(float(of_size(s))), lambda x, s: _count_wrapped(x, of_size(s)))


def fit_block_size(text: Column, width: Column, height: Column, original: float, least: float = 5.0, most: float = 12.0) -> Column:
    """The largest size tried at which the wrapped text fits its box."""
    return _first_fit(text, sizes_down(max(least, min(original, most)), least), least, height, 1.2, lambda s: width / F.lit(s * 0.5), lambda x, s: _count_to_width(x, width, F.lit(s)))


def pages_of_markers(text: Column, pages: int) -> Column:
    """The text of each page, cut at page markers; without any, equal shares of the lines.

    Of a page's markers the last counts, numbers out of range are dropped, and what stands before the first
    marker is page 1's unless that has one.
    """
    lines = F.split(text, "\n")
    share = F.greatest(F.lit(1), F.floor(F.size(lines) / pages).cast("int"))
    rest = lambda i: F.when(i < pages - 1, share).otherwise(F.greatest(F.lit(0), F.size(lines) - i * share))
    even = F.transform(F.sequence(F.lit(0), F.lit(pages - 1)), lambda i: F.array_join(F.slice(lines, i * share + 1, rest(i)), "\n"))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(MARKER), F.lit(1)), lambda n: n.cast("int"))
    parts = F.split(text, MARKER.replace("(", "(?:"))

    def page(i: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(numbers)), lambda k: F.element_at(numbers, k) == i)
        own = F.when(F.size(places) > 0, strip(F.element_at(parts, F.try_element_at(places, F.lit(-1)) + 1)))
        return F.coalesce(own, F.when(i == 1, strip(F.element_at(parts, 1))), F.lit(""))

    marked = F.transform(F.sequence(F.lit(1), F.lit(pages)), page)
    return F.when(F.size(numbers) > 0, marked).otherwise(even)


def percent(share: Column) -> Column:
    """A share with one decimal of percent; exact halves go to the even digit."""
    value = share * 100
    half = F.pmod(value * 4, F.lit(2.0)) == 1.0
    even = F.concat(F.floor(value).cast("string"), F.when(F.pmod(value, F.lit(1.0)) == 0.25, ".2").otherwise(".8"))
    return F.concat(F.when(half, even).otherwise(F.format_string("%.1f", value)), F.lit("%"))
