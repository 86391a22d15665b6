"""Which encoding a font name or a text points to, as column expressions.

Each returns a struct (encoding, confidence, method, fallbacks), null where nothing is found.  The order of
trials is part of the result: on equal scores the encoding that is tried first wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..data.fonts import BY_PRIORITY, PROFILES, UNICODE_FONTS
from .text import DEVANAGARI, count_in

UNICODE_NAMES = ("unicode", "unicode-devanagari", "utf-8", "utf8")
NO_NAMES = "array<string>"


def verdict(encoding: Column | str, confidence: Column | float, method: str, fallbacks: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.array().cast(NO_NAMES)
    return F.struct(lit(encoding).alias("encoding"), lit(confidence).cast("double").alias("confidence"), F.lit(method).alias("method"), (none if fallbacks is None else fallbacks).alias("fallbacks"))


def of_font(name: Column, custom: list[tuple[str, list[str]]] | None = None) -> Column:
    """By font name: a Unicode font, else the first pattern by priority; custom (encoding, patterns) go first."""
    name = F.lower(name)
    out = F.when(name.rlike("|".join(UNICODE_FONTS)), verdict("unicode-devanagari", 1.0, "unicode_detected"))
    for encoding, patterns in [*(custom or []), *((e, p) for e, _, p, _ in BY_PRIORITY)]:
        out = out.when(name.rlike("|".join(patterns).lower()), verdict(encoding, 0.95, "font_match"))
    return F.when(F.coalesce(name, F.lit("")) != "", out)


def is_unicode_text(text: Column) -> Column:
    """Over a tenth of the characters, blanks and line breaks aside, are Devanagari."""
    visible = F.length(F.translate(text, " \n\t", ""))
    return F.coalesce((visible > 0) & (count_in(text, DEVANAGARI).cast("double") / F.nullif(visible, F.lit(0)) > 0.1), F.lit(False))


def signature_scores(text: Column) -> Column:
    """array<struct<encoding, score>> in order of trial: the share of an encoding's signatures in the text."""
    scores = []
    for encoding, _, _, signatures in BY_PRIORITY:
        hits = sum((F.contains(text, F.lit(s)).cast("int") for s in signatures[1:]), F.contains(text, F.lit(signatures[0])).cast("int"))
        scores.append(F.struct(F.lit(encoding).alias("encoding"), (hits / F.lit(float(len(signatures)))).alias("score")))
    return F.array(*scores)


def best_signature(scores: Column) -> Column:
    """struct<best, score, fallbacks>: a better score displaces the best so far, which joins the fallbacks."""
    start = F.struct(F.lit(None).cast("string").alias("best"), F.lit(0.0).alias("score"), F.array().cast(NO_NAMES).alias("fallbacks"))

    def step(at: Column, x: Column) -> Column:
        displaced = F.when(at["best"].isNotNull(), F.array_append(at["fallbacks"], at["best"])).otherwise(at["fallbacks"])
        better = F.struct(x["encoding"].alias("best"), x["score"].alias("score"), displaced.alias("fallbacks"))
        also = F.struct(at["best"].alias("best"), at["score"].alias("score"), F.array_append(at["fallbacks"], x["encoding"]).alias("fallbacks"))
        return F.when(x["score"] > at["score"], better).when(x["score"] > 0.3, also).otherwise(at)

    return F.aggregate(scores, start, step)


def of_signatures(text: Column) -> Column:
    best = best_signature(signature_scores(text))
    found = lambda b: F.when(
        b["best"].isNotNull() & (b["score"] >= 0.3),
        verdict(b["best"], F.least(F.lit(0.90), F.lit(0.60) + b["score"] * 0.30), "heuristic", F.slice(b["fallbacks"], 1, 3)),
    )
    return F.transform(F.array(best), found)[0]


def of_frequency(text: Column) -> Column:
    """By the characters met, for texts of 20 characters and more with three or more beyond ASCII."""
    met = F.array_distinct(F.split(F.regexp_replace(text, r"[\x00-\x7f]+", ""), ""))
    scores = [F.struct((F.size(F.array_intersect(met, F.array(*map(F.lit, profile)))) / F.lit(float(len(profile)))).alias("score"), F.lit(-i).alias("turn"), F.lit(e).alias("encoding")) for i, (e, profile) in enumerate(PROFILES)]
    best = F.array_max(F.array(*scores))
    enough = (F.length(text) >= 20) & (count_in(text, r"\x{80}-\x{10ffff}") >= 3)
    found = lambda b: F.when(b["score"] > 0.2, verdict(b["encoding"], F.least(F.lit(0.85), F.lit(0.50) + b["score"] * 0.35), "heuristic"))
    return F.when(enough, F.transform(F.array(best), found)[0])


def of_text(text: Column) -> Column:
    """By text alone: Unicode, signatures, character profiles, then the share of U+0080 to U+00FF."""
    high = count_in(text, r"\x80-\xff").cast("double") / F.nullif(F.length(text), F.lit(0))
    legacy = verdict("unknown-legacy", 0.50, "heuristic", F.array(*map(F.lit, ("shree-dev", "shree-lipi", "kruti-dev"))))
    unknown = verdict("unknown", 0.0, "heuristic")
    return (
        F.when(F.coalesce(text, F.lit("")) == "", unknown)
        .when(is_unicode_text(text), verdict("unicode-devanagari", 1.0, "unicode_detected"))
        .otherwise(F.coalesce(of_signatures(text), of_frequency(text), F.when(high > 0.2, legacy), unknown))
    )


def of_block(font_name: Column, text: Column) -> Column:
    return F.coalesce(of_font(font_name), of_text(text))


def is_unicode(encoding: Column) -> Column:
    return F.lower(encoding).isin(*UNICODE_NAMES)


def is_legacy(encoding: Column) -> Column:
    return ~is_unicode(encoding) & (encoding != "unknown")
