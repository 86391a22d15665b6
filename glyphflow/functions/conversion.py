"""Conversion of legacy glyph codes to Unicode.

First the keys of two and more characters, one after another, longest first, each on the result of the one
before; then every remaining character by itself.  All of it runs in the JVM: NFC is that of the ICU library that Spark
has for its collations.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..data.encodings import PARTS, glyphs
from .detection import UNICODE_NAMES
from .postprocess import processor
from .text import DEVANAGARI, characters, once, where

#: What may stay as it is besides Devanagari: printable ASCII and line ends.
PASSED = r"\x20-\x7e\t\n\r"
#: Most characters of most texts, all of them passed.
PLAIN = r"\x20-\x7e\x{900}-\x{97f}"
UNKNOWN = "\ufffd"
#: First of the characters (private use, plane 15) that stand for longer values meanwhile.
PLACEHOLDERS = 0xF0000


#: Spark's own copy of ICU, and its composition; false: canonical.
ICU = ("com.ibm.icu.text.Normalizer", "compose", False)


def nfc(text: Column) -> Column:
    """Canonical composition; null stays null."""
    name, method, compatible = ICU
    return once(text, lambda t: F.when(t.isNotNull(), F.reflect(F.lit(name), F.lit(method), t, F.lit(compatible))))


def composed(made: Column) -> Column:
    """The same of a whole result (converted, unmapped)."""
    return once(made, lambda m: F.struct(nfc(m["converted"]).alias("converted"), m["unmapped"].alias("unmapped")))


def _class_of(characters: list[str]) -> str:
    """Characters as part of a character class."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in characters)


def _singles(encoding: str) -> dict[str, str]:
    return {k: v for k, v in glyphs(encoding).items() if len(k) == 1}


def _covered(encoding: str) -> str:
    """The class of characters that some rule covers."""
    return PASSED + DEVANAGARI + _class_of(list(_singles(encoding)))


def replace_sequences(text: Column, encoding: str) -> Column:
    """The keys of more than one character, in order, each on the result of the one before."""
    for k, v in glyphs(encoding).items():
        if len(k) > 1:
            text = F.replace(text, F.lit(k), F.lit(v))
    return text


def unmapped(text: Column, encoding: str) -> Column:
    """The distinct characters that no rule covers, sorted, of a text whose sequences have been replaced."""
    left = F.regexp_replace(text, f"[{PLAIN}]+", "")  # what most characters are, by two ranges and not by all of them
    return F.sort_array(F.array_distinct(characters(F.regexp_replace(left, f"[{_covered(encoding)}]+", ""))))


def _lengthened(text: Column, longer: dict[str, str]) -> Column:
    """Each key followed by its value without the first character: the text is cut behind all keys at once, and what a
    piece lacks follows from its last character, so a pass is enough however many keys there are."""
    if not longer:
        return text
    keys, rests = "".join(longer), F.array(*[F.lit(v[1:]) for v in longer.values()])

    def lengthened(piece: Column) -> Column:
        key = F.instr(F.lit(keys), F.substring(piece, -1, 1))
        return F.when(piece == "", piece).otherwise(F.concat(piece, F.coalesce(F.get(rests, key - 1), F.lit(""))))

    own = f"[{_class_of(list(longer))}]"
    return where(text, lambda t: t.rlike(own), lambda t: F.array_join(F.transform(F.split(t, f"(?<={own})"), lengthened), ""))


def replace_characters(text: Column, encoding: str, preserve_unknown: bool = True) -> Column:
    """Every remaining character by itself.

    One pass of translate, which maps characters to single ones or to nothing; what values have behind their first
    character is put there before.  A value whose further characters are keys themselves goes by a placeholder
    beyond all assigned characters; texts that hold such characters are mapped character by character.
    """
    singles = _singles(encoding)
    longer = {k: v for k, v in singles.items() if len(v) > 1}
    odd = [k for k, v in longer.items() if set(v[1:]) & {*singles, "$", "\\"}]
    placeholder = {k: chr(PLACEHOLDERS + i) for i, k in enumerate(odd)}
    if not preserve_unknown:
        text = F.regexp_replace(text, f"(?![{PLAIN}])[^{_covered(encoding)}]", UNKNOWN)
    out = _lengthened(text, {k: v for k, v in longer.items() if k not in placeholder})
    kept = [k for k, v in singles.items() if v] + [k for k, v in singles.items() if not v]  # translate drops the last ones
    out = F.translate(out, "".join(kept), "".join(placeholder.get(k, singles[k][:1]) for k in kept))
    if not odd:
        return out
    for k in odd:
        out = F.replace(out, F.lit(placeholder[k]), F.lit(singles[k]))
    table = F.create_map(*[F.lit(x) for kv in singles.items() for x in kv])
    slow = F.array_join(F.transform(characters(text), lambda c: F.coalesce(table[c], c)), "")
    return F.when(text.rlike(f"[\\x{{{PLACEHOLDERS:x}}}-\\x{{{PLACEHOLDERS + len(odd):x}}}]"), slow).otherwise(out)


def convert(text: Column, encoding: str, preserve_unknown: bool = True, normalize: bool = True) -> Column:
    """struct<converted, encoding_used, success, unmapped> of a text in one encoding."""
    if encoding.lower() in UNICODE_NAMES or encoding not in PARTS:
        known = encoding.lower() in UNICODE_NAMES
        return F.struct(text.alias("converted"), F.lit(encoding).alias("encoding_used"), F.lit(known).alias("success"), F.array().cast("array<string>").alias("unmapped"))
    made = applied(text, encoding, preserve_unknown)
    finish = nfc if normalize else lambda t: t
    return once(made, lambda m: F.struct(finish(m["converted"]).alias("converted"), F.lit(encoding).alias("encoding_used"), F.lit(True).alias("success"), m["unmapped"].alias("unmapped")))


def applied(text: Column, encoding: str, preserve_unknown: bool = True) -> Column:
    """struct<converted, unmapped> before composition."""

    def rest(replaced: Column) -> Column:
        done = processor(encoding)(replace_characters(replaced, encoding, preserve_unknown))
        return F.struct(done.alias("converted"), unmapped(replaced, encoding).alias("unmapped"))

    return once(replace_sequences(text, encoding), rest)


def conversion_rate(original: Column, n_unmapped: Column) -> Column:
    """The share of distinct characters that were mapped; 1 for empty text."""
    of = lambda n: F.when(n > 0, (n - n_unmapped).cast("double") / n)
    return F.when(F.length(original) > 0, once(F.size(F.array_distinct(characters(original))), of)).otherwise(1.0)
