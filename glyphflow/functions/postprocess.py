"""Order of Devanagari marks after glyphs have been replaced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES, where

# Signs that one font writes as two, and the sign they stand for.
VOWEL_PAIRS = [("\u093e\u0947", "\u094b"), ("\u093e\u0948", "\u094c"), ("\u0947\u093e", "\u094b"), ("\u0948\u093e", "\u094c")]
SHREE_DEV_PAIRS = [
    ("\u093e\u0947", "\u094b"),
    ("\u093e\u0948", "\u094c"),
    ("\u0945\u0902", "\u0901"),
    ("\u0902\u0945", "\u0901"),
    ("\u093e\u0945", "\u0949"),
    ("\u0945\u093e", "\u0949"),
    ("\u093e\u094b", "\u094b"),
    ("\u0948\u093e", "\u094c"),
    ("\u0947\u093e", "\u094b"),
]
SHREE_DEV_CONSONANT = "[\u0915-\u0931\u0932\u0933\u0935-\u0939\u0958-\u095f]"
SHREE_DEV_SIGN = "\u093e-\u0943\u0947\u0948\u094b\u094c"
#: A stand-in that some converted files hold, and what it stands for.
SHREE_DEV_STAND_IN = ("\u092a\u094d\u0932\u0947\u0938\u0939\u094b\u0932\u094d\u0921\u0930_\u0907", "\u092a")
#: Passes over what most characters are, which the many ranges of white space would be compared with one by one.
NO_SPACE = "(?![!-~\u0900-\u097f])"
#: Encodings whose glyph i stands before its consonant, as the letters p and q.
SHREE_DEV = ("shree-dev", "shree-dev-0714", "shree-dev-0708")


def _replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def common(text: Column) -> Column:
    """Vowel signs merged, nukta before them, nasal signs and visarga after them, no space before a mark."""
    text = _replace_all(text, VOWEL_PAIRS)
    text = where(text, lambda t: F.contains(t, F.lit("\u093c")), lambda t: F.regexp_replace(t, "([\u0915-\u0939\u0958-\u095f])([\u093e-\u094c\u0962\u0963])(\u093c)", "$1$3$2"))
    text = F.regexp_replace(text, "([\u0901-\u0903])([\u093e-\u094c]+)", "$2$1")
    return _unspaced(text, "[\u094d\u093e-\u094c\u0901\u0902]")


def _unspaced(text: Column, marks: str) -> Column:
    """No white space before a mark: looked for only in texts that have some there."""
    return where(text, lambda t: t.rlike(f"{NO_SPACE}[{SPACES}]{marks}"), lambda t: F.regexp_replace(t, rf"{NO_SPACE}[{SPACES}]+({marks})", "$1"))


def _signs_i(text: Column) -> Column:
    text = F.regexp_replace(text, f"([pq])({SHREE_DEV_CONSONANT})", "$2$1")
    text = F.regexp_replace(text, f"([pq])((?:\u094d{SHREE_DEV_CONSONANT})+)", "$2$1")
    return _replace_all(text, [("p", "\u093f"), ("q", "\u093f\u0902")])


def _signs_r(text: Column) -> Column:
    text = F.regexp_replace(text, f"({SHREE_DEV_CONSONANT})([{SHREE_DEV_SIGN}\u0901\u0902]*)\u00a9", "\u00a9$1$2")
    text = F.regexp_replace(text, f"((?:{SHREE_DEV_CONSONANT}\u094d)+)\u00a9", "\u00a9$1")
    return F.replace(text, F.lit("\u00a9"), F.lit("\u0930\u094d"))


def shree_dev(text: Column) -> Column:
    """The same for fonts that write i (p, q) before and r (the copyright sign) after its cluster.

    Steps that a text has no sign for are left out.
    """
    text = where(text, lambda t: t.rlike("[pq]"), _signs_i)
    text = where(text, lambda t: F.contains(t, F.lit("\u00a9")), _signs_r)
    signs = "".join({c for pair, _ in SHREE_DEV_PAIRS for c in pair})
    pairs = [SHREE_DEV_STAND_IN, *SHREE_DEV_PAIRS]
    text = where(text, lambda t: t.rlike(f"[{''.join(sorted(signs))}]{{2}}|{SHREE_DEV_STAND_IN[0]}"), lambda t: _replace_all(t, pairs))
    text = F.regexp_replace(text, f"([\u0901-\u0903\u0970]+)([{SHREE_DEV_SIGN}]+)", "$2$1")
    return _unspaced(text, "[\u093d\u094d\u093e\u0940-\u0943\u0947\u0948\u094b\u094c\u0901\u0902]")


#: Encoding to processor; every other encoding has the common one.
REGISTRY = dict.fromkeys(SHREE_DEV, shree_dev)


def processor(encoding: str):
    return REGISTRY.get(encoding.lower(), common)
