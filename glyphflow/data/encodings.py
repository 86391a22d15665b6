"""The catalogue of encodings with glyph tables, and each table in the order its keys are applied."""

from __future__ import annotations

from functools import lru_cache

from . import aps_dv, chanakya, dvb_tt, kruti_dev, shree_dev, shree_lipi, shusha, walkman_chanakya

# Fixed values: (encoding, font family, language, variants) of the built-in tables; all are in Devanagari script.
CATALOG = [
    ("shree-lipi", "Shree-Lipi", "Marathi", ["Shree-Dev-0714", "Shree-Dev-0702", "Shree-Dev-0705"]),
    ("kruti-dev", "Kruti Dev", "Hindi", ["KrutiDev010", "KrutiDev040"]),
    ("dvb-tt", "DVB-TT", "Marathi", ["DVBWTTSurekhNormal", "DVBWTTSurekhBold", "DVBTTSurekhNormal", "DVBWTT", "DVB-TT-Surekh"]),
    ("shree-dev", "SHREE-DEV", "Marathi", ["SHREE-DEV-0708", "SHREE-DEV-0714", "SHREE-DEV-0715", "SHREE-DEV-0721"]),
    ("chanakya", "Chanakya", "Hindi", ["Chanakya", "ChanakyaFont"]),
    ("aps-dv", "APS-DV", "Hindi", ["APS-DV", "APS-C-DV"]),
    ("walkman-chanakya", "Walkman-Chanakya", "Hindi", ["Walkman-Chanakya", "WM-Chanakya"]),
    ("shusha", "Shusha", "Marathi", ["Shusha", "Shushaa"]),
]
SCRIPT = "Devanagari"


def _longest_first(pairs: dict[str, str]) -> dict[str, str]:
    return dict(sorted(pairs.items(), key=lambda kv: -len(kv[0])))


#: Of each encoding, the parts of its table; a later part overrides an earlier one and keeps the earlier place.
PARTS: dict[str, list[dict[str, str]]] = {
    "shree-lipi": [shree_lipi.BASE, shree_lipi.LIGATURES],
    "kruti-dev": [kruti_dev.BASE, kruti_dev.LIGATURES],
    "dvb-tt": [
        _longest_first(dvb_tt.WORDS | dvb_tt.CONJUNCTS | dvb_tt.CONSONANTS | dvb_tt.MATRAS | dvb_tt.SPECIAL | dvb_tt.CONJUNCTS | dvb_tt.ADDITIONAL | dvb_tt.NUMBERS),
        dvb_tt.WORDS,
    ],
    "shree-dev": [shree_dev.BASE, shree_dev.LIGATURES, shree_dev.HALF_FORMS],
    "chanakya": [chanakya.BASE, chanakya.LIGATURES, chanakya.HALF_FORMS],
    "aps-dv": [aps_dv.BASE, aps_dv.LIGATURES, aps_dv.HALF_FORMS],
    "walkman-chanakya": [walkman_chanakya.BASE, walkman_chanakya.LIGATURES, walkman_chanakya.HALF_FORMS],
    "shusha": [shusha.BASE, shusha.LIGATURES, shusha.HALF_FORMS],
}


@lru_cache
def glyphs(encoding: str) -> dict[str, str]:
    """legacy to Unicode, longest keys first; equally long ones in the order of the table."""
    merged: dict[str, str] = {}
    for part in PARTS[encoding]:
        merged |= part
    return _longest_first(merged)


def map_rows() -> list[tuple[str, int, str, str]]:
    """(encoding, ord, legacy, unicode) of all tables: the glyph relation."""
    return [(e, i, k, v) for e in PARTS for i, (k, v) in enumerate(glyphs(e).items())]
