"""Pieces of DuckDB SQL for the oracles, generated from the same fixed tables but written on their own."""

from __future__ import annotations

from ..data.encodings import glyphs
from ..data.fonts import BY_PRIORITY, PROFILES, UNICODE_FONTS

DEVA = r"\x{900}-\x{97f}\x{a8e0}-\x{a8ff}\x{1cd0}-\x{1cff}"
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(items) -> str:
    return "[" + ", ".join(map(q, items)) + "]::VARCHAR[]"


def count_in(t: str, chars: str) -> str:
    return f"(length({t}) - length(regexp_replace({t}, '[{chars}]+', '', 'g')))"


def unicode_text(t: str) -> str:
    visible = f"length(translate({t}, ' ' || chr(10) || chr(9), ''))"
    return f"({visible} > 0 AND CAST({count_in(t, DEVA)} AS DOUBLE) / {visible} > 0.1::DOUBLE)"


def font_case(n: str) -> str:
    arms = [f"WHEN regexp_matches(lower({n}), {q('|'.join(UNICODE_FONTS))}) THEN 'unicode-devanagari'"]
    arms += [f"WHEN regexp_matches(lower({n}), {q('|'.join(p))}) THEN {q(e)}" for e, _, p, _ in BY_PRIORITY]
    return f"CASE WHEN coalesce({n}, '') = '' THEN NULL " + " ".join(arms) + " END"


def scores(t: str) -> str:
    rows = []
    for e, _, _, sigs in BY_PRIORITY:
        hits = " + ".join(f"CAST(contains({t}, {q(s)}) AS INT)" for s in sigs)
        rows.append(f"{{'b': {q(e)}, 's': CAST({hits} AS DOUBLE) / {len(sigs)}, 'f': []::VARCHAR[]}}")
    return "[{'b': NULL::VARCHAR, 's': 0.0::DOUBLE, 'f': []::VARCHAR[]}, " + ", ".join(rows) + "]"


def best(t: str) -> str:
    """struct(b, s, f): the running best and its fallbacks."""
    return f"""list_reduce({scores(t)}, lambda a, x: CASE
      WHEN x.s > a.s THEN {{'b': x.b, 's': x.s, 'f': CASE WHEN a.b IS NOT NULL THEN list_append(a.f, a.b) ELSE a.f END}}
      WHEN x.s > 0.3::DOUBLE THEN {{'b': a.b, 's': a.s, 'f': list_append(a.f, x.b)}} ELSE a END)"""


def frequency(t: str) -> str:
    """struct(s, turn, e): the best profile."""
    rows = [f"{{'s': CAST(len(list_intersect(list_distinct(string_split({t}, '')), {strings(p)})) AS DOUBLE) / {len(p)}, 'turn': {-i}, 'e': {q(e)}}}" for i, (e, p) in enumerate(PROFILES)]
    return f"list_max([{', '.join(rows)}])"


#: Verdicts of blocks (doc_id, page_number, block_idx, font_name, raw_text): adds enc, conf, method, fb.
def judged(blocks: str) -> str:
    high = count_in("raw_text", r"\x{80}-\x{ff}")
    beyond = count_in("raw_text", r"\x{80}-\x{10ffff}")
    return f"""
    SELECT * EXCLUDE (fc, uni, sig, freq, high),
      CASE WHEN fc IS NOT NULL THEN fc WHEN raw_text = '' THEN 'unknown' WHEN uni THEN 'unicode-devanagari' WHEN sig.s >= 0.3::DOUBLE THEN sig.b WHEN freq IS NOT NULL THEN freq.e WHEN high > 0.2::DOUBLE THEN 'unknown-legacy' ELSE 'unknown' END AS enc,
      CASE WHEN fc = 'unicode-devanagari' THEN 1.0::DOUBLE WHEN fc IS NOT NULL THEN 0.95::DOUBLE WHEN raw_text = '' THEN 0.0::DOUBLE WHEN uni THEN 1.0::DOUBLE
        WHEN sig.s >= 0.3::DOUBLE THEN least(0.90::DOUBLE, 0.60::DOUBLE + sig.s * 0.30::DOUBLE) WHEN freq IS NOT NULL THEN least(0.85::DOUBLE, 0.50::DOUBLE + freq.s * 0.35::DOUBLE) WHEN high > 0.2::DOUBLE THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS conf,
      CASE WHEN fc = 'unicode-devanagari' THEN 'unicode_detected' WHEN fc IS NOT NULL THEN 'font_match' WHEN raw_text = '' THEN 'heuristic' WHEN uni THEN 'unicode_detected' ELSE 'heuristic' END AS method,
      CASE WHEN fc IS NOT NULL OR raw_text = '' OR uni THEN []::VARCHAR[] WHEN sig.s >= 0.3::DOUBLE THEN sig.f[1:3] WHEN freq IS NOT NULL THEN []::VARCHAR[] WHEN high > 0.2::DOUBLE THEN ['shree-dev', 'shree-lipi', 'kruti-dev'] ELSE []::VARCHAR[] END AS fb
    FROM (SELECT *, {font_case("font_name")} AS fc, {unicode_text("raw_text")} AS uni, {best("raw_text")} AS sig,
      CASE WHEN length(raw_text) >= 20 AND {beyond} >= 3 AND ({frequency("raw_text")}).s > 0.2::DOUBLE THEN {frequency("raw_text")} END AS freq,
      CAST({high} AS DOUBLE) / nullif(length(raw_text), 0) AS high FROM ({blocks}))"""


def sequences(t: str, encoding: str) -> str:
    for k, v in glyphs(encoding).items():
        if len(k) > 1:
            t = f"replace({t}, {q(k)}, {q(v)})"
    return t


def single(t: str, encoding: str, unknown: str | None = None) -> str:
    one = {k: v for k, v in glyphs(encoding).items() if len(k) == 1}
    mapped = f"({strings(one.values())})[list_position({strings(one)}, c)]"
    other = "c" if unknown is None else f"CASE WHEN regexp_matches(c, '[\\x20-\\x7e\\t\\n\\r{DEVA}]') THEN c ELSE {q(unknown)} END"
    return f"array_to_string(list_transform(string_split({t}, ''), lambda c: coalesce({mapped}, {other})), '')"


def unmapped(t: str, encoding: str) -> str:
    one = [k for k in glyphs(encoding) if len(k) == 1]
    return f"array_to_string(list_sort(list_filter(list_distinct(string_split({t}, '')), lambda c: c <> '' AND NOT regexp_matches(c, '[\\x20-\\x7e\\t\\n\\r{DEVA}]') AND NOT list_contains({strings(one)}, c))), '')"


def _pairs(t: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        t = f"replace({t}, {q(a)}, {q(b)})"
    return t


def common(t: str) -> str:
    t = _pairs(t, [("\u093e\u0947", "\u094b"), ("\u093e\u0948", "\u094c"), ("\u0947\u093e", "\u094b"), ("\u0948\u093e", "\u094c")])
    t = rf"regexp_replace({t}, '([\x{{915}}-\x{{939}}\x{{958}}-\x{{95f}}])([\x{{93e}}-\x{{94c}}\x{{962}}\x{{963}}])(\x{{93c}})', '\1\3\2', 'g')"
    t = rf"regexp_replace({t}, '([\x{{901}}-\x{{903}}])([\x{{93e}}-\x{{94c}}]+)', '\2\1', 'g')"
    return rf"regexp_replace({t}, '[{WS}]+([\x{{94d}}\x{{93e}}-\x{{94c}}\x{{901}}\x{{902}}])', '\1', 'g')"


def shree_dev(t: str) -> str:
    c = r"[\x{915}-\x{931}\x{932}\x{933}\x{935}-\x{939}\x{958}-\x{95f}]"
    m = r"\x{93e}-\x{943}\x{947}\x{948}\x{94b}\x{94c}"
    t = rf"regexp_replace({t}, '([pq])({c})', '\2\1', 'g')"
    t = rf"regexp_replace({t}, '([pq])((?:\x{{94d}}{c})+)', '\2\1', 'g')"
    t = f"replace(replace({t}, 'p', chr(2367)), 'q', chr(2367) || chr(2306))"
    t = rf"regexp_replace({t}, '({c})([{m}\x{{901}}\x{{902}}]*)\x{{a9}}', chr(169) || '\1\2', 'g')"
    t = rf"regexp_replace({t}, '((?:{c}\x{{94d}})+)\x{{a9}}', chr(169) || '\1', 'g')"
    t = f"replace({t}, chr(169), chr(2352) || chr(2381))"
    t = f"replace({t}, 'प्लेसहोल्डर_इ', 'प')"
    for a, b, to in ((0x93E, 0x947, 0x94B), (0x93E, 0x948, 0x94C), (0x945, 0x902, 0x901), (0x902, 0x945, 0x901), (0x93E, 0x945, 0x949), (0x945, 0x93E, 0x949), (0x93E, 0x94B, 0x94B), (0x948, 0x93E, 0x94C), (0x947, 0x93E, 0x94B)):
        t = f"replace({t}, chr({a}) || chr({b}), chr({to}))"
    t = rf"regexp_replace({t}, '([\x{{901}}-\x{{903}}\x{{970}}]+)([{m}]+)', '\2\1', 'g')"
    return rf"regexp_replace({t}, '[{WS}]+([\x{{93d}}\x{{94d}}\x{{93e}}\x{{940}}-\x{{943}}\x{{947}}\x{{948}}\x{{94b}}\x{{94c}}\x{{901}}\x{{902}}])', '\1', 'g')"


def converted(source: str, encoding: str, unknown: str | None = None) -> str:
    """SELECT doc_id, converted, unmapped of a relation (doc_id, t)."""
    fix = shree_dev if encoding == "shree-dev" else common
    return f"""SELECT doc_id, nfc_normalize({fix("one")}) AS converted, missed AS unmapped FROM (
      SELECT doc_id, {single("many", encoding, unknown)} AS one, {unmapped("many", encoding)} AS missed FROM (SELECT doc_id, {sequences("t", encoding)} AS many FROM ({source})))"""


def folded(items: str, step_fits: str, joined: str) -> str:
    """Greedy packing of a list of strings: what fits is joined to the last piece, else begins a new one."""
    start = "[{'c': []::VARCHAR[], 'u': '', 'n': 0}]"
    rest = f"list_transform({items}, lambda s: {{'c': []::VARCHAR[], 'u': s, 'n': 0}})"
    put = "CASE WHEN a.u <> '' THEN list_append(a.c, a.u) ELSE a.c END"
    return f"list_reduce({start} || {rest}, lambda a, x: CASE WHEN {step_fits} THEN {joined} ELSE {{'c': {put}, 'u': x.u, 'n': length(x.u)}} END)"


def folded_list(items: str, step_fits: str, joined: str) -> str:
    f = folded(items, step_fits, joined)
    return f"(SELECT CASE WHEN f.u <> '' THEN list_append(f.c, f.u) ELSE f.c END FROM (SELECT {f} AS f))"
