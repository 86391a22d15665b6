"""Font-name patterns, text signatures and character profiles of the detectable encodings."""

# Names, order and code points decide what is detected.
UNICODE_FONTS = [
    r"sakal[-_\s]*marathi",
    r"mangal",
    r"nirmala[-_\s]*ui",
    r"aparajita",
    r"kokila",
    r"utsaah",
    r"shruti",
    r"lohit[-_\s]*devanagari",
    r"noto[-_\s]*sans[-_\s]*devanagari",
    r"adobe[-_\s]*devanagari",
    r"tiro[-_\s]*devanagari",
    r"poppins[-_\s]*devanagari",
]

# Fixed values: (encoding, priority, font-name patterns, signatures), in definition order.
LEGACY = [
    ("shree-dev", 10, [r"shree[-_\s]*dev[-_\s]*07\d{2}", r"shree[-_\s]*dev[-_\s]*\d+", r"shree[-_\s]*dev"], ["CP", "BP", "KP", "PR", "ÀP", "ÁP", "ÌP", "mP", "rP", "Am"]),
    ("shree-lipi", 9, [r"shree[-_\s]*lipi", r"sdl[-_\s]*dev"], ["´Ö", "Æü", "Ö¸ü", "®Ö", "ÖμÖ", "ÖÂ", "™Òü", "×", "†"]),
    ("kruti-dev", 9, [r"kruti[-_\s]*dev", r"krutidev", r"kruti[-_\s]*\d+"], ["d`fr", "Hkkjr", "ns'k", "gS", "fd", "dh", "esa", "ls"]),
    ("aps-dv", 8, [r"aps[-_\s]*dv", r"aps[-_\s]*c[-_\s]*dv"], ["¼ã", "ãä", "äã", "Úæ"]),
    ("chanakya", 7, [r"chanakya", r"chankya"], ["Ñfr", "Ákns'k", "Hkkjr"]),
    ("walkman-chanakya", 8, [r"walkman[-_\s]*chanakya", r"wm[-_\s]*chanakya"], ["Ökfr", "çns'k"]),
    (
        "dvb-tt",
        10,
        [r"dvb[-_\s]*tt", r"dv[-_\s]*tt[-_\s]*yogesh", r"dvbw[-_\s]*tt", r"dvbwtt[-_\s]*surekh", r"dvbtt[-_\s]*surekh", r"surekh[-_\s]*(normal|bold)"],
        ["´Ö", "¿Ö", "Ã", "®", "×¾Ö", "×¬Ö", "¸ü", "Æü", "ÖÓ", "†×"],
    ),
    ("shusha", 6, [r"shusha", r"shushaa"], ["ÉÉ®úiÉ", "½þè"]),
    ("agra", 5, [r"agra[-_\s]*\d*"], ["¼ã", "ãä", "Úæ", "½ã", "¾ä"]),
    ("akruti", 5, [r"akruti", r"aku[-_\s]*dev"], ["°è", "±é", "²ê", "³ë", "´ì"]),
]

# Characters typical of an encoding, in the order they are tried.
PROFILES = [
    ("shree-dev", "§¨²¡¢¥¦°þÿŠŒŸ»½¿"),
    ("kruti-dev", "Å¥Þ¡"),
    ("dvb-tt", "´Ö¿Ã®×¬¸üÆ†‡‰‹"),
    ("chanakya", "ÑÁÂÄÆÈÊÌÎÐÒÔÖØÚ"),
    ("shusha", "ÉÊÈËÍÏÐÒÔÖ®½þêë"),
]

#: The order in which encodings are tried: by priority, then as defined.
BY_PRIORITY = sorted(LEGACY, key=lambda x: -x[1])
