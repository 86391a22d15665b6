"""Glyph codes of Walkman-Chanakya fonts and the characters they stand for."""

# The code points have to be these for conversions to come out right.
BASE = {
    'v': 'अ',
    'b': 'इ',
    'm': 'उ',
    ',': 'ए',
    'd': 'क',
    'x': 'ग',
    'p': 'च',
    'N': 'छ',
    't': 'ज',
    '>': 'झ',
    'V': 'ट',
    'B': 'ठ',
    'M': 'ड',
    '<': 'ढ',
    'r': 'त',
    'n': 'द',
    'u': 'न',
    'i': 'प',
    'Q': 'फ',
    'c': 'ब',
    'e': 'म',
    ';': 'य',
    'j': 'र',
    'y': 'ल',
    'o': 'व',
    'l': 'स',
    'g': 'ह',
    'G': 'ळ',
    'k': 'ा',
    'f': 'ि',
    'h': 'ी',
    'q': 'ु',
    'w': 'ू',
    '`': 'ृ',
    's': 'े',
    'S': 'ै',
    '~': '्',
    'a': 'ं',
    '¡': 'ँ',
    '%': 'ः',
    'A': '।',
    'Þ': '॥',
    'À': 'क्',
    'Á': 'ख्',
    'Â': 'ग्',
    'Ã': 'घ्',
    'Ä': 'च्',
    'Å': 'ज्',
    'Æ': 'झ्',
    'Ç': 'ट्',
    'È': 'ठ्',
    'É': 'ण्',
    'Ê': 'त्',
    'Ë': 'थ्',
    'Ì': 'द्',
    'Í': 'ध्',
    'Î': 'न्',
    'Ï': 'प्',
    'Ð': 'फ्',
    'Ñ': 'ब्',
    'Ò': 'भ्',
    'Ó': 'म्',
    'Ô': 'य्',
    'Õ': 'ल्',
    'Ö': 'व्',
    '×': 'श्',
    'Ø': 'ष्',
    'Ù': 'स्',
    'Ú': 'ह्',
    'Û': 'ळ्',
    '0': '०',
    '1': '१',
    '2': '२',
    '3': '३',
    '4': '४',
    '5': '५',
    '6': '६',
    '7': '७',
    '8': '८',
    '9': '९',
    '.': '.',
    '!': '!',
    '?': '?',
    ':': ':',
    '-': '-',
    '(': '(',
    ')': ')',
    '/': '/',
    '+': '+',
    '=': '=',
}

LIGATURES = {
    'vk': 'आ',
    'bZ': 'ई',
    'Ü': 'ऊ',
    ',s': 'ऐ',
    'vks': 'ओ',
    'vkS': 'औ',
    'ks': 'ो',
    'kS': 'ौ',
    '[k': 'ख',
    '?k': 'घ',
    '.k': 'ण',
    'Fk': 'थ',
    '/k': 'ध',
    'Hk': 'भ',
    "'k": 'श',
    '"k': 'ष',
    'Ý': 'क्ष',
    'ß': 'ज्ञ',
    'à': 'श्र',
    'á': 'त्र',
    'â': 'द्र',
    'ã': 'प्र',
    'ä': '्र',
    'Ökfr': 'वाति',
    "çns'k": 'प्रदेश',
}

HALF_FORMS = {
    'À': 'क्',
    'Á': 'ख्',
    'Â': 'ग्',
    'Ã': 'घ्',
    'Ä': 'च्',
    'Å': 'ज्',
    'Æ': 'झ्',
    'Ç': 'ट्',
    'È': 'ठ्',
    'É': 'ण्',
    'Ê': 'त्',
    'Ë': 'थ्',
    'Ì': 'द्',
    'Í': 'ध्',
    'Î': 'न्',
    'Ï': 'प्',
    'Ð': 'फ्',
    'Ñ': 'ब्',
    'Ò': 'भ्',
    'Ó': 'म्',
    'Ô': 'य्',
    'Õ': 'ल्',
    'Ö': 'व्',
    '×': 'श्',
    'Ø': 'ष्',
    'Ù': 'स्',
    'Ú': 'ह्',
    'Û': 'ळ्',
}
