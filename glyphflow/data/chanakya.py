"""Glyph codes of Chanakya fonts and the characters they stand for."""

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
    'D': 'क्',
    'R': 'ख्',
    'T': 'ग्',
    'W': 'घ्',
    'P': 'च्',
    'X': 'ज्',
    'Y': 'झ्',
    'K': 'ट्',
    'L': 'ठ्',
    'J': 'ण्',
    'E': 'त्',
    'F': 'थ्',
    'H': 'द्',
    'I': 'ध्',
    'C': 'न्',
    'O': 'प्',
    'U': 'फ्',
    'Z': 'ब्',
    'Â': 'भ्',
    'Ä': 'म्',
    'Æ': 'य्',
    'È': 'ल्',
    'Ê': 'व्',
    'Ì': 'श्',
    'Î': 'ष्',
    'Ð': 'स्',
    'Ò': 'ह्',
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
    'Å': 'ऊ',
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
    'Ô': 'क्ष',
    'Ö': 'ज्ञ',
    'Ø': 'श्र',
    'Ú': 'त्र',
    'Hkkjr': 'भारत',
    "ns'k": 'देश',
    'gS': 'है',
    'fd': 'कि',
    'dh': 'की',
    'esa': 'में',
    'ls': 'से',
    'dk': 'का',
    'ds': 'के',
    'dks': 'को',
}

HALF_FORMS = {
    'D': 'क्',
    'R': 'ख्',
    'T': 'ग्',
    'W': 'घ्',
    'P': 'च्',
    'X': 'ज्',
    'Y': 'झ्',
    'K': 'ट्',
    'L': 'ठ्',
    'J': 'ण्',
    'E': 'त्',
    'F': 'थ्',
    'H': 'द्',
    'I': 'ध्',
    'C': 'न्',
    'O': 'प्',
    'U': 'फ्',
    'Z': 'ब्',
    'Â': 'भ्',
    'Ä': 'म्',
    'Æ': 'य्',
    'È': 'ल्',
    'Ê': 'व्',
    'Ì': 'श्',
    'Î': 'ष्',
    'Ð': 'स्',
    'Ò': 'ह्',
}
