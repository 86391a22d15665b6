"""Glyph codes of Kruti Dev fonts and the characters they stand for."""

# The code points have to be these for conversions to come out right.
BASE = {
    'v': 'अ',
    'vk': 'आ',
    'b': 'इ',
    'bZ': 'ई',
    'm': 'उ',
    'Å': 'ऊ',
    ',': 'ए',
    ',s': 'ऐ',
    'vks': 'ओ',
    'vkS': 'औ',
    'd': 'क',
    '[k': 'ख',
    'x': 'ग',
    '?k': 'घ',
    '³': 'ङ',
    'p': 'च',
    'N': 'छ',
    't': 'ज',
    '>': 'झ',
    '¥': 'ञ',
    'V': 'ट',
    'B': 'ठ',
    'M': 'ड',
    '<': 'ढ',
    '.k': 'ण',
    'r': 'त',
    'Fk': 'थ',
    'n': 'द',
    '/k': 'ध',
    'u': 'न',
    'i': 'प',
    'Q': 'फ',
    'c': 'ब',
    'Hk': 'भ',
    'e': 'म',
    ';': 'य',
    'j': 'र',
    'y': 'ल',
    'o': 'व',
    "'k": 'श',
    '"k': 'ष',
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
    'ks': 'ो',
    'kS': 'ौ',
    '~': '्',
    'a': 'ं',
    '¡': 'ँ',
    '%': 'ः',
    'A': '।',
    'Þ': '॥',
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
}

LIGATURES = {
    'Hkkjr': 'भारत',
    "ns'k": 'देश',
    'd`fr': 'कृति',
    'gS': 'है',
    'fd': 'कि',
    'dh': 'की',
    'esa': 'में',
    'ls': 'से',
    'dk': 'का',
    'ds': 'के',
    'dks': 'को',
}
