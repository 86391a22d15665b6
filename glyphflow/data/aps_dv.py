"""Glyph codes of APS-DV fonts and the characters they stand for."""

# The code points have to be these for conversions to come out right.
BASE = {
    '¼': 'अ',
    '½': 'आ',
    '¾': 'इ',
    '¿': 'ई',
    'À': 'उ',
    'Á': 'ऊ',
    'Â': 'ऋ',
    'Ã': 'ए',
    'Ä': 'ऐ',
    'Å': 'ओ',
    'Æ': 'औ',
    'Ç': 'क',
    'È': 'ख',
    'É': 'ग',
    'Ê': 'घ',
    'Ë': 'ङ',
    'Ì': 'च',
    'Í': 'छ',
    'Î': 'ज',
    'Ï': 'झ',
    'Ð': 'ञ',
    'Ñ': 'ट',
    'Ò': 'ठ',
    'Ó': 'ड',
    'Ô': 'ढ',
    'Õ': 'ण',
    'Ö': 'त',
    '×': 'थ',
    'Ø': 'द',
    'Ù': 'ध',
    'Ú': 'न',
    'Û': 'प',
    'Ü': 'फ',
    'Ý': 'ब',
    'Þ': 'भ',
    'ß': 'म',
    'à': 'य',
    'á': 'र',
    'â': 'ल',
    'ã': 'व',
    'ä': 'श',
    'å': 'ष',
    'æ': 'स',
    'ç': 'ह',
    'è': 'ळ',
    'é': 'ा',
    'ê': 'ि',
    'ë': 'ी',
    'ì': 'ु',
    'í': 'ू',
    'î': 'ृ',
    'ï': 'े',
    'ð': 'ै',
    'ñ': 'ो',
    'ò': 'ौ',
    'ó': '्',
    'ô': 'ं',
    'õ': 'ँ',
    'ö': 'ः',
    '÷': '़',
    '¤': '।',
    '¥': '॥',
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
    ',': ',',
    '!': '!',
    '?': '?',
    ':': ':',
    ';': ';',
    '-': '-',
    '(': '(',
    ')': ')',
    '/': '/',
    '+': '+',
    '=': '=',
}

LIGATURES = {
    'ø': 'क्ष',
    'ù': 'ज्ञ',
    'ú': 'त्र',
    'û': 'श्र',
    'Çó': 'क्',
    'Èó': 'ख्',
    'Éó': 'ग्',
    'Êó': 'घ्',
    'Ìó': 'च्',
    'Îó': 'ज्',
    'Öó': 'त्',
    'Øó': 'द्',
    'Úó': 'न्',
    'Ûó': 'प्',
    'Ýó': 'ब्',
    'ßó': 'म्',
    'âó': 'ल्',
    'äó': 'श्',
    'æó': 'स्',
    'çó': 'ह्',
    'éï': 'ो',
    'éð': 'ौ',
}

HALF_FORMS = {
    '\x80': 'क्',
    '\x81': 'ख्',
    '\x82': 'ग्',
    '\x83': 'घ्',
    '\x84': 'च्',
    '\x85': 'ज्',
    '\x86': 'झ्',
    '\x87': 'ञ्',
    '\x88': 'ण्',
    '\x89': 'त्',
    '\x8a': 'थ्',
    '\x8b': 'द्',
    '\x8c': 'ध्',
    '\x8d': 'न्',
    '\x8e': 'प्',
    '\x8f': 'फ्',
    '\x90': 'ब्',
    '\x91': 'भ्',
    '\x92': 'म्',
    '\x93': 'य्',
    '\x94': 'ल्',
    '\x95': 'व्',
    '\x96': 'श्',
    '\x97': 'ष्',
    '\x98': 'स्',
    '\x99': 'ह्',
    '\x9a': 'ळ्',
}
