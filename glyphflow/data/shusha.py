"""Glyph codes of Shusha fonts and the characters they stand for."""

# The code points have to be these for conversions to come out right.
BASE = {
    'A': 'अ',
    'AA': 'आ',
    'B': 'इ',
    'C': 'उ',
    'D': 'ऊ',
    'F': 'ए',
    'G': 'ऋ',
    'É': 'क',
    'Ê': 'ख',
    'È': 'ग',
    'Ë': 'घ',
    'Ì': 'ङ',
    'Í': 'च',
    'Î': 'छ',
    'Ï': 'ज',
    'Ð': 'झ',
    'Ñ': 'ञ',
    'Ò': 'ट',
    'Ó': 'ठ',
    'Ô': 'ड',
    'Õ': 'ढ',
    'Ö': 'ण',
    'i': 'त',
    'Ø': 'थ',
    'Ù': 'द',
    'Ú': 'ध',
    'Û': 'न',
    'Ü': 'प',
    'Ý': 'फ',
    'Þ': 'ब',
    'ß': 'भ',
    'à': 'म',
    'á': 'य',
    '®': 'र',
    'ã': 'ल',
    'ä': 'व',
    'å': 'श',
    'æ': 'ष',
    'ç': 'स',
    'è': 'ह',
    'é': 'ळ',
    'ê': 'ा',
    'ë': 'ि',
    'ì': 'ी',
    'ú': 'ु',
    'û': 'ू',
    'î': 'ृ',
    'ï': 'े',
    'ð': 'ै',
    'ñ': 'ो',
    'ò': 'ौ',
    '½': '्',
    'þ': 'ं',
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
    'AA': 'आ',
    'BB': 'ई',
    'CC': 'ऊ',
    'FF': 'ऐ',
    'ø': 'क्ष',
    'ù': 'ज्ञ',
    'ó': 'त्र',
    'ô': 'श्र',
    'ÉÉ®ú': 'कार',
    'ÉÉ®úiÉ': 'कारतक',
    '½þè': '्ंह',
    'êï': 'ो',
    'êð': 'ौ',
    'É½': 'क्',
    'Ê½': 'ख्',
    'È½': 'ग्',
    'Ë½': 'घ्',
    'Í½': 'च्',
    'Ï½': 'ज्',
    'i½': 'त्',
    'Ù½': 'द्',
    'Û½': 'न्',
    'Ü½': 'प्',
    'Ý½': 'फ्',
    'Þ½': 'ब्',
    'à½': 'म्',
    'ã½': 'ल्',
    'å½': 'श्',
    'ç½': 'स्',
    'è½': 'ह्',
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
    '\x88': 'ट्',
    '\x89': 'ठ्',
    '\x8a': 'ण्',
    '\x8b': 'त्',
    '\x8c': 'थ्',
    '\x8d': 'द्',
    '\x8e': 'ध्',
    '\x8f': 'न्',
    '\x90': 'प्',
    '\x91': 'फ्',
    '\x92': 'ब्',
    '\x93': 'भ्',
    '\x94': 'म्',
    '\x95': 'य्',
    '\x96': 'ल्',
    '\x97': 'व्',
    '\x98': 'श्',
    '\x99': 'ष्',
    '\x9a': 'स्',
    '\x9b': 'ह्',
    '\x9c': 'ळ्',
}
