"""Glyph codes of SHREE-DEV fonts and the characters they stand for."""

# The code points have to be these for conversions to come out right.
BASE = {
    '>': '',
    '$': '',
    '›': 'ॐ',
    '@': 'ऽ',
    '&': '।',
    'H': 'क',
    'I': 'ख',
    'J': 'ग',
    'K': 'घ',
    'L': 'ङ',
    'M': 'च',
    'N': 'छ',
    'O': 'ज',
    'P': 'झ',
    'Q': 'ट',
    'R': 'ठ',
    'S': 'ड',
    'T': 'ढ',
    'U': 'ण',
    'V': 'त',
    'W': 'थ',
    'X': 'द',
    'Y': 'ध',
    'Z': 'न',
    'n': 'प',
    '\\': 'फ',
    '~': 'ब',
    '^': 'भ',
    '_': 'म',
    '`': 'य',
    'a': 'र',
    'b': 'ल',
    'c': 'ल',
    'd': 'व',
    'e': 'श',
    'f': 'ष',
    'g': 'स',
    'h': 'ह',
    'i': 'ळ',
    'A': 'अ',
    'B': 'इ',
    'C': 'उ',
    'D': 'ऊ',
    'E': 'ए',
    'F': 'ऋ',
    'G': 'ॠ',
    'm': 'ा',
    'r': 'ी',
    's': 'ी',
    't': 'ीं',
    'w': 'ु',
    'x': 'ु',
    'y': 'ू',
    'z': 'ू',
    'o': 'े',
    '|': 'ें',
    '¡': 'ै',
    '¢': 'ैं',
    '¥': 'ृ',
    '¦': 'ॄ',
    '°': 'ॅ',
    'þ': 'ु',
    'ÿ': 'ू',
    '§': 'ं',
    '¨': 'ं',
    '±': 'ँ',
    '²': '्',
    '…': 'ः',
    'µ': '़',
    'Š': 'क्',
    '»': 'ख्',
    '½': 'ग्',
    '¿': 'घ्',
    'À': 'च्',
    'Á': 'ज्',
    'Â': 'झ्',
    'Ä': 'ञ्',
    'Ê': 'ण्',
    'Ë': 'त्',
    'Ï': 'थ्',
    'Ü': 'ध्',
    'Ý': 'न्',
    'ß': 'प्',
    'â': 'फ्',
    'ã': 'ब्',
    'ä': 'भ्',
    'å': 'म्',
    'æ': 'य्',
    'ë': 'ल्',
    'ì': 'व्',
    'í': 'श्',
    'î': 'ष्',
    'ñ': 'स्',
    'ô': 'ह्',
    'ù': 'ळ्',
    'û': 'श्',
    'ú': 'क्ष्',
    'j': 'क्ष',
    'k': 'ज्ञ',
    'l': 'श्र',
    'Ì': 'त्र',
    'Í': 'त्र्',
    'Î': 'त्त्',
    '®': '्रु',
    '¯': '्रू',
    'é': 'रु',
    'ê': 'रू',
    '#': 'ञ्च्',
    '‚': 'ज्ज्',
    'ƒ': 'च्च',
    '„': 'ल्ल',
    '†': 'ह्ण',
    '‡': 'ह्ल',
    'ˆ': 'ह्व',
    '‰': '्व',
    "'": "'",
    '¬': 'ङ्क्ष',
    '•': 'ह्न',
    '–': 'ड्ढ',
    'œ': 'श्व',
    '³': '्न',
    '¶': 'ङ्म',
    '¸': 'क्क',
    '¹': 'क्व',
    'º': 'क्त',
    '¼': 'ख्र',
    'Ã': 'झ्र',
    '¾': 'ग्न',
    'Å': 'ट्ट',
    'Æ': 'ट्ठ',
    'Ç': 'ठ्ठ',
    'È': 'ड्ड',
    'É': 'ड्ढ',
    'Ð': 'द्र',
    'Ñ': 'दृ',
    'Ò': 'द्ग',
    'Ó': 'द्घ',
    'Ô': 'द्द',
    'Õ': 'द्ध',
    'Ö': 'द्न',
    '×': 'द्ब',
    'Ø': 'द्भ',
    'Ù': 'द्म',
    'Ú': 'द्य',
    'Û': 'द्व',
    'Þ': 'न्न',
    'à': 'प्र',
    'á': 'प्त',
    'ï': 'ष्ट',
    'ð': 'ष्ठ',
    'ò': 'स्र',
    'ó': 'स्त्र',
    'õ': 'ह्र',
    'ö': 'हृ',
    '÷': 'ह्म',
    'ø': 'ह्य',
    'ü': 'श्च',
    'ý': 'श्न',
    'ç': '्य',
    'Œ': '्र',
    '´': '्र',
    '«': '्र',
    'µH': 'क़',
    '™': 'ख़्',
    '˜': 'ख़',
    'µJ': 'ग़',
    'µO': 'ज़',
    'µÁ': 'ज़्',
    'µS': 'ड़',
    'µT': 'ढ़',
    'µ\\': 'फ़',
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
    '%': '%',
    '+': '+',
    '=': '=',
    '<': '<',
    '"': "'",
    '[': 'p',
    '{': 'p',
}

LIGATURES = {
    'Am¡': 'औ',
    'Amo': 'ओ',
    'Am°': 'ऑ',
    'Am': 'आ',
    'B©': 'ई',
    'Eo': 'ऐ',
    'm¡': 'ौ',
    'mo': 'ो',
    'm°': 'ॉ',
    'm|': 'ों',
    'm¢': 'ौं',
    'ª': 'र्',
    '©': 'र्',
    'Q´': 'ट्र',
    'Q\xad': 'ट्र',
    'º$': 'क्त',
    'Îm': 'त्ता',
    'µO': 'ज़',
    'µÁ': 'ज़्',
    '¶S': 'ड़',
    '¶T': 'ढ़',
    'µH': 'क़',
    'µJ': 'ग़',
    'µ\\': 'फ़',
    '²m': '',
    '²o': 'े',
    '²¡': 'ै',
}

HALF_FORMS = {
    'Š': 'क्',
    '»': 'ख्',
    '½': 'ग्',
    '¿': 'घ्',
    'À': 'च्',
    'Á': 'ज्',
    'Â': 'झ्',
    'Ä': 'ञ्',
    'Ê': 'ण्',
    'Ë': 'त्',
    'Ï': 'थ्',
    'Ü': 'ध्',
    'Ý': 'न्',
    'ß': 'प्',
    'â': 'फ्',
    'ã': 'ब्',
    'ä': 'भ्',
    'å': 'म्',
    'æ': 'य्',
    'ë': 'ल्',
    'ì': 'व्',
    'í': 'श्',
    'î': 'ष्',
    'ñ': 'स्',
    'ô': 'ह्',
    'ù': 'ळ्',
    'û': 'श्',
    'ú': 'क्ष्',
}
