"""Glyph codes of Shree-Lipi fonts and the characters they stand for."""

# The code points have to be these for conversions to come out right.
BASE = {
    '†': 'अ',
    '‡': 'आ',
    'ˆ': 'इ',
    '‰': 'ई',
    'Š': 'उ',
    '‹': 'ऊ',
    'Œ': 'ऋ',
    '': 'औ',
    'Ž': 'ऐ',
    "'": 'अः',
    '¹': 'क',
    'º': 'ख',
    '»': 'ग',
    '¼': 'घ',
    '½': 'ङ',
    '¾': 'च',
    '¿': 'छ',
    'À': 'ज',
    'Á': 'झ',
    'Â': 'ञ',
    'Ã': 'ट',
    'Ä': 'ठ',
    'Å': 'ड',
    'Æ': 'ढ',
    'Ç': 'ण',
    'È': 'त',
    'É': 'थ',
    'Ê': 'द',
    'Ë': 'ध',
    'Ì': 'न',
    'Í': 'प',
    'Î': 'फ',
    'Ï': 'ब',
    'Ð': 'भ',
    'Ñ': '्',
    'Ò': 'य',
    'Ó': 'र',
    'Ô': 'ल',
    'Õ': 'व',
    'Ö': 'ा',
    '×': 'ि',
    'Ø': 'ी',
    'Ù': 'ु',
    'Ú': 'ू',
    'Û': 'ृ',
    'Ü': 'े',
    'Ý': 'ै',
    'Þ': 'ो',
    'ß': 'ौ',
    'Ö¸ü': 'ार',
    'Ö®Ö': 'ान',
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
    'ü': '्',
    'Ÿ': 'ं',
    ' ': 'ः',
    '।': '।',
    '॥': '॥',
}

LIGATURES = {
    'Œ': 'क्ष',
    '¡': 'त्र',
    '–': 'ज्ञ',
    '´Ö': 'मा',
    'Æü': 'ढ',
    'Ö¸ü': 'ार',
    '®Ö': 'न',
    'ÖμÖ': 'ाय',
    'ÖÂ': 'ाष',
    '™Òü': 'ट्र',
    '†×': 'अ',
    '×®Ö': 'नि',
    '´ÖÆüÖ¸üÖÂ™Òü': 'महाराष्ट्र',
}
