"""Glyph codes of DVB-TT fonts and the characters they stand for."""

# The code points have to be these for conversions to come out right.
CONSONANTS = {
    '†': 'अ',
    '‡': 'इ',
    'ˆ': 'उ',
    '‰': 'ऊ',
    'Û': 'क',
    'Ü': 'ख',
    '‹': 'ख',
    'Ý': 'ग',
    'à': 'घ',
    'ã': 'ङ',
    '¾': 'व',
    'á': 'छ',
    '•': 'ज',
    '—': 'झ',
    '¥': 'ञ',
    '™': 'ट',
    'š': 'ठ',
    '›': 'ड',
    'œ': 'ढ',
    'Þ': 'ण',
    'ŸÖ': 'त',
    'Ÿ': 'त',
    'ÉÖ': 'थ',
    'É': 'थ',
    '¤': 'द',
    '¬': 'ध',
    '®': 'न',
    '¯': 'प',
    '±': 'फ',
    '²': 'ब',
    '³': 'भ',
    '´': 'म',
    'μ': 'य',
    '¸': 'र',
    '»': 'ल',
    '¹': 'ळ',
    '¿': 'श',
    'Â': 'ष',
    'Ã': 'स',
    'Æ': 'ह',
    'Ê': 'क्ष',
}

MATRAS = {
    'üÖ': 'ा',
    'ÖÖ': 'ा',
    'Öã': 'ु',
    'Ö‡Ô': 'ई',
    'Ö‡': 'इ',
    'Ö': '',
    '×': 'ि',
    'Ø': 'ी',
    'ß': 'ी',
    'Ù': 'ु',
    'ò': 'ू',
    'é': 'ृ',
    'ê': 'े',
    'ì': 'ै',
    'ë': 'ॅ',
    'üÖê': 'ो',
    'üÖì': 'ौ',
}

SPECIAL = {
    'ü': '्',
    'Ó': 'ं',
    'Ô': 'ः',
    'Õ': 'ँ',
    'ú': '',
    'û': '',
    '§': '॥',
    '¦': '।',
    '·': '॰',
}

CONJUNCTS = {
    'Ò': '्र',
    'Î': '्र',
    'Ï': '्र',
    'ÛÎ': 'क्र',
    'ÛÎú': 'क्र',
    '¦ü': 'द्र',
    'Ã£': 'स्थ',
    'ÐÖ': 'द्ध',
    'Ð': 'द्',
    '©': 'द्व',
    'ª': 'द्य',
    '«': 'ट्ट',
    "'": 'श्र',
    '“ÖÔ': 'र्च',
    '“': 'च',
    '–': 'ह्य',
    'æ': 'त्त',
    'î': 'द्द',
}

NUMBERS = {
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

ADDITIONAL = {
    '¡': 'ड़',
    '£': 'ण',
    '¨': 'ऑ',
    'º': 'ळ',
    'ó': 'ू',
    'ô': 'ृ',
    'õ': 'े',
    'ý': 'य',
    'þ': 'र',
    'Œ': '',
    'œ': '',
}

WORDS = {
    '´ÖÆüÖ¸üÖÂ™Òü': 'महाराष्ट्र',
    '¿ÖÖÃÖ®Ö': 'शासन',
    '×¾Ö³ÖÖÝÖ': 'विभाग',
    '×®ÖμÖ´Ö': 'नियम',
    '†×¬Ö×®ÖμÖ´Ö': 'अधिनियम',
    'Ûú»Ö´Ö': 'कलम',
    '†®Öãêû¤ü': 'अनुच्छेद',
    '¯ÖÏ×ŸÖ': 'प्रति',
    '¯Öã¹ýÂÖ': 'पुरुष',
    '´Ö×Æü»ÖÖ': 'महिला',
    'ÃÖ´ÖÖ®Ö': 'समान',
    '†×¬ÖÛúÖ¸ü': 'अधिकार',
    'ÃÖ¸üÛúÖ¸ü': 'सरकार',
    '¸üÖ•μÖ': 'राज्य',
    '³ÖÖÂÖÖ': 'भाषा',
    '¸üÖ•Ö³ÖÖÂÖÖ': 'राजभाषा',
    '´Ö¸üÖšüß': 'मराठी',
    '¤êü¾Ö®ÖÖÝÖ¸üß': 'देवनागरी',
    'ÃÖÓ×¾Ö¬ÖÖ®Ö': 'संविधान',
    '×¾Ö¬ÖÖ®Ö´ÖÓ›üôû': 'विधानमंडळ',
    '×¾Ö¬ÖêμÖÛú': 'विधेयक',
    '×¾Ö×¬Ö': 'विधि',
    '®μÖÖμÖ': 'न्याय',
    '¯ÖÏÖ¸Óü³Ö': 'प्रारंभ',
    'ˆ¯Ö²ÖÓ¬Ö': 'उपबंध',
    'ŸÖ¸üŸÖæ¤ü': 'तरतूद',
    '†Ó´Ö»Ö²Ö•ÖÖ¾ÖÞÖß': 'अंमलबजावणी',
    'ÃÖ×´ÖŸÖß': 'समिती',
    'ÛúÖμÖÖÔ»ÖμÖ': 'कार्यालय',
    '×¤ü®ÖÖÓÛú': 'दिनांक',
    'ÛÎú´ÖÖÓÛú': 'क्रमांक',
    '¯ÖéÂšü': 'पृष्ठ',
}
