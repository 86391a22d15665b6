"""Language codes of encodings, translation services and text recognisers, and the option lists of the service."""

# Codes that other programs expect.
NAMES = {"mr": "Marathi", "hi": "Hindi", "en": "English", "ta": "Tamil", "te": "Telugu", "kn": "Kannada", "ml": "Malayalam", "gu": "Gujarati", "bn": "Bengali", "pa": "Punjabi", "san": "Sanskrit", "auto": "Auto-detect"}
GOOGLE = {"marathi": "mr", "hindi": "hi", "english": "en", "auto": "auto"}
MYMEMORY = {"mr": "mr-IN", "hi": "hi-IN", "en": "en-GB", "ta": "ta-IN", "te": "te-IN", "kn": "kn-IN", "ml": "ml-IN", "gu": "gu-IN", "bn": "bn-IN", "pa": "pa-IN"}
TESSERACT = {"mr": "mar", "hi": "hin", "ta": "tam", "te": "tel", "kn": "kan", "ml": "mal", "bn": "ben", "gu": "guj", "pa": "pan", "san": "san"}

# Source language of an encoding, in order of definition.
OF_ENCODING = {
    "shree-dev": "mr",
    "shree-dev-0714": "mr",
    "shree-dev-0708": "mr",
    "shree-lipi": "mr",
    "dvb-tt": "mr",
    "shusha": "mr",
    "kruti-dev": "hi",
    "chanakya": "hi",
    "aps-dv": "hi",
    "walkman-chanakya": "hi",
    "agra": "hi",
    "akruti": "hi",
    "unicode-devanagari": "hi",
    "unicode-ocr": "hi",
}
DEFAULT_SOURCE = "mr"

# What a recogniser is told for a language or a name of it.
OCR_TESSERACT = {"marathi": "mar", "mr": "mar", "hindi": "hin", "hi": "hin", "english": "eng", "en": "eng", "devanagari": "mar+hin"}
# Fixed values: (name, two-letter code, three-letter code) of the languages of the two other recognisers.
INDIAN = [
    ("marathi", "mr", "mar"),
    ("hindi", "hi", "hin"),
    ("tamil", "ta", "tam"),
    ("telugu", "te", "tel"),
    ("kannada", "kn", "kan"),
    ("malayalam", "ml", "mal"),
    ("bengali", "bn", "ben"),
    ("gujarati", "gu", "guj"),
    ("punjabi", "pa", "pan"),
]
OCR_VISION = {k: (["mr", "hi"] if two == "mr" else [two]) for name, two, three in INDIAN for k in (name, two, three)} | {"devanagari": ["mr", "hi", "sa"]}
OCR_EASY = {k: [two, "en"] for name, two, three in INDIAN for k in (name, two, three)} | {"devanagari": ["hi", "mr", "en"]} | dict.fromkeys(("english", "en", "eng"), ["en"])

# What the service offers.
TARGETS = {"en": "English", "hi": "Hindi", "es": "Spanish", "fr": "French", "de": "German", "pt": "Portuguese", "ru": "Russian", "zh": "Chinese", "ja": "Japanese", "ko": "Korean"}
OPTIONS = {
    "ocr_language": {"mar": "Marathi", "hin": "Hindi", "tam": "Tamil", "tel": "Telugu", "kan": "Kannada", "mal": "Malayalam", "ben": "Bengali", "guj": "Gujarati", "pan": "Punjabi", "san": "Sanskrit"},
    "ocr_engine": {"easyocr": "EasyOCR (FREE - Recommended)", "tesseract": "Tesseract (FREE - requires install)"},
    "output_format": {"pdf": "PDF", "text": "Text", "markdown": "Markdown"},
    "translator": {
        "trans": "Translate-Shell (CLI) - Recommended",
        "gcp_cloud": "Google Cloud Translation (500K free/month)",
        "google": "Google Translate (Free)",
        "mymemory": "MyMemory (Free)",
        "ollama": "Ollama (Local LLM)",
        "openai": "OpenAI (API Key Required)",
    },
    "translation_mode": {"structure_preserving": "Structure Preserving (Maintains Layout)", "flowing": "Flowing Text (Standard)"},
    "workflow": {"scan_copy": "Scanned Copy", "convert": "Convert to Unicode", "translate": "Full Translation"},
}
