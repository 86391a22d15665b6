"""Every registered query of the text-normalisation operators, with its DuckDB SQL.

Each query runs over the whole of its tables.  Lists are joined to strings where order matters.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..data import languages as L
from ..data.encodings import CATALOG, PARTS, map_rows
from ..functions import conversion as C
from ..functions import detection as D
from ..functions import postprocess as P
from ..functions import shaping as S
from ..functions.text import DEVANAGARI, characters, count_in, strip, words
from ..operators import catalog as K
from ..operators import convert, detect, layout, render, translate, usage
from ..session import shared_dir
from ..sources import adapters as A
from ..sources import pdf
from ..sources.tables import read as table
from ..streaming import usage as stream
from . import sql as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def _blocks(s: SparkSession, d: str, fonts: bool = True) -> DataFrame:
    return A.blocks(table(s, d, "documents"), fonts)


BLOCKS = A.BLOCKS_SQL
JUDGED = Q.judged(BLOCKS)
DOCS = "SELECT doc_id, text AS t FROM documents"
join = lambda c: F.array_join(c, ",")

# -- detection ----------------------------------------------------------------------------------------------


@register("detect_font_name", f"SELECT doc_id, block_idx, {Q.font_case('font_name')} AS encoding FROM ({BLOCKS})")
def detect_font_name(s, d):
    return _blocks(s, d).select("doc_id", "block_idx", D.of_font(F.col("font_name"))["encoding"].alias("encoding"))


@register("detect_unicode_ratio", f"SELECT doc_id, {Q.count_in('t', Q.DEVA)} AS n_devanagari, {Q.unicode_text('t')} AS is_unicode FROM (SELECT doc_id, converted AS t FROM ({Q.converted(DOCS, 'kruti-dev')}))")
def detect_unicode_ratio(s, d):
    t = table(s, d, "documents").select("doc_id", C.convert(F.col("text"), "kruti-dev")["converted"].alias("t"))
    return t.select("doc_id", count_in(F.col("t"), DEVANAGARI).alias("n_devanagari"), D.is_unicode_text(F.col("t")).alias("is_unicode"))


@register(
    "detect_frequency",
    f"SELECT doc_id, CASE WHEN ok AND f.s > 0.2::DOUBLE THEN f.e END AS encoding, CASE WHEN ok AND f.s > 0.2::DOUBLE THEN least(0.85::DOUBLE, 0.50::DOUBLE + f.s * 0.35::DOUBLE) END AS confidence"
    f" FROM (SELECT doc_id, length(text) >= 20 AND {Q.count_in('text', chr(92) + 'x{80}-' + chr(92) + 'x{10ffff}')} >= 3 AS ok, {Q.frequency('text')} AS f FROM documents)",
)
def detect_frequency(s, d):
    return table(s, d, "documents").select("doc_id", D.of_frequency(F.col("text")).alias("f")).select("doc_id", "f.encoding", "f.confidence")


@register("detect_signature", f"SELECT doc_id, unnest(sc).b AS encoding, unnest(sc).s AS score FROM (SELECT doc_id, {Q.scores('text')}[2:] AS sc FROM documents)")
def detect_signature(s, d):
    scored = table(s, d, "documents").select("doc_id", F.explode(D.signature_scores(F.col("text"))).alias("x"))
    return scored.select("doc_id", "x.encoding", "x.score")


@register("detect_fallbacks", f"SELECT doc_id, b.b AS best, b.s AS score, array_to_string(b.f, ',') AS fallbacks FROM (SELECT doc_id, {Q.best('text')} AS b FROM documents)")
def detect_fallbacks(s, d):
    best = table(s, d, "documents").select("doc_id", D.best_signature(D.signature_scores(F.col("text"))).alias("b"))
    return best.select("doc_id", "b.best", "b.score", join("b.fallbacks").alias("fallbacks"))


@register("detect_block", f"SELECT doc_id, block_idx, enc AS encoding, conf AS confidence, method, array_to_string(fb, ',') AS fallbacks FROM ({JUDGED})")
def detect_block(s, d):
    return detect.detect_blocks(_blocks(s, d)).select("doc_id", "block_idx", "found.encoding", "found.confidence", "found.method", join("found.fallbacks").alias("fallbacks"))


PAGES = f"""SELECT doc_id, page_number, enc, conf, method FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY conf DESC, block_idx) AS rn FROM ({JUDGED})) WHERE rn = 1 AND conf > 0"""


@register("detect_page", f"SELECT doc_id, page_number, enc AS encoding, conf AS confidence, method FROM ({PAGES})")
def detect_page(s, d):
    return detect.detect_pages(_blocks(s, d))


@register(
    "detect_document",
    f"""WITH p AS ({PAGES}),
k AS (SELECT doc_id, enc, count(*) AS n, min(page_number) AS first, arg_min(method, page_number) AS method, sum(conf) AS total FROM p GROUP BY doc_id, enc),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rk FROM k),
a AS (SELECT doc_id, max(CASE WHEN rk = 1 THEN enc END) AS encoding, round(sum(total) / sum(n), 12) AS confidence, max(CASE WHEN rk = 1 THEN method END) AS method,
  coalesce(string_agg(CASE WHEN rk BETWEEN 2 AND 4 THEN enc END, ',' ORDER BY rk), '') AS fallbacks, CAST(sum(n) AS BIGINT) AS n_pages FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(encoding, 'unknown') AS encoding, coalesce(confidence, 0.0::DOUBLE) AS confidence, coalesce(method, 'heuristic') AS method, coalesce(fallbacks, '') AS fallbacks, coalesce(n_pages, 0) AS n_pages
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id""",
)
def detect_document(s, d):
    found = detect.detect_documents(detect.detect_pages(_blocks(s, d)), table(s, d, "documents"))
    return found.withColumn("fallbacks", join("fallbacks"))


FONTS = f"SELECT doc_id, min(block_idx) AS ord, font_name AS name FROM ({BLOCKS}) GROUP BY doc_id, font_name"


@register(
    "font_first_match",
    f"SELECT doc_id, arg_min(e, ord) AS encoding, min(ord) AS at FROM (SELECT doc_id, ord, {Q.font_case('name')} AS e FROM ({FONTS})) WHERE e IS NOT NULL GROUP BY doc_id",
)
def font_first_match(s, d):
    fonts = _blocks(s, d).groupBy("doc_id", F.col("font_name").alias("name")).agg(F.min("block_idx").alias("ord"))
    at = fonts.where(D.of_font(F.col("name")).isNotNull()).groupBy("doc_id").agg(F.min("ord").cast("long").alias("at"))
    return detect.first_font_match(fonts).select("doc_id", "encoding").join(at, "doc_id")


@register(
    "is_legacy_flags",
    f"SELECT enc AS encoding, lower(enc) IN ('unicode', 'unicode-devanagari', 'utf-8', 'utf8') AS is_unicode, NOT lower(enc) IN ('unicode', 'unicode-devanagari', 'utf-8', 'utf8') AND enc <> 'unknown' AS is_legacy, count(*) AS n, sum(CASE WHEN conf >= 0.9::DOUBLE THEN 1 ELSE 0 END)::BIGINT AS n_sure FROM ({JUDGED}) GROUP BY enc",
)
def is_legacy_flags(s, d):
    found = detect.detect_blocks(_blocks(s, d)).select("found.encoding", "found.confidence")
    counted = found.groupBy("encoding").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") >= 0.9).alias("n_sure"))
    return counted.select("encoding", D.is_unicode(F.col("encoding")).alias("is_unicode"), D.is_legacy(F.col("encoding")).alias("is_legacy"), "n", "n_sure")


# -- conversion ---------------------------------------------------------------------------------------------


def _conversion(encoding: str):
    name = f"convert_{encoding.replace('-', '_')}"

    @register(name, Q.converted(DOCS, encoding))
    def run(s, d):
        made = table(s, d, "documents").select("doc_id", C.convert(F.col("text"), encoding).alias("c"))
        return made.select("doc_id", "c.converted", F.array_join("c.unmapped", "").alias("unmapped"))

    return run


for _encoding in PARTS:
    _conversion(_encoding)


@register("convert_replacement_char", Q.converted(DOCS, "chanakya", "�"))
def convert_replacement_char(s, d):
    made = table(s, d, "documents").select("doc_id", C.convert(F.col("text"), "chanakya", preserve_unknown=False).alias("c"))
    return made.select("doc_id", "c.converted", F.array_join("c.unmapped", "").alias("unmapped"))


def _keyed(encoding: str) -> str:
    keys = list(C.glyphs(encoding))
    return f"SELECT doc_id, k || substr(text, 1, 5) || k AS t FROM (SELECT doc_id, text, ([{', '.join(map(Q.q, keys))}])[doc_id % {len(keys)} + 1] AS k FROM documents)"


@register("convert_every_key", " UNION ALL ".join(f"SELECT '{e}' AS encoding, doc_id, converted, unmapped FROM ({Q.converted(_keyed(e), e)})" for e in PARTS))
def convert_every_key(s, d):
    """Each document's beginning between two of a key, the keys of every table taking turns."""
    out = None
    for e in PARTS:
        key = K.key_of(e, F.col("doc_id"))
        made = table(s, d, "documents").select("doc_id", C.convert(F.concat(key, F.substring("text", 1, 5), key), e).alias("c"))
        made = made.select(F.lit(e).alias("encoding"), "doc_id", "c.converted", F.array_join("c.unmapped", "").alias("unmapped"))
        out = made if out is None else out.union(made)
    return out


@register("unmapped_chars", f"SELECT c AS character, count(*) AS n_documents FROM (SELECT doc_id, unnest(string_split(unmapped, '')) AS c FROM ({Q.converted(DOCS, 'shree-lipi')})) WHERE c <> '' GROUP BY c")
def unmapped_chars(s, d):
    replaced = C.replace_sequences(F.col("text"), "shree-lipi")
    missed = table(s, d, "documents").select("doc_id", F.explode(C.unmapped(replaced, "shree-lipi")).alias("character"))
    return missed.groupBy("character").agg(F.count(F.lit(1)).alias("n_documents"))


@register(
    "conversion_rate",
    f"SELECT r.doc_id, CASE WHEN text = '' THEN 1.0::DOUBLE ELSE CAST(nd - nu AS DOUBLE) / nd END AS rate FROM (SELECT doc_id, length(unmapped) AS nu FROM ({Q.converted(DOCS, 'chanakya')})) r JOIN (SELECT doc_id, text, len(list_distinct(string_split(text, ''))) AS nd FROM documents) d ON r.doc_id = d.doc_id",
)
def conversion_rate(s, d):
    missed = C.unmapped(C.replace_sequences(F.col("text"), "chanakya"), "chanakya")
    return table(s, d, "documents").select("doc_id", C.conversion_rate(F.col("text"), F.size(missed)).alias("rate"))


@register(
    "convert_blocks",
    "WITH j AS (" + JUDGED + ") " + " UNION ALL ".join(f"SELECT b.doc_id, b.block_idx, '{e}' AS encoding_used, converted AS unicode_text, true AS success FROM (SELECT doc_id * 100000 + block_idx AS k, doc_id, block_idx FROM j WHERE enc = '{e}') b JOIN ({Q.converted('SELECT doc_id * 100000 + block_idx AS doc_id, raw_text AS t FROM j WHERE enc = ' + Q.q(e), e)}) c ON b.k = c.doc_id" for e in PARTS)
    + " UNION ALL SELECT doc_id, block_idx, enc, nfc_normalize(raw_text), lower(enc) IN ('unicode', 'unicode-devanagari', 'utf-8', 'utf8') FROM j WHERE enc NOT IN (" + ", ".join(Q.q(e) for e in PARTS) + ")",
)
def convert_blocks(s, d):
    blocks = detect.detect_blocks(_blocks(s, d)).withColumn("detected_encoding", F.col("found.encoding"))
    return convert.convert_blocks(blocks).select("doc_id", "block_idx", "encoding_used", "unicode_text", "success")


MARKS = "replace(replace(replace(text, 'the', chr(2325) || chr(2366) || chr(2375)), 'in', chr(2306) || chr(2366) || ' ' || chr(2381)), 'on', chr(2325) || chr(2367) || chr(2364))"


@register("post_common", f"SELECT doc_id, {Q.common(MARKS)} AS fixed FROM documents")
def post_common(s, d):
    t = F.col("text")
    for old, new in (("the", "\u0915\u093e\u0947"), ("in", "\u0902\u093e \u094d"), ("on", "\u0915\u093f\u093c")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return table(s, d, "documents").select("doc_id", P.common(t).alias("fixed"))


@register("post_shree_dev", f"SELECT doc_id, {Q.shree_dev('replace(replace(' + MARKS + ', chr(101), chr(2325) || chr(2381) || chr(2327)), chr(97), chr(2327) || chr(169))')} AS fixed FROM documents")
def post_shree_dev(s, d):
    t = F.col("text")
    for old, new in (("the", "\u0915\u093e\u0947"), ("in", "\u0902\u093e \u094d"), ("on", "\u0915\u093f\u093c"), ("e", "\u0915\u094d\u0917"), ("a", "\u0917\u00a9")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return table(s, d, "documents").select("doc_id", P.shree_dev(t).alias("fixed"))


@register("clean_legacy_text", r"SELECT page_id, regexp_replace(html, '[^\n\r\t\x20-\x7e\x{80}-\x{ff}]', '', 'g') AS cleaned, regexp_replace(html, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffd}]', '', 'g') AS kept FROM pages")
def clean_legacy_text(s, d):
    return table(s, d, "pages").select("page_id", pdf.clean_legacy(F.col("html")).alias("cleaned"), pdf.without_dirt(F.col("html")).alias("kept"))


# -- catalogue ----------------------------------------------------------------------------------------------

MAP = "(VALUES " + ", ".join(f"({Q.q(e)}, {i}, {Q.q(k)}, {Q.q(v)})" for e, i, k, v in map_rows()) + ") AS g(encoding, ord, legacy, uni)"
BUILTIN = "(VALUES " + ", ".join(f"({Q.q(e)}, {Q.q(f)}, {Q.q(lang)}, {Q.q(','.join(v))})" for e, f, lang, v in CATALOG) + ") AS b(encoding, font_family, language, variants)"
FONT_OF = f"SELECT doc_id, ([{', '.join('NULL' if f is None else Q.q(f) for f in A.FONTS)}])[doc_id % {len(A.FONTS)} + 1] AS font FROM documents"


def _fonts(s: SparkSession, d: str) -> DataFrame:
    """doc_id and the font that stands in for the document's own."""
    names = F.array(*[F.lit(f).cast("string") for f in A.FONTS])
    return table(s, d, "documents").select("doc_id", F.element_at(names, (F.col("doc_id") % len(A.FONTS) + 1).cast("int")).alias("font"))


@register(
    "reverse_mapping",
    f"""WITH c AS (SELECT DISTINCT doc_id, unnest(string_split(converted, '')) AS unicode FROM ({Q.converted(DOCS, 'kruti-dev')})),
r AS (SELECT uni, arg_min(legacy, ord) AS legacy FROM {MAP} WHERE encoding = 'kruti-dev' GROUP BY uni)
SELECT unicode, legacy, count(*) AS n_documents FROM c JOIN r ON unicode = uni GROUP BY ALL""",
)
def reverse_mapping(s, d):
    """The key behind each character of converted texts."""
    chars = table(s, d, "documents").select(F.explode(F.array_distinct(characters(C.convert(F.col("text"), "kruti-dev")["converted"]))).alias("unicode"))
    keys = K.reverse_map(K.glyph_map(s).where("encoding = 'kruti-dev'"))
    counted = chars.groupBy("unicode").agg(F.count(F.lit(1)).alias("n_documents"))
    return counted.join(keys, "unicode").select("unicode", "legacy", "n_documents")


@register(
    "encoding_catalog",
    f"""SELECT e.*, coalesce(n, 0) AS n_documents FROM (VALUES
  ('shree-lipi', 'Shree-Lipi', 'Marathi', 'Shree-Dev-0714,Shree-Dev-0702,Shree-Dev-0705', 77, 11),
  ('kruti-dev', 'Kruti Dev', 'Hindi', 'KrutiDev010,KrutiDev040', 81, 26),
  ('dvb-tt', 'DVB-TT', 'Marathi', 'DVBWTTSurekhNormal,DVBWTTSurekhBold,DVBTTSurekhNormal,DVBWTT,DVB-TT-Surekh', 137, 47),
  ('shree-dev', 'SHREE-DEV', 'Marathi', 'SHREE-DEV-0708,SHREE-DEV-0714,SHREE-DEV-0715,SHREE-DEV-0721', 220, 27),
  ('chanakya', 'Chanakya', 'Hindi', 'Chanakya,ChanakyaFont', 119, 25),
  ('aps-dv', 'APS-DV', 'Hindi', 'APS-DV,APS-C-DV', 133, 18),
  ('walkman-chanakya', 'Walkman-Chanakya', 'Hindi', 'Walkman-Chanakya,WM-Chanakya', 115, 17),
  ('shusha', 'Shusha', 'Marathi', 'Shusha,Shushaa', 138, 26)) AS e(encoding, font_family, language, variants, n_keys, n_long)
LEFT JOIN (SELECT {Q.font_case('font')} AS enc, count(*) AS n FROM ({FONT_OF}) GROUP BY 1) f ON e.encoding = f.enc""",
)
def encoding_catalog(s, d):
    """The built-in tables, and how many documents have a font of each."""
    keys = K.glyph_map(s).groupBy("encoding").agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.length("legacy") > 1).alias("n_long"))
    found = _fonts(s, d).groupBy(D.of_font(F.col("font"))["encoding"].alias("encoding")).agg(F.count(F.lit(1)).alias("n"))
    listed = K.encodings(s).join(keys, "encoding").join(found, "encoding", "left")
    return listed.select("encoding", "font_family", "language", join("variants").alias("variants"), F.col("n_keys").cast("int").alias("n_keys"), F.col("n_long").cast("int").alias("n_long"), F.coalesce("n", F.lit(0)).alias("n_documents"))


@register(
    "encoding_search",
    f"""SELECT doc_id, e.encoding, e.font_family, e.language FROM ({FONT_OF}) JOIN (VALUES
  ('shree-lipi', 'Shree-Lipi', 'Marathi'), ('kruti-dev', 'Kruti Dev', 'Hindi'), ('dvb-tt', 'DVB-TT', 'Marathi'), ('shree-dev', 'SHREE-DEV', 'Marathi'),
  ('chanakya', 'Chanakya', 'Hindi'), ('aps-dv', 'APS-DV', 'Hindi'), ('walkman-chanakya', 'Walkman-Chanakya', 'Hindi'), ('shusha', 'Shusha', 'Marathi')) AS e(encoding, font_family, language)
ON font <> '' AND contains(e.encoding, lower(font[1:3]))""",
)
def encoding_search(s, d):
    """The tables that the beginning of each document's font finds."""
    asked = _fonts(s, d).where("font <> ''").select("doc_id", F.substring("font", 1, 3).alias("term"))
    return asked.select("doc_id", F.inline(K.matching(F.col("term"))))


OF = "(VALUES " + ", ".join(f"({i}, {Q.q(e)}, {Q.q(c)})" for i, (e, c) in enumerate(L.OF_ENCODING.items())) + ") AS o(ord, e, lang)"


@register("source_language", f"SELECT doc_id, block_idx, coalesce(lang, 'mr') AS language FROM ({JUDGED}) j LEFT JOIN {OF} ON lower(j.enc) = o.e")
def source_language(s, d):
    return detect.detect_blocks(_blocks(s, d)).select("doc_id", "block_idx", K.source_language(F.col("found.encoding")).alias("language"))


@register(
    "languages_by_source",
    f"""SELECT language, n_documents, CASE language
  WHEN 'mr' THEN 'shree-dev,shree-dev-0714,shree-dev-0708,shree-lipi,dvb-tt,shusha'
  WHEN 'hi' THEN 'kruti-dev,chanakya,aps-dv,walkman-chanakya,agra,akruti,unicode-devanagari,unicode-ocr' END AS encodings
FROM (SELECT CASE WHEN e IN ('kruti-dev', 'chanakya', 'aps-dv', 'walkman-chanakya', 'agra', 'akruti', 'unicode-devanagari') THEN 'hi' ELSE 'mr' END AS language, count(*) AS n_documents
  FROM (SELECT {Q.font_case('font')} AS e FROM ({FONT_OF})) GROUP BY 1)""",
)
def languages_by_source(s, d):
    """The source languages of documents by their fonts, and every encoding that each has."""
    language = K.source_language(D.of_font(F.col("font"))["encoding"]).alias("language")
    found = _fonts(s, d).groupBy(language).agg(F.count(F.lit(1)).alias("n_documents"))
    return found.join(K.encodings_by_language(s), "language").select("language", "n_documents", join("encodings").alias("encodings"))


def _case(code: str, pairs: dict[str, str], default: str) -> str:
    return f"CASE lower({code}) " + " ".join(f"WHEN {Q.q(k)} THEN {Q.q(v)}" for k, v in pairs.items()) + f" ELSE {default} END"


@register(
    "lang_codes",
    f"SELECT lang, n, {_case('lang', L.NAMES, 'lang')} AS name, {_case('lang', L.GOOGLE, 'lower(lang)')} AS google, {_case('lang', L.MYMEMORY, 'lower(lang)')} AS mymemory, {_case('lang', L.TESSERACT, 'lower(lang)')} AS tesseract FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT UPPER(x), 0 FROM (VALUES ('mr'), ('hi'), ('san'), ('marathi')) AS v(x))",
)
def lang_codes(s, d):
    more = s.createDataFrame([(x, 0) for x in ("MR", "HI", "SAN", "MARATHI")], "lang string, n long")
    c = F.col("lang")
    codes = table(s, d, "documents").groupBy("lang").count().withColumnRenamed("count", "n").union(more)
    return codes.select("lang", "n", K.language_name(c).alias("name"), K.google_code(c).alias("google"), K.mymemory_code(c).alias("mymemory"), K.tesseract_code(c).alias("tesseract"))


@register(
    "service_options",
    """SELECT lang, n, 'target_language' AS kind, ord, label FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
JOIN (VALUES ('en', 0, 'English'), ('hi', 1, 'Hindi'), ('es', 2, 'Spanish'), ('fr', 3, 'French'), ('de', 4, 'German'), ('pt', 5, 'Portuguese'), ('ru', 6, 'Russian'), ('zh', 7, 'Chinese'), ('ja', 8, 'Japanese'), ('ko', 9, 'Korean')) AS t(code, ord, label) ON lang = code
UNION ALL SELECT source, n, 'output_format', ord, label FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)
JOIN (VALUES ('src0', 0, 'PDF'), ('src1', 1, 'Text'), ('src2', 2, 'Markdown')) AS f(code, ord, label) ON source = code""",
)
def service_options(s, d):
    """What is offered for the languages of documents, and for sources that name a format by its number."""
    docs, offered = table(s, d, "documents"), K.options(s)
    langs = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).join(offered.where("kind = 'target_language'"), F.col("lang") == F.col("code"))
    numbered = offered.where("kind = 'output_format'").withColumn("code", F.concat(F.lit("src"), F.col("ord").cast("string")))
    formats = docs.groupBy(F.col("source").alias("lang")).agg(F.count(F.lit(1)).alias("n")).join(numbered, F.col("lang") == F.col("code"))
    return langs.unionByName(formats).select("lang", "n", "kind", "ord", "label")


# -- views and layout ---------------------------------------------------------------------------------------


@register("page_text", f"SELECT doc_id, page_number, string_agg(raw_text, chr(10) ORDER BY block_idx) AS page_text, count(*) AS n_blocks FROM ({BLOCKS}) GROUP BY doc_id, page_number")
def page_text(s, d):
    return render.page_texts(_blocks(s, d, False))


DOC_TEXTS = f"SELECT doc_id, string_agg(page_text, chr(10) || chr(10) ORDER BY page_number) AS doc_text, count(*) AS page_count FROM (SELECT doc_id, page_number, string_agg(raw_text, chr(10) ORDER BY block_idx) AS page_text FROM ({BLOCKS}) GROUP BY doc_id, page_number) GROUP BY doc_id"


@register("doc_text", DOC_TEXTS)
def doc_text(s, d):
    return render.document_texts(render.page_texts(_blocks(s, d, False)))


@register("fonts_used", f"SELECT doc_id, coalesce(string_agg(DISTINCT font_name, ',' ORDER BY font_name) FILTER (WHERE font_name <> ''), '') AS fonts FROM ({BLOCKS}) GROUP BY doc_id")
def fonts_used(s, d):
    return render.fonts_used(_blocks(s, d)).select("doc_id", join("fonts").alias("fonts"))


def _box(default: str) -> str:
    return f"min(\"left\") * 0.24::DOUBLE AS x0, min(top) * 0.24::DOUBLE AS y0, max(\"left\" + width) * 0.24::DOUBLE AS x1, max(top + height) * 0.24::DOUBLE AS y1, round(coalesce(avg(CASE WHEN conf >= 0 THEN conf END), {default}) / 100, 12) AS confidence"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("confidence", F.round("confidence", 12))


@register("line_group_block", f"SELECT doc_id, page_number, block_num, line_num, string_agg(text, ' ' ORDER BY word_idx, text) AS raw_text, {_box('0.0::DOUBLE')} FROM ({A.WORDS_SQL}) GROUP BY doc_id, page_number, block_num, line_num")
def line_group_block(s, d):
    return _rounded(layout.lines_by_number(A.ocr_words(table(s, d, "lineitem"))))


def _gap(name: str, engine: str) -> None:
    gap, default = layout.ENGINES[engine]
    sql = f"""WITH w AS (SELECT *, lag(top) OVER (PARTITION BY doc_id, page_number ORDER BY top, "left", word_idx) AS last FROM ({A.WORDS_SQL})),
    l AS (SELECT *, CAST(sum(CASE WHEN last >= 0 AND abs(top - last) > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number ORDER BY top, "left", word_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line FROM w)
    SELECT doc_id, page_number, line, string_agg(text, ' ' ORDER BY "left", top, word_idx, text) AS raw_text, {_box(f'{default}::DOUBLE')} FROM l GROUP BY doc_id, page_number, line"""
    register(name, sql)(lambda s, d: _rounded(layout.lines_by_gap(A.ocr_words(table(s, d, "lineitem")), engine)))


_gap("line_group_gap20", "vision")
_gap("line_group_gap30", "easy")


@register(
    "font_category",
    f"""WITH b AS (SELECT *, CASE WHEN font_size <> 12 THEN font_size ELSE (y1 - y0) * 0.85::DOUBLE END AS size FROM ({BLOCKS})),
l AS (SELECT doc_id, count(*) AS n, list_sort(list(size)) AS s FROM b GROUP BY doc_id)
SELECT b.doc_id, block_idx, CASE WHEN n = 1 OR s[n] - s[1] < 3 THEN 'body' WHEN size >= s[least(n * 85 // 100, n - 1) + 1] THEN 'heading' WHEN size <= s[n * 15 // 100 + 1] THEN 'caption' ELSE 'body' END AS font_category
FROM b JOIN l ON b.doc_id = l.doc_id""",
)
def font_category(s, d):
    return layout.font_categories(_blocks(s, d, False)).select("doc_id", "block_idx", "font_category")


@register(
    "overlap_pairs",
    f"WITH b AS ({BLOCKS}) SELECT a.doc_id, a.page_number, a.block_idx AS idx_a, c.block_idx AS idx_b FROM b a JOIN b c ON a.doc_id = c.doc_id AND a.page_number = c.page_number AND a.block_idx < c.block_idx WHERE NOT (a.x1 < c.x0 OR a.x0 > c.x1) AND NOT (a.y1 < c.y0 OR a.y0 > c.y1)",
)
def overlap_pairs(s, d):
    return layout.overlap_pairs(_blocks(s, d, False))


def _moved(gap: float, blocks: str = BLOCKS) -> str:
    return f"""SELECT doc_id, page_number, unnest(r).idx AS block_idx, unnest(r).a AS adj_y0, unnest(r).a + unnest(r).h AS adj_y1 FROM (
  SELECT doc_id, page_number, list_reduce(list([{{'idx': block_idx, 'a': y0, 'h': y1 - y0, 'x0': x0, 'x1': x1}}] ORDER BY y0, x0, block_idx), lambda p, n: list_append(p, {{'idx': n[1].idx,
    'a': greatest(n[1].a, coalesce(list_max(list_transform(list_filter(p, lambda o: NOT (n[1].x1 < o.x0 OR n[1].x0 > o.x1)), lambda o: o.a + o.h + {gap}::DOUBLE)), n[1].a)), 'h': n[1].h, 'x0': n[1].x0, 'x1': n[1].x1}})) AS r
  FROM ({blocks}) GROUP BY doc_id, page_number)"""


#: Documents as the boxes of crowded pages, a thousand a page.
CROWDED = """SELECT 1 AS doc_id, CAST(doc_id // 1000 AS INT) AS page_number, doc_id AS block_idx, CAST(doc_id * 37 % 601 AS DOUBLE) AS x0, CAST(doc_id * 91 % 809 AS DOUBLE) AS y0,
  CAST(doc_id * 37 % 601 + coalesce(length(text), 0) % 83 AS DOUBLE) AS x1, CAST(doc_id * 91 % 809 + 3 + doc_id % 11 AS DOUBLE) AS y1 FROM documents"""


def _crowded(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    x0, y0 = i * 37 % 601, i * 91 % 809
    box = F.struct(*[c.cast("double").alias(n) for n, c in (("x0", x0), ("y0", y0), ("x1", x0 + F.coalesce(F.length("text"), F.lit(0)) % 83), ("y1", y0 + 3 + i % 11))])
    return table(s, d, "documents").select(F.lit(1).alias("doc_id"), F.floor(i / 1000).cast("int").alias("page_number"), i.alias("block_idx"), box.alias("position"))


@register("overlap_crowded", f"WITH b AS ({CROWDED}) SELECT a.page_number, a.block_idx AS idx_a, c.block_idx AS idx_b FROM b a JOIN b c ON a.page_number = c.page_number AND a.block_idx < c.block_idx WHERE NOT (a.x1 < c.x0 OR a.x0 > c.x1) AND NOT (a.y1 < c.y0 OR a.y0 > c.y1)")
def overlap_crowded(s, d):
    return layout.overlap_pairs(_crowded(s, d)).drop("doc_id")


@register("overlap_swept", _moved(4.0, CROWDED))
def overlap_swept(s, d):
    return layout.resolve_overlaps(_crowded(s, d))


@register("overlap_resolve", _moved(4.0))
def overlap_resolve(s, d):
    return layout.resolve_overlaps(_blocks(s, d, False))


@register("min_size_blocks", f"SELECT doc_id, block_idx FROM ({BLOCKS}) WHERE regexp_matches(raw_text, '[^{Q.WS}]') AND x1 - x0 >= 20 AND y1 - y0 >= 10")
def min_size_blocks(s, d):
    return layout.large_enough(_blocks(s, d, False)).select("doc_id", "block_idx")


def _lines_to_width(text: str, width: str, size: str) -> str:
    """The list of lines that a text without line breaks wraps to, by estimated widths."""
    words = f"list_filter(regexp_split_to_array({text}, '[{Q.WS}]+'), lambda w: w <> '')"
    own = f"length(x.u) * {size} * 0.5::DOUBLE"
    used = f"a.n + CASE WHEN a.u = '' THEN 0.0::DOUBLE ELSE {size} * 0.25::DOUBLE END + {own}"
    put = "CASE WHEN a.u <> '' THEN list_append(a.c, a.u) ELSE a.c END"
    step = f"CASE WHEN {used} <= {width} THEN {{'c': a.c, 'u': CASE WHEN a.u = '' THEN x.u ELSE a.u || ' ' || x.u END, 'n': {used}}} ELSE {{'c': {put}, 'u': x.u, 'n': {own}}} END"
    items = f"[{{'c': []::VARCHAR[], 'u': '', 'n': 0.0::DOUBLE}}] || list_transform({words}, lambda w: {{'c': []::VARCHAR[], 'u': w, 'n': 0.0::DOUBLE}})"
    lines = f"(SELECT CASE WHEN f.u <> '' THEN list_append(f.c, f.u) ELSE f.c END FROM (SELECT list_reduce({items}, lambda a, x: {step}) AS f))"
    return f"CASE WHEN regexp_matches({text}, '[^{Q.WS}]') THEN {lines} ELSE [''] END"


PLACED = f"""WITH k AS (SELECT doc_id, page_number, block_idx, x0, y0, x1, len({_lines_to_width('raw_text', '(x1 - x0 - 4.0::DOUBLE)', '11.0::DOUBLE')}) AS m FROM ({BLOCKS}) WHERE regexp_matches(raw_text, '[^{Q.WS}]') AND x1 - x0 >= 20 AND y1 - y0 >= 10),
l AS (SELECT doc_id, page_number, list({{'i': block_idx, 'x0': x0, 'x1': x1, 'y': y0, 'n': CAST(m AS BIGINT), 'e': 0.0::DOUBLE, 'p': []::STRUCT(i BIGINT, x0 DOUBLE, x1 DOUBLE, y DOUBLE, n BIGINT, e DOUBLE)[]}} ORDER BY y0, x0, block_idx) AS bs FROM k GROUP BY doc_id, page_number),
r AS (SELECT doc_id, page_number, list_reduce([{{'i': CAST(-1 AS BIGINT), 'x0': 0.0::DOUBLE, 'x1': 0.0::DOUBLE, 'y': 0.0::DOUBLE, 'n': CAST(0 AS BIGINT), 'e': 0.0::DOUBLE, 'p': []::STRUCT(i BIGINT, x0 DOUBLE, x1 DOUBLE, y DOUBLE, n BIGINT, e DOUBLE)[]}}] || bs, lambda a, b:
  {{'i': b.i, 'x0': b.x0, 'x1': b.x1, 'y': b.y, 'n': b.n, 'e': b.e, 'p': list_append(a.p, list_transform([greatest(b.y + 2.0::DOUBLE, coalesce(list_max(list_transform(list_filter(a.p, lambda o: o.n > 0 AND NOT (b.x1 < o.x0 OR b.x0 > o.x1)), lambda o: o.e + 8.0::DOUBLE)), b.y + 2.0::DOUBLE)) + 11.0::DOUBLE],
    lambda y: {{'i': b.i, 'x0': b.x0, 'x1': b.x1, 'y': y, 'n': least(b.n, greatest(0, CAST(floor((840.0::DOUBLE - y) / (11.0::DOUBLE * 1.2::DOUBLE)) + 1 AS BIGINT))), 'e': y + least(b.n, greatest(0, CAST(floor((840.0::DOUBLE - y) / (11.0::DOUBLE * 1.2::DOUBLE)) + 1 AS BIGINT))) * (11.0::DOUBLE * 1.2::DOUBLE)}})[1])}}).p AS p FROM l)
SELECT doc_id, page_number, unnest(p).i AS block_idx, round(unnest(p).y, 6) AS y, CAST(unnest(p).n AS INT) AS n_lines, round(unnest(p).e, 6) AS next_y FROM r"""


@register("place_lines", PLACED)
def place_lines(s, d):
    placed = layout.place_lines(layout.large_enough(_blocks(s, d, False)))
    return placed.withColumns({"y": F.round("y", 6), "next_y": F.round("next_y", 6)})


@register("flow_pages", f"SELECT doc_id, block_idx AS line, CAST(block_idx // 47 + 1 AS INT) AS page_number, round(80.8::DOUBLE + (block_idx % 47) * 15.4::DOUBLE, 6) AS y FROM ({BLOCKS})")
def flow_pages(s, d):
    return layout.flow_pages(_blocks(s, d, False).select("doc_id", F.col("block_idx").alias("line"))).withColumn("y", F.round("y", 6))


# -- shaping ------------------------------------------------------------------------------------------------

#: Lines stand for paragraphs, so that chunks are packed from paragraphs and sentences.
PARAS = "replace(text, chr(10), chr(10) || chr(10))"
paras = lambda: F.replace("text", F.lit("\n"), F.lit("\n\n"))

PACKED = Q.folded_list(
    r"regexp_extract_all(replace(text, chr(10), ' '), '[^\x{964}\x{965}.!?]*[\x{964}\x{965}.!?]+[" + Q.WS + r"]*|[^\x{964}\x{965}.!?]+$')",
    "length(a.u) + length(x.u) <= 2000", "{'c': a.c, 'u': a.u || x.u, 'n': 0}",
)


@register(
    "chunk_text",
    f"SELECT doc_id, unnest(range(len(c))) AS ord, unnest(c) AS chunk FROM (SELECT doc_id, CASE WHEN length(text) <= 2000 THEN [replace(text, chr(10), ' ')] ELSE {PACKED} END AS c FROM documents)",
)
def chunk_text(s, d):
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    return table(s, d, "documents").select("doc_id", F.posexplode(S.chunks(flat)).alias("ord", "chunk"))


def _packed_paragraphs() -> str:
    start = lambda c, u: f"{{'c': {c}, 'u': {u}}}"
    put = lambda a: f"CASE WHEN {a}.u <> '' THEN list_append({a}.c, {a}.u) ELSE {a}.c END"
    cut = rf"regexp_extract_all(p.u, '[^\x{{964}}\x{{965}}.!?]*[\x{{964}}\x{{965}}.!?]+[{Q.WS}]*|[^\x{{964}}\x{{965}}.!?]+$')"
    none = "[]::VARCHAR[]"
    sentence = f"CASE WHEN length(b.u) + length(q.u) <= 2000 THEN {start('b.c', 'b.u || q.u')} ELSE {start(put('b'), 'q.u')} END"
    long = f"list_reduce([{start(put('a'), chr(39) * 2)}] || list_transform({cut}, lambda z: {start(none, 'z')}), lambda b, q: {sentence})"
    joined = start("a.c", "CASE WHEN a.u <> '' THEN a.u || chr(10) || chr(10) || p.u ELSE p.u END")
    step = f"CASE WHEN length(a.u) + length(p.u) + 2 <= 2000 THEN {joined} WHEN length(p.u) <= 2000 THEN {start(put('a'), 'p.u')} ELSE {long} END"
    folded = f"list_reduce([{start(none, chr(39) * 2)}] || list_transform(string_split(t, chr(10) || chr(10)), lambda z: {start(none, 'z')}), lambda a, p: {step})"
    return f"(SELECT {put('f')} FROM (SELECT {folded} AS f))"


@register("chunk_paragraphs", f"SELECT doc_id, unnest(range(len(c))) AS ord, unnest(c) AS chunk FROM (SELECT doc_id, CASE WHEN length(t) <= 2000 THEN [t] ELSE {_packed_paragraphs()} END AS c FROM (SELECT doc_id, {PARAS} AS t FROM documents))")
def chunk_paragraphs(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(S.chunks(paras())).alias("ord", "chunk"))


@register("chunk_fixed_500", "SELECT doc_id, i AS ord, substr(text, i * 500 + 1, 500) AS chunk FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil(length(text) / 500) AS BIGINT)))) AS i FROM documents)")
def chunk_fixed_500(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(S.slices(F.col("text"))).alias("ord", "chunk"))


def _wrapped(p: str, width: str) -> str:
    ws = f"list_filter(regexp_split_to_array({p}, '[{Q.WS}]+'), lambda w: w <> '')"
    fits = f"a.n + length(x.u) + 1 <= {width}"
    return Q.folded_list(ws, fits, "{'c': a.c, 'u': CASE WHEN a.u <> '' THEN a.u || ' ' || x.u ELSE x.u END, 'n': a.n + length(x.u) + 1}")


@register("wrap_simple", f"SELECT doc_id, block_idx, CASE WHEN regexp_matches(raw_text, '[^{Q.WS}]') THEN array_to_string({_wrapped('raw_text', '80')}, chr(10)) ELSE '' END AS wrapped FROM ({BLOCKS})")
def wrap_simple(s, d):
    return _blocks(s, d, False).select("doc_id", "block_idx", F.array_join(S.wrap(F.col("raw_text")), "\n").alias("wrapped"))


@register("wrap_precise", f"SELECT doc_id, block_idx, array_to_string({_lines_to_width('raw_text', '(x1 - x0)', 'font_size')}, chr(10)) AS wrapped FROM ({BLOCKS})")
def wrap_precise(s, d):
    p = F.col("position")
    return _blocks(s, d, False).select("doc_id", "block_idx", F.array_join(S.wrap_to_width(F.col("raw_text"), p["x1"] - p["x0"], F.col("font_size")), "\n").alias("wrapped"))


def _fit_sql() -> str:
    arms = []
    for z in S.sizes_down(11.0, 6.0):
        arms.append(f"WHEN CAST(CASE WHEN regexp_matches(raw_text, '[^{Q.WS}]') THEN len({_wrapped('raw_text', str(int(300.0 / (z * 0.5))))}) ELSE 1 END AS DOUBLE) * {z * 1.4!r}::DOUBLE <= 60 THEN {z!r}::DOUBLE")
    return "CASE " + " ".join(arms) + " ELSE 6.0::DOUBLE END"


@register("fit_font_size", f"SELECT doc_id, block_idx, {_fit_sql()} AS size FROM ({BLOCKS})")
def fit_font_size(s, d):
    return _blocks(s, d, False).select("doc_id", "block_idx", S.fit_font_size(F.col("raw_text"), 300.0, 60.0).alias("size"))


FITS = "CASE " + " ".join(f"WHEN len({_lines_to_width('raw_text', '(x1 - x0)', f'{z!r}::DOUBLE')}) * {z * 1.2!r}::DOUBLE <= y1 - y0 THEN {z!r}::DOUBLE" for z in S.sizes_down(12.0, 5.0)) + " ELSE 5.0::DOUBLE END"


@register("fit_block_size", f"SELECT doc_id, block_idx, {FITS} AS size FROM ({BLOCKS})")
def fit_block_size(s, d):
    p = F.col("position")
    return _blocks(s, d, False).select("doc_id", "block_idx", S.fit_block_size(F.col("raw_text"), p["x1"] - p["x0"], p["y1"] - p["y0"], 12.0).alias("size"))


MARKED = "CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN 'start --- Page 2 ---' || text || '--- Page 9 --- gone' ELSE '--- Page 1 ---' || text || ' ---Page 3--- third' END"


@register(
    "page_markers",
    f"""WITH m AS (SELECT doc_id, {MARKED} AS t FROM documents),
n AS (SELECT doc_id, t, string_split(t, chr(10)) AS ls, greatest(1, len(string_split(t, chr(10))) // 3) AS k FROM m),
p AS (SELECT doc_id, unnest([1, 2, 3]) AS page, t, ls, k FROM n)
SELECT doc_id, CAST(page AS INT) AS page, CASE WHEN doc_id % 3 = 0 THEN coalesce(array_to_string(CASE WHEN page < 3 THEN ls[(page - 1) * k + 1:page * k] ELSE ls[2 * k + 1:] END, chr(10)), '')
  WHEN doc_id % 3 = 1 THEN CASE page WHEN 1 THEN 'start' WHEN 2 THEN regexp_replace(regexp_extract(t, '(?s)--- Page 2 ---(.*)--- Page 9 ---', 1), '^[{Q.WS}]+|[{Q.WS}]+$', '', 'g') ELSE '' END
  ELSE CASE page WHEN 1 THEN regexp_replace(regexp_extract(t, '(?s)--- Page 1 ---(.*)---Page 3---', 1), '^[{Q.WS}]+|[{Q.WS}]+$', '', 'g') WHEN 2 THEN '' ELSE 'third' END END AS content
FROM p""",
)
def page_markers(s, d):
    t = F.expr(MARKED)
    cut = table(s, d, "documents").select("doc_id", F.posexplode(S.pages_of_markers(t, 3)).alias("page", "content"))
    return cut.select("doc_id", (F.col("page") + 1).alias("page"), "content")


TURNS = "SELECT conv_id AS doc_id, string_agg(CASE WHEN role = 'user' THEN text END, chr(10) || chr(10) ORDER BY turn) AS s, string_agg(CASE WHEN role <> 'user' THEN text END, chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id"


@register(
    "bilingual_rows",
    f"""WITH x AS ({TURNS}), y AS (SELECT doc_id, coalesce(string_split(s, chr(10) || chr(10)), []) AS a, coalesce(string_split(t, chr(10) || chr(10)), []) AS b FROM x),
z AS (SELECT doc_id, a, b, unnest(range(greatest(len(a), len(b)))) AS ord FROM y)
SELECT doc_id, ord, replace(replace(coalesce(a[ord + 1], ''), '|', '\\|'), chr(10), ' ') AS original, replace(replace(coalesce(b[ord + 1], ''), '|', '\\|'), chr(10), ' ') AS translation FROM z""",
)
def bilingual_rows(s, d):
    return render.bilingual_rows(_turns(s, d))


def _turns(s, d) -> DataFrame:
    """The user's and the others' turns of each conversation, as a text and its translation."""

    def side(user: bool):
        turn = F.when((F.col("role") == "user") == F.lit(user), F.struct("turn", "text"))
        return F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda r: r["text"]), "\n\n")

    return table(s, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(side(True).alias("source_text"), side(False).alias("translated_text"))


# -- translation, usage, rendering --------------------------------------------------------------------------


@register(
    "mock_translate",
    f"SELECT doc_id, CASE WHEN regexp_matches(t, '[^{Q.WS}]') THEN array_to_string(list_transform(c, lambda x: '[TRANSLATED] ' || x), chr(10) || chr(10)) ELSE t END AS translated_text, CAST(len(c) AS INT) AS chunk_count FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t, CASE WHEN length(text) <= 2000 THEN [replace(text, chr(10), ' ')] ELSE {PACKED} END AS c FROM documents)",
)
def mock_translate(s, d):
    texts = table(s, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("source_text"))
    return translate.translate_texts(texts).select("doc_id", "translated_text", "chunk_count")


USES = "SELECT event_type AS service, CAST(round(coalesce(value, 0) * 100) AS BIGINT) AS characters, ts FROM events"


@register("monthly_usage", f"SELECT service, strftime(ts, '%Y-%m') AS month, CAST(sum(characters) AS BIGINT) AS characters, max(ts) AS last_updated FROM ({USES}) GROUP BY ALL")
def monthly_usage(s, d):
    return usage.monthly_usage(A.usage_events(table(s, d, "events")))


@register(
    "usage_limit",
    f"WITH m AS (SELECT service, strftime(ts, '%Y-%m') AS month, CAST(sum(characters) AS BIGINT) AS characters FROM ({USES}) GROUP BY ALL) SELECT service, month, characters, characters / 500000.0::DOUBLE * 100 AS percent_used, greatest(0, 500000 - characters) AS remaining FROM m WHERE month = (SELECT max(month) FROM m n WHERE n.service = m.service)",
)
def usage_limit(s, d):
    return usage.limit_report(usage.current_usage(A.usage_events(table(s, d, "events")))).drop("last_updated")


@register(
    "usage_check",
    f"WITH m AS (SELECT service, strftime(ts, '%Y-%m') AS month, CAST(sum(characters) AS BIGINT) AS used FROM ({USES}) GROUP BY ALL), r AS (SELECT DISTINCT event_type AS service, month, 500000 - used + k AS n FROM events JOIN m ON event_type = service, (VALUES (0), (1)) AS v(k)) SELECT r.service, r.month, n, used, used + n > 500000 AS exceeds FROM r JOIN m ON r.service = m.service AND r.month = m.month",
)
def usage_check(s, d):
    used = usage.monthly_usage(A.usage_events(table(s, d, "events")))
    requests = used.select("service", "month", (F.lit(translate.FREE_TIER) - F.col("characters")).alias("left"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    return usage.check_limit(requests.select("service", "month", (F.col("left") + F.col("k")).alias("n")), used)


@register(
    "session_expiry",
    "WITH s AS (SELECT user_id AS session_id, max(ts) AS created_at, arg_max(event_type, (epoch_us(ts), event_id)) = 'purchase' AS processing FROM events GROUP BY user_id), n AS (SELECT max(ts) + INTERVAL 1 DAY AS now FROM events) SELECT session_id, created_at FROM s, n WHERE epoch(date_trunc('second', now)) - epoch(date_trunc('second', created_at)) > 1800 AND NOT processing",
)
def session_expiry(s, d):
    events = table(s, d, "events")
    now = events.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).cast("string")).first()[0]
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    sessions = events.groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("created_at"), (last == "purchase").alias("processing"))
    return usage.expired_sessions(sessions, now).select("session_id", "created_at")


META_SQL = "SELECT doc_id, 'doc' || doc_id || '.pdf' AS source_file, CAST(doc_id % 41 AS DOUBLE) / 40 AS confidence, lang FROM documents"


def _meta(s, d) -> DataFrame:
    docs = table(s, d, "documents")
    return docs.select(
        "doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source_file"), F.lit("kruti-dev").alias("encoding"), ((F.col("doc_id") % 41).cast("double") / 40).alias("confidence"),
        F.col("lang").alias("source_language"), F.lit("en").alias("target_language"), F.lit("mock").alias("backend"), F.lit(None).cast("string").alias("translated_text"),
        (1 + F.floor((F.size(F.split("text", "\n")) - 1) / A.LINES_A_PAGE)).alias("page_count"), F.lit("2024-01-01T00:00:00").alias("generated_at"),
    )


def _render_sql(before: str, after: str, header: str) -> str:
    return f"""WITH p AS (SELECT doc_id, page_number, string_agg(raw_text, chr(10) ORDER BY block_idx) AS page_text FROM ({BLOCKS}) GROUP BY doc_id, page_number),
b AS (SELECT doc_id, count(*) AS n, string_agg('{before}' || page_number || '{after}' || chr(10) || chr(10) || page_text || chr(10), chr(10) ORDER BY page_number) AS paged, min(page_text) AS plain FROM p GROUP BY doc_id)
SELECT b.doc_id, {header} || chr(10) || CASE WHEN n > 1 THEN paged ELSE plain END AS rendered FROM b JOIN ({META_SQL}) m ON b.doc_id = m.doc_id"""


PCT = "printf('%.1f', confidence * 100) || '%'"


@register(
    "render_text",
    _render_sql("--- Page ", " ---", f"'Translation Output' || chr(10) || repeat('=', 18) || chr(10) || 'Source File: ' || source_file || chr(10) || 'Encoding: kruti-dev (confidence: ' || {PCT} || ')' || chr(10) || 'Languages: ' || lang || ' → en' || chr(10) || 'Backend: mock' || chr(10) || 'Pages: ' || n || chr(10) || 'Generated: 2024-01-01T00:00:00' || chr(10) || chr(10) || repeat('=', 60) || chr(10)"),
)
def render_text(s, d):
    return render.render(render.page_texts(_blocks(s, d, False)), _meta(s, d), "text")


@register(
    "render_markdown",
    _render_sql("## Page ", "", f"'# Translation: ' || source_file || chr(10) || chr(10) || '| Property | Value |' || chr(10) || '|----------|-------|' || chr(10) || '| Source File | `' || source_file || '` |' || chr(10) || '| Encoding | kruti-dev |' || chr(10) || '| Confidence | ' || {PCT} || ' |' || chr(10) || '| Languages | ' || lang || ' → en |' || chr(10) || '| Backend | mock |' || chr(10) || '| Pages | ' || n || ' |' || chr(10) || '| Generated | 2024-01-01T00:00:00 |' || chr(10) || chr(10) || '---' || chr(10)"),
)
def render_markdown(s, d):
    return render.render(render.page_texts(_blocks(s, d, False)), _meta(s, d), "markdown")


@register("output_names", "SELECT page_id, regexp_replace(url, '\\.[^./]*$', '') || '_converted.txt' AS name FROM pages")
def output_names(s, d):
    return table(s, d, "pages").select("page_id", render.output_name(F.col("url"), "_converted.txt").alias("name"))


@register("strip_text", f"SELECT doc_id, regexp_replace(text, '^[{Q.WS}]+|[{Q.WS}]+$', '', 'g') AS stripped, len(list_filter(regexp_split_to_array(text, '[{Q.WS}]+'), lambda w: w <> '')) AS n_words FROM documents")
def strip_text(s, d):

    return table(s, d, "documents").select("doc_id", strip(F.col("text")).alias("stripped"), F.size(words(F.col("text"))).cast("long").alias("n_words"))




# -- streams ------------------------------------------------------------------------------------------------


def _streamed(s: SparkSession, d: str, make, mode: str = "complete") -> DataFrame:
    """Runs a stream over the events that are there, and gives what it left."""
    at = f"{shared_dir(s)}/glyphflow-stream-{uuid.uuid4().hex}"
    stream.to_table(make(stream.read_events(s, d)), f"{at}/table", f"{at}/checkpoint", mode).awaitTermination()
    return s.read.parquet(f"{at}/table")


@register("stream_usage", f"SELECT service, date_trunc('day', ts) AS start, CAST(sum(characters) AS BIGINT) AS characters, count(*) AS uses FROM ({USES}) GROUP BY ALL")
def stream_usage(s, d):
    return _streamed(s, d, stream.usage_by_window)


@register(
    "stream_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM g GROUP BY user_id, k""",
)
def stream_sessions(s, d):
    return _streamed(s, d, stream.sessions)
