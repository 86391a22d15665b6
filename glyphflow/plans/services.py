"""Queries over what surrounds conversion: sessions, usage, edges' table parts, warnings, names and pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..data import languages as L
from ..data.encodings import CATALOG, PARTS
from ..functions.text import preview, strip_ansi
from ..operators import catalog as K
from ..operators import convert, detect, draw, layout, render, scan, sessions, translate, usage
from ..sources import adapters as A
from ..sources import files, ocr
from ..sources.tables import read as table
from . import sql as Q
from .catalog import BLOCKS, BUILTIN, FONTS, QUERIES, JUDGED, PACKED, PAGES, PCT, TURNS, USES, _blocks, _meta, _turns, join, register

_BEFORE = set(QUERIES)
SORTED_PAGES = f"SELECT doc_id, page_number, string_agg(raw_text, chr(10) ORDER BY block_idx) AS page_text FROM ({BLOCKS}) GROUP BY doc_id, page_number"

# -- detection and conversion by page -----------------------------------------------------------------------


@register("page_report", f"SELECT doc_id, page_number, enc AS encoding, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS INT) AS ord FROM ({PAGES})")
def page_report(s, d):
    return detect.report(detect.detect_pages(_blocks(s, d))).select("doc_id", "page_number", "encoding", "ord")


@register(
    "shortcut_pages",
    f"""WITH j AS ({JUDGED}), f AS (SELECT doc_id, arg_min(e, ord) AS enc FROM (SELECT doc_id, ord, {Q.font_case('name')} AS e FROM ({FONTS})) WHERE e IS NOT NULL GROUP BY doc_id),
g AS (SELECT * FROM f WHERE enc NOT IN ('unicode-devanagari', 'unknown')),
p AS (SELECT doc_id, page_number, enc, conf, method FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY conf DESC, block_idx) AS rn FROM j WHERE doc_id NOT IN (SELECT doc_id FROM g)) WHERE rn = 1 AND conf > 0)
SELECT doc_id, page_number, enc AS encoding, conf AS confidence, method FROM p
UNION ALL SELECT DISTINCT b.doc_id, b.page_number, g.enc, 0.95::DOUBLE, 'font_match' FROM ({BLOCKS}) b JOIN g ON b.doc_id = g.doc_id""",
)
def shortcut_pages(s, d):
    blocks = _blocks(s, d)
    fonts = blocks.groupBy("doc_id", F.col("font_name").alias("name")).agg(F.min("block_idx").alias("ord"))
    return detect.detect_pages(blocks, fonts)


KNOWN = ", ".join(map(Q.q, [*PARTS, "unicode", "unicode-devanagari", "utf-8", "utf8"]))


def _converted(blocks, **options):
    return convert.convert_blocks(blocks, **options).select("doc_id", "block_idx", "encoding_used", "success")


@register("page_encodings", f"SELECT b.doc_id, b.block_idx, coalesce(p.enc, 'kruti-dev') AS encoding_used, coalesce(p.enc, 'kruti-dev') IN ({KNOWN}) AS success FROM ({BLOCKS}) b LEFT JOIN ({PAGES}) p ON b.doc_id = p.doc_id AND b.page_number = p.page_number")
def page_encodings(s, d):
    blocks = _blocks(s, d)
    return _converted(blocks.withColumn("detected_encoding", F.lit("kruti-dev")), page_encodings=detect.detect_pages(blocks))


@register("override_pages", f"SELECT doc_id, page_number, 'chanakya' AS encoding, 1.0::DOUBLE AS confidence, 'user_override' AS method FROM ({PAGES})")
def override_pages(s, d):
    return detect.override(detect.detect_pages(_blocks(s, d)), "chanakya")


@register("ocr_pages", f"SELECT DISTINCT doc_id, page_number, 'unicode-ocr' AS encoding, 1.0::DOUBLE AS confidence, 'unicode_detected' AS method FROM ({BLOCKS})")
def ocr_pages(s, d):
    return detect.ocr_result(_blocks(s, d, False).select("doc_id", "page_number").distinct())


SHOWN = "list_transform(string_split(unmapped, '')[1:5], lambda c: chr(39) || c || chr(39))"


@register("conversion_warnings", f"SELECT doc_id, CASE WHEN unmapped = '' THEN '' ELSE 'Found ' || length(unmapped) || ' unmapped character(s): ' || array_to_string({SHOWN}, ', ') END AS warnings FROM ({Q.converted('SELECT doc_id, text AS t FROM documents', 'aps-dv')})")
def conversion_warnings(s, d):
    rows = table(s, d, "documents").select("doc_id", F.lit(0).alias("block_idx"), F.col("text").alias("raw_text"))
    return convert.warnings(convert.convert_blocks(rows, encoding="aps-dv")).select("doc_id", F.array_join("warnings", ",").alias("warnings"))


@register("fonts_shown", f"SELECT doc_id, coalesce(array_to_string(list_sort(list(DISTINCT font_name) FILTER (WHERE font_name <> ''))[1:10], ','), '') AS fonts FROM (SELECT doc_id // 20 AS doc_id, font_name FROM ({BLOCKS})) GROUP BY doc_id")
def fonts_shown(s, d):
    groups = _blocks(s, d).withColumn("doc_id", F.floor(F.col("doc_id") / 20))
    return render.fonts_used(groups).select("doc_id", join(F.slice("fonts", 1, 10)).alias("fonts"))


# -- the catalogue ------------------------------------------------------------------------------------------

PART_KEYS = "(VALUES " + ", ".join(f"({Q.q(e)}, {i}, {Q.q(k)})" for e, parts in PARTS.items() for i, part in enumerate(parts) for k in part) + ") AS k(encoding, part, legacy)"


@register(
    "mapping_overlap",
    f"""WITH t AS (SELECT *, bool_or(part > 0) OVER (PARTITION BY encoding, legacy) AS twice FROM {PART_KEYS}),
n AS (SELECT encoding, count(DISTINCT legacy) FILTER (WHERE part = 0) AS n_base, count(DISTINCT legacy) FILTER (WHERE part = 0 AND twice) AS n_overlap FROM t GROUP BY encoding),
h AS (SELECT encoding, count(DISTINCT doc_id) AS n_documents FROM documents JOIN (SELECT DISTINCT encoding, legacy FROM t WHERE part = 0 AND twice) o ON contains(text, legacy) GROUP BY encoding)
SELECT n.encoding, n_base, n_overlap, coalesce(n_documents, 0) AS n_documents FROM n LEFT JOIN h ON n.encoding = h.encoding""",
)
def mapping_overlap(s, d):
    """Keys that two parts of a table have, and how many documents hold one of them."""
    holding = [F.count_if(K.holds_any(F.col("text"), K.shared_keys(e))).alias(e) for e in PARTS]
    counts = table(s, d, "documents").agg(*holding).unpivot([], [F.col(f"`{e}`") for e in PARTS], "encoding", "n_documents")
    return K.overlaps(s).join(counts, "encoding")


NAMED = "lower(replace(replace('My ' || upper(lang) || '_Font ' || source, ' ', '-'), '_', '-'))"


@register("mapping_files", f"SELECT DISTINCT {NAMED} AS encoding, 'External' AS font_family, '-' AS language, 'file' AS source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL UNION ALL SELECT encoding, font_family, language, 'builtin' FROM {BUILTIN}")
def mapping_files(s, d):
    name = F.concat(F.lit("My "), F.upper("lang"), F.lit("_Font "), F.col("source"))
    found = table(s, d, "documents").select(K.file_name(name).alias("encoding")).where("encoding is not null").distinct()
    return K.listing(K.encodings(s), found)


ASKED_LANGUAGES = ["marathi", "hi", "tam", "telugu", "kn", "Mal", "bengali", "gu", "PAN", "devanagari", "EN", "zz"]


@register(
    "ocr_languages",
    """SELECT language, engine, count(*) AS n, CASE engine
  WHEN 'tesseract' THEN CASE language WHEN 'marathi' THEN 'mar' WHEN 'hi' THEN 'hin' WHEN 'en' THEN 'eng' WHEN 'devanagari' THEN 'mar+hin' ELSE language END
  WHEN 'vision' THEN CASE language WHEN 'marathi' THEN 'mr,hi' WHEN 'devanagari' THEN 'mr,hi,sa' WHEN 'tam' THEN 'ta' WHEN 'telugu' THEN 'te' WHEN 'mal' THEN 'ml' WHEN 'bengali' THEN 'bn' WHEN 'pan' THEN 'pa' ELSE language END
  ELSE CASE language WHEN 'marathi' THEN 'mr,en' WHEN 'hi' THEN 'hi,en' WHEN 'tam' THEN 'ta,en' WHEN 'telugu' THEN 'te,en' WHEN 'kn' THEN 'kn,en' WHEN 'mal' THEN 'ml,en' WHEN 'bengali' THEN 'bn,en' WHEN 'gu' THEN 'gu,en' WHEN 'pan' THEN 'pa,en' WHEN 'devanagari' THEN 'hi,mr,en' ELSE 'en' END END AS told
FROM (SELECT (['marathi', 'hi', 'tam', 'telugu', 'kn', 'mal', 'bengali', 'gu', 'pan', 'devanagari', 'en', 'zz'])[doc_id % 12 + 1] AS language, unnest(['tesseract', 'vision', 'easyocr']) AS engine FROM documents)
GROUP BY ALL""",
)
def ocr_languages(s, d):
    """What each engine is told for the languages that documents are asked to be in."""
    names = F.array(*map(F.lit, ASKED_LANGUAGES))
    asked = table(s, d, "documents").groupBy(F.get(names, (F.col("doc_id") % len(ASKED_LANGUAGES)).cast("int")).alias("asked")).agg(F.count(F.lit(1)).alias("n"))
    told = F.explode(F.array(*[F.struct(F.lit(e).alias("engine"), ocr.told(e, F.col("asked")).alias("told")) for e in ocr.ENGINES])).alias("x")
    return asked.select(F.lower("asked").alias("language"), "n", told).select("language", "x.engine", "n", "x.told")


# -- texts --------------------------------------------------------------------------------------------------


@register("page_marked", f"SELECT doc_id, string_agg('--- Page ' || page_number || ' ---' || chr(10) || chr(10) || page_text, chr(10) || chr(10) ORDER BY page_number) AS marked FROM ({SORTED_PAGES}) GROUP BY doc_id")
def page_marked(s, d):
    return translate.page_marked(render.page_texts(_blocks(s, d, False)))


@register("prompts", "SELECT doc_id, 'Translate the following text from Marathi to English. Give only the translation.' || chr(10) || chr(10) || text AS prompt FROM documents")
def prompts(s, d):
    return table(s, d, "documents").select("doc_id", translate.prompt(F.col("text"), "Marathi", "English").alias("prompt"))


@register("ansi_strip", "SELECT doc_id, replace(text, 'the', 'THE') AS plain FROM documents")
def ansi_strip(s, d):
    coloured = F.replace("text", F.lit("the"), F.lit("\x1b[1;31mTHE\x1b[0m"))
    return table(s, d, "documents").select("doc_id", strip_ansi(F.concat(F.lit("\x1b[m"), coloured)).alias("plain"))


@register("previews", "SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS preview FROM documents")
def previews(s, d):
    return table(s, d, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


HEADER = f"'# Translation: ' || source_file || chr(10) || chr(10) || '| Property | Value |' || chr(10) || '|----------|-------|' || chr(10) || '| Source File | `' || source_file || '` |' || chr(10) || '| Encoding | kruti-dev |' || chr(10) || '| Confidence | ' || {PCT} || ' |' || chr(10) || '| Languages | ' || lang || ' → en |' || chr(10) || '| Backend | mock |' || chr(10) || '| Pages | ' || n || ' |' || chr(10) || '| Generated | 2024-01-01T00:00:00 |' || chr(10) || chr(10) || '---' || chr(10)"


@register(
    "render_bilingual",
    f"""WITH x AS ({TURNS}), y AS (SELECT doc_id, coalesce(string_split(s, chr(10) || chr(10)), ['']) AS a, coalesce(string_split(t, chr(10) || chr(10)), ['']) AS b FROM x),
z AS (SELECT doc_id, a, b, unnest(range(greatest(len(a), len(b)))) AS ord FROM y),
c AS (SELECT doc_id, ord, '| ' || replace(replace(coalesce(a[ord + 1], ''), '|', '\\|'), chr(10), ' ') || ' | ' || replace(replace(coalesce(b[ord + 1], ''), '|', '\\|'), chr(10), ' ') || ' |' AS line FROM z),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY ord) AS rows FROM c GROUP BY doc_id),
m AS (SELECT doc_id, 'doc' || doc_id || '.pdf' AS source_file, CAST(doc_id % 41 AS DOUBLE) / 40 AS confidence, lang, 1 + (len(string_split(text, chr(10))) - 1) // {A.LINES_A_PAGE} AS n FROM documents)
SELECT t.doc_id, {HEADER} || chr(10) || '## Bilingual Content' || chr(10) || chr(10) || '| Original | Translation |' || chr(10) || '|----------|-------------|' || chr(10) || rows AS rendered FROM t JOIN m ON t.doc_id = m.doc_id""",
)
def render_bilingual(s, d):
    return render.bilingual(_turns(s, d), _meta(s, d))


# -- places and pictures ------------------------------------------------------------------------------------


@register("positioned_blocks", f"SELECT doc_id, block_idx FROM ({BLOCKS}) WHERE regexp_matches(raw_text, '[^{Q.WS}]') AND x1 - x0 >= 20 AND y1 - y0 >= 10 AND block_idx % 5 <> 0")
def positioned_blocks(s, d):
    blocks = _blocks(s, d, False).withColumn("position", F.when(F.col("block_idx") % 5 != 0, F.col("position")))
    return layout.large_enough(blocks).select("doc_id", "block_idx")


BLANKED = A.WORDS_SQL.replace("'w' || l_partkey AS text", "CASE l_partkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN chr(160) || chr(9) ELSE 'w' || l_partkey END AS text")


@register("nonblank_words", f"SELECT doc_id, page_number, block_num, line_num, string_agg(text, ' ' ORDER BY word_idx, text) AS raw_text FROM ({BLANKED}) WHERE regexp_matches(text, '[^{Q.WS}]') GROUP BY doc_id, page_number, block_num, line_num")
def nonblank_words(s, d):
    turn = F.pmod(F.substring("text", 2, 20).cast("long"), F.lit(4))
    words = A.ocr_words(table(s, d, "lineitem")).withColumn("text", F.when(turn == 0, " ").when(turn == 1, "\u00a0\t").otherwise(F.col("text")))
    return layout.lines_by_number(words).select("doc_id", "page_number", "block_num", "line_num", "raw_text")


@register("whole_pages", f"SELECT doc_id, page_number, page_text AS raw_text, 0.8::DOUBLE AS confidence FROM ({SORTED_PAGES}) WHERE regexp_matches(page_text, '[^{Q.WS}]') AND page_number % 2 = 0")
def whole_pages(s, d):
    pages = render.page_texts(_blocks(s, d, False))
    return ocr.whole_pages(pages, pages.where("page_number % 2 = 1"), "tesseract")


@register(
    "polygon_boxes",
    "SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey, l_partkey + l_linenumber) AS x, least(l_suppkey, l_linenumber, l_orderkey) AS y, greatest(l_partkey, l_suppkey, l_partkey + l_linenumber) - least(l_partkey, l_suppkey, l_partkey + l_linenumber) AS w, greatest(l_suppkey, l_linenumber, l_orderkey) - least(l_suppkey, l_linenumber, l_orderkey) AS h FROM lineitem",
)
def polygon_boxes(s, d):
    c = lambda n: F.col(n).cast("long")
    points = [(c("l_partkey"), c("l_suppkey")), (c("l_suppkey"), c("l_linenumber")), (c("l_partkey") + c("l_linenumber"), c("l_orderkey"))]
    box = layout.polygon_box(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in points]))
    boxed = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b"))
    return boxed.select("l_orderkey", "l_linenumber", F.col("b.left").alias("x"), F.col("b.top").alias("y"), F.col("b.width").alias("w"), F.col("b.height").alias("h"))


@register("pixel_threshold", "SELECT l_orderkey, string_agg(CASE WHEN l_partkey % 256 > 180 THEN '255' ELSE '0' END, ',' ORDER BY l_linenumber, l_partkey) AS pixels FROM lineitem GROUP BY l_orderkey")
def pixel_threshold(s, d):
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    grey = F.transform(ordered, lambda r: (r["l_partkey"] % 256).cast("int"))
    rows = table(s, d, "lineitem").groupBy("l_orderkey").agg(grey.alias("p"))
    return rows.select("l_orderkey", F.array_join(scan.in_mode(F.col("p"), "bw"), ",").alias("pixels"))


@register("scan_pages", "SELECT p_partkey, CAST(ceil(p_size * 10.0::DOUBLE * (300.0::DOUBLE / 72)) AS INT) AS width, CAST(ceil((p_size + 100.0::DOUBLE) * (300.0::DOUBLE / 72)) AS INT) AS height FROM part")
def scan_pages(s, d):
    size = scan.picture_size(F.col("p_size") * F.lit(10.0), F.col("p_size") + F.lit(100.0))
    return table(s, d, "part").select("p_partkey", size.alias("z")).select("p_partkey", "z.width", "z.height")


@register("any_placed", f"SELECT doc_id, bool_or(contains(raw_text, 'the') AND block_idx % 5 <> 0) AS placed FROM ({BLOCKS}) GROUP BY doc_id")
def any_placed(s, d):
    blocks = _blocks(s, d, False).withColumns({"position": F.when(F.col("block_idx") % 5 != 0, F.col("position")), "translated_text": F.when(F.col("raw_text").contains("the"), F.col("raw_text"))})
    return draw.any_placed(blocks)


# -- translation and usage ----------------------------------------------------------------------------------


def _odd(text: str, source: str, target: str) -> str:
    if len(text) % 2:
        raise translate.TranslationError("odd")
    return f"<{text}>"


ODD = f"SELECT doc_id, t, CASE WHEN length(t) <= 2000 THEN [t] ELSE {PACKED} END AS c FROM (SELECT doc_id, text, replace(text, chr(10), ' ') AS t FROM documents WHERE regexp_matches(text, '[^{Q.WS}]'))"


def _translated(s, d):
    texts = table(s, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("source_text")).where(F.col("source_text").rlike(f"[^{Q.WS}]"))
    return texts, translate.translate_texts(texts, translate.Backend("odd", _odd, retries=1))


@register("failed_chunks", f"SELECT doc_id, CAST(len(c) AS INT) AS chunk_count, CAST(len(list_filter(c, lambda x: length(x) % 2 = 1)) AS INT) AS n_failed, len(list_filter(c, lambda x: length(x) % 2 = 1)) = len(c) AS failed, array_to_string(list_transform(c, lambda x: CASE WHEN length(x) % 2 = 1 THEN x ELSE '<' || x || '>' END), chr(10) || chr(10)) AS translated_text FROM ({ODD})")
def failed_chunks(s, d):
    return translate.all_failed(_translated(s, d)[1]).drop("warnings")


@register("characters_sent", f"SELECT doc_id, CASE WHEN len(list_filter(c, lambda x: length(x) % 2 = 1)) = 0 THEN length(t) ELSE 0 END AS characters FROM ({ODD})")
def characters_sent(s, d):
    return translate.characters_sent(*_translated(s, d))


@register("within_limit", "SELECT service, n, used, used + n <= 500000 AS allowed FROM (SELECT source AS service, CAST(sum(length(text)) AS BIGINT) AS n, CASE WHEN source LIKE '%2' THEN 499000 ELSE 0 END AS used FROM documents WHERE source IS NOT NULL GROUP BY source)")
def within_limit(s, d):
    docs = table(s, d, "documents").where("source is not null").select(F.col("source").alias("service"), F.col("text").alias("source_text"))
    used = docs.select("service").distinct().where("service LIKE '%2'").withColumn("characters", F.lit(499_000))
    return translate.within_limit(docs, used)


@register(
    "request_schedule",
    "SELECT doc_id, n, attempt, f * 1.0::DOUBLE AS least, f * 4.0::DOUBLE AS most, CAST(pow(2, attempt) AS DOUBLE) * 3 AS backoff, least(180.0::DOUBLE, 60.0::DOUBLE * pow(1.5::DOUBLE, attempt)) AS allowed FROM (SELECT doc_id, doc_id % 14 + 1 AS n, doc_id % 5 AS attempt, CASE WHEN doc_id % 14 + 1 > 10 THEN 2.25::DOUBLE WHEN doc_id % 14 + 1 > 5 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS f FROM documents)",
)
def request_schedule(s, d):
    return translate.schedule(table(s, d, "documents").select("doc_id", (F.col("doc_id") % 14 + 1).alias("n"), (F.col("doc_id") % 5).alias("attempt")))


@register("usage_round_trip", f"SELECT service, strftime(ts, '%Y-%m') AS month, CAST(sum(characters) AS BIGINT) AS characters, date_trunc('second', max(ts)) AS last_updated FROM ({USES}) GROUP BY ALL")
def usage_round_trip(s, d):
    written = files.usage_json(usage.monthly_usage(A.usage_events(table(s, d, "events"))))
    broken = s.createDataFrame([("{broken",), ("",)], "json string")
    return files.usage_of_json(written.union(broken))


@register("uploads", "SELECT page_id, CASE WHEN NOT ends_with(lower(name), '.pdf') OR n = 0 THEN 400 WHEN n > 50000000 THEN 413 ELSE 200 END AS status FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE url || '.Pdf' END AS name, CASE WHEN page_id % 7 = 0 THEN 0 ELSE length(html) * (page_id % 5) * 10000 END AS n FROM pages)")
def uploads(s, d):
    i = F.col("page_id")
    name = F.when(i % 3 == 0, F.col("url")).otherwise(F.concat("url", F.lit(".Pdf")))
    length = F.when(i % 7 == 0, 0).otherwise(F.length("html") * (i % 5) * 10000)
    return usage.valid_uploads(table(s, d, "pages").select("page_id", name.alias("name"), length.alias("length"))).select("page_id", "status")


# -- sessions -----------------------------------------------------------------------------------------------

KIND = "CASE event_type WHEN 'purchase' THEN 'set_result' WHEN 'click' THEN 'delete' ELSE 'create' END"
OPERATIONS = f"SELECT user_id AS session_id, event_id AS seq, {KIND} AS kind, 'r' || event_id AS told FROM events"
STATES = f"""SELECT session_id, created_at, CASE WHEN set_at > created_at THEN result END AS result FROM (
  SELECT session_id, max(seq) FILTER (WHERE kind = 'create') AS created_at, max(seq) FILTER (WHERE kind = 'delete') AS deleted_at, max(seq) FILTER (WHERE kind = 'set_result') AS set_at, arg_max(told, seq) FILTER (WHERE kind = 'set_result') AS result
  FROM ({OPERATIONS}) GROUP BY session_id) WHERE created_at IS NOT NULL AND (deleted_at IS NULL OR deleted_at < created_at)"""


def _operations(s, d):
    kind = F.when(F.col("event_type") == "purchase", "set_result").when(F.col("event_type") == "click", "delete").otherwise("create")
    return table(s, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("at"), kind.alias("kind"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("result"))


@register("session_store", STATES)
def session_store(s, d):
    return sessions.store(_operations(s, d))


@register("session_look_up", f"SELECT DISTINCT c_custkey AS session_id, CASE WHEN c_custkey IN (SELECT session_id FROM ({STATES})) THEN 200 ELSE 404 END AS status FROM customer")
def session_look_up(s, d):
    asked = table(s, d, "customer").select(F.col("c_custkey").alias("session_id")).distinct()
    return sessions.look_up(asked, sessions.store(_operations(s, d)))


@register("single_flight", "SELECT session_id, seq, CASE WHEN kind = 'start' AND coalesce(lag(kind) OVER (PARTITION BY session_id ORDER BY seq) = 'start', false) THEN 409 ELSE 200 END AS status FROM (SELECT user_id % 50 AS session_id, event_id AS seq, CASE WHEN event_type = 'purchase' OR event_id % 3 = 0 THEN 'finish' ELSE 'start' END AS kind FROM events)")
def single_flight(s, d):
    kind = F.when((F.col("event_type") == "purchase") | (F.col("event_id") % 3 == 0), "finish").otherwise("start")
    asked = table(s, d, "events").select((F.col("user_id") % 50).alias("session_id"), F.col("event_id").alias("at"), kind.alias("kind"))
    return sessions.single_flight(asked).select("session_id", F.col("at").alias("seq"), "status")


@register(
    "progress_frames",
    f"""SELECT doc_id, n, percent, 'data: {{"status":"translating","percent":' || percent || ',"step":"translate","message":"' || n || '/' || total || '"}}' || chr(10) || chr(10) AS frame
FROM (SELECT doc_id, block_idx + 1 AS n, total, CAST(40 + 40 * (block_idx + 1) // total AS INT) AS percent FROM (SELECT doc_id, block_idx, count(*) OVER (PARTITION BY doc_id) AS total FROM ({BLOCKS})))""",
)
def progress_frames(s, d):
    blocks = _blocks(s, d, False)
    total = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    return sessions.progress(blocks.join(total, "doc_id").select("doc_id", (F.col("block_idx") + 1).alias("n"), "total"))


#: The queries of this module.
NAMES = [n for n in QUERIES if n not in _BEFORE]
