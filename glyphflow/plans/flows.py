"""Queries over documents in files, sessions as a stream, budgets and send times."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import translate, usage
from ..operators.patterns import match_patterns
from ..session import scratch, shared_dir
from ..sources import documents
from ..sources.tables import read as table
from ..streaming import session_state
from .catalog import FONT_OF, _fonts, register

# -- font names and patterns --------------------------------------------------------------------------------


@register(
    "custom_patterns",
    f"""WITH p AS (SELECT row_number() OVER (ORDER BY p_name) - 1 AS k, p_name FROM (SELECT DISTINCT p_name FROM part)),
n AS (SELECT doc_id, p_name, doc_id % 97 AS turn, upper(p_name) || '-' || doc_id % 97 || '-' || coalesce(font, '') AS name FROM ({FONT_OF}) JOIN p ON doc_id % (SELECT count(*) FROM p) = k),
m AS (SELECT n.doc_id, n.name, arg_min('custom-' || p_partkey, (-p_size, p_partkey)) AS encoding FROM n LEFT JOIN (SELECT * FROM part WHERE p_partkey < 1000) q ON q.p_name = n.p_name AND q.p_partkey % 97 = n.turn GROUP BY ALL)
SELECT * FROM m""",
)
def custom_patterns(s, d):
    """Font names made of documents, and the best of a thousand patterns that parts stand for."""
    part, i = table(s, d, "part"), F.col("doc_id")
    kinds = part.select("p_name").distinct()
    k = F.row_number().over(Window.orderBy("p_name")) - 1  # of the few names that parts have
    numbered = kinds.withColumn("k", k)
    fonts = _fonts(s, d).withColumn("k", i % kinds.count()).join(numbered, "k")
    named = fonts.select("doc_id", F.concat(F.upper("p_name"), F.lit("-"), (i % 97).cast("string"), F.lit("-"), F.coalesce("font", F.lit(""))).alias("name"))
    regex = F.concat(F.lit("^"), F.replace("p_name", F.lit(" "), F.lit(r"[-_\s]*")), F.lit(r"[-_\s]*"), (F.col("p_partkey") % 97).cast("string"), F.lit("(-|$)"))
    asked = part.where("p_partkey < 1000").select(F.concat(F.lit("custom-"), F.col("p_partkey").cast("string")).alias("encoding"), F.col("p_size").cast("int").alias("priority"), F.col("p_partkey").cast("int").alias("ord"), regex.alias("regex"))
    return named.join(match_patterns(named, asked), "name", "left").select("doc_id", "name", "encoding")


# -- documents in files -------------------------------------------------------------------------------------

#: Pages of a site's document.
OF_SITE = 40
FORM_FEED = "glyphflow.sources.documents:FORM_FEED"


@register(
    "paged_documents",
    f"""SELECT path, page_number, length(t) AS n_chars, sha256(t) AS sha256 FROM (
  SELECT 'site-' || page_id // {OF_SITE} || '.txt' AS path, CAST(row_number() OVER (PARTITION BY page_id // {OF_SITE} ORDER BY page_id) AS INTEGER) AS page_number, replace(coalesce(html, ''), chr(12), '') AS t FROM pages)
WHERE page_number BETWEEN 3 AND 9 AND starts_with(path, 'site-') AND path <> 'site-1.txt'""",
)
def paged_documents(s, d):
    """Web pages as documents of many pages, of which a filter reads some."""
    site = F.floor(F.col("page_id") / OF_SITE)
    page = F.struct("page_id", F.translate(F.coalesce("html", F.lit("")), "\f", "").alias("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(page)), lambda p: p["t"]), "\f")
    made = table(s, d, "pages").groupBy(site.alias("site")).agg(whole.alias("content")).select(F.format_string("site-%d.txt", F.col("site")).alias("name"), "content")
    shared_dir(s)
    with scratch(s, "documents") as at:
        documents.write_files(made, at)
        pages = documents.read_pages(s, at, format=FORM_FEED, task_bytes=1 << 18, pushdown=True)
        some = pages.where("page_number BETWEEN 3 AND 9 AND startswith(path, 'site-') AND path <> 'site-1.txt'")
        return some.select("path", "page_number", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha256")).checkpoint()


@register(
    "document_files",
    """SELECT 'c' || conv_id % 10 || '/conversation-' || conv_id || '.md' AS path, sha256(string_agg('**' || coalesce(role, '') || '**: ' || replace(coalesce(text, ''), chr(12), ''), chr(10) || chr(10) ORDER BY turn)) AS sha256
FROM conversations GROUP BY conv_id""",
)
def document_files(s, d):
    """A file for each conversation: what is there after a write that failed and one that was repeated."""
    said = F.concat(F.lit("**"), F.coalesce("role", F.lit("")), F.lit("**: "), F.translate(F.coalesce("text", F.lit("")), "\f", ""))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("t")))), lambda p: p["t"]), "\n\n")
    conversations = table(s, d, "conversations")
    made = conversations.groupBy("conv_id").agg(whole.alias("content"))
    made = made.select("conv_id", F.concat(F.lit("c"), (F.col("conv_id") % 10).cast("string"), F.lit("/conversation-"), F.col("conv_id").cast("string"), F.lit(".md")).alias("name"), "content")
    last = conversations.agg(F.max("conv_id")).first()[0] or 0
    shared_dir(s)
    with scratch(s, "files") as at:
        fails = made.where(F.col("conv_id") % 100 == 0).withColumn("content", F.when(F.col("conv_id") + 100 > last, F.raise_error(F.lit("the write fails here"))).otherwise("of the write that failed"))
        try:
            documents.write_files(fails, at)
        except PySparkException:
            pass  # what it has left must not be read
        documents.write_files(made.where(F.col("conv_id") % 3 == 0), at)
        documents.write_files(made, at)
        pages = documents.read_pages(s, at, format=FORM_FEED, ending=".md")
        return pages.select("path", F.sha2("text", 256).alias("sha256")).checkpoint()


# -- sessions as a stream -----------------------------------------------------------------------------------

TTL = 86_400
OPERATIONS = "SELECT user_id AS session_id, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'set_result' WHEN 'click' THEN 'delete' ELSE 'get' END AS kind, 'r' || event_id AS result FROM events"


@register(
    "session_states",
    f"""WITH RECURSIVE o AS (
  SELECT session_id, epoch_us(ts) AS "at", seq, kind, result, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS n FROM ({OPERATIONS})),
f(session_id, n, "at", seq, kind, created, busy, done, held, status, gone) AS (
  SELECT DISTINCT session_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, '', NULL::BIGINT, false, 0::BIGINT, NULL::VARCHAR, 0, NULL::BIGINT FROM o
  UNION ALL
  SELECT session_id, n, "at", seq, kind,
    CASE WHEN kind = 'create' THEN "at" WHEN NOT there OR kind = 'delete' THEN NULL ELSE created END,
    CASE WHEN kind = 'start' AND there THEN true WHEN there AND kind = 'get' THEN busy ELSE false END,
    CASE WHEN kind = 'set_result' AND there THEN "at" WHEN kind = 'create' THEN 0 ELSE done END,
    CASE WHEN kind = 'set_result' AND there THEN result WHEN kind IN ('create', 'delete') OR NOT there THEN NULL ELSE held END,
    CASE WHEN kind = 'create' THEN 200 WHEN NOT there THEN 404 WHEN kind = 'start' AND busy THEN 409 ELSE 200 END,
    CASE WHEN over THEN greatest(created + {TTL}000000, done) END
  FROM (SELECT *, created IS NOT NULL AND NOT over AS there FROM (
    SELECT o.session_id, o.n, o."at", o.seq, o.kind, o.result, f.created, f.busy, f.done, f.held, coalesce(f.created IS NOT NULL AND NOT f.busy AND o."at" - f.created > {TTL}000000, false) AS over
    FROM f JOIN o ON o.session_id = f.session_id AND o.n = f.n + 1))),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC) = 1)
SELECT session_id, "at", seq, kind, status, held AS result FROM f WHERE n > 0
UNION ALL SELECT session_id, gone, -1, 'expire', 410, NULL FROM f WHERE gone IS NOT NULL
UNION ALL SELECT session_id, greatest(created + {TTL}000000, done), -1, 'expire', 410, NULL FROM l WHERE created IS NOT NULL AND NOT busy""",
)
def session_states(s, d):
    """The events as operations, in four parts that the stream takes one after the other, and one that ends time."""
    kinds = F.create_map(*[F.lit(x) for pair in (("signup", "create"), ("view", "start"), ("purchase", "set_result"), ("click", "delete")) for x in pair])
    events = table(s, d, "events").select(
        F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.coalesce(kinds[F.col("event_type")], F.lit("get")).alias("kind"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("result")
    )
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    shared_dir(s)
    with scratch(s, "sessions") as at, session_state.rocks(s):
        cuts = [first + (last - first) * k / 4 for k in range(1, 4)] if first else []
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            part = events.where((F.lit(True) if low is None else F.col("ts") >= F.lit(low)) & (F.lit(True) if high is None else F.col("ts") < F.lit(high)))
            part.write.mode("append").parquet(f"{at}/in")
        s.range(1).select(F.lit(-1).cast("long").alias("session_id"), F.to_timestamp(F.lit("2200-01-01 00:00:00")).alias("ts"), F.lit(-1).cast("long").alias("seq"), F.lit("get").alias("kind"), F.lit(None).cast("string").alias("result")).write.mode("append").parquet(f"{at}/in")
        files = max(64, events.rdd.getNumPartitions())  # a part has no more, so batches stay few however large the parts are
        read = s.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/in")
        stream = session_state.session_states(read, TTL, "20 days")
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
        return s.read.schema(session_state.TOLD).parquet(f"{at}/out").checkpoint()


# -- budgets and send times ---------------------------------------------------------------------------------

ASKED = "SELECT source AS service, 'm' || doc_id % 3 AS month, doc_id % 100 AS made, doc_id AS id, CAST(length(coalesce(text, '')) AS BIGINT) AS n FROM documents"


@register(
    "budget_cut",
    f"""SELECT service, month, id, n, before, before + n <= 500000 AS allowed FROM (
  SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY service, month ORDER BY made, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN service LIKE '%2' THEN 490000 ELSE 0 END AS BIGINT) AS before FROM ({ASKED}))""",
)
def budget_cut(s, d):
    """Which texts a month's characters are enough for, one service having a good part of all texts."""
    i = F.col("doc_id")
    asked = table(s, d, "documents").select(F.col("source").alias("service"), F.concat(F.lit("m"), (i % 3).cast("string")).alias("month"), (i % 100).alias("at"), i.alias("id"), F.length("text").cast("long").alias("n"))
    used = asked.where("service LIKE '%2'").select("service", "month").distinct().withColumn("characters", F.lit(490_000))
    return usage.budget_cut(asked, used).select("service", "month", "id", "n", "before", "allowed")


@register(
    "send_times",
    """WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 1501 + 500 AS share FROM documents)
SELECT lang, doc_id, n, CAST(sum(CASE WHEN n = 1 THEN 0 ELSE CAST(2000 * share * CASE WHEN n > 10 THEN 2.25::DOUBLE WHEN n > 5 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS BIGINT) END) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS at_us FROM r""",
)
def send_times(s, d):
    """When each document's request is sent, if every language has one sender for all of a job's tasks."""
    return translate.send_times(table(s, d, "documents").select("lang", "doc_id"), ["doc_id"], ["lang"])
