"""The relations behind the encodings: glyph tables, patterns, languages and options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..data import languages as L
from ..data.encodings import CATALOG, PARTS, SCRIPT, glyphs, map_rows
from ..data.fonts import BY_PRIORITY


def encodings(spark: SparkSession) -> DataFrame:
    rows = [(e, family, language, SCRIPT, "1.0", variants) for e, family, language, variants in CATALOG]
    return spark.createDataFrame(rows, "encoding string, font_family string, language string, script string, version string, variants array<string>")


def glyph_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(map_rows(), "encoding string, ord int, legacy string, unicode string")


def signatures(spark: SparkSession) -> DataFrame:
    rows = [(e, p, i, s) for e, p, _, sigs in BY_PRIORITY for i, s in enumerate(sigs)]
    return spark.createDataFrame(rows, "encoding string, priority int, ord int, sig string")


def font_patterns(spark: SparkSession) -> DataFrame:
    rows = [(e, p, i, r) for e, p, patterns, _ in BY_PRIORITY for i, r in enumerate(patterns)]
    return spark.createDataFrame(rows, "encoding string, priority int, ord int, regex string")


def reverse_map(glyphs: DataFrame) -> DataFrame:
    """encoding, unicode, legacy: the first key, in order of application, that gives each character."""
    return glyphs.groupBy("encoding", "unicode").agg(F.min_by("legacy", "ord").alias("legacy"))


def listing(builtin: DataFrame, files: DataFrame | None = None, search: str | None = None) -> DataFrame:
    """encoding, font_family, language, source: built-in tables and those of files, by name; search: a part of it."""
    names = builtin.select("encoding")
    names = names.union(files.select("encoding")).distinct() if files is not None else names
    out = names.join(builtin, "encoding", "left").select(
        "encoding", F.coalesce("font_family", F.lit("External")).alias("font_family"), F.coalesce("language", F.lit("-")).alias("language"), F.when(F.col("font_family").isNull(), "file").otherwise("builtin").alias("source")
    )
    return out.where(F.lower("encoding").contains(search.lower())) if search else out


def matching(term: Column) -> Column:
    """array<struct<encoding, font_family, language>>: the built-in tables whose name has the term, in any case."""
    names = F.array(*[F.struct(F.lit(e).alias("encoding"), F.lit(family).alias("font_family"), F.lit(language).alias("language")) for e, family, language, _ in CATALOG])
    return F.filter(names, lambda x: x["encoding"].contains(F.lower(term)))


def shared_keys(encoding: str) -> list[str]:
    """Keys of a table's first part that a later part has too."""
    first, *later = PARTS[encoding]
    return [k for k in first if any(k in part for part in later)]


def holds_any(text: Column, keys: list[str]) -> Column:
    """Whether a text has one of the keys.

    A place is looked at only if it may be a key's beginning: printable ASCII by one range where no key begins so, else
    by the class of all first characters.  Keys of one character are a class and not tried one after another.
    """
    if not keys:
        return F.lit(False)
    written = lambda k: "".join(f"\\x{{{ord(c):x}}}" for c in k)
    firsts = sorted({k[0] for k in keys})
    singles, longer = [k for k in keys if len(k) == 1], [k for k in keys if len(k) > 1]
    guard = "(?![ -~])" if not any(" " <= c <= "~" for c in firsts) else f"(?=[{''.join(map(written, firsts))}])"
    return text.rlike(f"{guard}(?:{'|'.join([f'[{written(singles)}]'] * bool(singles) + [written(k) for k in longer])})")


def key_of(encoding: str, number: Column) -> Column:
    """A table's key by number, counted on from the first after the last, in the order of application."""
    keys = list(glyphs(encoding))
    return F.get(F.array(*map(F.lit, keys)), (number % len(keys)).cast("int"))


def overlaps(spark: SparkSession) -> DataFrame:
    """encoding, n_base, n_overlap: keys of a table's first part that a later part has too."""
    rows = [(e, i, k) for e, parts in PARTS.items() for i, part in enumerate(parts) for k in part]
    keys = spark.createDataFrame(rows, "encoding string, part int, legacy string")
    base, later = keys.where("part = 0").select("encoding", "legacy"), keys.where("part > 0").select("encoding", "legacy")
    both = base.intersect(later).groupBy("encoding").agg(F.count(F.lit(1)).alias("n_overlap"))
    return base.groupBy("encoding").agg(F.count(F.lit(1)).alias("n_base")).join(both, "encoding", "left").select("encoding", "n_base", F.coalesce("n_overlap", F.lit(0)).alias("n_overlap"))


def file_name(encoding: Column) -> Column:
    """An encoding's name as files have it."""
    return F.translate(F.lower(encoding), " _", "--")


def _look_up(code: Column, table: dict[str, str], default: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(pairs[F.lower(code)], default)


def source_language(encoding: Column) -> Column:
    return _look_up(encoding, L.OF_ENCODING, F.lit(L.DEFAULT_SOURCE))


def language_name(code: Column) -> Column:
    return _look_up(code, L.NAMES, code)


def google_code(code: Column) -> Column:
    return _look_up(code, L.GOOGLE, F.lower(code))


def mymemory_code(code: Column) -> Column:
    return _look_up(code, L.MYMEMORY, F.lower(code))


def tesseract_code(code: Column) -> Column:
    return _look_up(code, L.TESSERACT, F.lower(code))


def encodings_by_language(spark: SparkSession) -> DataFrame:
    """language and its encodings, in the order they are defined."""
    rows = spark.createDataFrame([(i, e, c) for i, (e, c) in enumerate(L.OF_ENCODING.items())], "ord int, encoding string, language string")
    ordered = F.array_sort(F.collect_list(F.struct("ord", "encoding")))
    return rows.groupBy("language").agg(F.transform(ordered, lambda r: r["encoding"]).alias("encodings"))


def options(spark: SparkSession) -> DataFrame:
    """kind, ord, code, label of everything the service offers."""
    tables = {"target_language": L.TARGETS} | L.OPTIONS
    return spark.createDataFrame([(kind, i, c, label) for kind, t in tables.items() for i, (c, label) in enumerate(t.items())], "kind string, ord int, code string, label string")
