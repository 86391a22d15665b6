"""Glyph tables from files in any store that Spark reads, beside the built-in ones."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import glyph_map

#: Endings in the order in which they are tried.
ENDINGS = (".yaml", ".yml", ".json")
ROWS = "encoding string, ord int, legacy string, unicode string"


class MappingError(ValueError):
    """A mapping file that has no mappings, or can't be read."""


def file_name(encoding: str) -> str:
    """An encoding's name as files have it."""
    return encoding.lower().replace(" ", "-").replace("_", "-")


def _path(spark: SparkSession, name: str):
    """A path of Hadoop's and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def find(spark: SparkSession, encoding: str, folders: Iterable[str]) -> str | None:
    """The first file of the encoding: folder by folder, ending by ending."""
    for folder in folders:
        for ending in ENDINGS:
            path, files = _path(spark, f"{folder.rstrip('/')}/{file_name(encoding)}{ending}")
            if files.exists(path):
                return path.toString()
    return None


def parse(text: str, ending: str) -> dict:
    if ending == ".json":
        try:
            data = json.loads(text)
        except ValueError as e:
            raise MappingError(str(e)) from e
    else:
        try:
            import yaml
        except ImportError as e:
            raise MappingError("YAML files need PyYAML") from e
        data = yaml.safe_load(text)
    if not isinstance(data, dict) or "mappings" not in data:
        raise MappingError("no mappings")
    return data


def table_of(data: dict) -> dict[str, str]:
    """The keys in the order they are applied: base, ligatures, half forms; longest first."""
    merged = {**data["mappings"], **(data.get("ligatures") or {}), **(data.get("half_forms") or {})}
    return dict(sorted(merged.items(), key=lambda kv: -len(kv[0])))


def load(spark: SparkSession, encoding: str, folders: Iterable[str] = ()) -> DataFrame:
    """encoding, ord, legacy, unicode: the built-in table if there is one, else the file's."""
    builtin = glyph_map(spark).where(F.col("encoding") == encoding)
    path = None if builtin.limit(1).count() else find(spark, encoding, folders)
    if path is None:
        return builtin
    text = spark.read.text(path, wholetext=True).first()
    rows = [(encoding, i, k, v) for i, (k, v) in enumerate(table_of(parse(text.value if text else "", path[path.rindex(".") :])).items())]
    return spark.createDataFrame(rows, ROWS)


def available(spark: SparkSession, folders: Iterable[str]) -> list[str]:
    """Encodings that have a file."""
    found = set()
    for folder in folders:
        path, files = _path(spark, folder)
        for status in files.listStatus(path) if files.exists(path) else []:
            stem, dot, ending = status.getPath().getName().rpartition(".")
            if dot + ending in ENDINGS:
                found.add(stem)
    return sorted(found)


def read_tables(spark: SparkSession, folder: str) -> DataFrame:
    """encoding, ord, legacy, unicode, error of every mapping file of a folder, read where the files are dealt to; a
    file that can't be read is a row with its error.  The encoding is the file's name."""
    schema = pa.schema([("encoding", pa.string()), ("ord", pa.int32()), ("legacy", pa.string()), ("unicode", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                stem, _, ending = path.rpartition("/")[2].rpartition(".")
                try:
                    table = table_of(parse(content.decode(), f".{ending}"))
                    rows = [{"encoding": stem, "ord": i, "legacy": k, "unicode": v} for i, (k, v) in enumerate(table.items())]
                except Exception as e:  # whatever is wrong with the file
                    rows = [{"encoding": stem, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{yaml,yml,json}").load(folder)
    return files.select("path", "content").mapInArrow(run, f"{ROWS}, error string")
