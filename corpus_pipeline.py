"""Five stages that make a training corpus of raw documents; each calls one operator of glyphflow.llm.

Every stage is a function of (spark, docs, sf_dir), docs having the columns of documents; its result is written
as Parquet and read again as the next stage's docs.  All but the last return those columns.

Defined cases, in every stage: null and empty texts are documents like any other (not toxic, copies of each
other, without shingles, of size 0, without tokens); rows that share an id or have none are documents of their
own, decided on each by itself; empty tables stay empty.
"""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.llm.bpe import encode_texts, vocabulary_path
from glyphflow.llm.exact_dedup import exact_dedup
from glyphflow.llm.jaccard_join import jaccard_join
from glyphflow.llm.mixing import mix
from glyphflow.llm.toxicity import score_toxicity
from glyphflow.llm.workspace import Workspace, numbered

#: A word with the white space before it; splitting and joining by it gives back a text's beginning.
WORD_AND_GAP = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


#: Tables of numbered rows that results of stages still read.
_IN_USE: list[Workspace] = []


@atexit.register
def _remove() -> None:
    while _IN_USE:
        ws = _IN_USE.pop()
        if ws.spark.sparkContext._jsc is not None:  # the session may end before this module does
            ws.remove()


def _numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that tells its rows apart, and the column's name."""
    row = next(f"row_{i}" for i in range(len(docs.columns) + 1) if f"row_{i}" not in docs.columns)
    ws = Workspace(spark, "rows")
    rows, own = numbered(ws, docs, "doc_id", "text", row)
    if not own:
        _IN_USE.append(ws)
    return rows, row


def _texts(rows: DataFrame, row: str) -> DataFrame:
    return rows.select(F.col(row).alias("doc_id"), "text")


def _those(rows: DataFrame, row: str, ids: DataFrame) -> DataFrame:
    return rows.join(ids.toDF(row), row, "left_semi").drop(row)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are not predicted to be toxic."""
    rows, row = _numbered(spark, docs)
    scored = score_toxicity(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), row=row)
    return _those(rows, row, scored.where("predicted = 0").select(row))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    rows, row = _numbered(spark, docs)
    return _those(rows, row, exact_dedup(_texts(rows, row)).where("kept").select("doc_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each component of near copies."""
    rows, row = _numbered(spark, docs)
    return _those(rows, row, jaccard_join(_texts(rows, row)).where("doc_id = component_id").select("doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes it; the one at a source's cut has its first words only."""
    docs_, row = _numbered(spark, docs)
    taken = mix(docs_, row=row).where("taken > 0").select(F.col(row).alias("mix_row"), F.col("size").alias("mix_size"), F.col("taken").alias("mix_taken"))
    own = [f"mix_doc_{i}" for i in range(len(docs.columns))]  # whatever else the columns are called
    rows = docs_.select(*docs.columns, row).toDF(*own, "mix_of").join(taken, F.col("mix_of") == F.col("mix_row")).drop("mix_of", "mix_row")
    rows = rows.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.expr("(mix_taken - 1) div mix_size"))))
    rows = rows.select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns, strict=True)], F.col("mix_size"), (F.col("mix_taken") - F.col("mix_copy") * F.col("mix_size")).alias("mix_words"))
    words, size = F.col("mix_words"), F.col("mix_size")
    beginning = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD_AND_GAP), F.lit(0)), F.lit(1), words.cast("int")), "")
    text = F.when(words >= size, F.col("text")).otherwise(beginning)
    cut = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    with Workspace(spark, "encode", batch_rows=256) as ws:
        return ws.result(encode_texts(docs, vocabulary_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_documents),
]

#: Neither the scores nor the token ids can be expressed in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Workspace(spark, "pipeline") as ws:
        for k, (_, stage) in enumerate(STAGES):
            docs = ws.keep(stage(spark, docs, sf_dir), f"stage-{k}")
            _remove()
        return ws.result(docs)
