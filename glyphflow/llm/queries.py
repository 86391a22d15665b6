"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_dedup, exact_dedup, filter_audit, html_extract, jaccard_join, licenses, mixing, periodic_runs, substring_dedup, toxicity, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_mixing": mixing.op6_mixing,
    "op7_bpe": bpe.op7_bpe,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_html_text": html_extract.op9_html_text,
    "op10_licenses": licenses.op10_licenses,
    "op11_warc": warc.op11_warc,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op4_url_filter": url_filter.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op10_licenses": licenses.ORACLE,
    "op11_warc": warc.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
