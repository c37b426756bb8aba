"""Names by which SQL can call the functions that have no built-in."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .markup import clean_markup, section_text
from .similarity import block_overlap_udf, opening_udf, ratio_udf, relevance_udf
from .text import _nfc


def register(spark: SparkSession) -> None:
    for name, function in {
        "seq_ratio": ratio_udf, "opening_similarity": opening_udf(), "opening_similarity_anywhere": opening_udf(window=True), "block_overlap": block_overlap_udf,
        "title_relevance": relevance_udf, "nfc": _nfc, "clean_markup": clean_markup, "section_text": section_text,
    }.items():
        spark.udf.register(name, function)
