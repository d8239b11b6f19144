"""Stateless operators on streams.

Selection, validation, parsing and region filters are projections without
actions, so a streaming DataFrame passes through them unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.operators.selection import validate
from helixframe.sources.readers import parse_fasta


def fasta_stream(spark: SparkSession, path: str) -> DataFrame:
    """Sequences of FASTA files as they arrive in a folder, with the reason of any reject."""
    records = spark.readStream.option("lineSep", ">").text(path).select(F.col("value").alias("text"))
    return validate(parse_fasta(records.where(F.trim("text") != "")))
