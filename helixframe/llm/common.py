"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

#: Text bytes that one task turns into output at a time.
SLICE_BYTES = 2 << 20


def query(name: str, sql: str | None = None):
    """Register ``plan(spark, sf_dir)`` under ``name``, with its oracle statement if SQL can say it."""

    def register(plan):
        _QUERIES[name] = plan
        if sql is not None:
            _ORACLES[name] = sql
        return plan

    return register


def registered() -> tuple[dict, dict]:
    return dict(_QUERIES), dict(_ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each; a longer value stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = held = 0
        for row, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += size
        yield batch.slice(begin)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch; null counts as empty."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def held_out(doc_id: Column) -> Column:
    """Rows kept from every fit: crc32 of the decimal id is divisible by 5.  A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, name: str) -> DataFrame:
    """One target per ``doc_id`` that may be learned from: the mean of its labels.

    Held-out ids, null ids and null labels are left out.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull() & ~held_out(F.col("doc_id")))
    return usable.groupBy("doc_id").agg(F.avg(F.col(name).cast("double")).alias("target"))
