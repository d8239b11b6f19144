"""Exact token counts for every context limit, from one histogram of encoded lengths.

Documents are encoded once and aggregated by their number of ids; the table of
lengths is as large as the number of different lengths, not of documents.
Running sums over it from the long end answer every question about a limit L:
documents of at least L ids, ids kept when each document is cut at L, documents
that fit, and the quantiles.

Results: null and empty texts have length 0 and count as documents.  Rows count
one by one, also repeated ones.  An empty table gives an empty histogram, and
no answers.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helixframe.llm.bpe import default_vocabulary, encode
from helixframe.llm.common import query, table
from helixframe.operators.ordered import prefix_scan
from helixframe.session import cut_lineage


def length_histogram(docs: DataFrame, vocabulary: tuple[bytes, str] | None = None, text: str = "text") -> DataFrame:
    """``n_tokens, n_docs`` over all documents; partial sums before the shuffle."""
    ids = encode(docs.select(text), vocabulary, text)
    return ids.groupBy(F.size("ids").cast("bigint").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def limit_answers(histogram: DataFrame) -> DataFrame:
    """Add to each length, taken as a limit: documents and ids at or above it (suffix
    sums) and at or below it, and the ids left when every document is cut there."""
    # Written once, so that the documents are encoded once however often it is read.
    held = cut_lineage(histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("_ids")))
    run = prefix_scan(held, [], [(F.col("n_tokens"), "desc")], docs_from=("sum", "n_docs"), ids_from=("sum", "_ids"))
    run = run.withColumns({"docs": held.agg(F.sum("n_docs")).scalar(), "ids": held.agg(F.sum("_ids")).scalar()})
    return run.select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "ids_from",
        (F.col("docs") - F.col("docs_from") + F.col("n_docs")).alias("docs_upto"),
        (F.col("ids") - F.col("ids_from") + F.col("_ids")).alias("ids_upto"),
        (F.col("ids") - F.col("ids_from") + F.col("n_tokens") * F.col("docs_from")).alias("ids_cut"),
        "docs",
        "ids",
    )


def truncated_totals(answers: DataFrame, limits: list[int]) -> DataFrame:
    """Ids kept under limits that need not be lengths: ``context_limit, docs_over, ids_cut``.

    A document above the limit counts with the limit.
    """
    out = None
    for limit in limits:
        over = F.col("n_tokens") > limit
        one = answers.agg(
            F.lit(limit).cast("bigint").alias("context_limit"),
            F.coalesce(F.max(F.when(over, F.col("docs_from"))), F.lit(0)).alias("docs_over"),
            F.coalesce(F.max(F.when(~over, F.col("ids_upto"))), F.lit(0)).alias("_under"),
        ).select("context_limit", "docs_over", (F.col("_under") + F.col("docs_over") * limit).alias("ids_cut"))
        out = one if out is None else out.unionByName(one)
    return out


def quantile(answers: DataFrame, share: float) -> Column:
    """Aggregate over ``limit_answers``: smallest length that covers ``share`` of the documents."""
    return F.min(F.when(F.col("docs_upto") >= F.ceil(F.col("docs") * share), F.col("n_tokens")))


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of all documents with the answers of every limit that is a length."""
    histogram = length_histogram(table(spark, sf_dir, "documents"), default_vocabulary())
    return limit_answers(histogram).withColumn("quantile", F.col("docs_upto") / F.col("docs"))
