"""From raw documents to token ids: filters, one document of each near-duplicate group, mix, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.llm import bpe, mixing, near_duplicates, quality, toxicity
from helixframe.llm.common import table
from helixframe.session import cut_lineage, scratch_path

#: The filters are fitted models; no SQL says them.  tests/llm compares the stages with plain Python.
ORACLE_SQL = None


#: Rows that travel to Python at once.  A stage's batches of whole texts and shingle sets stand in memory on
#: both sides, in every task of an executor.
ARROW_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``ARROW_ROWS``; smaller ones stay as they are."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(name))
    if held <= 0 or held > ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def _plain(docs: DataFrame) -> DataFrame:
    """The documents under names that no operator uses."""
    return docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])


def _plain_name(docs: DataFrame, column: str) -> str:
    return f"_{docs.columns.index(column)}"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels of these documents."""
    _small_batches(spark)
    stats = cut_lineage(quality.with_statistics(docs.select("doc_id", "text")))
    model = quality.fit(stats, table(spark, sf_dir, "labels"))
    scored = quality.score(_plain(docs), model, _plain_name(docs, "text"))
    return scored.where(F.col("score") >= quality.THRESHOLD).drop("score").toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject; it learns from the labels of these documents."""
    _small_batches(spark)
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(_plain(docs), machine, _plain_name(docs, "text"))
    return scored.where(F.col("score") < toxicity.THRESHOLD).drop("score").toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more."""
    _small_batches(spark)
    return near_duplicates.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and whether they decode to its text."""
    _small_batches(spark)
    vocabulary = bpe.default_vocabulary()
    tokens = bpe.decode(bpe.encode(docs.select("doc_id", "source", "text"), vocabulary, keep_text=True), vocabulary)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return tokens.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), same.alias("round_trip"), "ids")


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
