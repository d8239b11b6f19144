from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from helixframe.llm import bpe, quality, toxicity
from test_near_duplicates import by_hand

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Documents before the first and after every stage, written and read like in a run."""
    folder = tmp_path_factory.mktemp("stages")
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs[-1], SF).write.parquet(f"{folder}/{name}")
        docs.append(spark.read.parquet(f"{folder}/{name}"))
    return docs


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_columns(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mix", "bpe"]
    for before, after in zip(steps, steps[1:-1]):
        assert after.columns == before.columns


def test_filters_keep_what_the_scores_say(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stats = quality.with_statistics(steps[0].select("doc_id", "text"))
    scored = quality.score(stats, quality.fit(stats, labels)).collect()
    assert sorted(r["doc_id"] for r in scored if r["score"] >= quality.THRESHOLD) == sorted(d for d, in rows(steps[1], "doc_id"))
    machine = toxicity.fit(steps[1], labels)
    scored = toxicity.score(steps[1], machine).collect()
    assert sorted(r["doc_id"] for r in scored if r["score"] < toxicity.THRESHOLD) == sorted(d for d, in rows(steps[2], "doc_id"))


def test_one_of_each_group_stays(steps):
    want = {c for _, _, c in by_hand(rows(steps[2], "doc_id", "text"), 5, 80)}
    assert sorted(d for d, in rows(steps[3], "doc_id")) == sorted(want)


def test_mix_repeats_whole_documents(steps):
    whole = Counter(rows(steps[3], *steps[3].columns))
    mixed = Counter(rows(steps[4], *steps[4].columns))
    assert set(mixed) <= set(whole) and all(n <= 2 * whole[r] for r, n in mixed.items())
    size = lambda counted: sum(n * len(r[1].encode().split()) for r, n in counted.items())
    longest = max(len(r[1].encode().split()) for r in whole)
    assert 1.5 * size(whole) - longest <= size(mixed) <= 1.5 * size(whole)


def test_ids_decode(steps):
    texts = {r[0]: r[1] for r in rows(steps[4], "doc_id", "text")}
    work = bpe.encoder(*bpe.default_vocabulary())
    out = steps[5].collect()
    assert Counter(r["doc_id"] for r in out) == Counter(d for d, in rows(steps[4], "doc_id"))
    for r in out:
        assert r["round_trip"] and r["n_tokens"] == len(r["ids"])
        assert r["ids"] == work.encode([texts[r["doc_id"]]])[0].tolist()


def test_stages_take_odd_rows(spark, tmp_path):
    odd = [(1, None, "en", "a", 0), (2, "", None, None, None), (None, "some text", "en", "a", 9), (3, "same", "en", "a", 4), (3, "same", "en", "a", 4)]
    spark.createDataFrame(odd, steps_schema(spark)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(r["doc_id"] for r in out.collect()) <= {1, 2, 3, None}
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []


def steps_schema(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").schema
