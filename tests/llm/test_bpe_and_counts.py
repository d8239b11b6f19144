import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from helixframe.llm import bpe, token_counts

SCHEMA = "doc_id long, text string, ids string, decoded int"


@pytest.fixture(scope="module")
def reference():
    ranks, pattern = bpe.default_vocabulary()
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    letters = "aab bcdeéü\n\t  1234'sßñ漢字🙂 \u0085  %%%,.!?ABCÉ<|endoftext|>"
    made = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 200))) for _ in range(300)]
    return [*made, "", " ", "a" * 20_000, "\n" * 300, "the" * 400, "".join(map(chr, range(1, 0x2000))), None, None, "same", "same"]


def test_ids_equal_the_public_library_and_decode(spark, texts, reference):
    docs = spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts)], SCHEMA)
    rows = bpe.decode(bpe.encode(docs, keep_text=True)).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row["doc_id"]] or ""
        assert row["ids"] == reference.encode_ordinary(text)
        assert bytes(row["decoded"]) == text.encode()
        assert row["text"] == texts[row["doc_id"]]


def test_both_segment_trees_agree():
    vocabulary = bpe.Vocabulary(bpe.default_vocabulary()[0])
    draw = random.Random(5)
    for _ in range(400):
        data = bytes(draw.choice(b"abcdeinorstu \xc3\xa9") for _ in range(draw.randint(2, 64)))
        width = 1 << (len(data) - 1).bit_length()
        assert np.array(bpe.merge_one(data, vocabulary), "<i4").tobytes() == bpe.merge_many([data], width, vocabulary)[0]


def test_small_cache_changes_nothing(texts, monkeypatch):
    ranks, pattern = bpe.default_vocabulary()
    some = [t for t in texts[:60] if t]
    whole = bpe.Encoder(ranks, pattern)
    want = [whole.encode([t])[0].tolist() for t in some]
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    small = bpe.Encoder(ranks, pattern)
    assert [small.encode([t])[0].tolist() for t in some] == want


def test_unknown_ids_decode_to_nothing(spark):
    tokens = spark.createDataFrame([(1, [0, None, 10**6, -5]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(tokens).collect()}
    assert got == {1: b"!", 2: b"", 3: b""}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(none)).collect() == []
    assert token_counts.limit_answers(token_counts.length_histogram(none)).collect() == []


def test_query_digests(spark, tmp_path, texts, reference):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for row in bpe.op4(spark, str(tmp_path)).collect():
        text = texts[row["doc_id"]] or ""
        ids = reference.encode_ordinary(text)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_limit_answers(spark, tmp_path, texts, reference):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lengths = [len(reference.encode_ordinary(t or "")) for t in texts]
    rows = {r["n_tokens"]: r for r in token_counts.op8(spark, str(tmp_path)).collect()}
    assert {n: r["n_docs"] for n, r in rows.items()} == dict(Counter(lengths))
    for limit, row in rows.items():
        assert row["docs_from"] == sum(n >= limit for n in lengths)
        assert row["ids_from"] == sum(n for n in lengths if n >= limit)
        assert row["docs_upto"] == sum(n <= limit for n in lengths)
        assert row["ids_upto"] == sum(n for n in lengths if n <= limit)
        assert row["ids_cut"] == sum(min(n, limit) for n in lengths)
        assert (row["docs"], row["ids"]) == (len(lengths), sum(lengths))
    answers = token_counts.limit_answers(token_counts.length_histogram(spark.read.parquet(f"{tmp_path}/documents.parquet")))
    for row in token_counts.truncated_totals(answers, [0, 1, 7, 100, 10**6]).collect():
        assert row["docs_over"] == sum(n > row["context_limit"] for n in lengths)
        assert row["ids_cut"] == sum(min(n, row["context_limit"]) for n in lengths)
    half = answers.agg(token_counts.quantile(answers, 0.5).alias("q")).first()["q"]
    assert half == sorted(lengths)[-(-len(lengths) // 2) - 1]


def test_matches_met_again_stay_known(monkeypatch):
    """What the newer half of the cache pushes out is taken from the older one, not merged again."""
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 8)
    work = bpe.Encoder(*bpe.default_vocabulary())
    words = ["qzxqzx", "wvkjwvkj", "zzqqxxjj"]
    want = [work.encode([w])[0].tolist() for w in words]
    work.encode(["kkvvkkvv"]), work.encode(["jjwwqq"])
    merged = []
    many = bpe.merge_many
    monkeypatch.setattr(bpe, "merge_many", lambda data, *rest: merged.extend(data) or many(data, *rest))
    assert [work.encode([w])[0].tolist() for w in words] == want
    assert not merged
