import pytest
from pyspark.sql import functions as F

from helixframe.llm import mixing


def targets_by_hand(sizes, weights, budget, passes):
    """Give every source its share, cap those above, share the rest again."""
    total, capped = sum(sizes) * budget / 100, {}
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(capped.values())
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free} if free else {}
        above = [i for i in free if share[i] > passes * sizes[i]]
        if not above:
            return [capped.get(i, share.get(i)) for i in range(len(sizes))]
        capped |= {i: passes * sizes[i] for i in above}


def corpus(spark):
    rows = []
    for source, count in [("b", 400), ("a", 60), ("é", 30), (None, 90), ("c", 8), ("empty", 5)]:
        for i in range(count):
            text = " ".join(["w"] * (i * 7 % 40)) if source != "empty" else ["", None][i % 2]
            rows.append((len(rows), text, source, "x", i))
    rows += [(5, "same words here", "a", "x", 1)] * 30 + [(None, "no id", "b", "x", 1)] * 40
    return spark.createDataFrame(rows, "doc_id long, text string, source string, uid string, size int"), rows


def test_targets_and_taken(spark, tmp_path):
    docs, rows = corpus(spark)
    docs.select("doc_id", "text", "source").write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op1(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by_source = {}
    for _, text, source, _, _ in rows:
        by_source[source] = by_source.get(source, 0) + len((text or "").split())
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    weights = [(5, 2, 1)[i % 3] for i in range(len(names))]
    want = dict(zip(names, targets_by_hand([by_source[n] for n in names], weights, 150, 2)))
    assert sorted({(r["source_size"], round(r["target"], 6)) for r in got}) == sorted({(by_source[n], round(want[n], 6)) for n in names})
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    total = sum(by_source.values())
    assert 1.5 * total - 40 <= sum(r["taken"] for r in got) <= 1.5 * total
    for name in names:
        target = round(want[name], 6)
        taken = sum(r["taken"] for r in got if round(r["target"], 6) == target and r["source_size"] == by_source[name])
        assert abs(taken - target) <= 60
    again = mixing.op1(spark, str(tmp_path)).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(again, key=key)


def test_mixed_corpus_has_the_columns_and_the_counts(spark):
    docs, rows = corpus(spark)
    mixed = mixing.mix(docs)
    assert mixed.schema == docs.schema
    size = mixed.agg(F.sum(mixing.words(F.col("text"))).alias("s")).first()["s"]
    total = sum(len((r[1] or "").split()) for r in rows)
    assert 1.5 * total - 40 <= size <= 1.5 * total
    assert mixed.groupBy(*docs.columns).count().join(docs.groupBy(*docs.columns).agg(F.count("*").alias("n")), docs.columns).where("count > 2 * n").count() == 0


@pytest.mark.parametrize("rows", [[], [(1, None, "a")], [(1, "", None), (2, "", "a")]])
def test_nothing_to_mix(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing.mix(docs).collect() == []


def test_words(spark):
    text = spark.createDataFrame([("a\u00a0b c\x0b\x1cd\n\n e",), (None,), ("",), (" \t",)], "t string")
    assert [r[0] for r in text.select(mixing.words(F.col("t"))).collect()] == [4, 0, 0, 0]
