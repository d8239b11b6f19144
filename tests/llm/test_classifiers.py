import random
import zlib

import numpy as np
import pytest

from helixframe.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def auc(rows, labels, name):
    held = [(r["score"], labels[r["doc_id"]][name]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    ones, zeros = [s for s, y in held if y], [s for s, y in held if not y]
    assert ones and zeros
    return np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros]), held


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_quality_of_held_out_rows(spark, labels):
    rows = quality.op7(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    area, held = auc(rows, labels, "quality")
    assert area > 0.97
    kept = [s >= quality.THRESHOLD for s, y in held if y]
    assert sum(kept) / len(kept) > 0.99
    for r in rows[:200]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)


def test_toxicity_of_held_out_rows(spark, labels):
    rows = toxicity.op5(spark, SF).collect()
    area, held = auc(rows, labels, "toxic")
    assert area > 0.97
    right = [(s >= 0.5) == y for s, y in held]
    assert sum(right) / len(right) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, score string, terms int, stats int")


@pytest.mark.parametrize("labels", [
    [], [(1, 1, 1)], [(i, None, None) for i in range(9)], [(i, 1, 1) for i in range(9)], [(None, 1, 0)],
    [(i, i % 2, i % 2) for i in range(9)] * 2 + [(3, 0, 0)],
])
def test_odd_rows_and_labels(spark, labels):
    rows = [(i, t, "c", 1, 1) for i, t in enumerate([None, "", "a", "a", "Ä! " * 3000, "x\ny\nx", "|", "1 2 3", "你好"])]
    rows += [(None, "no id", "c", 1, 1), (3, "again", "c", 1, 1)]
    docs = made(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for out in (
        quality.score(docs, quality.fit(quality.with_statistics(docs), marks), "text"),
        quality.score(quality.with_statistics(docs), quality.fit(quality.with_statistics(docs), marks)),
        toxicity.score(docs, toxicity.fit(docs, marks)),
    ):
        scores = [r["score"] for r in out.collect()]
        assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores)
    assert quality.score(docs.limit(0), quality.fit(quality.with_statistics(docs), marks), "text").collect() == []
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), marks)).collect() == []


def test_pairs_of_harmless_terms(spark):
    """Two words are toxic only together; additive weights cannot separate the four cases."""
    draw = random.Random(2)
    filler = [f"word{chr(97 + i)}" for i in range(26)]
    rows, labels = [], []
    for i in range(1200):
        has = draw.random() < 0.5, draw.random() < 0.5
        words = draw.sample(filler, 5) + ["group"] * has[0] + ["awful"] * has[1]
        draw.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(all(has))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    machine = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, machine).collect()}
    right = [(scores[i] >= 0.5) == bool(y) for i, y in labels]
    assert sum(right) / len(right) > 0.99


@pytest.mark.parametrize("case", ["neutral", "clean"])
def test_pairs_with_a_term_that_is_not_toxic_alone(spark, case):
    """An insult is toxic only beside a group that is as common in clean rows, or only if it is not quoted."""
    draw = random.Random(4)
    filler = [f"word{chr(97 + i)}" for i in range(26)]
    rows, labels, others = [], [], []
    for i in range(2000):
        insult, threat = draw.random() < 0.3, case == "neutral" and draw.random() < 0.15
        other = draw.random() < (0.5 if case == "clean" or insult or threat else 0.9)
        words = draw.sample(filler, 5) + ["insult"] * insult + ["threat"] * threat + ["other"] * other
        draw.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(threat or insult and other == (case == "neutral"))))
        others.append(other)
    shares = [np.mean([o for o, (_, y) in zip(others, labels) if y == want]) for want in (0, 1)]
    assert abs(shares[0] - shares[1]) < 0.06 if case == "neutral" else shares[0] > shares[1] + 0.2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    machine = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, machine).collect()}
    right = [(scores[i] >= 0.5) == bool(y) for i, y in labels]
    assert sum(right) / len(right) > 0.98


def test_toxicity_fit_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs, marks = docs.unionByName(docs.limit(50).withColumn("text", docs["text"].substr(1, 300))), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    one, two = (toxicity.fit(docs.repartition(n), marks) for n in (1, 7))
    assert one.places == two.places and one.bias == two.bias
    assert (one.linear == two.linear).all() and (one.factors == two.factors).all()


def test_margin_is_linear_plus_all_pairs():
    draw = np.random.default_rng(1)
    machine = toxicity.Machine({}, 0.3, draw.normal(size=9), draw.normal(size=(9, 3)))
    rows = [np.array([0, 3, 5]), np.array([], int), np.array([8]), np.arange(9)]
    want = [
        0.3 + machine.linear[r].sum() + sum(machine.factors[i] @ machine.factors[j] for i in r for j in r if i < j) for r in rows
    ]
    assert np.allclose(machine.margin(np.concatenate(rows), np.array([len(r) for r in rows])), want)


def test_pooled_is_the_isotonic_fit():
    draw = np.random.default_rng(4)
    weight, target = draw.integers(1, 9, 40).astype(float), draw.normal(size=40) + np.arange(40) / 10
    got = quality.pooled(weight, target)
    # Min-max formula of isotonic regression.
    mean = lambda a, b: np.average(target[a : b + 1], weights=weight[a : b + 1])
    want = [max(min(mean(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(got, want)


def test_fit_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    models = [quality.fit(quality.with_statistics(docs.repartition(n)), marks) for n in (1, 7)]
    assert (models[0].weights == models[1].weights).all() and all((a == b).all() for a, b in zip(models[0].curve, models[1].curve))
