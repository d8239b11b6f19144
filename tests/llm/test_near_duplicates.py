import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import near_duplicates as nd
from helixframe.llm.components import join_components


def sets_of(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def by_hand(rows, size, percent):
    sets = [sets_of(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            both = len(sets[i] & sets[j])
            linked = both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)
            if linked or rows[i][0] == rows[j][0]:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), None if d is None else least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, copies=60):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [draw.choice(vocabulary) for _ in range(n)]

    def edited(words, edits):
        words = list(words)
        for _ in range(edits):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        return words

    texts = [" ".join(text(draw.randint(1, 120))) for _ in range(80)]
    base = text(150)
    texts += [" ".join(edited(base, draw.randint(0, 7))) for _ in range(copies)]  # a loose group
    chain = text(100)
    for _ in range(25):  # each near the one before, the ends far apart
        chain = edited(chain, 2)
        texts.append(" ".join(chain))
    shared = text(60)
    texts += [" ".join(text(30) + shared + text(30)) for _ in range(30)]
    texts += ["Same Text here now", "same text\nhere  now", "same text here now!", "a b", "A b", "a", "", " \t", None, None]
    texts += [texts[0]] * 5
    ids = list(range(len(texts)))
    draw.shuffle(ids)
    return list(zip(ids, texts)) + [(ids[0], texts[0]), (ids[1], "another text under one id"), (None, texts[0]), (None, None)]


@pytest.mark.parametrize("size, percent, seed", [(3, 85, 1), (5, 80, 2)])
def test_components(spark, size, percent, seed, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 16)
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, bands int, node string")
    got = nd.classes(docs, size, percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == by_hand(rows, size, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_block_stage_alone_finds_every_link(spark, monkeypatch):
    """With leaders that link nothing all links come from the blocks, also from buckets of many blocks."""
    monkeypatch.setattr(nd, "BLOCK", 8)
    monkeypatch.setattr(nd, "_alike", lambda pairs, *_: pairs.limit(0))
    rows = corpus(3)
    got = nd.classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == by_hand(rows, 3, 85)


def test_deduplicate_keeps_columns(spark):
    rows = corpus(4, 10)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, kept int")
    out = nd.deduplicate(docs, 3, 85)
    # Texts are groups of their own, also under one id: number the rows.
    known = [(d, t) for d, t in rows if d is not None]
    numbered = by_hand(list(enumerate(t for _, t in known)), 3, 85)
    members = {}
    for i, _, c in numbered:
        members.setdefault(c, []).append(known[i][0])
    want = [min(m) for c, m in members.items()]
    got = out.collect()
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(want)
    assert sum(r["doc_id"] is None for r in got) == 2


def test_every_text_of_an_id_counts(spark):
    a, b, c = "one two three four five six seven", "other words that are like nothing here", "a third text of the same id"
    rows = [(7, a), (7, b), (8, a), (9, b), (7, c), (10, ""), (7, "")]
    got = nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(7, 7)] * 4 + [(8, 7), (9, 7), (10, 10)]
    out = nd.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in out) == sorted([(7, a), (7, b), (7, c), (7, ""), (10, "")])


def test_the_row_that_stays_is_the_least(spark):
    a = "one two three four five six seven"
    rows = [(7, a, "z", 1), (7, a, "b", 2), (8, a, "a", 0), (7, a, "b", 3), (9, "something else that stays in any case", None, 1)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string, _place int").repartition(3)
        assert sorted(tuple(r) for r in nd.deduplicate(docs).collect()) == [rows[1], rows[4]]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (2, "")], [(None, "a b c d")] * 3])
def test_little(spark, rows):
    got = nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, [(r["doc_id"], r["component_id"]) for r in got])) == sorted(map(str, [(d, d) for d, _ in rows]))


def test_estimate_is_near_the_similarity():
    rows, bands = nd.band_shape(85)
    multipliers = nd._multipliers(rows * bands)
    draw = np.random.default_rng(3)
    errors = []
    for _ in range(40):
        pool = draw.integers(0, 1 << 63, 600, np.uint64)
        a, b = np.sort(pool[:500]), np.sort(pool[draw.integers(0, 120) :])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        bits = [np.frombuffer(nd.signature(nd.minima(x, multipliers)), np.uint8) for x in (a, b)]
        errors.append(nd.estimated(bits[0], bits[1], rows * bands) - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_outlines_rule_out_no_link():
    draw = np.random.default_rng(8)
    close = 0
    for _ in range(400):
        pool = draw.integers(0, 1 << 63, draw.integers(5, 6000), np.uint64)
        a, b = np.unique(pool[draw.random(len(pool)) < 0.95]), np.unique(pool[draw.random(len(pool)) < 0.95])
        common = len(np.intersect1d(a, b))
        linked = 100 * common >= 85 * (len(a) + len(b) - common)
        x, y = (np.frombuffer(nd.outline(v), np.uint8) for v in (a, b))
        assert nd.may_reach(len(a), x, np.array([len(b)]), y[None], 85)[0] or not linked
        close += linked
    assert close > 100
    far = [np.frombuffer(nd.outline(draw.integers(0, 1 << 63, 150, np.uint64)), np.uint8) for _ in range(2)]
    assert not nd.may_reach(150, far[0], np.array([150]), far[1][None], 85)[0]


def test_components_of_links(spark):
    draw = random.Random(1)
    nodes = list(range(300))
    links = [(i, i + 1) for i in range(0, 90)] + [(draw.randrange(100, 300), draw.randrange(100, 300)) for _ in range(90)] + [(5, 5), (7, None), (1, 9999)]
    labels = spark.createDataFrame([(n, n) for n in nodes], "node long, comp long")
    got = dict(tuple(r) for r in join_components(labels, spark.createDataFrame(links, "a long, b long")).collect())
    comp = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            if a in comp and b in comp:
                comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == comp


def test_estimate_of_sets_that_differ_in_low_bits():
    """The differing shingles share no residue modulo 4 with the others; chance equality must not depend on that."""
    draw = np.random.default_rng(8)
    rows, bands = nd.band_shape(85)
    multipliers, errors = nd._multipliers(rows * bands), []
    for _ in range(100):
        values = draw.integers(0, 1 << 62, 20, np.uint64) * np.uint64(4)
        values[17:] += np.array([1, 2, 2], np.uint64)
        one, two = values[:18], np.concatenate([values[:17], values[18:]])
        bits = [np.frombuffer(nd.signature(nd.minima(np.sort(x), multipliers)), np.uint8) for x in (one, two)]
        errors.append(nd.estimated(bits[0], bits[1], rows * bands) - 17 / 20)
    assert abs(np.mean(errors)) < 0.01


def test_small_sets_are_confirmed_without_estimate(spark, monkeypatch):
    monkeypatch.setattr(nd, "least_estimate", lambda percent, count: 2.0)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, "some other text of its own")], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in nd.classes(docs).collect()}
    assert found[1] == found[2] != found[3]
