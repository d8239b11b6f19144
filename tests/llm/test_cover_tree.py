import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import cover_tree
from helixframe.llm.cover_tree import Tree, search

LIMIT = (1 << 63) - 1


def by_hand(rows, every=50):
    """Rows (id, label, embedding) to (anchor, positive, rank, negative, scores)."""
    usable = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for at, (anchor, label, v) in enumerate(usable):
        if anchor % every:
            continue
        scored = [(-max(-LIMIT - 1, min(LIMIT, sum(a * b for a, b in zip(v, w)))), i, other) for k, (i, other, w) in enumerate(usable) if k != at and len(w) == len(v)]
        for p, positive, _ in sorted(s for s in scored if s[2] == label)[:5]:
            hard = sorted((n, i) for n, i, other in scored if other != label and 50 * -p <= 100 * -n <= 95 * -p)[:3]
            out += [(anchor, positive, rank, i, -p, -n) for rank, (n, i) in enumerate(hard, 1)]
    return sorted(out)


def clusters(seed, count, centres, spread, width=24):
    draw = np.random.default_rng(seed)
    middle = draw.normal(0, 1, (centres, width))
    its = draw.integers(0, centres, count)
    return its, middle[its] + draw.normal(0, spread, (count, width))


def run(spark, folder, rows):
    made = [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v], 1, 2, "x") for i, label, v in rows]
    schema = "vec_id long, label int, embedding array<float>, row int, rank int, anchor_id string"
    spark.createDataFrame(made, schema).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return sorted(tuple(r) for r in cover_tree.op13(spark, str(folder)).collect())


@pytest.mark.parametrize("block", [65_536, 40])
def test_against_all_scores(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    monkeypatch.setattr(cover_tree, "LEAST_BLOCK", min(block, 512))
    monkeypatch.setattr(cover_tree, "ANCHORS", 6)
    its, vectors = clusters(1, 900, 12, 0.6)
    rows = [(i, int(its[i]) % 4 if i % 3 else 0, v.tolist()) for i, v in enumerate(vectors)]  # label 0 is frequent
    rows += [(2000 + i, i % 10, vectors[100].tolist()) for i in range(120)]  # ties
    rows += [(50, 1, vectors[7].tolist()), (100, 2, vectors[8].tolist()), (100, 2, vectors[100].tolist()), (51, 1, vectors[9].tolist())]  # repeated ids
    rows += [(None, 1, vectors[0].tolist()), (3000, None, vectors[1].tolist()), (3050, 2, None), (3100, 2, [math.nan] * 24), (3150, 2, [math.inf] * 24), (3200, 2, [None] * 24)]
    rows += [(4000 + i, i % 3, [float(i), -1.0]) for i in range(30)] + [(5000, 1, []), (5001, 1, []), (5002, 2, []), (5050, 3, [0.5]), (6000, 1, [0.0] * 24)]
    got = run(spark, tmp_path, rows)
    assert got == by_hand(rows) and got


def test_scores_beyond_64_bits(spark, tmp_path):
    draw = np.random.default_rng(3)
    rows = [(i, i % 2, (draw.normal(0, 1, 3) * 10.0 ** (i % 9 * 4)).tolist()) for i in range(0, 500, 5)]
    rows += [(10_000 + i, i % 3, (draw.normal(1, 0.2, 3) * 1e5).tolist()) for i in range(0, 300, 25)]
    assert run(spark, tmp_path, rows) == by_hand(rows)


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, label int, v array<double>")
    assert cover_tree.hard_negatives(none, F.lit(True)).collect() == []


def tree_of(vectors, labels):
    return Tree.over(np.arange(len(vectors)), np.arange(len(vectors)), labels, vectors)


def test_nodes_cover_their_points():
    its, vectors = clusters(5, 3000, 30, 0.3)
    tree = tree_of(np.floor(256 * vectors), its)
    points, _ = cover_tree.unit_points(tree.vectors)
    levels = 0
    for centre, radius, child, children, begin, end in tree.nodes:
        inside = points[int(begin) : int(end)]
        assert (cover_tree._angles(inside, points[int(centre)]) <= radius).all()
        assert children or end - begin <= cover_tree.LEAF
        if children:
            below = tree.nodes[int(child) : int(child + children)]
            assert below[0, 4] == begin and below[-1, 5] == end and (below[1:, 4] == below[:-1, 5]).all()
            levels += 1
    assert levels > 10


@pytest.mark.parametrize(("spread", "share"), [(0.05, 0.06), (0.3, 0.35)])
def test_little_is_scored_where_vectors_cluster(spread, share):
    its, vectors = clusters(6, 8000, 60, spread)
    vectors = np.floor(256 * vectors)
    tree, asked = tree_of(vectors, its), vectors[::50]
    rows, labels = np.arange(0, 8000, 50), its[::50]
    all_scores = vectors @ asked.T
    low, high = np.full((160, 1), -(1 << 63)), np.full((160, 1), LIMIT)
    (anchor, _, score, ids), scored = search(tree, asked, rows, labels, True, low, high, 5)
    assert scored < share * all_scores.size
    for a in range(160):
        want = sorted((-int(s), i) for i, s in enumerate(all_scores[:, a]) if i != rows[a] and its[i] == labels[a])[:5]
        assert [(-int(s), int(i)) for s, i in zip(score[anchor == a], ids[anchor == a])] == want
    best = np.array([score[anchor == a][0] for a in range(160)])[:, None]
    window = best // 2, best * 95 // 100
    (anchor, _, score, ids), scored = search(tree, asked, rows, labels, False, *window, 3)
    print("share of points scored", scored / all_scores.size)
    for a in range(160):
        want = sorted((-int(s), i) for i, s in enumerate(all_scores[:, a]) if its[i] != labels[a] and window[0][a, 0] <= s <= window[1][a, 0])[:3]
        assert [(-int(s), int(i)) for s, i in zip(score[anchor == a], ids[anchor == a])] == want
