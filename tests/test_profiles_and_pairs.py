import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import metrics
from helixframe.functions.special import digamma_array, lgamma_array, lgamma_sql
from helixframe.operators import clusters, comparison, kernels, mixture, profiles as p


def matrix(spark, grids):
    rows = [(name, i + 1, *map(float, col)) for name, grid in grids.items() for i, col in enumerate(grid)]
    return spark.createDataFrame(rows, "matrix_id string, pos int, a double, c double, g double, t double")


IDENTITY = [(9, 0, 0, 0), (0, 9, 0, 0), (0, 0, 9, 0), (0, 0, 0, 9)]


def test_invariant_column_carries_two_bits_and_uniform_pwm_is_zero(spark):
    m = matrix(spark, {"m": [(4, 0, 0, 0), (1, 1, 1, 1)]})
    ic = {r["pos"]: r["ic"] for r in p.column_ic(m).collect()}
    assert ic == pytest.approx({1: 2.0, 2: 0.0})
    pwm = p.log_odds(p.pseudo_frequencies(m)).where("pos = 2").first()
    assert [pwm[b] for b in p.BASES] == pytest.approx([0] * 4)


def test_reverse_complement_twice_is_the_same(spark):
    m = matrix(spark, {"m": [(1, 2, 3, 4), (5, 6, 7, 8), (0, 1, 0, 9)]})
    twice = p.reverse_complement(p.reverse_complement(m))
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, m.collect()))


def test_identity_matrices_score_twice_their_width(spark):
    m = matrix(spark, {"x": IDENTITY, "y": IDENTITY})
    found = comparison.align_pairs(comparison.pair_up(comparison.pack(m)), "scan", "ssd").collect()
    assert all(r["score"] == pytest.approx(8, abs=0.01) for r in found)


def test_special_functions(spark):
    xs = [0.01, 0.5, 1.0, 2.5, 40.0, 1e4]
    assert lgamma_array(np.array(xs)) == pytest.approx([math.lgamma(x) for x in xs], abs=1e-8)
    assert digamma_array(np.array([1.0]))[0] == pytest.approx(-0.5772156649, abs=1e-9)
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", F.expr(lgamma_sql("x")).alias("y"))
    assert [r["y"] for r in df.collect()] == pytest.approx([math.lgamma(x) for x in xs], abs=1e-8)


def plain_affine(s, opened, extended, overlap, whole):
    """Cell-by-cell recurrence on whole millionths."""
    w1, w2 = len(s), len(s[0])
    m, x, y = ([[0] * (w2 + 1) for _ in range(w1 + 1)] for _ in range(3))
    if whole:
        for k in range(1, max(w1, w2) + 1):
            for t in (m, x, y):
                if k <= w1:
                    t[k][0] = -(opened + (k - 1) * extended)
                if k <= w2:
                    t[0][k] = -(opened + (k - 1) * extended)
    best = None
    for i in range(1, w1 + 1):
        for j in range(1, w2 + 1):
            m[i][j] = s[i - 1][j - 1] + max(m[i - 1][j - 1], x[i - 1][j - 1], y[i - 1][j - 1])
            x[i][j] = max(m[i - 1][j] - opened, x[i - 1][j] - extended) if i > 1 else m[i - 1][j] - opened
            y[i][j] = max(m[i][j - 1] - opened, y[i][j - 1] - extended) if j > 1 else m[i][j - 1] - opened
            top = max(m[i][j], x[i][j], y[i][j])
            if not overlap and not whole:
                m[i][j] = max(m[i][j], 0)
            if whole or not overlap or (i == w1 and j >= 3) or (j == w2 and i >= 3):
                best = top if whole or best is None or top > best else best
    return best


@pytest.mark.parametrize("overlap,whole", [(True, False), (False, False), (False, True)])
def test_affine_kernel_matches_plain_recurrence(overlap, whole):
    rnd = np.random.default_rng(1)
    s = kernels.units(rnd.uniform(-1, 1, (6, 7, 9)))
    score = kernels.affine(s, overlap=overlap, whole=whole)[0]
    assert [plain_affine(x.tolist(), kernels.units(1.0), kernels.units(0.5), overlap, whole) for x in s] == score.tolist()


@pytest.mark.parametrize("method", ["scan", "sw", "nw", "swa", "ungapped"])
def test_path_adds_up_to_the_score(method):
    """Walking the path and charging its columns and gaps gives the reported score."""
    rnd = np.random.default_rng(2)
    s = kernels.units(rnd.uniform(-0.3, 1, (20, 6, 8)))
    opened, extended = (3_000_000, 10_000) if method == "scan" else (1_000_000, 500_000)
    score, end_i, end_j, steps = kernels.METHODS[method](s)
    seen_i, seen_j = kernels.walk(end_i, end_j, steps)
    if method in ("nw", "swa"):
        assert (score <= [x.clip(0).sum() for x in s]).all()
        return
    for k in range(len(s)):
        total, gap = 0, "edge" if method == "scan" else None
        for i, j in [(a, b) for a, b in zip(seen_i[k][::-1], seen_j[k][::-1]) if a >= 0]:
            now = "i" if j == 0 else "j" if i == 0 else None
            if now is None:
                total += s[k, i - 1, j - 1]
            elif method == "sw":
                total -= opened
            else:
                # The scanner extends a gap that starts at a profile's edge for the low price.
                total -= extended if gap in (now, "edge") else opened
            gap = now
        assert total == score[k]


def test_metric_grids_match_expressions(spark):
    rnd = random.Random(4)
    n = [[rnd.randint(0, 9) for _ in range(4)] for _ in range(2)]
    f = [[(x + 0.00025) / (sum(col) + 0.001) for x in col] for col in n]
    one = {"n": np.array([[n[0]]], float), "f": np.array([[f[0]]])}
    two = {"n": np.array([[n[1]]], float), "f": np.array([[f[1]]])}
    lit = lambda xs: [F.lit(float(x)) for x in xs]
    w = [[math.log2(x / 0.25) for x in col] for col in f]
    row = spark.range(1).select(
        metrics.pcc(lit(f[0]), lit(f[1])).alias("pcc"), metrics.ssd(lit(f[0]), lit(f[1])).alias("ssd"),
        metrics.kl(lit(f[0]), lit(f[1])).alias("kl"), metrics.allr(lit(n[0]), lit(w[0]), lit(n[1]), lit(w[1])).alias("allr"),
        metrics.allr_ll(lit(n[0]), lit(w[0]), lit(n[1]), lit(w[1])).alias("allr_ll"), metrics.chi2(lit(n[0]), lit(n[1])).alias("chi2"),
    ).first()
    for name in metrics.METRICS:
        assert metrics.METRICS[name](one, two)[0, 0, 0] == pytest.approx(row[name], abs=1e-9)


def test_mixture_likelihood_rises(spark):
    rnd = random.Random(6)
    rows = [[rnd.choice([9, 10]), 1, 0, 1] if rnd.random() < 0.5 else [0, 1, rnd.choice([7, 8]), 2] for _ in range(200)]
    m = matrix(spark, {"m": rows})
    start = [mixture.Component(0.5, (2.0, 2.1, 1.9, 2.0)), mixture.Component(0.5, (1.9, 2.0, 2.1, 2.0))]
    mix, ll = mixture.fit(m, start, max_rounds=15)
    assert all(b >= a - 1e-9 for a, b in zip(ll, ll[1:])) and ll[-1] > ll[0] + 1
    assert sum(c.share for c in mix) == pytest.approx(1)


def test_mixture_reaches_the_plain_fit(spark):
    import pandas as pd

    rnd = random.Random(7)
    rows = [[rnd.randint(5, 12), rnd.randint(0, 3), 1, rnd.randint(0, 2)] if rnd.random() < 0.6 else [1, rnd.randint(2, 6), rnd.randint(3, 8), 2] for _ in range(300)]
    start = [mixture.Component(0.4, (2.0, 1.0, 1.9, 1.0)), mixture.Component(0.6, (1.0, 2.0, 1.1, 2.0))]
    batch = pd.DataFrame([[*map(float, r), 1.0] for r in rows], columns=[*p.BASES, "w"])
    mix, lls = start, []
    while len(lls) < 2 or lls[-1] - lls[-2] > 1e-3:
        sums = next(mixture._partial_sums(mix, iter([batch])))
        lls.append(sums["ll"][0])
        mix = [mixture.Component(s["resp"] / 300, tuple(a * s[f"num_{b}"] / s["den"] for a, b in zip(c.alpha, p.BASES))) for c, (_, s) in zip(mix, sums.iterrows())]
    found, history = mixture.fit(matrix(spark, {"m": rows}), start, min_gain=1e-3)
    assert len(history) < len(lls) and history[-1] >= lls[-1] - 0.01
    assert [c.share for c in found] == pytest.approx([c.share for c in mix], abs=0.02)


def plain_upgma(names, d):
    """One merge at a time; returns {leaves: height}."""
    nodes = {(n,): 1 for n in names}
    dist = {frozenset([(a,), (b,)]): x for (a, b), x in d.items()}
    out = {}
    while len(nodes) > 1:
        pair = min(dist, key=dist.get)
        a, b = pair
        new = tuple(sorted(a + b))
        out[new] = dist[pair] / 2
        for c in list(nodes):
            if c not in pair:
                dist[frozenset([new, c])] = (
                    len(a) * dist[frozenset([a, c])] + len(b) * dist[frozenset([b, c])]
                ) / (len(a) + len(b))
        dist = {k: v for k, v in dist.items() if not k & pair}
        del nodes[a], nodes[b]
        nodes[new] = 1
    return out


def test_merge_rounds_give_the_average_linkage_tree(spark):
    rnd = random.Random(8)
    names = [f"m{i}" for i in range(7)]
    d = {(a, b): rnd.random() for i, a in enumerate(names) for b in names[i + 1:]}
    merges = clusters.upgma(spark.createDataFrame([("g", a, b, x) for (a, b), x in d.items()], "grp string, a string, b string, d double"))
    edges = merges.select("node", F.explode(F.array("left", "right")).alias("child"))
    closure = clusters.leaf_closure(edges).collect()
    leaves = {}
    for r in closure:
        leaves.setdefault(r["node"], []).append(r["leaf"])
    got = {tuple(sorted(leaves[r["node"]])): r["height"] for r in merges.collect()}
    want = plain_upgma(names, d)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert clusters.newick(merges).first()["tree"].count("m") == 7


def test_error_function_of_arrays():
    import math

    import numpy as np

    from helixframe.functions.special import chi2_tail_3df, erfc_array, normal_cdf

    x = np.concatenate([np.linspace(-8, 12, 2001), [0.0, 2.5, -2.5, 26.0, 40.0, np.inf, -np.inf]])
    want = np.array([math.erfc(v) for v in x])
    got = erfc_array(x)
    assert np.all(np.abs(got - want) <= 1e-14 + 1e-10 * want)
    assert normal_cdf(np.zeros(0)).size == 0 and chi2_tail_3df(np.zeros(0)).size == 0
    assert abs(normal_cdf(np.array([1.96]))[0] - 0.9750021048517795) < 1e-14
