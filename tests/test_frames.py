import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import footprint, genome


def aligned(rnd, n):
    pick = lambda: rnd.choice("ACGT" * 4 + "--.")
    rows = []
    while len(rows) < n:
        a, b = pick(), rnd.choice("ACGT")
        b = a if rnd.random() < 0.6 else pick()
        if not (a in "-." and b in "-."):
            rows.append((a, b))
    return rows


@pytest.fixture(scope="module")
def giant(spark):
    """One alignment holds nearly all rows."""
    rnd = random.Random(21)
    texts = {1: aligned(rnd, 3000), 2: aligned(rnd, 40), 3: [("A", "-")], 4: [("-", "A"), ("C", "C")]}
    rows = [(i, n, a, b) for i, t in texts.items() for n, (a, b) in enumerate(t, 1)]
    return texts, spark.createDataFrame(rows, "aln_id bigint, apos int, c1 string, c2 string").repartition(7)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(footprint, "FRAME_ROWS", 100)


def positions(text):
    p1 = p2 = 0
    for n, (a, b) in enumerate(text, 1):
        p1, p2 = p1 + (a not in "-."), p2 + (b not in "-.")
        yield n, a, b, p1 if a not in "-." else None, p2 if b not in "-." else None


def test_index(giant):
    texts, rows = giant
    want = sorted((i, *p) for i, t in texts.items() for p in positions(t))
    got = footprint.alignment_index(rows).select("aln_id", "apos", "c1", "c2", "p1", "p2").collect()
    assert sorted(map(tuple, got)) == want


def test_profile_cutoff_and_regions(giant):
    texts, rows = giant
    index = footprint.alignment_index(rows)
    for which in (1, 2):
        want = {}
        for i, t in texts.items():
            same = [int(a == b) for _, a, b, p1, p2 in positions(t) if (p1, p2)[which - 1] is not None]
            for p in range(len(same)):
                want[i, p + 1] = sum(same[max(0, p - 24) : p + 26]) * 2.0
        got = {(r["aln_id"], r["pos"]): r["conservation"] for r in footprint.conservation(index, 50, which).collect()}
        assert got == want
    profile = footprint.conservation(index, 50, 2)
    cutoffs = {i: sorted(v for (k, _), v in want.items() if k == i) for i in texts}
    cutoffs = {i: v[int(0.9 * len(v))] for i, v in cutoffs.items() if v}
    assert {r["aln_id"]: r["cutoff"] for r in footprint.conservation_cutoff(profile).collect()} == cutoffs
    regions = []
    for i in texts:
        high = [p for p in sorted(p for k, p in want if k == i) if want[i, p] >= cutoffs[i]]
        for p in high:
            if p - 1 not in high:
                regions.append([i, p, p])
            regions[-1][2] = p
    got = footprint.conserved_regions(profile, footprint.conservation_cutoff(profile)).select("aln_id", "r_start", "r_end").collect()
    assert sorted(map(list, got)) == sorted(regions)


def test_nearest_positions(giant):
    texts, rows = giant
    got = {(r["aln_id"], r["p1"]): (r["lower"], r["higher"]) for r in footprint.nearest_mapped(footprint.alignment_index(rows), "p1", "p2").collect()}
    for i, t in texts.items():
        known = [(p1, p2) for _, _, _, p1, p2 in positions(t) if p1]
        for n, (p1, _) in enumerate(known):
            lower = [q for _, q in known[: n + 1] if q]
            higher = [q for _, q in known[n:] if q]
            assert got[i, p1] == (lower[-1] if lower else 1, higher[0] if higher else None)


def test_scores(spark, giant):
    texts, rows = giant
    got = {(r["aln_id"], r["distance"]): r["score"] for r in genome.alignment_scores(rows, spark).collect()}
    for distance, opening, extend, *_ in genome.PRESETS:
        for i, t in texts.items():
            total, before = 0, 0
            for a, b in t:
                gap = 1 if a in "-." else 2 if b in "-." else 0
                if gap:
                    total -= extend + (opening if gap != before else 0)
                else:
                    total += genome.SUBSTITUTION[distance]["ACGT".index(a)]["ACGT".index(b)]
                before = gap
            assert got[i, distance] == total


def test_frames_hold_no_more_than_their_rows(giant):
    _, rows = giant
    sizes = footprint.framed(rows, "apos", 24, 25).groupBy("aln_id", "_block").count().agg(F.max("count")).first()[0]
    assert sizes <= 100 + 24 + 25
