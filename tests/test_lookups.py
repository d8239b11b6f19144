"""Findings of the fourth round: lookups in alignments without a row per position on the driver."""

import random
import re

import pytest
from pyspark.sql import functions as F

from helixframe.operators import footprint
from helixframe.plans import catalogue


def _tables(spark, path, texts, events):
    spark.createDataFrame([(i, t, "de", "src1") for i, t in texts.items()], "doc_id bigint, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(events, "event_id bigint, user_id bigint, value double, event_type string").write.parquet(f"{path}/events.parquet")
    return str(path)


def _broadcast(df):
    """Operators below each broadcast of the plan that ran."""
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = [len(re.match(r"[\s:+\-|]*", line).group()) for line in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((k for k in range(i + 1, len(lines)) if depth[k] <= depth[i]), len(lines))
            yield " ".join(lines[i:below])


@pytest.mark.parametrize("name", ["coord_lookup", "view_range", "paired_sites", "hit_pair_table", "filtering_ratio"])
def test_positions_of_alignments_do_not_come_to_the_driver(spark, tmp_path, name):
    rnd = random.Random(3)
    texts = {i: "".join(rnd.choice("ACGT") for _ in range(400)) for i in range(4)}
    folder = _tables(spark, tmp_path, texts, [(n, n % 5, float(n), "error") for n in range(40)])
    spark.createDataFrame([(1, "a", "b", "c", 3)], "p_partkey bigint, p_brand string, p_type string, p_name string, p_size int").write.parquet(f"{folder}/part.parquet")
    assert not [plan for plan in _broadcast(catalogue.queries()[name](spark, folder)) if "MapInArrow" in plan]


def test_places_across_lead_to_the_other_sequence(spark, monkeypatch):
    monkeypatch.setattr(footprint, "FRAME_ROWS", 7)
    draw = random.Random(5)
    rows = [(aln, apos, draw.choice("ACGT-"), draw.choice("ACG-.")) for aln, n in ((1, 60), (2, 1), (5, 23)) for apos in range(1, n + 1)]
    rows += rows[5:9] + [(7, 1, "-", "A"), (7, 2, "C", None)]
    alignment = spark.createDataFrame(rows, "aln_id long, apos int, c1 string, c2 string")
    index = footprint.alignment_index(alignment)
    points = spark.createDataFrame([(n, aln, p) for n, (aln, p) in enumerate([(a, p) for a in (1, 2, 5, 7, 9, None) for p in (*range(0, 62, 2), None)] * 2)], "id int, aln_id long, p1 int")
    found = footprint.lookup(points, footprint.alignment_index(alignment, places="p2"), "p1", "p2")
    want = points.join(index.where("p1 IS NOT NULL").select("aln_id", "p1", "p2"), ["aln_id", "p1"], "left")
    key = lambda df: sorted(map(str, ((r.id, r.aln_id, r.p1, r.p2) for r in df.collect())))
    assert key(found) == key(want) and dict(found.dtypes)["p2"] == "int"


def test_ranges_are_mapped_as_by_the_index(spark, monkeypatch):
    monkeypatch.setattr(footprint, "FRAME_ROWS", 7)
    draw = random.Random(6)
    alignment = spark.createDataFrame([(aln, apos, draw.choice("ACGT-"), "A") for aln in (1, 2) for apos in range(1, 50)] + [(3, 1, "-", "A")], "aln_id long, apos int, c1 string, c2 string")
    at = {(r.aln_id, r.p1): r.apos for r in footprint.alignment_index(alignment).collect() if r.p1}
    asked = [(aln, a, b) for aln in (1, 2, 3, 4, None) for a, b in ((-3, 10), (30, 4), (5, 5), (40, 99), (5, 5))]
    want = []
    for aln, a, b in asked:
        n = max((p for k, p in at if k == aln), default=None)
        if n:
            low, high = (min(max(x, 1), n) for x in sorted((a, b)))
            want.append((aln, a, b, at[aln, low], at[aln, high]))
    requests = spark.createDataFrame(asked, "aln_id long, r_from int, r_to int")
    assert sorted(map(tuple, footprint.view_range(requests, footprint.alignment_index(alignment, places=True)).collect())) == sorted(want)


def test_hits_pair_off_by_places_as_by_the_index(spark):
    draw = random.Random(7)
    alignment = spark.createDataFrame([(aln, apos, *draw.choice(["AA", "CC", "AC", "-A", "G-"])) for aln in (1, 2) for apos in range(1, 200)], "aln_id long, apos int, c1 string, c2 string")
    index = footprint.alignment_index(alignment)
    profile = footprint.conservation(index)
    hits = [spark.createDataFrame([(draw.choice([1, 2, 3]), draw.choice("mn"), s, s + 3, draw.choice([1, -1]), 1.0, "ACGT") for s in range(1, 150)],
                                  "aln_id long, matrix_id string, start int, end int, strand int, score double, site string") for _ in "ab"]
    cutoffs = profile.groupBy("aln_id").agg(F.lit(10.0).alias("cutoff"))
    plain, by_places = (footprint.paired_sites(*hits, index, profile, cutoffs, places=p) for p in (None, footprint.alignment_index(alignment, places=True)))
    assert sorted(map(str, by_places.collect())) == sorted(map(str, plain.collect())) != []
    assert by_places.dtypes == plain.dtypes
