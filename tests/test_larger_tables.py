"""Findings of the third round: whole results, and work that grows no faster than the input."""

import random
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.operators import genome, scanning
from helixframe.operators.ordered import prefix_scan, segments
from helixframe.operators.ranges import sweep
from helixframe.plans import catalogue


def test_soft_mask_query_returns_whole_sequences(spark, tmp_path):
    rnd = random.Random(1)
    texts = {1: "".join(rnd.choice("ACGT") for _ in range(9_000)), 2: "AC", 3: "x"}
    spark.createDataFrame([(i, t, "de", "s") for i, t in texts.items()], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(40, 1, 1020.5, "click"), (30, 1, 8190.0, "view"), (7, 2, 1.0, "error")], "event_id bigint, user_id bigint, value double, event_type string").write.parquet(
        f"{tmp_path}/events.parquet")
    masked = catalogue.queries()["soft_mask"](spark, str(tmp_path))
    assert masked.columns == ["seq_id", "seq"]
    got = {r["seq_id"]: r["seq"] for r in masked.collect()}
    lower = {*range(1021, 1062), *range(8191, 8222)}
    assert got == {1: "".join(x.lower() if p in lower else x for p, x in enumerate(texts[1], 1)), 2: "AC"}


def test_prefix_scan_moves_its_rows_once(spark):
    """Rows are dealt into ranges and written; nothing but the table of one row per range is joined to them."""
    rows = spark.range(0, 5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("x"), (F.col("id") % 7).alias("v"))
    scanned = prefix_scan(rows, ["k"], [F.col("x")], rn=("rank", None), s=("sum", "v"))
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(_range" not in plan and "BroadcastHashJoin" in plan
    assert {(r["k"], r["rn"]) for r in scanned.collect()} == {(k, n) for k in range(3) for n in range(1, len(range(k, 5000, 3)) + 1)}


@pytest.mark.parametrize("size", [3, 50, 10_000])
def test_running_values_over_batches_and_ranges(spark, size):
    """Keys that span batches and ranges, nulls, sums of numbers of both kinds."""
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "a", "a", "b", None, "c"]), i, rnd.choice([None, *range(9)]), rnd.choice([None, 0.5, -1.25])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i bigint, v int, d double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = prefix_scan(df, ["k"], [F.col("i")], rn=("rank", None), s=("sum", "v"), t=("sum", "d"), m=("max_before", "v"), l=("last", "v"), g=("lag", "v")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for key in {r[0] for r in rows}:
        n, total, reals, top, last, before = 0, None, None, None, None, None
        for _, i, v, d in sorted(r for r in rows if r[0] == key):
            n += 1
            total = total if v is None else (total or 0) + v
            reals = reals if d is None else (reals or 0) + d
            last = last if v is None else v
            want[i] = (n, total, reals, top, last, before)
            top = top if v is None else max(v, v if top is None else top)
            before = v
    assert {r["i"]: (r["rn"], r["s"], r["t"], r["m"], r["l"], r["g"]) for r in got} == want


@pytest.mark.parametrize("size", [3, 40, 10_000])
@pytest.mark.parametrize("share", [0.0, 0.3, 0.999, 1.0])
def test_segments_over_batches_and_ranges(spark, size, share):
    rnd = random.Random(6)
    rows = [(rnd.choice(["a", "a", None, "b"]), i, rnd.random() < share, rnd.randint(0, 10**6)) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, i bigint, on boolean, v bigint").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = segments(df, ["k"], [F.col("i")], ["on"], lambda before, now: now["on"], "v", "least").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for key in {r[0] for r in rows}:
        run = []
        for _, i, on, v in sorted(r for r in rows if r[0] == key):
            if not (on and run):
                run = []
            run.append(i)
            low = min(v, want[run[0]] if len(run) > 1 else v)
            for j in run:
                want[j] = low
    assert {r["i"]: r["least"] for r in got} == want


def test_sweep_agrees_with_brute_force(spark):
    rnd = random.Random(9)
    key = lambda: rnd.choice(["hot", "hot", "k1", None])
    covers = [(key(), s, s + rnd.choice([-3, 0, 4, 60, 4000]), rnd.randint(1, 40), n) for n, s in enumerate(rnd.randint(-20, 5000) for _ in range(500))]
    covers.append(("hot", None, 77, 3, 9))
    spans = [(key(), s, s + rnd.choice([5, 900, 6000]), n) for n, s in enumerate(rnd.randint(0, 5000) for _ in range(60))]
    got = sweep(spark.createDataFrame(covers, "k string, s bigint, e bigint, rk bigint, id bigint"), spark.createDataFrame(spans, "k string, s bigint, e bigint, rk bigint")).collect()
    want = {}
    for k in ("hot", "k1"):
        points = sorted({x for r in [*covers, *spans] if r[0] == k for x in r[1:3] if x is not None})
        for p, after in zip(points, [*points[1:], None]):
            over = [(rk, n) for kk, s, e, rk, n in covers if kk == k and s is not None and s <= p < e]
            if over:
                rk, n = min(over)
                better = [r for kk, s, e, r in spans if kk == k and s <= p < e and r < rk]
                want[k, p] = (after, rk, n, len(better), max(better, default=None))
    found = {(r["k"], r["start"]): (r["end"], r["rk"], r["id"], r["_better"], r["_next"]) for r in got if r["rk"] is not None}
    assert found.keys() == want.keys()
    assert all(found[x][1:] == want[x][1:] and found[x][0] in (None, want[x][0]) for x in want)


def test_scores_of_every_width():
    rnd = np.random.default_rng(5)
    codes = rnd.integers(0, 5, 300).astype(np.uint8)
    for width in range(1, 20):
        table = rnd.integers(-(10**9), 10**9, (width, 5))
        want = [sum(int(table[j, codes[i + j]]) for j in range(width)) for i in range(300 - width + 1)]
        assert scanning._scores(scanning._words(codes), table).tolist() == want


def test_hits_come_as_arrow_batches():
    """Sites are cut from the letters without a Python object for each."""
    rows = pa.RecordBatch.from_pydict({"seq_id": [7, 8], "offset": [0, 40], "own": [6, 2], "text": ["ACGTAC", "GTAC"]})
    grid = [[5, -5, -5, -5], [-5, 5, -5, -5], [-5, -5, 5, -5]]
    profile = scanning._profiles(pa.table({"matrix_id": ["m"], "width": [3], "cells": [sum(grid, [])], "low": [-15], "high": [15]}).to_pandas())
    parts = list(scanning._scan_all(iter([rows]), profile, partial(scanning._hits, percent=80, both=True)))
    assert all(isinstance(p, pa.RecordBatch) for p in parts)
    got = {(r["seq_id"], r["start"], r["end"], r["strand"], r["site"]) for p in parts for r in p.to_pylist()}
    assert got == {(7, 1, 3, 1, "ACG"), (7, 2, 4, -1, "ACG")}


def test_seed_matches_are_not_moved_after_the_join_on_words(spark):
    rnd = random.Random(3)
    letters = {i: "".join(rnd.choice("ACGT") for _ in range(60)) for i in (1, 2)}
    texts = spark.createDataFrame([(1, letters[1]), (2, letters[2])], "seq_id bigint, seq string")
    found = genome.seed_matches(texts, spark.createDataFrame([(3, letters[1][20:50])], "seq_id bigint, seq string"), 50)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    top = next(line for line in plan.splitlines() if "Join " in line)
    assert "word" in top and "q_id" not in top
    assert {tuple(r) for r in found.where("strand = 1").collect()} == {(1, 20 + i, 3, 1, i) for i in range(1, 13)}
