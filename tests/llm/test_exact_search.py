import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import exact_search


def by_hand(rows, k):
    usable = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(64 * x) for x in v]))
    out = []
    for at, (q, v) in enumerate(usable):
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for j, (i, w) in enumerate(usable) if j != at and len(w) == len(v))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def rows():
    draw = np.random.default_rng(6)
    made = [(i, draw.normal(0, 0.2, 40).tolist()) for i in range(700)]
    made += [(1000 + i, made[3][1]) for i in range(60)]  # ties
    made += [(20, made[20][1]), (40, made[5][1]), (None, made[1][1]), (2000, None), (2020, [math.nan] * 40), (2040, [math.inf] * 40), (2060, [None] * 40)]
    made += [(3000 + i, [float(i), -1.0]) for i in range(0, 50)] + [(4000, []), (4020, []), (5000, [0.5])]
    return [(i, v) for i, v in made]


def test_rows_of_one_id_are_all_candidates(spark):
    made = [(20, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [9.0, 9.0]), (20, [5.0, 5.0])]
    docs = spark.createDataFrame([(i, v, 7, "x") for i, v in made], "vec_id long, v array<double>, rank int, score string")
    got = exact_search.top_k(docs, F.col("vec_id") == 20, 3).collect()
    want = [(20, 1, 1, 9), (20, 2, 20, 5), (20, 3, 1, 1), (20, 1, 1, 90), (20, 2, 1, 10), (20, 3, 20, 5)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_sql_and_plan_agree_on_repeated_ids(spark, tmp_path):
    import duckdb

    draw = np.random.default_rng(8)
    made = [(i % 30, draw.normal(0, 0.3, 6).tolist()) for i in range(90)]
    spark.createDataFrame(made, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    from helixframe.llm.common import registered

    got = sorted(tuple(r) for r in exact_search.op9(spark, str(tmp_path)).collect())
    assert got == sorted(duck.execute(registered()[1]["op9_exact_topk"]).fetchall()) and len(got) == 6 * 20


def test_most_columns_are_never_read():
    draw = np.random.default_rng(9)
    vectors = np.floor(64 * draw.normal(0, 1, (20_000, 64)))
    block = exact_search.Block(np.arange(20_000), np.arange(20_000), vectors)
    for row in range(20):
        ids, scores = block.best(row, vectors[row], 20)
        every = vectors @ vectors[row]
        every[row] = -np.inf
        assert ids.tolist() == np.lexsort((np.arange(20_000), -every))[:20].tolist()
    # Random directions are the hardest case; the share of column entries read:
    starts = sorted(block.summed)
    read = sum(n * (end - at) for (at, n), end in zip(sorted(block.summed.items()), [*starts[1:], 64]))
    print("share of column entries read", read / (20 * 20_000 * 64), {at: n / (20 * 20_000) for at, n in sorted(block.summed.items())})
    assert read < 0.55 * 20 * 20_000 * 64


def test_short_candidates_are_not_looked_at():
    draw = np.random.default_rng(10)
    vectors = np.floor(64 * draw.normal(0, 1, (30_000, 16)) * np.exp(-np.arange(30_000) / 3000)[:, None])
    block = exact_search.Block(np.arange(30_000), np.arange(30_000), vectors)
    block.best(5, vectors[5], 20)
    assert block.summed[0] <= 2 * exact_search.CHUNK


@pytest.mark.parametrize("sizes", [(65_536, 16_384), (50, 7)])
def test_against_all_scores(spark, tmp_path, monkeypatch, sizes):
    monkeypatch.setattr(exact_search, "CANDIDATES", sizes[0])
    monkeypatch.setattr(exact_search, "QUERIES", sizes[1])
    made = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], 1) for i, v in rows()]
    spark.createDataFrame(made, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in exact_search.op9(spark, str(tmp_path)).collect())
    assert got == by_hand([(i, v) for i, v, _ in made], 20)


def test_large_components(spark):
    made = [(i, [2.0**40 * (i - 3), 2.0**30 + i]) for i in range(30)]
    got = exact_search.top_k(spark.createDataFrame(made, "vec_id long, v array<double>"), F.col("vec_id") == 0, 5).collect()
    limit = (1 << 63) - 1
    whole = lambda v: [int(x) for x in v]
    want = sorted((-sum(a * b for a, b in zip(whole(made[0][1]), whole(v))), i) for i, v in made if i)[:5]
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(i, max(-limit - 1, min(limit, -s))) for s, i in want]


def test_empty(spark):
    assert exact_search.top_k(spark.createDataFrame([], "vec_id long, v array<double>"), F.lit(True)).collect() == []
