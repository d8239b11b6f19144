import random

from pyspark.sql import functions as F

from helixframe.operators.ordered import desc, islands, prefix_scan
from helixframe.operators.pairing import grid_pairs, unordered_pairs
from helixframe.operators.ranges import merge_intervals, ranks_below, stab


def skewed(spark, n=400, seed=3):
    """A third of all rows under one key."""
    rnd = random.Random(seed)
    rows = [("hot" if i % 3 == 0 else f"k{i % 7}", i, rnd.randint(0, 50), rnd.choice([None, 1, 2, 3])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, i int, v int, w int").repartition(5)


def test_prefix_scan_matches_a_plain_walk(spark):
    rows, df = skewed(spark)
    got = prefix_scan(df, ["k"], [desc("v"), F.col("i")], rn=("rank", None), s=("sum", "v"), m=("max_before", "i"),
                      l=("last", "w"), g=("lag", "w")).collect()
    want = {}
    for key in {r[0] for r in rows}:
        total, top, last, before = 0, None, None, None
        for n, (_, i, v, w) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], r[1])), 1):
            total += v
            last = w if w is not None else last
            want[i] = (n, total, top, last, before)
            top, before = max(i, top if top is not None else i), w
    assert {r["i"]: (r["rn"], r["s"], r["m"], r["l"], r["g"]) for r in got} == want


def test_prefix_scan_keeps_null_keys(spark):
    rows = [(None, 1, 1), (None, 2, 5), ("a", 1, 2), ("a", 2, None), (None, 3, 1)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(3)
    got = prefix_scan(df, ["k"], [F.col("i")], rn=("rank", None), s=("sum", "v")).collect()
    assert sorted(((r["k"], r["i"], r["rn"], r["s"]) for r in got), key=str) == sorted(
        [(None, 1, 1, 1), (None, 2, 2, 6), (None, 3, 3, 7), ("a", 1, 1, 2), ("a", 2, 2, 2)], key=str)


def test_islands_and_union(spark):
    rnd = random.Random(5)
    rows = sorted({("t", s, s + rnd.randint(1, 6)) for s in (rnd.randint(0, 200) for _ in range(80))})
    df = spark.createDataFrame(rows, "k string, s int, e int")
    covered = {p for _, s, e in rows for p in range(s, e)}
    merged = merge_intervals(df, ["k"], "s", "e").collect()
    assert sorted(p for r in merged for p in range(r["s"], r["e"])) == sorted(covered)
    assert all(r["e"] not in covered for r in merged)
    assert islands(df, ["k"], "s", "e").select("island").distinct().count() == len(merged)


def test_stab_agrees_with_brute_force(spark):
    rnd = random.Random(7)
    spans = [("k", s, s + rnd.randint(0, 300), n) for n, s in enumerate(rnd.randint(0, 500) for _ in range(120))]
    points = [("k", p) for p in range(0, 850, 7)]
    found = stab(
        spark.createDataFrame(points, "k string, p int"), spark.createDataFrame(spans, "k string, s int, e int, v int"),
        ["k"], "p", "s", "e", low=("min", "v"), all=("sum", "v"),
    ).collect()
    for r in found:
        hit = [v for _, s, e, v in spans if s <= r["p"] <= e]
        assert (r["low"], r["all"]) == ((min(hit), sum(hit)) if hit else (None, None))


def test_stab_of_one_giant_key_over_many_ranges(spark):
    """Two thirds of all rows in one key, intervals over one, two and all ranges, keys that share a range."""
    rnd = random.Random(8)
    key = lambda: rnd.choice(["hot", "hot", "k1", "k2", None])
    spans = [(key(), s, s + rnd.choice([0, 3, 500, 20_000]), n) for n, s in enumerate(rnd.randint(-50, 20_000) for _ in range(700))]
    spans += [("hot", 5, 4, 1), (None, 1, 9, 2), ("other", -9, 9, 3)]
    points = [(key(), rnd.choice([None, *[rnd.randint(-60, 21_000) for _ in range(30)]]), i) for i in range(3000)]
    found = stab(
        spark.createDataFrame(points, "k string, p int, n int").repartition(7), spark.createDataFrame(spans, "k string, s int, e int, v int"),
        ["k"], "p", "s", "e", low=("min", "v"), high=("max", "v"), all=("sum", "v"),
    ).collect()
    assert len(found) == len(points)
    by_number = {n: (k, p) for k, p, n in points}
    for r in found:
        k, p = by_number[r["n"]]
        hit = [v for kk, s, e, v in spans if k is not None and kk == k and p is not None and s <= p <= e]
        assert (r["k"], r["p"]) == (k, p)
        assert (r["low"], r["high"], r["all"]) == ((min(hit), max(hit), sum(hit)) if hit else (None, None, None))


def test_stab_of_nothing(spark):
    points, none = spark.createDataFrame([("a", 1)], "k string, p int"), spark.createDataFrame([], "k string, s int, e int, v int")
    assert [tuple(r) for r in stab(points, none, ["k"], "p", "s", "e", low=("min", "v")).collect()] == [("a", 1, None)]
    assert stab(points.limit(0), none, ["k"], "p", "s", "e", low=("min", "v")).collect() == []


def test_ranks_below_over_many_ranges(spark):
    rnd = random.Random(9)
    spans = [(rnd.choice(["hot", "hot", "k"]), s, s + rnd.choice([1, 60, 5000]), n) for n, s in enumerate(rnd.randint(0, 5000) for _ in range(300))]
    points = [(rnd.choice(["hot", "hot", "k"]), p, rnd.randint(0, 320)) for p in rnd.sample(range(6000), 1500)]
    got = ranks_below(
        spark.createDataFrame(points, "k string, p int, r long"), spark.createDataFrame(spans, "k string, s int, e int, r long"), ["k"], "p", "s", "e", "r"
    ).collect()
    want = []
    for k, p, own in points:
        lower = [r for kk, s, e, r in spans if kk == k and s <= p <= e and r < own]
        want.append((k, p, own, len(lower), max(lower, default=None)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_grid_pairs_meets_every_pair_once(spark):
    left = spark.range(23).toDF("x")
    right = spark.range(17).toDF("y")
    pairs = grid_pairs(left, right, "x", "y", side=3).collect()
    assert len(pairs) == 23 * 17 and len(set(map(tuple, pairs))) == 23 * 17


def test_grid_is_cut_by_both_sizes(spark):
    one, many = spark.createDataFrame([(7,)], "x long"), spark.range(50).toDF("y")
    assert sorted(map(tuple, grid_pairs(one, many, "x", "y").collect())) == [(7, i) for i in range(50)]
    assert grid_pairs(one.limit(0), many, "x", "y").collect() == []


def test_unordered_pairs_are_made_once(spark):
    df = spark.createDataFrame([(f"m{i}", i) for i in range(31)], "k string, v int")
    names = sorted(f"m{i}" for i in range(31))
    for own in (True, False):
        for side in (None, 1, 4):
            got = [(r["lo"]["k"], r["hi"]["k"]) for r in unordered_pairs(df, "k", own, side).collect()]
            assert sorted(got) == [(a, b) for a in names for b in names if a < b or own and a == b]


def test_chunks_are_cut_like_substrings(spark):
    from helixframe.operators.scanning import chunked

    rnd = random.Random(9)
    texts = {i: "".join(rnd.choice("ACGT") for _ in range(n)) for i, n in enumerate([0, 1, 511, 512, 513, 8192, 8193, 40_000])}
    df = spark.createDataFrame(list(texts.items()), "seq_id long, seq string")
    for lap, size in ((18, 512), (0, 100), (11, 1 << 17), (600, 500)):
        got = sorted(tuple(r) for r in chunked(df, lap, size).select("seq_id", "offset", "own", "text").collect())
        assert got == [(i, at, min(size, len(t) - at), t[at : at + size + lap]) for i, t in texts.items() for at in range(0, len(t), size)]


def test_scratch_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    from helixframe import session

    monkeypatch.setattr(session, "_tables", lambda _: str(tmp_path / "tables"))
    kept = session.cut_lineage(spark.range(5))
    assert kept.count() == 5 and list((tmp_path / "tables").iterdir())
    session.clear_scratch(spark)
    assert not (tmp_path / "tables").exists()


def test_fasta_stream(spark, tmp_path):
    from helixframe.streaming import fasta_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">one first\nACGT\nac gt\n>two\nACXT\n>three\n")
    stream = fasta_stream(spark, str(tmp_path / "in"))
    assert stream.isStreaming
    run = stream.writeStream.format("memory").queryName("fasta").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = {r["header"]: (r["seq"], r["reason"]) for r in spark.table("fasta").collect()}
    assert rows == {"one": ("ACGTACGT", None), "two": ("ACXT", "unknown letter"), "three": ("", "empty")}


def test_no_pairs_make_no_tree(spark):
    from helixframe.operators import clusters

    none = spark.createDataFrame([], "grp string, a string, b string, d double")
    assert clusters.upgma(none).collect() == []
