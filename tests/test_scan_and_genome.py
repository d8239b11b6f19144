import math
import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import chains, footprint, genome, scanning


def sequences(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq_id bigint, seq string")


def test_chunked_scan_equals_whole_scan_and_block_join(spark, monkeypatch):
    rnd = random.Random(1)
    seqs = sequences(spark, ["".join(rnd.choice("ACGTN") for _ in range(n)) for n in (300, 7, 0, 123)])
    rows = [(f"m{k}", i + 1, *[round(rnd.uniform(-2, 2), 3) for _ in range(4)]) for k in range(5) for i in range(4 + k)]
    pwm = spark.createDataFrame(rows, "matrix_id string, pos int, a double, c double, g double, t double")
    library = scanning.pack_pwm(pwm)
    want = []
    for seq_id, seq in [tuple(r) for r in seqs.collect()]:
        for k in range(5):
            cols = [r[2:] for r in rows if r[0] == f"m{k}"]
            low, high = (sum(round(f(c) * 1e6) for c in cols) for f in (min, max))
            for strand, table in ((1, cols), (-1, [c[::-1] for c in cols[::-1]])):
                for at in range(len(seq) - len(cols) + 1):
                    window = seq[at:at + len(cols)]
                    if "N" in window:
                        continue
                    score = sum(round(c["ACGT".index(x)] * 1e6) for c, x in zip(table, window))
                    if (score - low) * 100 >= 80 * (high - low):
                        want.append((seq_id, f"m{k}", at + 1, strand, score))
    pick = lambda df: sorted((r["seq_id"], r["matrix_id"], r["start"], r["strand"], round(r["score"] * 1e6)) for r in df.collect())
    assert pick(scanning.scan(seqs, library, 80)) == sorted(want)
    monkeypatch.setattr(scanning, "CHUNK", 16)
    small = scanning.chunked(seqs, 7, 16)
    from functools import partial

    kernel = partial(scanning._hits, percent=80, both=True)
    monkeypatch.setattr(scanning, "LIBRARY_LIMIT", 2)
    assert pick(scanning._run_blocks(small, library, 5, kernel, scanning.HITS, lanes=3)) == sorted(want)


def test_identical_sequences_are_fully_conserved_inside(spark):
    rows = [(1, i + 1, x, x) for i, x in enumerate("ACGTTGCA" * 10)]
    index = footprint.alignment_index(spark.createDataFrame(rows, "aln_id bigint, apos int, c1 string, c2 string"))
    profile = {r["pos"]: r["conservation"] for r in footprint.conservation(index, 10).collect()}
    assert all(profile[k] == 100 for k in range(6, 75)) and profile[1] < 100


def test_chunks_cover_every_base_and_lift_back(spark):
    sizes = spark.createDataFrame([("g", 1, 1234), ("g", 2, 90)], "genome string, seq_id bigint, size bigint")
    cut = genome.chunks(sizes, 100, 20)
    covered = {p for r in cut.collect() for p in range(r["start"], r["end"])}
    assert covered == set(range(1234))
    lift = genome.lift_table(cut.select(genome.chunk_name().alias("chunk")), sizes)
    asked = lift.select(F.col("chunk").alias("result_id"), "chunk", F.lit(3).alias("start"), F.lit(9).alias("end"))
    back = genome.lift_up(asked, lift).join(lift.select(F.col("chunk").alias("result_id"), "offset"), "result_id")
    assert back.where("start - offset <> 3 OR end - offset <> 9 OR status <> 'ok'").count() == 0


def test_packing_follows_the_greedy_rule(spark):
    rnd = random.Random(2)
    rows = [(f"g{i % 2}", i, rnd.randint(1, 60)) for i in range(60)]
    got = {r["seq_id"]: r["part"] for r in genome.pack_small(spark.createDataFrame(rows, "genome string, seq_id bigint, size bigint"), 100, limit=5).collect()}
    want = {}
    for g in ("g0", "g1"):
        held = n = 0
        part = 1
        for _, i, size in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            if n and (held + size > 100 or n >= 5):
                part, held, n = part + 1, 0, 0
            held, n = held + size, n + 1
            want[i] = part
    assert got == want


def random_blocks(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        t, q, size = rnd.randint(0, 900), rnd.randint(0, 900), rnd.randint(3, 30)
        rows.append((i, "t", t, t + size, "q", q, q + size, rnd.choice("+-"), rnd.randint(50, 500)))
    return rows


def blocks_of(spark, rows):
    return spark.createDataFrame(
        rows, "block_id bigint, t_name string, t_start bigint, t_end bigint, q_name string, q_start bigint, q_end bigint, strand string, score bigint"
    )


def test_best_chain_score_is_the_optimum(spark):
    rows = random_blocks(60, 3)
    gap, cost = 120, 1.0

    def query(r):
        return (r[5], r[6]) if r[7] == "+" else (-r[6], -r[5])

    best = {}
    for r in sorted(rows, key=lambda r: r[2]):
        via = 0
        for p in rows:
            if p[0] in best and p[7] == r[7]:
                dt, dq = r[2] - p[3], query(r)[0] - query(p)[1]
                if 0 <= dt <= gap and 0 <= dq <= gap:
                    via = max(via, best[p[0]] - (dt + dq) * cost)
        best[r[0]] = r[8] + via
    chained = chains.chain_best(blocks_of(spark, rows), gap, cost).collect()
    assert len(chained) == len(rows)
    by = {r[0]: r for r in rows}
    scores = []
    for c in {r["chain_id"] for r in chained}:
        path = sorted((by[r["block_id"]] for r in chained if r["chain_id"] == c), key=lambda r: r[2])
        total = path[0][8]
        for p, r in zip(path, path[1:]):
            dt, dq = r[2] - p[3], query(r)[0] - query(p)[1]
            assert 0 <= dt <= gap and 0 <= dq <= gap
            total += r[8] - (dt + dq) * cost
        scores.append(total)
    assert max(scores) == max(best.values())
    table = {r["chain_id"]: r["score"] for r in chains.chain_table(chains.chain_best(blocks_of(spark, rows), gap, cost)).collect()}
    assert sorted(table.values()) == sorted(scores)


def chain_scores(rows, gap, cost):
    """Best score of a chain that ends in each block, by a plain loop."""
    best = {}
    side = lambda r: (r[5], r[6]) if r[7] == "+" else (-r[6], -r[5])
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        via = 0
        for p in rows:
            dt, dq = r[2] - p[3], side(r)[0] - side(p)[1]
            if p[0] in best and p[7] == r[7] and 0 <= dt <= gap and 0 <= dq <= gap:
                via = max(via, best[p[0]] - cost(dt, dq))
        best[r[0]] = r[8] + via
    return best


def test_named_gap_costs_over_ranges_of_a_lane(spark, monkeypatch):
    """One lane holds nearly all blocks; it is settled range by range, with blocks carried over."""
    rnd = random.Random(14)
    rows = [(i, "t", t, t + rnd.choice([5, 9, 700]), "q", q, q + 5, "-" if i % 40 == 0 else "+", rnd.randint(300, 2500))
            for i, (t, q) in enumerate((rnd.randint(0, 3000), rnd.randint(0, 3000)) for _ in range(200))]

    def cost(kind):
        one, both = chains.GAP_COSTS[kind]

        def of(dt, dq):
            if dt + dq == 0:
                return 0
            values, total, at = both if dt and dq else one, dt + dq, 0
            while at < len(values) - 2 and chains.GAP_LENGTHS[at + 1] <= total:
                at += 1
            a, b = chains.GAP_LENGTHS[at : at + 2]
            return math.floor(values[at] + (values[at + 1] - values[at]) * (total - a) / (b - a) + 0.5)
        return of

    for kind in ("medium", "loose"):
        want = chain_scores(rows, 800, cost(kind))
        for size in (100_000, 23):
            monkeypatch.setattr(chains, "LANE_ROWS", size)
            state = chains._settled(blocks_of(spark, rows), 800, kind).collect()
            assert {r["j"]: r["best"] for r in state} == want
        chained = chains.chain_table(chains.chain_best(blocks_of(spark, rows), 800, kind)).collect()
        assert max(r["score"] for r in chained) == max(want.values()) and sum(r["blocks"] for r in chained) == 200
    assert chains.chain_best(blocks_of(spark, rows).limit(0), 800, "loose").collect() == []


def test_one_cut_off_input_fails_the_pipeline(spark, tmp_path):
    rows = blocks_of(spark, random_blocks(60, 5))
    lines = [(f, n, "line") for f in "ab" for n in range(3)] + [("a", 3, "# end")]
    log = spark.createDataFrame(lines + [("b", 3, "# end")], "file_id string, line_no int, line string")
    whole = chains.net_pipeline(rows, 40, 100, log, "# end")
    assert whole.count() == chains.net_pipeline(rows, 40, 100).count() > 0
    assert {r["kind"] for r in whole.collect()} <= {"top", "syn", "inv", "nonSyn"}
    cut_off = spark.createDataFrame(lines, "file_id string, line_no int, line string")
    with pytest.raises(Exception, match="1 incomplete inputs, the first one is b"):
        chains.gated(rows, cut_off, "# end").write.parquet(f"{tmp_path}/rows")
    with pytest.raises(Exception, match="incomplete inputs"):
        chains.net_pipeline(rows, 40, 100, cut_off, "# end")


def test_net_owners_are_disjoint_and_best(spark):
    rows = random_blocks(80, 4)
    chained = chains.chain_runs(blocks_of(spark, rows), 40)
    ranked = chains.sort_chains(chains.chain_table(chained))
    rank = {r["chain_id"]: r["rk"] for r in ranked.collect()}
    owner = {}
    for b in chained.collect():
        for pos in range(b["t_start"], b["t_end"]):
            owner[pos] = min(owner.get(pos, 10**9), rank[b["chain_id"]])
    got = {}
    for r in chains.net(ranked, chained).collect():
        for pos in range(r["start"], r["end"]):
            assert pos not in got
            got[pos] = r["rk"]
    assert got == owner


def test_pairs_can_leave_out_reading_frames(spark):
    letters = "ACGTTGCAAC" * 6
    index = footprint.alignment_index(spark.createDataFrame([(1, i + 1, x, x) for i, x in enumerate(letters)], "aln_id bigint, apos int, c1 string, c2 string"))
    profile = footprint.conservation(index, 10)
    cutoffs = spark.createDataFrame([(1, 100.0)], "aln_id bigint, cutoff double")
    hits = spark.createDataFrame([(1, "m", s, s + 3, 1, 1.0, "ACGT") for s in (11, 21, 31, 55)],
                                 "aln_id bigint, matrix_id string, start int, end int, strand int, score double, site string")
    starts = lambda **options: sorted(r["start1"] for r in footprint.paired_sites(hits, hits, index, profile, cutoffs, **options).collect())
    assert starts() == [11, 21, 31, 55]
    assert starts(orfs=spark.createDataFrame([(1, 20, 25), (2, 1, 60)], "aln_id bigint, f_start int, f_end int")) == [11, 31, 55]
    ends = {r["pos"]: r["conservation"] for r in profile.collect()}
    assert ends[55] == 100 and ends[56] < 100
    assert starts(compat=True) == [11, 21, 31]


def test_seeds_and_segments_on_both_strands(spark):
    rnd = random.Random(12)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    one, two = text(60), text(60)
    targets = spark.createDataFrame([(1, text(40) + one + text(50) + two + text(30))], "seq_id long, seq string")
    queries = spark.createDataFrame([(7, text(15) + one + text(20)), (8, text(25) + turn(two) + text(9))], "seq_id long, seq string")
    seeds = genome.seed_matches(targets, queries, 50)
    found = {(r["q_id"], r["strand"], r["t_pos"] - r["q_pos"]) for r in seeds.collect()}
    assert {(7, 1, 25), (8, -1, 150 - 9)} <= found
    segments = {(r["q_id"], r["strand"]): r for r in genome.ungapped_hsps(seeds, targets, queries, "far", 2200).collect()}
    assert set(segments) == {(7, 1), (8, -1)}
    assert segments[7, 1]["t_start"] <= 41 and segments[7, 1]["t_end"] >= 100
    assert segments[8, -1]["t_start"] <= 151 and segments[8, -1]["t_end"] >= 210
