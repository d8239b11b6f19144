import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import extension, genome, pieces, scanning
from helixframe.sources import readers, writers

TURN = str.maketrans("ACGT", "TGCA")


def letters(rnd, n):
    return "".join(rnd.choice("ACGT") for _ in range(n))


def table(spark, texts):
    return spark.createDataFrame(sorted(texts.items()), "seq_id bigint, seq string")


def test_laps_and_tiles(spark):
    rnd = random.Random(1)
    texts = {i: letters(rnd, n) for i, n in enumerate([1, 15, 16, 17, 32, 100])}
    small = pieces.cut(table(spark, texts), 16)
    assert max(len(r["text"]) for r in small.collect()) == 16
    for lap, tile in ((0, 16), (5, 16), (16, 16), (3, 4), (16, 8)):
        got = sorted(tuple(r) for r in pieces.tiles(small, lap, tile, 16).select("seq_id", "offset", "own", "text").collect())
        assert got == [(i, at, min(tile, len(t) - at), t[at : at + tile + lap]) for i, t in texts.items() for at in range(0, len(t), tile)]
    with pytest.raises(ValueError):
        pieces.with_lap(small, 17, 16)


def test_scan_of_pieces_equals_scan_of_whole_sequences(spark):
    rnd = random.Random(2)
    seqs = table(spark, {i: letters(rnd, n) for i, n in enumerate([40_000, 8192, 8193, 12, 9000])})
    rows = [("m", i + 1, *[round(rnd.uniform(-2, 2), 3) for _ in range(4)]) for i in range(9)]
    library = scanning.pack_pwm(spark.createDataFrame(rows, "matrix_id string, pos int, a double, c double, g double, t double"))
    pick = lambda df: sorted((r["seq_id"], r["start"], r["strand"], r["score"]) for r in df.collect())
    whole = pick(scanning.scan(seqs, library, 85))
    assert pick(scanning.scan(pieces.cut(seqs), library, 85)) == whole and whole


def test_fasta_in_pieces(spark, tmp_path):
    rnd = random.Random(3)
    texts = {i: letters(rnd, n) for i, n in enumerate([1, 59, 60, 61, 999, 1000, 1001, 5000])}
    body = "".join(f">s{i} note {i}\n" + "".join(t[k : k + 70].lower() + (" 7\n" if i % 2 else "\r\n") for k in range(0, len(t), 70)) + "\n" for i, t in texts.items())
    (tmp_path / "a.fa").write_text("no header yet\n" + body + ">empty\n>last\nACGT")
    (tmp_path / "b.fa").write_text(">s0 in another file\nTTTT\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = readers.read_fasta_pieces(spark, str(tmp_path), 100).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [("a.fa", f"s{i}", at, t[at : at + 100]) for i, t in texts.items() for at in range(0, len(t), 100)]
    want += [("a.fa", "last", 0, "ACGT"), ("b.fa", "s0", 0, "TTTT")]
    assert sorted((r["path"].rsplit("/", 1)[1], r["header"], r["offset"], r["text"]) for r in got) == sorted(want)


def test_fasta_is_written_in_pieces(spark, tmp_path):
    rnd = random.Random(4)
    texts = {i: letters(rnd, 5 + 700 * i) for i in range(9)}
    cut = pieces.cut(table(spark, texts), 512).repartition(6)
    writers.write_fasta(cut, F.col("seq_id").cast("string"), f"{tmp_path}/out")
    back = readers.read_fasta_pieces(spark, f"{tmp_path}/out", 512)
    assert sorted(map(tuple, back.select(F.col("header").cast("long"), "offset", "text").collect())) == sorted(map(tuple, cut.select("seq_id", "offset", "text").collect()))


def by_hand(seeds, targets, queries, distance, threshold):
    """Plain walk, letter by letter."""
    grid, drop, span = genome.SUBSTITUTION[distance], genome.drop_off(distance), len(genome.SEED)
    lanes = {}
    for t_id, t_pos, q_id, strand, q_pos in seeds:
        lanes.setdefault((t_id, q_id, strand, t_pos - q_pos), set()).add(t_pos)
    out = []
    for (t_id, q_id, strand, diag), places in lanes.items():
        t = targets[t_id]
        q = queries[q_id] if strand > 0 else queries[q_id][::-1].translate(TURN)
        score = lambda p: grid["ACGT".index(t[p - 1])]["ACGT".index(q[p - diag - 1])]

        def go(positions):
            total = best = length = 0
            for n, p in enumerate(positions, 1):
                total += score(p)
                if total < best - drop:
                    return best, length, None
                if total > best:
                    best, length = total, n
            return best, length, total

        anchors = []
        for p in sorted(places):
            if anchors and p <= anchors[-1][1]:
                anchors[-1][1] = p + span
            else:
                anchors.append([p, p + span])
        first, runs = max(1, diag + 1), []
        for a, e in anchors:
            core = sum(score(p) for p in range(a, e))
            best, length, total = go(range(a - 1, (runs[-1][1] if runs else first) - 1, -1))
            if runs and total is not None:
                runs[-1] = [runs[-1][0], e, runs[-1][2] + total + core, runs[-1][3]]
            else:
                runs.append([a, e, core + best, a - length])
        for _, e, whole, start in runs:
            best, length, _ = go(range(e, min(len(t), len(q) + diag) + 1))
            if whole + best >= threshold:
                out.append((t_id, q_id, strand, diag, start, e - 1 + length, whole + best))
    return sorted(out)


def compare(spark, targets, queries, distance="far", threshold=2200):
    seeds = genome.seed_matches(table(spark, targets), table(spark, queries), 50)
    got = genome.ungapped_hsps(seeds, table(spark, targets), table(spark, queries), distance, threshold)
    got = sorted(tuple(r) for r in got.collect())
    assert got == by_hand([tuple(r) for r in seeds.collect()], targets, queries, distance, threshold)
    return got


def test_two_segments_with_a_drop_between(spark):
    rnd = random.Random(5)
    one, two, between = letters(rnd, 120), letters(rnd, 30), letters(rnd, 50)
    other = between.translate(str.maketrans("ACGT", "CATG"))  # no letter stays
    got = compare(spark, {1: one + between + two}, {7: one + other + two})
    main = [r for r in got if r[3] == 0]
    assert [r[4:6] for r in main] == [(1, 120), (171, 200)] and main[0][6] > 10_000 and main[1][6] > 2200


def test_segment_goes_on_without_seeds(spark):
    # Every eighth letter differs: seeds need luck, the extension does not.
    rnd = random.Random(6)
    text = letters(rnd, 900)
    worn = "".join(x if i < 40 or i % 8 else x.translate(str.maketrans("ACGT", "GTAC")) for i, x in enumerate(text))
    assert any(r[5] - r[4] > 850 for r in compare(spark, {1: text}, {2: worn}))


@pytest.mark.parametrize("distance", ["near", "medium", "far"])
def test_segments_against_a_plain_walk(spark, distance):
    rnd = random.Random(7)
    base = [letters(rnd, 300) for _ in range(4)]

    def mutated(text, rate):
        return "".join(rnd.choice("ACGT") if rnd.random() < rate else x for x in text)

    targets = {i: letters(rnd, rnd.randint(0, 200)) + base[i % 4] + letters(rnd, 90) + base[(i + 1) % 4] for i in range(4)}
    queries = {10 + i: mutated(base[i % 4], 0.08 * (i % 4)) + letters(rnd, rnd.randint(0, 60)) + mutated(base[(i + 1) % 4], 0.1) for i in range(6)}
    queries |= {20 + i: mutated(base[i], 0.1)[::-1].translate(TURN) for i in range(3)}
    got = compare(spark, targets, queries, distance, 3000)
    assert {r[2] for r in got} == {1, -1}


def test_windows_over_many_pieces(spark, monkeypatch):
    """One diagonal with most anchors, walked over the edges of small pieces in many rounds."""
    monkeypatch.setattr(extension, "WINDOWS", (8, 32, 64))
    rnd = random.Random(8)
    text = letters(rnd, 20_000)
    worn = "".join(rnd.choice("ACGT") if rnd.random() < 0.06 else x for x in text)
    got = compare(spark, {1: text}, {2: worn[3:], 3: worn[5_000:9_000][::-1].translate(TURN)}, "far", 5000)
    assert max(r[5] - r[4] for r in got) > 15_000


def test_transition_seeds(spark):
    rnd = random.Random(9)
    text = letters(rnd, 19)
    changed = text[:4] + text[4].translate(str.maketrans("ACGT", "GTAC")) + text[5:]  # place 5 is a care position
    twice = changed[:7] + changed[7].translate(str.maketrans("ACGT", "GTAC")) + changed[8:]
    found = lambda q, **kw: genome.seed_matches(table(spark, {1: text}), table(spark, {2: q}), 50, **kw).where("strand = 1").count()
    assert (found(text), found(changed), found(changed, transition=True), found(twice, transition=True)) == (1, 0, 1, 0)


def test_masked_tiles(spark):
    rnd = random.Random(10)
    texts = {1: letters(rnd, 10_000), 2: letters(rnd, 5)}
    spans = [(1, s, s + rnd.randint(0, 40)) for s in (rnd.randint(1, 10_100) for _ in range(300))] + [(1, 2000, 7000), (2, 2, 99)]
    got = genome.soft_mask(table(spark, texts), spark.createDataFrame(spans, "seq_id bigint, start bigint, end bigint"), 64).collect()
    for i, t in texts.items():
        covered = {p for s, a, b in spans if s == i for p in range(a, b + 1)}
        want = "".join(x.lower() if p in covered else x for p, x in enumerate(t, 1))
        assert "".join(r["text"] for r in sorted((r for r in got if r["seq_id"] == i), key=lambda r: r["offset"])) == want
