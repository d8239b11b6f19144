"""Seeds that are judged by the letters around them."""

import random

import pytest
from test_pieces_and_segments import by_hand, letters, table

from helixframe.operators import extension, genome


def changed(rnd, text, share):
    return "".join(rnd.choice("ACGT") if rnd.random() < share else x for x in text)


@pytest.mark.parametrize("threshold", [1500, 2200])
def test_flanked_seeds_give_the_same_segments(spark, threshold):
    rnd = random.Random(11)
    words = [letters(rnd, rnd.randint(12, 40)) for _ in range(150)]
    prose = lambda n: "".join(rnd.choice(words) for _ in range(n))
    long = prose(400)  # over the edge of a piece
    targets = {1: long, 2: prose(60), 3: prose(15), 4: letters(rnd, 30)}
    turned = changed(rnd, long[8_000:8_500], 0.1)[::-1].translate(str.maketrans("ACGT", "TGCA"))
    queries = {5: prose(60) + changed(rnd, long[7_900:8_400], 0.15), 6: turned, 7: prose(40), 8: targets[4], 9: changed(rnd, targets[2], 0.3)}
    t, q = table(spark, targets), table(spark, queries)
    plain, flanked = (genome.seed_matches(t, q, 50, flanked=f) for f in (False, True))
    names = ["t_id", "t_pos", "q_id", "strand", "q_pos"]
    every = sorted(tuple(r) for r in plain.select(names).collect())
    assert every == sorted(tuple(r) for r in flanked.select(names).collect()) and len(every) > 1_000
    got = sorted(tuple(r) for r in genome.ungapped_hsps(flanked, t, q, "far", threshold).collect())
    assert got == by_hand(every, targets, queries, "far", threshold) and got


def test_chance_seeds_fall_out_before_the_walks(spark):
    rnd = random.Random(12)
    t, q = ({i: letters(rnd, 60_000)} for i in (1, 2))
    flanked = genome.seed_matches(table(spark, t), table(spark, q), 50, flanked=True)
    left = extension.promising(flanked, genome.SEED, genome.SUBSTITUTION["far"], genome.drop_off("far"), 2200)
    assert flanked.count() > 300 and left.count() < flanked.count() / 20


def test_words_that_meet_nothing_are_not_moved(spark, monkeypatch):
    """Frequent words of the target, and words of the query that the target has not, fall out where they are made."""
    draw, made = random.Random(8), []
    text = lambda n: "".join(draw.choice("ACGT") for _ in range(n))
    shared, often = text(30), text(19)
    targets = spark.createDataFrame([(1, text(200) + shared + "".join(often + text(5) for _ in range(4)))], "seq_id long, seq string")
    queries = spark.createDataFrame([(7, text(3000) + shared), (8, often + text(10))], "seq_id long, seq string")
    words = genome.seed_words
    monkeypatch.setattr(genome, "seed_words", lambda *a, **k: made.append(words(*a, **k)) or made[-1])
    found = genome.seed_matches(targets, queries, 3)
    got = sorted(map(tuple, found.collect()))
    places = [[(r.word, r.seq_id, r.strand, r.pos) for r in words(x, both_strands=x is queries).collect()] for x in (targets, queries)]
    count = lambda w: sum(x[0] == w for x in places[0])
    want = sorted((t[1], t[3], q[1], q[2], q[3]) for t in places[0] for q in places[1] if t[0] == q[0] and count(t[0]) <= 3)
    assert got == want and len(got) >= 12 and not any(r[2] == 8 and r[4] == 1 and r[3] == 1 for r in got)
    assert found.dtypes == [("t_id", "bigint"), ("t_pos", "bigint"), ("q_id", "bigint"), ("strand", "int"), ("q_pos", "bigint")]
    # What the join reads: the target's words but the frequent ones, and the query's that meet those.
    assert made[-1].count() == len({(q, s, p) for _, _, q, s, p in got}) < len(places[1]) / 10
