"""Places of an alignment as runs, and the tables that alignments are built from."""

import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from helixframe.operators import footprint
from helixframe.plans import fixtures
from helixframe.plans import footprint as plans
from helixframe.plans import scanning


def _alignment(spark, seed=1):
    draw = random.Random(seed)
    rows = [(aln, apos, draw.choice("ACGT-"), draw.choice("ACG-.")) for aln, n in ((1, 60), (2, 1), (5, 23)) for apos in range(1, n + 1)]
    # Rows that come twice, a missing letter, and an alignment of gaps alone.
    rows += rows[5:9] + [(7, 1, "-", "A"), (7, 2, "-", None), (7, 3, ".", "C")]
    return spark.createDataFrame(rows, "aln_id long, apos int, c1 string, c2 string")


def test_places_tell_the_same_as_the_index(spark, monkeypatch):
    monkeypatch.setattr(footprint, "FRAME_ROWS", 7)
    alignment = _alignment(spark)
    rows = footprint.alignment_index(alignment).collect()
    runs = footprint.alignment_index(alignment, places=True).collect()
    told = sorted((r.which, r.aln_id, r._at + i, r.apos + i) for r in runs for i in range(r._n))
    assert told == sorted((n, r.aln_id, r[f"p{n}"], r.apos) for r in rows for n in (1, 2) if r[f"p{n}"] is not None)
    assert all((r._at - 1) // 7 == r._block == (r._at + r._n - 2) // 7 for r in runs)
    assert len(runs) < len(told)


def test_points_get_their_place(spark, monkeypatch):
    monkeypatch.setattr(footprint, "FRAME_ROWS", 7)
    alignment = _alignment(spark, 2)
    index = footprint.alignment_index(alignment)
    places = footprint.alignment_index(alignment, places=True)
    asked = [(m, aln, p) for m in "xy" for aln in (1, 2, 5, 7, 9) for p in range(0, 62, 3)] + [("x", 1, 3), ("z", None, 3), ("z", 1, None), (None, 5, 4)]
    points = spark.createDataFrame(asked, "matrix_id string, seq_id long, start long")
    for n in (1, 2):
        found = footprint.placed(points, places, n, "seq_id", "start")
        want = points.join(index.select(F.col("aln_id").alias("seq_id"), F.col(f"p{n}").alias("start"), "apos"), ["seq_id", "start"])
        key = lambda rows: sorted(map(str, ((r.matrix_id, r.seq_id, r.start, r.apos) for r in rows)))
        assert key(found.collect()) == key(want.collect()) != []


def test_points_are_placed_without_a_row_per_position(spark):
    """The longest run of bases is one row, whatever its length."""
    alignment = spark.range(1, 3001).select(F.lit(1).cast("long").alias("aln_id"), F.col("id").cast("int").alias("apos"), F.lit("A").alias("c1"), F.lit("C").alias("c2"))
    assert footprint.alignment_index(alignment.coalesce(1), places=True).count() == 2


def test_words_are_found_once(spark, monkeypatch):
    """Scans read their library several times; it is a written table by then."""
    calls = spark.sparkContext.accumulator(0)

    def word(name):
        calls.add(1)
        return "ACG"

    monkeypatch.setattr(scanning, "words", lambda fx: spark.createDataFrame([("m",)], "matrix_id string").withColumn("word", F.udf(word, "string")("matrix_id")).where("word > ''").repartition(1))
    fx = SimpleNamespace(kept={})
    assert plans.word_library(fx).count() == 1
    seen = calls.value
    assert scanning.word_library(fx).collect()[0].width == 3 and calls.value == seen


def test_bases_of_odd_texts(spark):
    texts = [None, "", "xyz", "aCgT", "-A ü C\n𝔸g-t", "ACGT" * 3000, "é", "N", "İaı"] * 3
    table = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    plain = F.upper(F.regexp_replace("text", "[^ACGTacgt]+", ""))
    assert table.where(~fixtures.bases("text").eqNullSafe(plain)).count() == 0
    assert table.where("id > 2").select(fixtures.bases("text").alias("x")).where(F.length("x") > 0).count() == 3 * 4


def test_alignment_rows_by_expression(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "_BATCH", 50)
    draw = random.Random(3)
    word = lambda n: "".join(draw.choice("ACGT") for _ in range(n))
    pieces = [(3, 0, word(40), word(60)), (3, 8192, word(30), word(9)), (-4, 0, word(5), ""), (10**12, 16384, word(100), word(100))]
    source = spark.createDataFrame(pieces, "aln_id long, offset long, s1 string, s2 string")
    found = source.mapInArrow(fixtures._aligned, "aln_id long, apos int, c1 string, c2 string")
    want = []
    for aln, offset, s1, s2 in pieces:
        for i, (own, other) in enumerate(zip(s1, s2)):
            apos = offset + i + 1
            gap1, gap2 = (apos * 7 + aln) % 17 == 0, (apos * 5 + aln) % 19 == 0
            want.append((aln, apos, "-" if gap1 else own, "-" if gap2 and not gap1 else other if (apos * 11 + aln) % 3 == 0 else own))
    assert sorted(map(tuple, found.collect())) == sorted(want)
    whole = footprint.alignment_runs(found, (source, fixtures._aligned))
    plain = footprint.alignment_runs(found)
    assert sorted(map(str, footprint.alignment_index(found, whole).collect())) == sorted(map(str, footprint.alignment_index(found, plain).collect()))


def test_gaps_are_taken_out(spark):
    table = spark.createDataFrame([("A-C..-G-",), ("",), (None,), ("--",)], "s string")
    assert [r[0] for r in table.select(footprint.strip_gaps(F.col("s"))).collect()] == ["ACG", "", None, ""]
