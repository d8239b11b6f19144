"""Alignments move as runs of positions, not as one row per letter."""

import random

import pytest

from helixframe.operators import footprint, runs, scanning
from helixframe.plans import catalogue

ALIGNMENT = "aln_id bigint, apos int, c1 string, c2 string"


def moved(df):
    """Columns of the rows in the exchanges of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]


@pytest.fixture(scope="module")
def letters(spark):
    rnd = random.Random(5)
    rows = [(i, n, rnd.choice("ACGT-"), rnd.choice("ACGT.")) for i, size in ((1, 900), (2, 7), (None, 30)) for n in range(1, size + 1)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, ALIGNMENT).repartition(3)


@pytest.mark.parametrize("size", [16, 1 << 16])
def test_runs_give_all_rows_back(spark, size):
    rows = [(1, 1, "A", "C"), (1, 2, None, "G"), (1, 3, "é", ""), (1, 4, "GT", "-"), (1, 5, "A", None), (1, 5, "A", "A"), (None, 5, "T", "T"), (None, 6, "T", "T")]
    rows += [(7, n, "ACGT"[n % 4], "-") for n in range(1, 40)]
    df = spark.createDataFrame(rows, ALIGNMENT)
    got = footprint.alignment_index(df).select("aln_id", "apos", "c1", "c2").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))
    packed = runs.packed(df.where("aln_id = 7"), "aln_id", "apos", ["c1", "c2"], size).collect()
    assert sum(r["_n"] for r in packed) == 39 and max(r["_n"] for r in packed) <= size


def test_positions_that_repeat_lie_side_by_side(spark):
    df = spark.createDataFrame([(1, n, x, x) for n, x in enumerate("ACGT", 1)] * 2, ALIGNMENT)
    index = footprint.alignment_index(df)
    assert sorted((r["p1"], r["apos"]) for r in index.collect()) == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (6, 3), (7, 4), (8, 4)]
    assert runs.joined(df, "aln_id", "apos", ["c1", "c2"], 3).first()["c1"] == "AACCGGTT"


def test_index_profile_and_lookup_move_runs(letters):
    """No exchange holds one row per letter (F15, F21)."""
    rows, df = letters
    index = footprint.alignment_index(df)
    for found in (index, footprint.conservation(index), footprint.nearest_mapped(index, "p1", "p2")):
        assert moved(found) and all("rangepartitioning" not in line and "p1" not in line for line in moved(found))
        assert "hashpartitioning(aln_id" in found._jdf.queryExecution().executedPlan().toString()
        assert "_block" in " ".join(moved(found))
    joined = {r["aln_id"]: r["c1"] for r in runs.joined(df, "aln_id", "apos", ["c1", "c2"], 100).collect()}
    assert joined == {i: "".join(c for j, _, c, _ in sorted(((j, n, c, d) for j, n, c, d in rows if j == i), key=lambda r: r[1])) for i in (1, 2, None)}


def test_hits_are_not_moved_to_lengths(spark, tmp_path):
    """The length comes with the chunks that are scanned (F26); repeated ids give what a join with the texts gives."""
    rnd = random.Random(8)
    texts = [(i, "".join(rnd.choice("ACGT") for _ in range(400)), "de", f"src{i % 2}") for i in (1, 2, 3, 4, 4)] + [(9, None, "de", "src1")]
    spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.queries()["strand_coordinates"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan[: plan.index("MapInArrow")]
    got = found.collect()
    assert got and all(r["given_pos"] == (401 - r["start"] if r["seq_id"] % 2 else r["start"]) for r in got)
    plain = scanning.scan(spark.createDataFrame([(1, "ACGTTGCA")], "seq_id long, seq string"), scanning.pack_words(spark.createDataFrame([("m", "TTG")], "matrix_id string, word string")),
                          100, known=spark.createDataFrame([(1, 77)], "seq_id long, n long"))
    assert [(r["start"], r["strand"], r["n"]) for r in plain.collect()] == [(4, 1, 77)]


def test_protein_texts_are_read_once(spark, tmp_path, monkeypatch):
    """Mutual information counts the residues of the texts a single time (F24, F25)."""
    from helixframe.plans import clusters

    rnd = random.Random(3)
    texts = [(i, "".join(rnd.choice("ACGTKLM") for _ in range(300)), "de", f"src{i % 3}") for i in range(12)]
    spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    calls, counted = [], clusters.p.residue_counts
    monkeypatch.setattr(clusters.p, "residue_counts", lambda *a: calls.append(1) or counted(*a))
    rows = catalogue.queries()["mutual_information_scaled"](spark, str(tmp_path)).collect()
    assert len(calls) == 1 and len({(r["i"], r["j"]) for r in rows}) == len(rows) > 0


def test_pairs_meet_by_order_number(spark):
    """Hits at positions below the cutoff fall out before they meet anything else; the others pair off by strand."""
    index = footprint.alignment_index(spark.createDataFrame([(1, i + 1, x, x) for i, x in enumerate("ACGTTGCAAC" * 3)], ALIGNMENT))
    profile = footprint.conservation(index, 10)
    cutoffs = spark.createDataFrame([(1, 100.0)], "aln_id bigint, cutoff double")
    kind = "aln_id bigint, matrix_id string, start int, end int, strand int, score double, site string"
    one = spark.createDataFrame([(1, "m", 11, 14, s, 1.0, "ACGT") for s in (1, -1)] + [(1, "m", 30, 33, 1, 1.0, "ACGT")], kind)
    two = spark.createDataFrame([(1, "m", 11, 14, -1, 2.0, "ACGT"), (1, "n", 11, 14, 1, 2.0, "ACGT"), (1, "m", 30, 33, 1, 1.0, "ACGT")], kind)
    got = footprint.paired_sites(one, two, index, profile, cutoffs).collect()
    assert [(r["apos"], r["matrix_id"], r["strand1"], r["strand2"]) for r in got] == [(11, "m", -1, -1)]
