import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import fingerprints as fp


def shingles(text):
    return {text[i : i + fp.WIDTH] for i in range(max(1, len(text) - fp.WIDTH + 1))} if text else set()


def resemblance(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def prose(seed, words):
    draw = np.random.default_rng(seed)
    known = ["".join(draw.choice(list("abcdeéfghiß漢字😀"), draw.integers(2, 9))) for _ in range(400)]
    return " ".join(draw.choice(known, words))


def rows():
    made = [(i, prose(i, 1 + (i * 37) % 900)) for i in range(60)]
    made += [(100, made[3][1]), (101, made[3][1]), (7, made[7][1]), (7, "another text of the same id"), (None, prose(900, 80)), (None, None)]
    made += [(200, None), (201, ""), (202, ""), (203, "a"), (204, "ab"), (205, prose(901, 30_000)), (-5, "negative ids come first")]
    return made


def by_hand(made):
    import xxhash

    texts = [(i, t or "") for i, t in made]
    # Equal ids stand in the order of Spark's hash, seed 42.
    signed = lambda t: np.array([xxhash.xxh64_intdigest(t.encode(), 42)], np.uint64).view(np.int64)[0]
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    out = []
    for at, (i, text) in enumerate(order):
        follows = order[at - 1][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follows[:cut]
        out.append((i, text, edited, follows))
    return out


@pytest.mark.parametrize("tasks", [1, 7, 200])
def test_against_whole_sets(spark, monkeypatch, tasks):
    monkeypatch.setattr(fp, "task_count", lambda spark: tasks)
    made = rows()
    docs = spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in made], "doc_id long, text string, h string, part int, near_next double").repartition(5)
    got = fp.edited_neighbours(docs).collect()
    want = by_hand(made)
    assert len(got) == len(want)
    key = lambda i, n, d: (i is not None, i or 0, n, d)
    got.sort(key=lambda r: key(r["doc_id"], r["n_chars"], r["edited_sha256"]))
    want.sort(key=lambda r: key(r[0], len(r[1]), hashlib.sha256(r[2].encode()).hexdigest()))
    for row, (i, text, edited, follows) in zip(got, want):
        assert (row["doc_id"], row["n_chars"], row["edited_sha256"]) == (i, len(text), hashlib.sha256(edited.encode()).hexdigest())
        for mine, whole in ((row["near_edited"], resemblance(text, edited)), (row["near_next"], resemblance(text, follows))):
            assert abs(mine - whole) < 0.25
            if len(shingles(text) | shingles(follows) | shingles(edited)) <= fp.LEAST:
                assert mine == whole
    by_text = {}
    for row, (_, text, _, _) in zip(got, want):
        assert by_text.setdefault(text, row["fingerprint"]) == row["fingerprint"]
    assert len(set(by_text.values())) == len(by_text)


def test_sketch_holds_all_below_the_fraction():
    text = prose(1, 8000)
    sketch = fp.Sketch.of(fp.points_of(text))
    each = {int(fp.shingle_hashes(fp.points_of(s))[0]) for s in shingles(text)}
    assert set(sketch.hashes.tolist()) == {h for h in each if h <= int(fp._LIMIT)}
    again = fp.Sketch.from_text(sketch.to_text())
    assert again.reach == sketch.reach and (again.hashes == sketch.hashes).all()


def test_merge_equals_sketch_of_all():
    pieces = [prose(s, 3000) for s in range(4)]
    merged = fp.merge(fp.Sketch.of(fp.points_of(p)) for p in pieces)
    each = {int(fp.shingle_hashes(fp.points_of(s))[0]) for p in pieces for s in shingles(p)}
    assert set(merged.hashes.tolist()) == {h for h in each if h <= merged.reach}
    assert fp.merge([]).reach == fp._TOP


def test_containment_of_a_short_text_in_a_long_one():
    long, other = prose(2, 20_000), prose(3, 400)
    part = long[30_000:38_000]
    inside, outside = fp.Sketch.of(fp.points_of(part)), fp.Sketch.of(fp.points_of(other))
    whole = fp.Sketch.of(fp.points_of(long))
    assert fp.compare(inside, whole)[1] > 0.95 and fp.compare(outside, whole)[1] < 0.05
    assert fp.compare(inside, whole)[0] < 0.2


def test_containment_in_collections(spark):
    base = prose(4, 6000)
    docs = spark.createDataFrame([(1, base[:9000], "a"), (2, base[9000:], "a"), (3, prose(5, 4000), "b"), (4, None, "b")], "doc_id long, text string, source string")
    sketched = fp.fingerprints(docs).join(docs.select("doc_id", "source"), "doc_id")
    asked = spark.createDataFrame([(9, base[5000:20_000])], "doc_id long, text string")
    ones = fp.hashes_of(fp.fingerprints(asked), "doc_id")
    got = {r["source"]: r["containment"] for r in fp.containments(ones, fp.hashes_of(sketched, "source"), "doc_id", "source").collect()}
    assert got["a"] > 0.95 and got.get("b", 0) < 0.05


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fp.edited_neighbours(none).collect() == [] and fp.fingerprints(none).collect() == []
    one = fp.edited_neighbours(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0
    assert fp.edited_neighbours(none.unionByName(spark.createDataFrame([(None, None)], "doc_id long, text string"))).first()["n_chars"] == 0
