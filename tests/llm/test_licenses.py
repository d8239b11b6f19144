import random
from collections import Counter

from helixframe.llm import licenses


def test_increasing_is_longest():
    draw = random.Random(1)
    for _ in range(200):
        places = draw.sample(range(30), draw.randint(0, 12))
        got = [places[i] for i in licenses.increasing(places)]
        assert got == sorted(got)
        best = [0] * len(places)
        for i, p in enumerate(places):
            best[i] = 1 + max((best[j] for j in range(i) if places[j] < p), default=0)
        assert len(got) == max(best, default=0)


def test_alignment_is_increasing_and_matches():
    draw = random.Random(2)
    for _ in range(100):
        a = [draw.choice("abcdefghij") + str(draw.randint(0, 3)) for _ in range(draw.randint(0, 40))]
        b = [w for w in a if draw.random() < 0.8] + ["zz"] * draw.randint(0, 3)
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < r and q < s for (p, q), (r, s) in zip(pairs, pairs[1:]))
    assert licenses.align("a b c d".split(), "x a b c d y".split()) == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_hits(spark):
    mit = " ".join(licenses.TEMPLATES["MIT"].split())
    changed = mit.replace("free of charge, ", "").replace("Software", "Work", 1)
    noise = "the of and is in this under work " * 2000
    rows = [
        (1, f"before {mit} after", "c"), (2, "Some text.\nReleased under the MIT License.\nMore. released under the mit license", "c"),
        (3, noise + changed + noise, "c"), (4, None, "c"), (5, "", "c"), (6, noise, "c"), (7, "This is the MIT campus, under license.", "c"),
        (8, "Licensed under CC BY-NC 4.0.", "c"), (8, "Licensed under CC BY-NC 4.0.", "c"), (None, "LICENSED UNDER CC BY-NC 4.0", "c"),
        (9, "This work is licensed under the GNU General Public License, version 3.", "c"), (10, "Licensed under the Apache License, Version 2.0.", "c"),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    found = sorted((str(r["doc_id"]), r["license"]) for r in got)
    assert found == sorted([
        ("1", "MIT"), ("2", "MIT notice"), ("2", "MIT notice"), ("3", "MIT"), ("8", "CC-BY-NC-4.0 notice"), ("8", "CC-BY-NC-4.0 notice"),
        ("None", "CC-BY-NC-4.0 notice"), ("9", "GPL-3.0 notice"), ("10", "Apache-2.0 notice"),
    ])
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert 0.8 <= r["coverage"] <= 1 and r["matched"] <= r["template_words"]
        if r["doc_id"] in (1, 9, 10):
            assert r["coverage"] == 1
            words = licenses.words_of(texts[r["doc_id"]][r["begin"] : r["end"]])[0]
            assert words == licenses.words_of(licenses.TEMPLATES[r["license"]])[0]


def test_inserted_words_at_every_offset():
    """Up to as many inserted words as the template has; what is found must not depend on the place."""
    draw = random.Random(5)
    for name, text in licenses.TEMPLATES.items():
        template = licenses.Template(name, text, 80)
        size = len(template.words)
        for added in (size // 2, size):
            holes = Counter(draw.randint(1, size - 1) for _ in range(added))
            notice = [w for i, own in enumerate(template.words) for w in ["inserted"] * holes[i] + [own]]
            for offset in range(size):
                got = template.hits(["before"] * offset + notice + ["after"] * size)
                assert got == [(size, offset, offset + len(notice) - 1)], (name, added, offset)


def test_more_inserted_words_than_twice_the_template():
    draw = random.Random(7)
    for name, text in licenses.TEMPLATES.items():
        template = licenses.Template(name, text, 80)
        size = len(template.words)
        for each in (2, min(4, size - 1)):
            notice = [w for own in template.words for w in [own] + [f"inserted{draw.randint(0, 9)}"] * each][:-each]
            for offset in range(0, 2 * size, 3):
                got = template.hits(["before"] * offset + notice + ["after"] * 3 * size)
                assert got == [(size, offset, offset + len(notice) - 1)], (name, each, offset)


def test_terms_of_a_foundation():
    words = "licensed under the terms of the apache software foundation license version 2.0".split()
    template = licenses.Template("t", licenses.TEMPLATES["Apache-2.0 notice"], 80)
    for offset in range(20):
        assert template.hits(["x"] * offset + words + ["y"] * 9) == [(7, offset, offset + 11)]


def test_coverage_is_that_of_the_patience_alignment(monkeypatch):
    # Where anchors stand crossed, patience keeps the longest run of them and may lose words that the longest
    # common subsequence of the same passage has.
    draw = random.Random(3)
    shorter = 0
    for _ in range(3000):
        letters = [draw.choice("abcdef") for _ in range(8)]
        words = [draw.choice("abcdefx") for _ in range(10)]
        template = licenses.Template("t", " ".join(letters), 50)
        pairs = licenses.align(letters, words)
        longest = len(licenses._common(letters, words, 0, 8, 0, 10))
        assert len(pairs) <= longest
        if len(pairs) < longest and template.need <= longest:
            shorter += 1
            hits = template.hits(words)
            # Alignments of regions around each seed decide, never the longest common subsequence of a passage.
            starts = [template.passage(words, at, row) for at, w in enumerate(words) for row in template.seeds.get(w, ())]
            assert {h for h in hits} <= {(len(p), p[0][1], p[-1][1]) for p in starts if p}
    assert shorter > 20
    text = licenses.words_of("Before. Released under the MIT License. After.")[0]
    template = licenses.Template("t", licenses.TEMPLATES["MIT notice"], 80)
    assert template.hits(text) == [(5, 1, 5)]
    monkeypatch.setattr(licenses, "align", lambda a, b: [])
    assert template.hits(text) == []


def test_prose_between_ends_a_passage():
    template = licenses.Template("t", licenses.TEMPLATES["MIT notice"], 80)
    words = "released".split() + ["x"] * 6 + "under the mit license".split()
    assert template.hits(words) == [(4, 7, 10)]


def test_prefilter_loses_nothing():
    draw = random.Random(4)
    for name, text in licenses.TEMPLATES.items():
        template = licenses.Template(name, text, 80)
        for _ in range(30):
            words = [w for w in template.words if draw.random() < 0.85]
            if template.shared(words) >= template.need:
                assert template.may_hit(" ".join(words))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(docs).collect() == []
    some = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    assert licenses.scan(some, {}).collect() == [] and licenses.scan(some, {"none": " . "}).collect() == []
