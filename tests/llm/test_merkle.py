import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from helixframe.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree long, pos int, root string"


def h(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def leaf_of(row, lower=False):
    doc_id, text, lang, source, n_chars = row[:5]
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def climb(levels, at, value, proof):
    for nodes in levels[:-1]:
        first = at // 16 * 16
        run = nodes[first : first + 16]
        proof += [n for i, n in enumerate(run, first) if i != at]
        value = h("".join(value if i == at else n for i, n in enumerate(run, first)))
        at //= 16
    return value


def by_hand(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        members = sorted(groups[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append((members, levels_of([leaf_of(r) for r in members])))
    top = levels_of([levels[-1][0] for _, levels in trees])
    out = []
    for number, (members, levels) in enumerate(trees):
        for at, row in enumerate(members):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            proof = []
            value = climb(levels, at, leaf_of(row, changed), proof)
            value = climb(top, number, value, proof)
            out.append((row[0], leaf_of(row), levels[-1][0], top[-1][0], h("".join(proof)), value, value == top[-1][0]))
    return out


def compare(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(3)
    got = merkle.Manifest(merkle.tampered(docs)).fold("replacement").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(by_hand(rows), key=key)


def test_states_are_those_of_the_hash():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(37)]
    words = np.frombuffer(b"".join(digests), ">u4").reshape(-1, 8).astype(np.uint32)
    runs = merkle.Runs.over(words)
    assert merkle._hex(runs.digests) == [h("".join(d.hex() for d in digests[i : i + 16])) for i in (0, 16, 32)]
    # What lies left of the slot is in the state alone: other children there change nothing.
    other = runs.children.copy()
    other[:, :7] = 0
    changed = merkle.Runs(other, runs.count, runs.states)
    parent, slot = np.array([0, 1]), np.array([7, 9])
    assert (changed.fold(parent, slot, words[[7, 25]]) == runs.digests[:2]).all()
    assert not (changed.fold(parent, slot, words[[8, 24]]) == runs.digests[:2]).any()


def test_many_subtrees_and_sources(spark):
    # One source has more leaves than three levels hold; sources fill two levels of the upper tree.
    rows = [(i, f"Text {i}", "en", "hot", i) for i in range(4500)]
    rows += [(10_000 + i, f"Été {i}" if i % 3 else None, None if i % 4 else "fr", f"s{i % 40}" if i % 41 else None, None) for i in range(700)]
    compare(spark, rows)


def test_odd_rows(spark):
    rows = [(1, "", "en", "a", 0), (1, "", "en", "a", 0), (1, "Other", "en", "a", 5), (None, "No id", None, None, None), (None, None, None, None, None)]
    rows += [(5, "X" * 300_000, "de", "é", 9), (6, "ß😀 A", "de", "z", 4), (-3, "Negative", "de", "", 8)]
    compare(spark, rows)


def test_one_document_and_none(spark):
    compare(spark, [(9, "Only", "en", "a", 4)])
    assert merkle.Manifest(merkle.tampered(spark.createDataFrame([], SCHEMA))).fold("replacement").collect() == []


def test_runs_of_exactly_sixteen(spark):
    compare(spark, [(i, "T", "en", "a" if i < 256 else "b", 1) for i in range(272)])


def test_new_leaf_changes_only_its_path(spark):
    docs = spark.createDataFrame([(i, f"T{i}", "en", "a", 1, 1, 2, "x") for i in range(600)], SCHEMA)
    manifest = merkle.Manifest(merkle.tampered(docs))
    rows = {(r["level"], r["idx"]): r["digest"] for r in manifest.parents.collect()}
    changed = merkle.Manifest(merkle.tampered(docs.withColumn("text", F.when(F.col("doc_id") == 300, "New").otherwise(F.col("text")))))
    other = {(r["level"], r["idx"]): r["digest"] for r in changed.parents.collect()}
    assert {k for k in rows if rows[k] != other[k]} == {(1, 18), (2, 1), (3, 0)}
