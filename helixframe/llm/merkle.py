"""Merkle manifest of a dataset: a tree of SHA-256 digests whose parents retain hash midstates.

Every document is a leaf.  The leaves of a source stand by ``doc_id``; runs of
``FAN`` neighbours are hashed to one parent, level by level, until one node, the
source's subroot, remains.  The subroots, by source, form one more tree of the
same kind; its last node is the root.

A digest in hex is as long as a block of SHA-256, so a child is a block, and a
parent retains the state of its hash before each child's slot.  Folding a changed
leaf resumes the state before its slot with the replacement and the siblings to
its right; what lies to the left is never hashed again.  The proof of a leaf, a
hash over all its siblings, is carried upwards as such a state, too, so that no
document ever holds its path.

Work is cut into subtrees of ``HEIGHT`` levels, at most ``FAN ** HEIGHT`` nodes,
which one task builds and folds at once; their uppermost nodes are the leaves of
the next round.  A hot source has many subtrees.  States of many nodes are
advanced together in numpy; leaves are hashed by Spark.

Results: rows are ordered by ``doc_id``, null first, then by digest, so repeated
rows stand side by side, each a leaf of its own.  Null values count as ``-``, a
null source is a source of its own and the first one; empty texts are ``0:``.  A
null ``doc_id`` is never tampered with.  A source of one document has it as
subroot, a table of one source has its subroot as root.  An empty table gives an
empty result.  Other columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from helixframe.llm.common import held_out, query, table
from helixframe.operators.ordered import rank_rows
from helixframe.session import cut_lineage, task_count

FAN, HEIGHT = 16, 3
_SPAN = FAN**HEIGHT
#: The tree over the subroots.
TOP = -1


def _primes(count: int) -> list[int]:
    found: list[int] = []
    number = 2
    while len(found) < count:
        if all(number % p for p in found):
            found.append(number)
        number += 1
    return found


def _cube_root(number: int) -> int:
    root = round(number ** (1 / 3))
    while root**3 > number:
        root -= 1
    while (root + 1) ** 3 <= number:
        root += 1
    return root


# The constants of SHA-256: fractions of the roots of the first primes.
_ROUND = [np.uint32(_cube_root(p << 96) & 0xFFFFFFFF) for p in _primes(64)]
START = np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
_HEX = np.frombuffer(bytes(range(256)).hex().encode(), np.uint8).reshape(256, 2)


def _turned(x: np.ndarray, *places: int) -> np.ndarray:
    out = (x >> np.uint32(places[0])) | (x << np.uint32(32 - places[0]))
    for p in places[1:]:
        out ^= (x >> np.uint32(p)) | (x << np.uint32(32 - p))
    return out


def advance(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """States (n, 8) after one more block (n, 16) each."""
    w = list(np.ascontiguousarray(blocks.T))
    a, b, c, d, e, f, g, h = np.ascontiguousarray(states.T)
    for i, constant in enumerate(_ROUND):
        if i >= 16:
            x, y = w[i - 15], w[i - 2]
            w.append(w[i - 16] + (_turned(x, 7, 18) ^ (x >> np.uint32(3))) + w[i - 7] + (_turned(y, 17, 19) ^ (y >> np.uint32(10))))
        one = h + _turned(e, 6, 11, 25) + (g ^ (e & (f ^ g))) + constant + w[i]
        two = _turned(a, 2, 13, 22) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return states + np.stack([a, b, c, d, e, f, g, h], axis=1)


def finish(states: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Digests (n, 8) of messages of ``count`` whole blocks."""
    last = np.zeros((len(states), 16), np.uint32)
    last[:, 0] = 1 << 31
    last[:, 15] = count * 512
    return advance(states, last)


def blocks_of(digests: np.ndarray) -> np.ndarray:
    """The hex text of digests (..., 8) as blocks (..., 16)."""
    raw = np.ascontiguousarray(digests.astype(">u4")).view(np.uint8)
    return _HEX[raw].reshape(*digests.shape[:-1], 64).view(">u4").astype(np.uint32)


def _packed(words: np.ndarray) -> list[bytes]:
    """Rows of words as bytes."""
    raw = np.ascontiguousarray(words.astype(">u4"))
    return [r.tobytes() for r in raw]


def _words(column: pa.ChunkedArray) -> np.ndarray:
    """Digests of a binary column (n, 8)."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, 8).astype(np.uint32)


def _hex(digests: np.ndarray) -> list[str]:
    return [r.hex() for r in _packed(digests)]


def levels_above(nodes: int) -> int:
    """Levels from ``nodes`` leaves up to one node."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FAN), levels + 1
    return levels


class Runs:
    """Parents of one level: children, number of children, and the state before each slot."""

    def __init__(self, children: np.ndarray, count: np.ndarray, states: np.ndarray, digests: np.ndarray | None = None):
        self.children, self.count, self.states, self.digests = children, count, states, digests

    @classmethod
    def over(cls, nodes: np.ndarray) -> Runs:
        """Parents of neighbouring nodes (n, 8)."""
        size = -(-len(nodes) // FAN)
        children = np.zeros((size * FAN, 8), np.uint32)
        children[: len(nodes)] = nodes
        children = children.reshape(size, FAN, 8)
        count = np.minimum(len(nodes) - np.arange(size) * FAN, FAN)
        states = np.zeros((size, FAN, 8), np.uint32)
        state = np.tile(START, (size, 1))
        for slot in range(FAN):
            has = np.flatnonzero(count > slot)
            states[has, slot] = state[has]
            state[has] = advance(state[has], blocks_of(children[has, slot]))
        return cls(children, count, states, finish(state, count))

    def fold(self, parent: np.ndarray, slot: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Digests of the parents with the child in ``slot`` replaced: from the state before the slot on."""
        state = self.states[parent, slot]
        for at in range(FAN):
            on = np.flatnonzero((slot <= at) & (at < self.count[parent]))
            if len(on):
                block = np.where((slot[on] == at)[:, None], values[on], self.children[parent[on], at])
                state[on] = advance(state[on], blocks_of(block))
        return finish(state, self.count[parent])

    def prove(self, parent: np.ndarray, slot: np.ndarray, states: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and block counts of the proofs after the siblings of this level."""
        states, hashed = states.copy(), hashed.copy()
        for at in range(FAN):
            on = np.flatnonzero((slot != at) & (at < self.count[parent]))
            if len(on):
                states[on] = advance(states[on], blocks_of(self.children[parent[on], at]))
                hashed[on] += 1
        return states, hashed


_PARENT = "tree long, level int, idx long, digest binary, children binary, states binary"


def _parents(nodes: DataFrame, tier: int) -> DataFrame:
    """Parents on the next ``HEIGHT`` levels over ``tree, pos, digest, total`` (of the whole tree on this level)."""

    def build(group: pa.Table) -> pa.Table:
        tree, total = group.column("tree")[0].as_py(), group.column("total")[0].as_py()
        position = group.column("pos").to_numpy()
        order = np.argsort(position, kind="stable")
        block = int(position[order[0]]) // _SPAN
        digests = _words(group.column("digest"))[order]
        out = []
        for level in range(1, min(HEIGHT, levels_above(total)) + 1):
            runs = Runs.over(digests)
            first = block * FAN ** (HEIGHT - level)
            for i, digest in enumerate(_packed(runs.digests)):
                held = runs.count[i]
                out.append((tree, tier * HEIGHT + level, first + i, digest, _joined(runs.children[i, :held]), _joined(runs.states[i, :held])))
            digests = runs.digests
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        columns = list(zip(*out)) if out else [()] * 6
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in _PARENT.split(", ")])

    placed = nodes.where("total > 1").withColumn("block", F.floor(F.col("pos") / _SPAN))
    return placed.repartition(task_count(nodes.sparkSession), "tree", "block").groupBy("tree", "block").applyInArrow(build, _PARENT)


def _joined(words: np.ndarray) -> bytes:
    return np.ascontiguousarray(words.astype(">u4")).tobytes()


def _levels(total: Column) -> Column:
    """``levels_above`` of a column."""
    found = F.lit(0)
    for k in range(16):
        found = found + F.when(total > FAN**k, 1).otherwise(0)
    return found


def build(nodes: DataFrame, largest: int) -> DataFrame:
    """All parents of trees given as ``tree, pos, digest, total``, the largest of ``largest`` nodes."""
    parents, tier = None, 0
    while parents is None or largest > 1:
        made = cut_lineage(_parents(nodes, tier))
        parents = made if parents is None else parents.unionByName(made)
        tier, largest = tier + 1, -(-largest // _SPAN)
        sizes = nodes.groupBy("tree").agg(F.any_value("total").alias("total")).where(F.col("total") > _SPAN)
        upper = made.where(F.col("level") == tier * HEIGHT).select("tree", F.col("idx").alias("pos"), "digest")
        nodes = upper.join(sizes.select("tree", F.ceil(F.col("total") / _SPAN).alias("total")), "tree")
    return parents


def roots(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """``tree, digest`` of the last node of each tree."""
    lone = nodes.where("total = 1").select("tree", "digest")
    sizes = nodes.groupBy("tree").agg(F.any_value("total").alias("total")).where("total > 1")
    last = parents.where("idx = 0").join(sizes.select("tree", _levels(F.col("total")).alias("level")), ["tree", "level"])
    return lone.unionByName(last.select("tree", "digest"))


class Manifest:
    """``leaves`` (``tree, pos, total`` and what came with the documents), ``trees`` (``tree, source, total``),
    ``parents``, ``subroots`` (``tree, subroot, root``) of a dataset."""

    def __init__(self, leaves: DataFrame):
        """``leaves`` has ``source, doc_id, leaf`` (binary digest) and columns that are kept."""
        placed = rank_rows(leaves, ["source"], [F.col("doc_id"), F.col("leaf")], "pos")
        sizes = placed.groupBy("source").agg(F.count("*").alias("total"))
        trees = rank_rows(sizes, [], [F.col("source")], "tree")
        self.trees = cut_lineage(trees.select((F.col("tree") - 1).alias("tree"), "source", "total"))
        count, largest = self.trees.agg(F.count("*"), F.coalesce(F.max("total"), F.lit(0))).first()
        known = self.trees.withColumnRenamed("source", "_source")
        joined = placed.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        self.leaves = cut_lineage(joined.withColumn("pos", F.col("pos") - 1))
        nodes = self.leaves.select("tree", "pos", F.col("leaf").alias("digest"), "total")
        self.parents = build(nodes, largest)
        under = cut_lineage(roots(nodes, self.parents))
        tops = under.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", F.lit(count).cast("long").alias("total"))
        self.top_parents = build(tops, count)
        root = roots(tops, self.top_parents).select("digest").scalar()
        self.subroots = under.select("tree", F.col("digest").alias("subroot"), root.alias("root"))
        self.count = count

    def _paths(self) -> DataFrame:
        """What leaves need above their own subtree: parents by ``tree, block``, in order of ``step``, with the slot below."""
        power = lambda level: F.pow(F.lit(FAN), level).cast("long")
        blocks = self.trees.select("tree", "total", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / _SPAN))).alias("block"))
        above = blocks.where(F.col("total") > _SPAN).withColumn("level", F.explode(F.sequence(F.lit(HEIGHT + 1), _levels(F.col("total")))))
        inside = above.select(
            "tree", "block", "level", F.floor(F.col("block") / power(F.col("level") - HEIGHT)).alias("idx"),
            F.pmod(F.floor(F.col("block") / power(F.col("level") - HEIGHT - 1)), F.lit(FAN)).cast("int").alias("slot"),
        ).join(self.parents, ["tree", "level", "idx"])
        top = self.trees.select("tree", F.explode(F.sequence(F.lit(1), F.lit(levels_above(self.count)))).alias("level")) if self.count > 1 else None
        found = inside.select("tree", "block", F.col("level").alias("step"), "idx", "slot", "children", "states")
        if top is None:
            return found
        placed = top.select(
            "tree", "level", F.floor(F.col("tree") / power(F.col("level"))).alias("idx"),
            F.pmod(F.floor(F.col("tree") / power(F.col("level") - 1)), F.lit(FAN)).cast("int").alias("slot"),
        ).join(self.top_parents.drop("tree"), ["level", "idx"])
        every = blocks.select("tree", "block").join(placed, "tree")
        return found.unionByName(every.select("tree", "block", (F.col("level") + 1000).alias("step"), "idx", "slot", "children", "states"))

    def fold(self, replacement: str) -> DataFrame:
        """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every leaf, the root being
        folded from the binary column ``replacement`` and the retained states."""
        own = self.parents.where(F.col("level") <= HEIGHT).select(
            "tree", F.floor(F.col("idx") / F.pow(F.lit(FAN), HEIGHT - F.col("level")).cast("long")).alias("block"), F.col("level").alias("step"), "idx", F.lit(-1).alias("slot"), "children", "states"
        )
        ends = self.trees.select("tree", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / _SPAN))).alias("block"), F.lit(0).alias("step"))
        ends = ends.join(self.subroots, "tree").select("tree", "block", "step", F.lit(0).cast("long").alias("idx"), F.lit(-1).alias("slot"), F.col("subroot").alias("children"), F.col("root").alias("states"))
        known = own.unionByName(self._paths()).unionByName(ends)
        leaves = self.leaves.select("tree", F.floor(F.col("pos") / _SPAN).alias("block"), "pos", "doc_id", "leaf", F.col(replacement).alias("replacement"))
        tasks = task_count(leaves.sparkSession)
        schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        sides = [side.repartition(tasks, "tree", "block").groupBy("tree", "block") for side in (leaves, known)]
        return sides[0].cogroup(sides[1]).applyInArrow(_folded, schema)


def _folded(leaves: pa.Table, known: pa.Table) -> pa.Table:
    """Folds and proves the leaves of one subtree up to the root."""
    position = leaves.column("pos").to_numpy() % _SPAN
    values, size = _words(leaves.column("replacement")), leaves.num_rows
    proof, hashed = np.tile(START, (size, 1)), np.zeros(size, np.int64)
    steps = known.column("step").to_numpy()
    kept = [known.column(n).to_pylist() for n in ("children", "states")]
    index, slots = known.column("idx").to_numpy(), known.column("slot").to_numpy()
    ends = int(np.flatnonzero(steps == 0)[0])
    for step in sorted(set(steps.tolist()) - {0}):
        rows = np.flatnonzero(steps == step)
        rows = rows[np.argsort(index[rows])]
        count = np.array([len(kept[0][r]) // 32 for r in rows.tolist()])
        children, states = (np.zeros((len(rows), FAN, 8), np.uint32) for _ in range(2))
        for i, r in enumerate(rows.tolist()):
            children[i, : count[i]] = np.frombuffer(kept[0][r], ">u4").reshape(-1, 8)
            states[i, : count[i]] = np.frombuffer(kept[1][r], ">u4").reshape(-1, 8)
        runs = Runs(children, count, states)
        if step <= HEIGHT:
            parent, slot = position // FAN, position % FAN
            position = parent
        else:  # one node for all the leaves here
            parent, slot = np.zeros(size, np.int64), np.full(size, slots[rows[0]], np.int64)
        values = runs.fold(parent, slot, values)
        proof, hashed = runs.prove(parent, slot, proof, hashed)
    subroot, root = kept[0][ends].hex(), kept[1][ends].hex()
    folded = _hex(values)
    return pa.table({
        "doc_id": leaves.column("doc_id"), "leaf": pa.array([v.hex() for v in leaves.column("leaf").to_pylist()]), "subroot": pa.array([subroot] * size),
        "root": pa.array([root] * size), "proof_sha256": pa.array(_hex(finish(proof, hashed))), "folded_root": pa.array(folded),
        "verified": pa.array([f == root for f in folded]),
    })


def leaf(*columns: Column) -> Column:
    """Digest of the values: each ``-`` if null, else its length in bytes, a colon and itself."""
    texts = [c.cast("string") for c in columns]
    sized = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*sized), 256))


def tampered(docs: DataFrame) -> DataFrame:
    """Leaves of the documents, and of those with lower-cased texts where 5 divides the checksum of the id."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    own = leaf(*rest, F.col("text"))
    return docs.select(
        "source", F.col("doc_id").cast("long").alias("doc_id"), own.alias("leaf"),
        F.when(held_out(F.col("doc_id")), leaf(*rest, lower)).otherwise(own).alias("replacement"),
    )


_SQL = """
    WITH RECURSIVE d AS (SELECT *, row_number() OVER (ORDER BY doc_id, text) AS k FROM documents),
    f AS (SELECT k, doc_id, source, text,
            CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
            || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
            || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
            || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head,
            CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' END AS size,
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
            xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
              lambda a, x: CASE WHEN xor(a, x) & 1 = 1 THEN xor(xor(a, x) >> 1, 3988292384::BIGINT) ELSE xor(a, x) >> 1 END),
              4294967295::BIGINT) % 5 = 0 AS held FROM d),
    h AS (SELECT k, doc_id, source, sha256(head || size || coalesce(text, '')) AS leaf,
            sha256(head || size || coalesce(CASE WHEN held THEN low ELSE text END, '')) AS forged FROM f),
    s AS (SELECT source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) AS n FROM h GROUP BY source),
    p AS (SELECT h.*, s.tree, s.n, row_number() OVER (PARTITION BY s.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
          FROM h JOIN s ON h.source IS NOT DISTINCT FROM s.source),
    u(tree, level, pos, n, digest) AS (SELECT tree, 0, pos, n, leaf FROM p
      UNION ALL SELECT tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
      FROM u WHERE n > 1 GROUP BY tree, level, pos // 16, n),
    b AS (SELECT tree, digest AS subroot FROM u WHERE n = 1),
    t(level, pos, n, digest) AS (SELECT 0, tree, (SELECT count(*) FROM b), subroot FROM b
      UNION ALL SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
      FROM t WHERE n > 1 GROUP BY level, pos // 16, n),
    r AS (SELECT digest AS root FROM t WHERE n = 1),
    c AS (SELECT tree, level, pos // 16 AS parent, list(digest ORDER BY pos) AS kids FROM u WHERE n > 1 GROUP BY ALL),
    ct AS (SELECT level, pos // 16 AS parent, list(digest ORDER BY pos) AS kids FROM t WHERE n > 1 GROUP BY ALL),
    m(k, tree, level, pos, digest, proof) AS (SELECT k, tree, 0, pos, forged, '' FROM p
      UNION ALL SELECT m.k, m.tree, m.level + 1, m.pos // 16,
        sha256(array_to_string(list_concat(list_concat(kids[1 : m.pos % 16], [digest]), kids[m.pos % 16 + 2 :]), '')),
        proof || array_to_string(list_concat(kids[1 : m.pos % 16], kids[m.pos % 16 + 2 :]), '')
      FROM m JOIN c ON c.tree = m.tree AND c.level = m.level AND c.parent = m.pos // 16),
    ms AS (SELECT k, tree, arg_max(digest, level) AS digest, arg_max(proof, level) AS proof FROM m GROUP BY ALL),
    mt(k, level, pos, digest, proof) AS (SELECT k, 0, tree, digest, proof FROM ms
      UNION ALL SELECT mt.k, mt.level + 1, mt.pos // 16,
        sha256(array_to_string(list_concat(list_concat(kids[1 : mt.pos % 16], [digest]), kids[mt.pos % 16 + 2 :]), '')),
        proof || array_to_string(list_concat(kids[1 : mt.pos % 16], kids[mt.pos % 16 + 2 :]), '')
      FROM mt JOIN ct ON ct.level = mt.level AND ct.parent = mt.pos // 16),
    e AS (SELECT k, arg_max(digest, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM mt GROUP BY k)
    SELECT p.doc_id, p.leaf, b.subroot, r.root, e.proof_sha256, e.folded_root, e.folded_root = r.root AS verified
    FROM p JOIN b USING (tree) JOIN e USING (k) CROSS JOIN r"""


@query("op12_merkle_manifest", _SQL)
def op12(spark, sf_dir):
    """Leaf, subroot, root, proof and folded root of every document."""
    return Manifest(tampered(table(spark, sf_dir, "documents"))).fold("replacement")
