"""Hard negatives by inner product, from cover trees over norm-augmented vectors.

One more component gives all vectors of a block the same length, which turns the
inner product with an anchor into the angle to it and changes no score.  Over
these points stands a cover tree: a node covers its points within a radius, its
children have a radius smaller by ``BASE`` each level, lie further apart than
that, and the first of them has the node's own centre.  The score of a node's
centre and its covering radius bound the scores of all points below.

A search keeps its open nodes by upper bound and opens the best ones first.
Nodes whose bounds lie outside every score window, or below the last of the k
best known, are never opened; the points of leaves are scored exactly.  Many
anchors descend together, and anchors that open the same node share its matrix
product.

Rows are dealt into blocks by label: a frequent label fills blocks of its own, so
positives are looked for in the blocks of one label only; negatives are looked
for in all blocks.  The trees are written once, as rows (points in tree order,
and nodes), and used by both searches.

How much is skipped depends on the vectors: near a window's edge, or where all
points stand at right angles to each other, hardly anything is.

Results: vectors that are null, or hold null, NaN or infinite components, take no
part, nor do rows without id or label.  Rows, not ids, are candidates: a row
never meets itself, but meets other rows with its id.  Anchors meet vectors of
their own length; empty vectors score 0.  Ties go to the smaller id; among rows of
one id they make no difference to the result.  Anchors without a positive, and
positives without a negative, have no rows.  A repeated anchor has its rows once
for each time.  A score beyond 64 bits is held at the end of that range.  Empty
tables give an empty result.  Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from helixframe.llm.common import query, table
from helixframe.llm.exact_search import scaled
from helixframe.operators.ordered import prefix_scan
from helixframe.session import cut_lineage, task_count

#: Ratio of the radii of two levels; points that are not split any further; points of a leaf.
BASE, SMALL, LEAF = 1.3, 64, 256
#: Rows of a block, anchors of a block, anchors that descend together, nodes that each opens at once.
BLOCK, LEAST_BLOCK, ANCHORS, TOGETHER, OPENED = 65_536, 512, 16_384, 256, 4
_SLACK = 1e-7
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def unit_points(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """The norm-augmented vectors as points of a sphere, and their common length."""
    largest = np.abs(vectors).max(initial=0)
    if not len(vectors) or not largest:
        return np.hstack([vectors * 0, np.ones((len(vectors), 1))]), 0.0
    small = vectors / largest
    squares = (small * small).sum(axis=1)
    top = squares.max()
    points = np.hstack([small, np.sqrt(np.maximum(top - squares, 0))[:, None]]) / np.sqrt(top)
    return points, float(np.sqrt(top) * largest)


def _angles(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(points @ centre, -1, 1))


class Tree:
    """Points in tree order and nodes: ``centre, radius, first child, children, begin, end``."""

    def __init__(self, rows, ids, labels, vectors, nodes):
        self.rows, self.ids, self.labels, self.vectors, self.nodes = rows, ids, labels, vectors, nodes
        self.length = float(np.sqrt((vectors * vectors).sum(axis=1).max(initial=0)))

    @classmethod
    def over(cls, rows, ids, labels, vectors) -> Tree:
        points, _ = unit_points(vectors)
        order = np.argsort(ids, kind="stable")  # points of a leaf stand by id
        middle = points.mean(axis=0)
        root = int(np.argmax(points @ middle))
        nodes = [[root, float(_angles(points, points[root]).max()) + _SLACK, 0, 0, 0, len(ids)]]
        at = 0
        while at < len(nodes):
            centre, radius, _, _, begin, end = nodes[at]
            groups = cls._split(points, order[begin:end], centre, radius)
            if groups:
                nodes[at][2:4] = len(nodes), len(groups)
                order[begin:end] = np.concatenate([members for _, members in groups])
                for its, members in groups:
                    within = float(_angles(points[members], points[its]).max()) + _SLACK
                    nodes.append([its, within, 0, 0, begin, begin + len(members)])
                    begin += len(members)
            at += 1
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        table = np.array(nodes, np.float64)
        table[:, 0] = place[table[:, 0].astype(np.int64)]
        return cls(rows[order], ids[order], labels[order], vectors[order], table)

    @staticmethod
    def _split(points, members, centre, radius):
        """Children of a node (centre, points); none for a leaf."""
        if len(members) <= SMALL:
            return []
        leaves = [(centre, members[i : i + LEAF]) for i in range(0, len(members), LEAF)] if len(members) > LEAF else []
        if radius <= 4 * _SLACK:  # equal points
            return leaves
        within = radius / BASE
        away = _angles(points[members], points[centre])
        groups, left = [(centre, np.flatnonzero(away <= within))], np.flatnonzero(away > within)
        nearest = away[left]
        while len(left):
            if len(groups) > len(members) // 16:  # points too far apart from each other for smaller balls
                return leaves
            its = int(members[left[np.argmax(nearest)]])
            away = _angles(points[members[left]], points[its])
            taken = away <= within
            groups.append((its, left[taken]))
            left, nearest = left[~taken], np.minimum(nearest, away)[~taken]
        return [(its, members[np.sort(places)]) for its, places in groups if len(places)]


def _scores(vectors: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers (vectors x asked), held in 64 bits."""
    width = max(1, vectors.shape[1])
    if float(np.abs(vectors).max(initial=0)) * float(np.abs(asked).max(initial=0)) * width < 2.0**53:
        return (vectors @ asked.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    product = whole(vectors) @ whole(asked).T
    return np.array([[min(max(x, _LOW), _HIGH) for x in r] for r in product.tolist()], np.int64).reshape(len(vectors), len(asked))


class Search:
    """The k best of a tree for each anchor and each of its windows of scores, ends included."""

    def __init__(self, tree: Tree, asked, rows, labels, same: bool, low, high, k: int):
        self.tree, self.asked, self.own, self.labels, self.same, self.k = tree, asked, rows, labels, same, k
        self.low, self.high = low, high
        # The ends of the range stand for no bound.
        self.low_f = np.where(low == _LOW, -np.inf, low.astype(np.float64))
        self.high_f = np.where(high == _HIGH, np.inf, high.astype(np.float64))
        self.kth, self.kth_id = np.full(low.shape, _LOW), np.full(low.shape, _HIGH)
        self.best = [np.zeros(0, np.int64)] * 4
        self.reach = np.sqrt((asked * asked).sum(axis=1)) * tree.length
        self.scored = 0

    def run(self):
        nodes = self.tree.nodes
        every = np.arange(len(self.asked))
        self.upper, self.lower = (np.full((len(every), len(nodes)), -np.inf) for _ in range(2))
        self._open(every, np.array([0]))
        while True:
            width = min(OPENED, len(nodes))
            first = np.argpartition(-self.upper, width - 1, axis=1)[:, :width]
            floors = np.maximum(self.low_f, np.where(self.kth == _LOW, -np.inf, self.kth.astype(np.float64))).min(axis=1)
            who, which = np.nonzero(np.take_along_axis(self.upper, first, 1) >= np.maximum(floors, -1e300)[:, None])
            if not len(who):
                return self.best
            node = first[who, which]
            useful = self._useful(who, self.upper[who, node], self.lower[who, node])
            self.upper[who, node] = -np.inf
            who, node = who[useful], node[useful]
            order = np.argsort(node, kind="stable")
            who, node = who[order], node[order]
            edges = [0, *(np.flatnonzero(np.diff(node)) + 1).tolist(), len(node)]
            found = []
            for begin, end in zip(edges, edges[1:]):
                if begin < end:
                    _, _, child, children, first_point, last_point = nodes[node[begin]]
                    if children:
                        self._open(who[begin:end], np.arange(int(child), int(child + children)))
                    else:
                        found.append(self._score(who[begin:end], int(first_point), int(last_point)))
            if found:
                self._keep([np.concatenate(c) for c in zip(*found)])

    def _useful(self, who, upper, lower):
        known = np.where(self.kth[who] == _LOW, -np.inf, self.kth[who].astype(np.float64))
        return ((upper[:, None] >= np.maximum(self.low_f[who], known)) & (lower[:, None] <= self.high_f[who])).any(axis=1)

    def _open(self, who, nodes):
        """Bounds of ``nodes`` for the anchors ``who``; the useful ones become open."""
        centres = self.tree.vectors[self.tree.nodes[nodes, 0].astype(np.int64)]
        product, reach = (centres @ self.asked[who].T).T, self.reach[who][:, None]
        angle = np.arccos(np.clip(np.divide(product, reach, out=np.zeros_like(product), where=reach > 0), -1, 1))
        radius = self.tree.nodes[nodes, 1][None, :] + _SLACK
        margin = reach * 1e-6
        upper = reach * np.cos(np.maximum(angle - radius, 0)) + margin
        lower = reach * np.cos(np.minimum(angle + radius, np.pi)) - margin
        at = np.repeat(who, len(nodes))
        useful = self._useful(at, upper.ravel(), lower.ravel())
        at, below = at[useful], np.tile(nodes, len(who))[useful]
        self.upper[at, below], self.lower[at, below] = upper.ravel()[useful], lower.ravel()[useful]

    def _score(self, who, begin, end):
        """Points of a leaf that belong to the best so far: anchor, window, score, id."""
        tree = self.tree
        score = _scores(tree.vectors[begin:end], self.asked[who])
        self.scored += score.size
        allowed = (tree.labels[begin:end, None] == self.labels[who]) == self.same
        allowed &= tree.rows[begin:end, None] != self.own[who]
        point, column = np.nonzero(allowed & (score >= np.maximum(self.low[who], self.kth[who]).min(axis=1)))
        anchor, value, ids = who[column], score[point, column], tree.ids[begin:end][point]
        kth = self.kth[anchor]
        fits = (value[:, None] >= self.low[anchor]) & (value[:, None] <= self.high[anchor])
        fits &= (value[:, None] > kth) | ((value[:, None] == kth) & (ids[:, None] < self.kth_id[anchor]))
        row, window = np.nonzero(fits)
        return anchor[row], window, value[row], ids[row]

    def _keep(self, found):
        anchor, window, score, ids = (np.concatenate(c) for c in zip(self.best, found))
        order = np.lexsort((ids, ~score, window, anchor))
        anchor, window, score, ids = anchor[order], window[order], score[order], ids[order]
        group = anchor * self.low.shape[1] + window
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        place = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
        kept = place < self.k
        self.best = [anchor[kept], window[kept], score[kept], ids[kept]]
        last = np.flatnonzero(place == self.k - 1)
        self.kth[anchor[last], window[last]], self.kth_id[anchor[last], window[last]] = score[last], ids[last]


def search(tree: Tree, asked, rows, labels, same: bool, low, high, k: int):
    """``anchor, window, score, id`` of the best points, and how many were scored exactly."""
    out, scored = [], 0
    for begin in range(0, len(asked), TOGETHER):
        part = slice(begin, begin + TOGETHER)
        one = Search(tree, asked[part], rows[part], labels[part], same, low[part], high[part], k)
        anchor, *rest = one.run()
        out.append((anchor + begin, *rest))
        scored += one.scored
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4, scored


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


_INDEX = "bucket long, place long, row long, vec_id long, label long, v array<double>"


class Index:
    """Cover trees over ``rows`` (``row, vec_id, label, v, size``), and where each label stands."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        counts = cut_lineage(rows.groupBy("size", "label").agg(F.count("*").alias("n")))
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        block = min(BLOCK, max(LEAST_BLOCK, -(-total // task_count(spark))))
        # Frequent labels have blocks of their own; the others fill blocks one after another, none above twice the size.
        parts = F.ceil(F.col("n") / block).cast("long")
        few = F.when(F.col("n") <= block, F.col("n")).otherwise(0)
        home = prefix_scan(counts.withColumn("few", few), ["size"], [F.col("label")], filled=("sum", "few")).withColumn("parts", parts)
        home = home.withColumn("base", F.when(F.col("parts") == 1, F.floor((F.col("filled") - F.col("n")) / block)))
        self.home = cut_lineage(home.select("size", "label", "parts", "base"))
        bucket = lambda part: F.xxhash64("size", F.coalesce("base", F.lit(-1)), F.when(F.col("base").isNull(), F.col("label")), part)
        shared = F.when(F.col("base").isNull(), F.pmod(F.xxhash64("row"), F.col("parts"))).otherwise(F.lit(0))
        placed = rows.join(self.home, ["size", "label"]).withColumn("bucket", bucket(shared))
        self.stands = self.home.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(
            "size", "label", bucket(F.col("part")).alias("bucket")
        )
        self.buckets = self.stands.select("size", "bucket").distinct()

        def build(group: pa.Table) -> pa.Table:
            tree = Tree.over(*[group.column(n).to_numpy() for n in ("row", "vec_id", "label")], _matrix(group.column("v")))
            bucket = group.column("bucket")[0].as_py()
            places = np.concatenate([np.arange(len(tree.rows)), -1 - np.arange(len(tree.nodes))])
            none = np.zeros(len(tree.nodes), np.int64)
            columns = [np.full(len(places), bucket), places, *[np.concatenate([c, none]) for c in (tree.rows, tree.ids, tree.labels)]]
            numbers = [*tree.vectors.tolist(), *tree.nodes.tolist()]
            return pa.table([*[pa.array(c, pa.int64()) for c in columns], pa.array(numbers, pa.list_(pa.float64()))], names=[f.split()[0] for f in _INDEX.split(", ")])

        tasks = task_count(spark)
        grouped = placed.select("bucket", "row", "vec_id", "label", "v").repartition(tasks, "bucket").groupBy("bucket")
        self.table = cut_lineage(grouped.applyInArrow(build, _INDEX))

    def best(self, asked: DataFrame, to: DataFrame, on: list[str], same: bool, k: int, blocks: int) -> DataFrame:
        """``row, window, vec_id, score``: the k best of every bucket that ``to`` names for the anchors
        ``asked`` (``row, label, v, low, high``, the last two arrays, one entry for each window)."""
        dealt = asked.join(to, on).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(blocks)))
        left = dealt.select("part", "bucket", "row", "label", "v", "low", "high")
        cells = left.select(F.col("part").alias("_part"), F.col("bucket").alias("_bucket")).distinct()
        met = self.table.join(cells, F.col("bucket") == F.col("_bucket"))
        right = met.select(F.col("_part").alias("part"), F.col("_bucket").alias("bucket"), "place", "row", "vec_id", "label", "v")

        def meet(anchors: pa.Table, points: pa.Table) -> pa.Table:
            if not anchors.num_rows or not points.num_rows:
                return pa.table([pa.array([], pa.int64())] * 4, names=names)
            tree = _tree_of(points)
            found, _ = search(tree, _matrix(anchors.column("v")), anchors.column("row").to_numpy(), anchors.column("label").to_numpy(),
                              same, _matrix(anchors.column("low")), _matrix(anchors.column("high")), k)
            anchor, window, score, ids = found
            return pa.table([anchors.column("row").take(pa.array(anchor)), *[pa.array(c, pa.int64()) for c in (window, ids, score)]], names=names)

        names = ["row", "window", "vec_id", "score"]
        tasks = task_count(asked.sparkSession)
        sides = [side.repartition(tasks, "part", "bucket").groupBy("part", "bucket") for side in (left, right)]
        return sides[0].cogroup(sides[1]).applyInArrow(meet, "row long, window long, vec_id long, score long")


def _tree_of(points: pa.Table) -> Tree:
    place = points.column("place").to_numpy()
    order = np.argsort(place, kind="stable")
    split = int((place < 0).sum())
    nodes = _matrix(points.column("v").take(pa.array(order[:split][::-1])))
    rest = points.take(pa.array(order[split:]))
    return Tree(*[rest.column(n).to_numpy() for n in ("row", "vec_id", "label")], _matrix(rest.column("v")), nodes)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id, label, v`` (arrays of whole doubles).  A negative scores between ``low``
    and ``high`` hundredths of the positive.
    """
    spark = vectors.sparkSession
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    numbered = usable.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        "v", F.size("v").alias("size"), is_anchor.alias("anchor"),
    )
    rows = cut_lineage(numbered)  # the numbers are drawn once
    index = Index(rows.drop("anchor"))
    anchors = rows.where("anchor").drop("anchor")
    blocks = max(1, -(-anchors.count() // ANCHORS))
    any_score = lambda end: F.array(F.lit(end).cast("long"))
    asked = anchors.select("row", "label", "size", "v", any_score(_LOW).alias("low"), any_score(_HIGH).alias("high"))
    near = index.best(asked, index.stands, ["size", "label"], True, positives, blocks)
    # Of each block of its label an anchor has at most ``positives`` rows.
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    first = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    pairs = cut_lineage(first.select("row", (F.col("place") - 1).cast("long").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    p = F.col("positive_score").cast("decimal(38,0)")
    ends = pairs.select(
        "row", "window", F.ceil(p * low / 100).cast("long").alias("low"), F.floor(p * high / 100).cast("long").alias("high")
    )
    listed = ends.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("window", "low", "high"))).alias("w"))
    asked = anchors.select("row", "label", "size", "v").join(listed, "row")
    # Fewer positives leave the last windows empty.
    empty = positives - F.size("w")
    asked = asked.select(
        "row", "label", "size", "v", F.concat("w.low", F.array_repeat(F.lit(_HIGH), empty)).alias("low"), F.concat("w.high", F.array_repeat(F.lit(_LOW + 1), empty)).alias("high")
    )
    hard = index.best(asked, index.buckets, ["size"], False, negatives, blocks)
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "vec_id")
    ranked = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    return ranked.join(pairs, ["row", "window"]).join(named, "row").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


@query(
    "op13_hard_negatives",
    """
    WITH e AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.k, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
          FROM e a JOIN e c ON a.k <> c.k AND len(a.v) = len(c.v) WHERE a.vec_id % 50 = 0),
    p AS (SELECT k, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS w
          FROM s WHERE same QUALIFY w <= 5),
    n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
            CAST(row_number() OVER (PARTITION BY p.k, p.w ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
          FROM p JOIN s ON s.k = p.k AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
          QUALIFY rank <= 3)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n
    """,
)
def op13(spark, sf_dir):
    """Negatives that score half to nineteen twentieths of a positive, for every fiftieth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), scaled(F.col("embedding"), 256).alias("v"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0)
