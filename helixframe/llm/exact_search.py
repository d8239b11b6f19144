"""Exact top-k search by inner product, columnar branch-and-bound.

Candidates and queries are dealt into blocks; every pair of a query block and a
candidate block meets in one task.  There the candidates stand dimension by
dimension, the longest first.  A query sums its scores over blocks of dimensions,
those with most of its own mass first; after each block a candidate's score can
still grow by at most the product of the two vectors' remaining lengths, and
candidates that cannot reach the k-th score known so far are dropped from the
columns.  Candidates come in chunks, so that the k best of earlier chunks set the
bound for later ones, and chunks too short for it are not looked at.  The k best
of every block pair are merged per query.

Components are integers, and the scores of the candidates that are left are exact
whole numbers of any size, so the result does not depend on the order of anything.

Results: vectors that are null or hold null, NaN or infinite components take no
part, nor do rows with a null id.  Rows, not ids, are candidates: a query meets
every row but its own, also others with its id, and of its own number of
components only.  A repeated query has its rows once for each time.  Ties go to
the smaller id.  Fewer than k candidates give as many rows as there are; empty
vectors score 0; empty tables give an empty result.  A score beyond 64 bits is
held at the end of that range.  Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from helixframe.llm.common import query, table
from helixframe.session import cut_lineage

#: Vectors of one block; dimensions summed at once; candidates looked at in turn; candidates that give a first bound.
CANDIDATES, QUERIES = 65_536, 16_384
DIMENSIONS, CHUNK, SEEDS = 8, 8192, 512
#: Share of a query's squared length that its first block of dimensions holds.
FIRST_MASS = 0.85
_OUT = "query_row long, query_id long, vec_id long, score long"
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _matrix(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return group.column("row").to_numpy(), group.column("vec_id").to_numpy(), flat.reshape(group.num_rows, -1)


class Block:
    """Candidates by falling length, dimension by dimension."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.largest = float(np.abs(vectors).max(initial=0)) or 1.0
        small = vectors / self.largest
        lengths = np.sqrt((small * small).sum(axis=1))
        order = np.lexsort((ids, -lengths))
        self.rows, self.ids, self.vectors, self.lengths = rows[order], ids[order], vectors[order], lengths[order].astype(np.float32)
        self.place = {row: i for i, row in enumerate(self.rows.tolist())}
        # Sums of rounded numbers decide what is dropped; their margin is far wider than their error.
        self.columns = np.ascontiguousarray(small[order].T.astype(np.float32))
        self.mass = (self.columns * self.columns).sum(axis=1)
        #: Candidates that a block of dimensions was summed for, by the number of the first dimension.
        self.summed: dict[int, int] = {}

    def exact(self, places: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Scores of candidates, held in 64 bits."""
        some = self.vectors[places]
        if self.largest * float(np.abs(asked).max(initial=0)) * max(1, len(asked)) < 2.0**53:
            return (some @ asked).astype(np.int64)
        whole = [int(x) for x in asked.tolist()]
        sums = (sum(int(x) * y for x, y in zip(v, whole)) for v in some.tolist())
        return np.array([min(max(s, _LOW), _HIGH) for s in sums], np.int64)

    def best(self, row: int, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates for one query."""
        size, own = len(asked), self.place.get(row, -1)
        top = float(np.abs(asked).max(initial=0)) or 1.0
        order = np.argsort(-np.abs(asked) * np.sqrt(self.mass), kind="stable")
        q = (asked[order] / top).astype(np.float32)
        squares = np.concatenate([[0], np.cumsum(q.astype(np.float64) ** 2)])
        length = float(np.sqrt(squares[-1]))
        first = int(np.searchsorted(squares, FIRST_MASS * squares[-1])) if length else size
        cuts = [0, *range(min(max(first, 1), size), size, DIMENSIONS), size] if size else [0, 0]
        left = np.sqrt(np.maximum(squares[-1] - squares, 0)) * (1 + 1e-6)
        unit = top * self.largest
        # The first bound: scores of some of the longest.
        seeds = np.arange(min(SEEDS, len(self.ids)))
        seeds = seeds[seeds != own]
        known = self.exact(seeds, asked)
        bound = np.partition(known, len(known) - k)[len(known) - k] if len(known) >= k else None
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for begin in range(0, len(self.ids), CHUNK):
            longest = float(self.lengths[begin]) * length
            margin = 1e-5 * longest
            # Scores held at the low end are no bound for those beyond it.
            least = -np.inf if bound is None or bound == _LOW else float(bound) / unit - margin
            if longest < least:
                break  # all later ones are shorter still
            stop = min(begin + CHUNK, len(self.ids))
            some = self.columns[:, begin:stop][order[: cuts[1]]]
            self.summed[0] = self.summed.get(0, 0) + stop - begin
            score = q[: cuts[1]] @ some
            rest = np.maximum(self.lengths[begin:stop] ** 2 - np.einsum("ij,ij->j", some, some), 0)
            alive = score + np.sqrt(rest) * left[cuts[1]] + margin >= least
            if begin <= own < stop:
                alive[own - begin] = False
            alive = np.flatnonzero(alive)
            score, rest, alive = score[alive], rest[alive], alive + begin
            for at, end in zip(cuts[1:], cuts[2:]):
                if not len(alive):
                    break
                self.summed[at] = self.summed.get(at, 0) + len(alive)
                some = self.columns[np.ix_(order[at:end], alive)]
                score = score + q[at:end] @ some
                rest = np.maximum(rest - np.einsum("ij,ij->j", some, some), 0)
                stays = score + np.sqrt(rest) * left[end] + margin >= least
                alive, score, rest = alive[stays], score[stays], rest[stays]
            ids, scores = np.concatenate([ids, self.ids[alive]]), np.concatenate([scores, self.exact(alive, asked)])
            best = np.lexsort((ids, ~scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(scores) == k:
                bound = scores[-1] if bound is None else max(bound, scores[-1])
        return ids, scores


def top_k(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``; ``vectors`` has ``vec_id, v`` (arrays of whole doubles),
    ``is_query`` is a condition on its rows."""
    spark = vectors.sparkSession
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    # The row numbers are drawn once, when the table is written.
    rows = cut_lineage(usable.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "v", is_query.alias("asked")))
    n, asked = rows.agg(F.count("*"), F.count(F.when(F.col("asked"), 1))).first()
    tasks = spark.sparkContext.defaultParallelism
    blocks = max(-(-n // CANDIDATES), min(tasks, -(-n // 2048)), 1)
    query_blocks = max(-(-asked // QUERIES), 1)
    size = F.size("v").alias("size")
    block, query_block = F.pmod(F.hash("row"), F.lit(blocks)), F.pmod(F.hash("row"), F.lit(query_blocks))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.where("asked").select("row", "vec_id", "v", size, query_block.alias("qb"), every(blocks).alias("cb"))
    right = rows.select("row", "vec_id", "v", size, every(query_blocks).alias("qb"), block.alias("cb"))

    def meet(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found = [[np.zeros(0, np.int64)] * 4]
        if queries.num_rows and candidates.num_rows:
            known = Block(*_matrix(candidates))
            for row, query_id, v in zip(*_matrix(queries)):
                ids, scores = known.best(row, v, k)
                found.append([np.full(len(ids), row), np.full(len(ids), query_id), ids, scores])
        return pa.table({n: pa.array(np.concatenate(c), pa.int64()) for n, c in zip(("query_row", "query_id", "vec_id", "score"), zip(*found))})

    cells = left.groupBy("size", "qb", "cb").cogroup(right.groupBy("size", "qb", "cb")).applyInArrow(meet, _OUT)
    # One query has at most k rows of each candidate block.
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(embedding, factor: int = 64):
    """Components times ``factor``, rounded down; null if any is null or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(F.forall(embedding, finite), F.transform(embedding, lambda x: F.floor(x.cast("double") * factor).cast("double")))


@query(
    "op9_exact_topk",
    """
    WITH e AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.k, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
          FROM e q JOIN e c ON q.k <> c.k AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def op9(spark, sf_dir):
    """The 20 best vectors for every twentieth one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", scaled(F.col("embedding")).alias("v"))
    return top_k(vectors, F.col("vec_id") % 20 == 0, 20)
