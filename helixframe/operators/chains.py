"""Chains and nets of alignment blocks.

Blocks are half open: ``(block_id, t_name, t_start, t_end, q_name, q_start,
q_end, strand, score)``.  A few chromosome pairs hold all blocks, so ordered work
goes through ``prefix_scan`` and coverage through sweeps over ranges; nothing
gathers a chromosome in one task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from helixframe.operators.genome import file_states
from helixframe.operators.ordered import desc, prefix_scan, rank_rows, segments
from helixframe.operators.ranges import merge_intervals, stab, sweep
from helixframe.session import cut_lineage, task_count

LANE = ["t_name", "q_name", "strand"]


def chain_runs(blocks: DataFrame, gap: int) -> DataFrame:
    """Blocks with ``chain_id``: neighbours in target order chain while both gaps are within ``gap``."""
    def joins(before: dict, now: dict) -> pa.Array:
        t_gap = pc.subtract(now["t_start"], before["t_end"])
        # The query runs backwards on the minus strand.
        plus, minus = pc.subtract(now["q_start"], before["q_end"]), pc.subtract(before["q_start"], now["q_end"])
        q_gap = pc.if_else(pc.equal(now["strand"], "+"), plus, minus)
        near = [pc.and_(pc.greater_equal(x, 0), pc.less_equal(x, gap)) for x in (t_gap, q_gap)]
        return pc.and_(*near)

    named = blocks.dropna(subset=LANE)
    return segments(named, LANE, [F.col("t_start"), F.col("block_id")], ["t_start", "t_end", "q_start", "q_end", "strand"], joins, "block_id", "chain_id")


def chain_table(chained: DataFrame, lane: list[str] = LANE) -> DataFrame:
    """One row per chain; the score is that of the blocks less the ``link_cost`` of the gaps, where there is one.

    The blocks of a chain lie in one lane; a table may tell only some columns of it.
    """
    paid = F.sum("score") - F.sum("link_cost") if "link_cost" in chained.columns else F.sum("score")
    return chained.groupBy("chain_id", *lane).agg(
        F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.min("q_start").alias("q_start"),
        F.max("q_end").alias("q_end"), paid.alias("score"), F.count(F.lit(1)).alias("blocks"),
    )


# Costs of the named gap kinds at eleven lengths, for a gap in one sequence and in both.
GAP_LENGTHS = (1, 2, 3, 11, 111, 2111, 12111, 32111, 72111, 152111, 252111)
GAP_COSTS = {
    "medium": (
        (350, 425, 450, 600, 900, 2900, 22900, 57900, 117900, 217900, 317900),
        (750, 825, 850, 1000, 1300, 3300, 23300, 58300, 118300, 218300, 318300),
    ),
    "loose": (
        (325, 360, 400, 450, 600, 1100, 3600, 7600, 15600, 31600, 56600),
        (625, 660, 700, 750, 900, 1400, 4000, 8000, 16000, 32000, 57000),
    ),
}
#: Blocks of a lane that one task chains at once.
LANE_ROWS = 100_000
#: Pairs of blocks that are looked at together in a task; at least those of one block.
CANDIDATES = 1 << 20


def gap_costs(kind: str | float, t_gap: np.ndarray, q_gap: np.ndarray) -> np.ndarray:
    """Costs of gaps: a price per letter, or a named kind, linear between its lengths and rounded."""
    total = t_gap + q_gap
    if not isinstance(kind, str):
        return total * kind
    at = np.clip(np.searchsorted(GAP_LENGTHS, total, side="right") - 1, 0, len(GAP_LENGTHS) - 2)
    low, high = (np.array(GAP_LENGTHS, np.float64)[at + i] for i in (0, 1))
    cost = 0.0
    for both, costs in enumerate(np.array(GAP_COSTS[kind], np.float64)):
        here = np.floor(costs[at] + (costs[at + 1] - costs[at]) * (total - low) / (high - low) + 0.5)
        cost = here if not both else np.where((t_gap > 0) & (q_gap > 0), here, cost)
    return np.where(total > 0, cost, 0.0)


_SETTLED = "j bigint, t_end bigint, q_end bigint, best double, i bigint, cost double"


def _settle(rows: pa.Table, max_gap: int, kind: str | float) -> pa.Table:
    """Best scores of the blocks of one range of a lane, in target order, after those carried in."""
    name, t_start, t_end, q_start, q_end, own, best = (
        rows.column(c).to_numpy(zero_copy_only=False) for c in ("j", "t_start", "t_end", "q_start", "q_end", "own", "best")
    )
    known = ~np.isnan(best)
    by_end = np.argsort(t_end, kind="stable")
    ends, q_ends = t_end[by_end], q_end[by_end]
    score = np.where(known, best, own)
    place = np.empty(len(by_end), np.int64)
    place[by_end] = np.arange(len(by_end))
    sorted_score = score[by_end].astype(np.float64)
    order = np.flatnonzero(~known)
    order = order[np.lexsort((name[order], t_start[order]))]
    # Ends by cells of the query, as long as a gap may be, and in them by the target: a block can follow those of two cells.
    cell = q_ends // (max_gap + 1)
    by_cell = np.lexsort((np.arange(len(cell)), cell))
    cells = np.unique(cell)
    width = len(cell) + 1
    keys = np.searchsorted(cells, cell[by_cell]) * width + by_cell
    low, high = (np.searchsorted(ends, t_start[order] - gap, side=side) for gap, side in ((max_gap, "left"), (0, "right")))
    first, count = np.zeros((len(order), 2), np.int64), np.zeros((len(order), 2), np.int64)
    for k, here in enumerate((q_start[order] // (max_gap + 1), (q_start[order] - max_gap) // (max_gap + 1))):
        code = np.searchsorted(cells, here)
        there = cells[np.minimum(code, len(cells) - 1)] == here
        first[:, k] = np.searchsorted(keys, code * width + low)
        count[:, k] = np.where(there, np.maximum(np.searchsorted(keys, code * width + high) - first[:, k], 0), 0)
    count[q_start[order] % (max_gap + 1) == max_gap, 1] = 0  # both ends of the reach lie in one cell
    back, paid = np.full(len(order), -1, np.int64), np.zeros(len(order))
    ids = name[by_end]
    share = np.cumsum(count.sum(axis=1)) // CANDIDATES
    edges = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(order)]
    for begin, end in zip(edges, edges[1:]):
        # Links of many blocks are looked up at once.
        some = count[begin:end].ravel()
        at = np.repeat(np.arange(len(some)), some)
        before = by_cell[np.arange(len(at)) - (np.cumsum(some) - some)[at] + first[begin:end].ravel()[at]]
        at = begin + at // 2
        q_gap = q_start[order[at]] - q_ends[before]
        near = np.flatnonzero((q_gap >= 0) & (q_gap <= max_gap))
        at, before = at[near], before[near]
        cost = gap_costs(kind, t_start[order[at]] - ends[before], q_gap[near])
        opens = np.flatnonzero(np.concatenate([[True], np.diff(at) != 0]))[: len(at)]
        # A block that ends where another begins has begun before it, so its score is settled.
        for n, home, since, until in zip(at[opens].tolist(), place[order[at[opens]]].tolist(), opens.tolist(), [*opens[1:].tolist(), len(at)]):
            if until - since == 1:
                linked = since
                top = sorted_score[before[linked]] - cost[linked]
            else:
                gain = sorted_score[before[since:until]] - cost[since:until]
                top = gain.max()
                tied = np.flatnonzero(gain == top)
                linked = since + (tied[np.argmin(ids[before[since + tied]])] if len(tied) > 1 else tied[0])
            if top > 0:
                back[n], paid[n] = ids[before[linked]], cost[linked]
                sorted_score[home] += top
    return pa.table({
        "j": pa.array(name[order]), "t_end": pa.array(t_end[order]), "q_end": pa.array(q_end[order]), "best": pa.array(sorted_score[place[order]]),
        "i": pa.array(back, mask=back < 0), "cost": pa.array(paid),
    })


def _settled(blocks: DataFrame, max_gap: int, kind: str | float) -> DataFrame:
    """``j, best, i, cost``: best score of a chain that ends in each block, the block before and what the link costs.

    Lanes are cut into ranges of target order; the ranges of all lanes with the same number are settled
    together.  What the next range can still link to, the blocks that end within ``max_gap`` before it, is
    carried on.  The rounds are as many as the longest lane has ranges, whatever the chains.
    """
    end_q = F.when(F.col("strand") == "+", F.col("q_end")).otherwise(-F.col("q_start"))
    start_q = F.when(F.col("strand") == "+", F.col("q_start")).otherwise(-F.col("q_end"))
    turned = blocks.select(*LANE, F.col("block_id").alias("j"), "t_start", "t_end", start_q.alias("q_start"), end_q.alias("q_end"), F.col("score").cast("double").alias("own"))
    ranked = rank_rows(turned, LANE, [F.col("t_start"), F.col("j")], "_rn")
    rows = cut_lineage(ranked.withColumn("range", F.floor((F.col("_rn") - 1) / LANE_ROWS)).drop("_rn"))
    begins = rows.groupBy(*LANE, (F.col("range") - 1).alias("range")).agg(F.min("t_start").alias("_next"))
    most = rows.agg(F.max("range")).first()[0]
    done, carried = None, None
    for number in range(0 if most is None else most + 1):
        here = rows.where(F.col("range") == number).select(*LANE, "j", "t_start", "t_end", "q_start", "q_end", "own", F.lit(float("nan")).alias("best"))
        if carried is not None:
            here = here.unionByName(carried)
        # A carried block keeps its settled score; where it begins no longer counts.
        lane = lambda group: _with_lane(group, _settle(group, max_gap, kind))
        found = cut_lineage(here.repartition(task_count(blocks.sparkSession), *LANE).groupBy(*LANE).applyInArrow(lane, f"t_name string, q_name string, strand string, {_SETTLED}"))
        done = found if done is None else done.unionByName(found)
        if number < most:
            # Blocks of this range, and those carried so far, that the next one can reach.
            open_ends = found.select(*LANE, "j", F.lit(0).cast("bigint").alias("t_start"), "t_end", F.lit(0).cast("bigint").alias("q_start"), "q_end", F.lit(0.0).alias("own"), "best")
            if carried is not None:
                open_ends = open_ends.unionByName(carried)
            after = begins.where(F.col("range") == number).drop("range")
            carried = cut_lineage(open_ends.join(after, LANE).where(F.col("t_end") >= F.col("_next") - max_gap).drop("_next"))
    if done is None:
        done = rows.select(*LANE, "j", "t_end", "q_end", F.col("own").alias("best"), F.lit(None).cast("bigint").alias("i"), F.lit(0.0).alias("cost"))
    return done.select("j", "best", "i", "cost")


def _with_lane(group: pa.Table, found: pa.Table) -> pa.Table:
    for at, c in enumerate(LANE):
        found = found.add_column(at, c, pa.array([group.column(c)[0].as_py()] * found.num_rows, pa.string()))
    return found


def chain_best(blocks: DataFrame, max_gap: int, gap_cost: str | float) -> DataFrame:
    """Blocks with ``chain_id`` and ``link_cost`` from highest-scoring colinear chains.

    A link leads to a block that starts within ``max_gap`` after another on both
    sequences and costs what ``gap_costs`` says.  Best scores are settled by a sweep
    in target order; then each block keeps its best predecessor and each predecessor
    the successor on the way to the highest score, if that is higher than its own; the
    chains are the remaining paths, named by doubling of back pointers.
    """
    state = cut_lineage(_settled(blocks, max_gap, gap_cost))
    back = state.where("i IS NOT NULL").select("j", "i")
    best = state.select("j", "best")
    # The best score that any path through a block goes on to reach.
    onward, jump = best.withColumnRenamed("best", "far"), back
    while not jump.isEmpty():
        below = jump.join(onward, "j").groupBy("i").agg(F.max("far").alias("_far")).withColumnRenamed("i", "j")
        onward = cut_lineage(onward.join(below, "j", "left").select("j", F.greatest("far", "_far").alias("far")))
        further = jump.select(F.col("j").alias("i"), F.col("i").alias("top"))
        jump = cut_lineage(jump.join(further, "i").select("j", F.col("top").alias("i")))
    # A chain ends where no way onward reaches a higher score.
    here = best.select(F.col("j").alias("i"), F.col("best").alias("_best"))
    taken = back.join(onward, "j").join(here, "i").where("far > _best").groupBy("i").agg(F.max_by("j", F.struct("far", -F.col("j"))).alias("j"))
    root = cut_lineage(
        best.select("j").join(taken, "j", "left").select("j", F.coalesce("i", "j").alias("up"))
    )
    while True:
        higher = root.select(F.col("j").alias("up"), F.col("up").alias("top"))
        moved = cut_lineage(root.join(higher, "up").select("j", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("ch")))
        root = moved.select("j", "up")
        if moved.where("ch").isEmpty():
            break
    paid = taken.join(state.select("j", "cost"), "j").select("j", "cost")
    named = root.join(paid, "j", "left").select(
        F.col("j").alias("block_id"), F.col("up").alias("chain_id"), F.coalesce("cost", F.lit(0.0)).alias("link_cost")
    )
    return blocks.join(named, "block_id")


def covered_share(chains: DataFrame, repeats: DataFrame) -> DataFrame:
    """Adds ``share``: part of a chain's target span inside ``repeats(t_name, r_start, r_end)``.

    The masked length before a position is a running sum read at the last repeat
    that starts before it, for both ends of the chain.
    """
    merged = merge_intervals(repeats, ["t_name"], "r_start", "r_end")
    summed = prefix_scan(merged.withColumn("_len", F.col("r_end") - F.col("r_start")), ["t_name"], [F.col("r_start")], _s=("sum", "_len"))
    mark = F.struct("r_start", "r_end", "_s")
    none = F.lit(None).cast("bigint")
    empty = F.lit(None).cast("struct<r_start:bigint,r_end:bigint,_s:bigint>")
    known = summed.select("t_name", F.col("r_start").alias("x"), mark.alias("m"), none.alias("chain_id"), F.lit(0).alias("side"))
    asks = chains.select(
        "t_name", F.inline(F.array(F.struct(F.col("t_start").alias("x"), F.lit(1).alias("side")), F.struct(F.col("t_end").alias("x"), F.lit(2).alias("side")))),
        "chain_id",
    ).select("t_name", "x", empty.alias("m"), "chain_id", "side")
    read = prefix_scan(known.unionByName(asks), ["t_name"], [F.col("x"), F.col("side"), F.col("chain_id")], _at=("last", "m"))
    before = F.coalesce(
        F.col("_at._s") - (F.col("_at.r_end") - F.col("_at.r_start")) + F.least(F.col("x"), F.col("_at.r_end")) - F.col("_at.r_start"),
        F.lit(0),
    )
    ends = read.where("side > 0").groupBy("chain_id").agg(
        F.sum(F.when(F.col("side") == 2, before).otherwise(-before)).alias("_masked")
    )
    return chains.join(ends, "chain_id").withColumn("share", F.col("_masked") / (F.col("t_end") - F.col("t_start"))).drop("_masked")


def anti_repeat(chains: DataFrame, repeats: DataFrame, limit: float) -> DataFrame:
    """Drops chains whose target span lies mostly in repeats."""
    return covered_share(chains, repeats).where(F.col("share") <= limit)


def sort_chains(chains: DataFrame) -> DataFrame:
    """All chains renumbered from the highest score down."""
    return rank_rows(chains, [], [desc("score"), F.col("chain_id")], "rk")


def _spans(rows: DataFrame, side: str, name: str = "rk") -> DataFrame:
    return rows.select(F.col(f"{side}_name").alias("k"), F.col(f"{side}_start").alias("s"), F.col(f"{side}_end").alias("e"), "rk", F.col(name).alias("id"))


def owners(spans: DataFrame, side: str) -> DataFrame:
    """Lowest rank covering each break point of ``spans(<side>_name, <side>_start, <side>_end, rk)``, where there is one.

    The owner of a break point owns everything up to the next one.
    """
    return sweep(_spans(spans, side)).select(F.col("k").alias(f"{side}_name"), F.col("start").alias("pos"), F.col("rk").alias("owner")).where("owner IS NOT NULL")


def pre_net(ranked: DataFrame) -> DataFrame:
    """Chains that own at least one base on the target or the query when better chains go first."""
    kept = owners(ranked, "t").select(F.col("owner").alias("rk")).unionByName(owners(ranked, "q").select(F.col("owner").alias("rk")))
    return ranked.join(kept.distinct(), "rk", "left_semi")


def net(ranked: DataFrame, chained: DataFrame) -> DataFrame:
    """Fills of the target: ``(t_name, start, end, rk, level, parent)``.

    A position belongs to the best chain with a block there.  ``level`` is one
    more than the number of better chains whose span holds the fill, ``parent``
    the lowest-ranked of those.
    """
    return fills(net_pieces(ranked, chained))


def net_pieces(ranked: DataFrame, chained: DataFrame) -> DataFrame:
    """Pieces between neighbouring break points of blocks and chain spans, with owner, its block, level and parent."""
    placed = chained.select("chain_id", "block_id", "t_name", "t_start", "t_end").join(ranked.select("chain_id", "rk"), "chain_id")
    blocks = cut_lineage(_spans(placed, "t", "block_id"))
    swept = cut_lineage(sweep(blocks, _spans(ranked, "t")))
    # A piece ends where the next one of its target begins, at the end of a range in one of the ranges after it.
    after = F.lead("start").over(W.partitionBy("k").orderBy("_range"))
    ahead = swept.where("_first").select(F.col("k").alias("_k"), F.col("_range").alias("_at"), after.alias("_then")).where("_then IS NOT NULL")
    whole = swept.where("rk IS NOT NULL").join(ahead, (F.col("k") == F.col("_k")) & (F.col("_range") == F.col("_at")) & F.col("end").isNull(), "left")
    return whole.select(
        F.col("k").alias("t_name"), "start", F.coalesce("end", "_then").alias("end"), "rk", F.col("id").alias("block_id"), (F.col("_better") + 1).alias("level"), F.col("_next").alias("parent")
    )


def number_fills(pieces: DataFrame) -> DataFrame:
    """Adds ``fill``: touching pieces with the same owner, level and parent share a number per target, the start of the first."""
    def joins(before: dict, now: dict) -> pa.Array:
        same = [pc.equal(now[c], before[c]) for c in ("rk", "level")]
        same.append(pc.equal(pc.fill_null(now["parent"], -1), pc.fill_null(before["parent"], -1)))
        return reduce(pc.and_, same, pc.equal(now["start"], before["end"]))

    return segments(pieces, ["t_name"], [F.col("start")], ["start", "end", "rk", "level", "parent"], joins, "start", "fill")


def fills(pieces: DataFrame) -> DataFrame:
    return number_fills(pieces).groupBy("t_name", "fill", "rk", "level", "parent").agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    ).drop("fill")


def classify(net_fills: DataFrame, ranked: DataFrame) -> DataFrame:
    """``top``, ``syn`` (same query and strand as the parent), ``inv`` (other strand) or ``nonSyn``."""
    own = ranked.select("rk", F.col("q_name").alias("_q"), F.col("strand").alias("_s"))
    up = ranked.select(F.col("rk").alias("parent"), F.col("q_name").alias("_pq"), F.col("strand").alias("_ps"))
    joined = net_fills.join(own, "rk").join(up, "parent", "left")
    kind = (
        F.when(F.col("parent").isNull(), "top").when(F.col("_q") != F.col("_pq"), "nonSyn")
        .when(F.col("_s") == F.col("_ps"), "syn").otherwise("inv")
    )
    return joined.withColumn("kind", kind).drop("_q", "_s", "_pq", "_ps")


def net_blocks(pieces: DataFrame, chained: DataFrame, *kept: str) -> DataFrame:
    """Blocks cut to the parts of the target that their chain owns, with matching query ranges.

    Pieces that differ in the columns ``kept`` stay apart.
    """
    def joins(before: dict, now: dict) -> pa.Array:
        same = [pc.equal(now[c], before[c]) for c in ("block_id", *kept)]
        return reduce(pc.and_, same, pc.equal(now["start"], before["end"]))

    held = pieces.select("t_name", "block_id", "start", "end", *kept)
    runs = segments(held, ["t_name"], [F.col("start")], ["block_id", "start", "end", *kept], joins, "start", "island").groupBy(
        "block_id", *kept, "island"
    ).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cut = runs.join(chained, "block_id")
    ahead, behind = F.col("start") - F.col("t_start"), F.col("t_end") - F.col("end")
    plus = F.col("strand") == "+"
    return cut.select(
        "block_id", "t_name", "start", "end", "q_name",
        (F.col("q_start") + F.when(plus, ahead).otherwise(behind)).alias("q_from"),
        (F.col("q_end") - F.when(plus, behind).otherwise(ahead)).alias("q_to"), "strand", *kept, "chain_id",
    )


def gated(rows: DataFrame, log: DataFrame, marker: str) -> DataFrame:
    """The rows, or an error as soon as any is read, if a file of ``log(file_id, line_no, line)`` does not end with ``marker``."""
    unfinished = file_states(log, marker).where("NOT complete").agg(F.count(F.lit(1)).alias("n"), F.min("file_id").alias("first"))
    said = unfinished.select(F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" incomplete inputs, the first one is "), F.col("first").cast("string")))).scalar()
    told = rows.withColumn("_gate", F.when(said.isNotNull(), F.raise_error(said)))
    return told.where("_gate IS NULL").drop("_gate")


def net_pipeline(blocks: DataFrame, gap: int, min_score: int, log: DataFrame | None = None, marker: str = "") -> DataFrame:
    """Blocks to chains, sorted and pruned, netted and cut back to alignments, each with its ``kind``.

    With ``log`` the job fails on reading the blocks if one of the inputs is incomplete.
    """
    # The runs are written at once, so a job with an incomplete input fails here.
    chained = chain_runs(blocks if log is None else gated(blocks, log, marker), gap)
    ranked = sort_chains(chain_table(chained).where(F.col("score") >= min_score))
    kept = cut_lineage(pre_net(ranked))
    of_kept = cut_lineage(chained.join(kept.select("chain_id"), "chain_id", "left_semi"))
    pieces = cut_lineage(classify(net_pieces(kept, of_kept), kept))
    return net_blocks(pieces, of_kept, "kind").orderBy("t_name", "start", "block_id")
