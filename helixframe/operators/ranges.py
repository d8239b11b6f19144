"""Interval lookups by a sweep over ranges of the coordinates.

Positions and intervals are dealt into ranges of (key, coordinate) that hold about
equally many positions and interval ends, so one giant key fills many ranges.  An
interval is sent to the ranges that its ends lie in, at most two.  What it does to
the ranges between is the same for all their positions: such intervals are
aggregated over runs of ranges, and each range gets one row for each key from all
of them.  A task then holds one range: positions sorted, every interval a run of
neighbouring positions, all runs folded together in numpy.  Nothing is copied per
position or per level, whatever the lengths and overlaps.  Intervals are closed on
both ends.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from helixframe.operators.ordered import islands
from helixframe.session import task_count

#: Positions and interval ends that one range holds at most, about.
RANGE_ROWS = 1 << 20
_LEAST, _MOST = -(1 << 62), 1 << 62


def node_cover(start: Column, end: Column) -> Column:
    """Array of ``(level, node)`` structs of aligned powers of two that tile ``[start, end]`` exactly."""
    length = end - start + 1
    top = F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double")) + F.lit(1e-9)).cast("int")

    def at(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level).cast("bigint")
        first = F.ceil(start / size).cast("bigint")
        stop = F.floor((end + 1) / size).cast("bigint")
        some = first < stop
        left = F.when(some & (F.pmod(first, F.lit(2)) == 1), F.struct(level.alias("level"), first.alias("node")))
        right = F.when(some & (F.pmod(stop, F.lit(2)) == 1), F.struct(level.alias("level"), (stop - 1).alias("node")))
        return F.array(left, right)

    nodes = F.flatten(F.transform(F.sequence(F.lit(0), top), at))
    return F.when(length >= 1, F.filter(nodes, lambda n: n.isNotNull()))


def _place(by: Sequence[str], x: str) -> Column:
    """Sort key of a coordinate: keys by 24 bits of their hash, coordinates inside.  Keys that meet in
    one range are told apart there."""
    inside = F.least(F.greatest(F.col(x).cast("bigint"), F.lit(0)), F.lit((1 << 40) - 1))
    return F.shiftleft(F.shiftright(F.xxhash64(*by), 40), 40) + inside


class _Ranges:
    """Cuts of the sort keys of positions and intervals into ranges of about equal size."""

    def __init__(self, points: DataFrame, intervals: DataFrame, by: Sequence[str], pos: str, start: str, end: str):
        keys = points.select(_place(by, pos).alias("k"))
        for side in (start, end):
            keys = keys.unionByName(intervals.select(_place(by, side).alias("k")))
        tasks = task_count(points.sparkSession)
        shares = [i / tasks for i in range(1, tasks)]
        rows, cuts = keys.agg(F.count("k"), F.percentile_approx("k", shares, 10 * tasks) if shares else F.lit(None)).first()
        if rows > RANGE_ROWS * tasks:
            tasks = -(-rows // RANGE_ROWS)
            cuts = keys.agg(F.percentile_approx("k", [i / tasks for i in range(1, tasks)], 10 * tasks)).first()[0]
        self.cuts = np.unique(np.array(cuts or [], np.int64))
        self.count = len(self.cuts) + 1
        self.by = by

    def of(self, x: str, by: Sequence[str] | None = None) -> Column:
        cuts = self.cuts

        @F.pandas_udf("int")
        def at(keys: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(cuts, keys.to_numpy(np.int64), side="left").astype(np.int32))

        return at(_place(by or self.by, x))


def _keys(by: Sequence[str]) -> list[Column]:
    """The key columns of intervals under names of their own: the two sides may come from one table."""
    return [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]


def _codes(points: pa.Table, intervals: pa.Table, by: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal keys of both tables."""
    codes = np.zeros(points.num_rows + intervals.num_rows, np.int64)
    for i, c in enumerate(by):
        both = pa.chunked_array([*points.column(c).chunks, *intervals.column(f"_k{i}").cast(points.schema.field(c).type).chunks])
        own = both.combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes * (len(own.dictionary) + 1) + own.indices.to_numpy()
        codes = np.unique(codes, return_inverse=True)[1]
    return codes[: points.num_rows], codes[points.num_rows :]


def _runs(points: pa.Table, intervals: pa.Table, by: Sequence[str], pos: str):
    """Order of the positions, and for each interval the run ``[i, j)`` of positions in it."""
    codes, own = _codes(points, intervals, by)
    x = points.column(pos).to_numpy().astype(np.int64)
    order = np.lexsort((x, codes))
    known = np.unique(x)
    width = len(known) + 1
    placed = codes[order] * width + np.searchsorted(known, x[order])
    first = np.searchsorted(placed, own * width + np.searchsorted(known, intervals.column("_s").to_numpy(), side="left"))
    last = np.searchsorted(placed, own * width + np.searchsorted(known, intervals.column("_e").to_numpy(), side="right"))
    return order, first, np.maximum(last, first)


def _folded(size: int, first: np.ndarray, last: np.ndarray, values: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Aggregate of the runs over every place, and whether there is any."""
    steps = np.zeros(size + 1, np.int64)
    some = last > first
    first, last, values = first[some], last[some], values[some]
    np.add.at(steps, first, 1)
    np.add.at(steps, last, -1)
    covered = np.cumsum(steps[:-1]) > 0
    if kind == "sum":
        sums = np.zeros(size + 1, values.dtype)
        np.add.at(sums, first, values)
        np.add.at(sums, last, -values)
        return np.cumsum(sums[:-1]), covered
    fold = np.minimum if kind == "min" else np.maximum
    info = np.iinfo(np.int64) if values.dtype.kind == "i" else np.finfo(values.dtype)
    none = info.max if kind == "min" else info.min
    # A run is two runs of the largest power of two in it; long ones fall to shorter ones level by level.
    level = np.floor(np.log2(np.maximum(last - first, 1))).astype(np.int64)
    now = np.full(size, none, values.dtype)
    for power in range(int(level.max(initial=0)), -1, -1):
        at = level == power
        fold.at(now, first[at], values[at])
        fold.at(now, last[at] - (1 << power), values[at])
        if power:
            half = 1 << (power - 1)
            then = now.copy()
            if half < size:
                then[half:] = fold(then[half:], now[:-half])
            now = then
    return now, covered


def _alone(asked: pa.Table, schema: T.StructType, **values) -> pa.Table:
    """Positions of a range without intervals; a side without rows has no columns."""
    wanted = to_arrow_schema(schema)
    known = set(asked.column_names) if asked.num_rows else set()
    columns = [asked.column(f.name).cast(f.type) if f.name in known else pa.array([values.get(f.name)] * asked.num_rows, f.type) for f in wanted]
    return pa.table(columns, schema=wanted)


def _between(sided: DataFrame, own: Sequence[str], aggs: dict) -> DataFrame:
    """One row for each key and range from all intervals that hold the range whole."""
    fold = {"min": F.min, "max": F.max, "sum": F.sum}
    nodes = sided.where("_to - _from > 1").select(*own, F.explode(node_cover(F.col("_from") + 1, F.col("_to") - 1)).alias("_n"), *[f"_v_{n}" for n in aggs])
    runs = nodes.groupBy(*own, "_n.level", "_n.node").agg(*[fold[kind](f"_v_{n}").alias(f"_v_{n}") for n, (kind, _) in aggs.items()])
    size = F.pow(F.lit(2.0), F.col("level")).cast("bigint")
    whole = runs.withColumn("_range", F.explode(F.sequence((F.col("node") * size).cast("int"), ((F.col("node") + 1) * size - 1).cast("int"))))
    whole = whole.groupBy(*own, "_range").agg(*[fold[kind](f"_v_{n}").alias(f"_v_{n}") for n, (kind, _) in aggs.items()])
    return whole.select(*own, F.lit(_LEAST).alias("_s"), F.lit(_MOST).alias("_e"), "_range", *[f"_v_{n}" for n in aggs])


def stab(
    points: DataFrame,
    intervals: DataFrame,
    by: Sequence[str],
    pos: str,
    start: str,
    end: str,
    **aggs: tuple[str, str],
) -> DataFrame:
    """Aggregates over the intervals of the same key that cover each position.

    ``aggs`` maps a new column to ``(kind, column)`` with kind ``min``, ``max`` or
    ``sum`` of a number.  Positions covered by nothing get null, also those with a
    null key or position.
    """
    by = list(by)
    ranges = _Ranges(points, intervals, by, pos, start, end)
    own = [f"_k{i}" for i in range(len(by))]
    sided = intervals.where(F.col(start) <= F.col(end)).select(
        *_keys(by), F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e"), *[F.col(c).alias(f"_v_{n}") for n, (_, c) in aggs.items()]
    )
    sided = sided.withColumn("_from", ranges.of("_s", own)).withColumn("_to", ranges.of("_e", own))
    ends = sided.select(*own, "_s", "_e", F.explode(F.array_distinct(F.array("_from", "_to"))).alias("_range"), *[f"_v_{n}" for n in aggs])
    whole = _between(sided, own, aggs)
    known = ends.unionByName(whole)
    kinds = {n: known.schema[f"_v_{n}"].dataType for n in aggs}
    schema = T.StructType([*points.schema.fields, *[T.StructField(n, kinds[n]) for n in aggs]])

    def meet(asked: pa.Table, given: pa.Table) -> pa.Table:
        if not asked.num_rows or not given.num_rows:
            return _alone(asked, schema)
        asked = asked.drop_columns(["_range"])
        clean = np.ones(asked.num_rows, bool)
        for c in (*by, pos):
            clean &= asked.column(c).is_valid().to_numpy()
        order, first, last = _runs(asked.filter(pa.array(clean)), given, by, pos)
        out = asked
        for n, (kind, _) in aggs.items():
            value = given.column(f"_v_{n}")
            numbers = value.to_numpy()
            numbers = numbers.astype(np.float64 if numbers.dtype.kind == "f" else np.int64)
            found, covered = _folded(len(order), first, last, numbers, kind)
            places = np.flatnonzero(clean)[order]
            column, has = np.zeros(asked.num_rows, found.dtype), np.zeros(asked.num_rows, bool)
            column[places], has[places] = found, covered
            out = out.append_column(n, pa.array(column, mask=~has).cast(value.type))
        return out

    tasks = task_count(points.sparkSession)
    left = points.withColumn("_range", F.coalesce(ranges.of(pos), F.lit(0))).repartition(tasks, "_range").groupBy("_range")
    return left.cogroup(known.repartition(tasks, "_range").groupBy("_range")).applyInArrow(meet, schema)


def _below(first: np.ndarray, last: np.ndarray, values: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place, how many of the runs over it have a smaller value than its own, and the largest of those (-1: none)."""
    better, after, held = np.zeros(len(mine), np.int64), np.full(len(mine), -1, np.int64), []
    used = np.flatnonzero(last > first)
    opens = used[np.argsort(first[used], kind="stable")]
    closes = used[np.argsort(last[used], kind="stable")]
    changes = np.unique(np.concatenate([first[used], last[used]]))
    o = c = 0
    edges = [0, *changes.tolist(), len(mine)]
    for begin, stop in zip(edges, edges[1:]):
        while c < len(closes) and last[closes[c]] <= begin:
            held.pop(bisect_left(held, int(values[closes[c]])))
            c += 1
        while o < len(opens) and first[opens[o]] <= begin:
            insort(held, int(values[opens[o]]))
            o += 1
        if stop > begin and held:
            ranks = np.array(held, np.int64)
            at = np.searchsorted(ranks, mine[begin:stop])
            better[begin:stop] = at
            after[begin:stop] = np.where(at > 0, ranks[np.maximum(at - 1, 0)], -1)
    return better, after


def ranks_below(points: DataFrame, intervals: DataFrame, by: Sequence[str], pos: str, start: str, end: str, rank: str) -> DataFrame:
    """Adds to each position ``_better``, the number of covering intervals with a smaller ``rank`` than its own,
    and ``_next``, the largest of those ranks.

    The intervals open at the edge of a range are its first state; inside the range the
    ranks of the open intervals stand sorted while the positions pass.
    """
    by = list(by)
    ranges = _Ranges(points, intervals, by, pos, start, end)
    own = [f"_k{i}" for i in range(len(by))]
    sided = intervals.select(*_keys(by), F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e"), F.col(rank).cast("bigint").alias("_r"))
    spread = sided.where("_s <= _e").withColumn("_range", F.explode(F.sequence(ranges.of("_s", own), ranges.of("_e", own))))
    schema = T.StructType([*points.schema.fields, T.StructField("_better", T.LongType()), T.StructField("_next", T.LongType())])

    def meet(asked: pa.Table, given: pa.Table) -> pa.Table:
        if not asked.num_rows or not given.num_rows:
            return _alone(asked, schema, _better=0)
        asked = asked.drop_columns(["_range"])
        order, first, last = _runs(asked, given, by, pos)
        values = given.column("_r").to_numpy()
        mine = asked.column(rank).to_numpy()[order]
        better, after = _below(first, last, values, mine)
        columns = [np.zeros(asked.num_rows, np.int64) for _ in range(2)]
        columns[0][order], columns[1][order] = better, after
        return asked.append_column("_better", pa.array(columns[0])).append_column("_next", pa.array(columns[1], mask=columns[1] < 0))

    tasks = task_count(points.sparkSession)
    left = points.withColumn("_range", ranges.of(pos)).repartition(tasks, "_range").groupBy("_range")
    return left.cogroup(spread.repartition(tasks, "_range").groupBy("_range")).applyInArrow(meet, schema)


_SWEPT = "start bigint, end bigint, rk bigint, id bigint, _better bigint, _next bigint, _range int, _first boolean"


def sweep(covers: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Pieces of the half-open intervals ``(k, s, e, rk, id)``, cut at the ends of all of them, with their lowest rank.

    One row ``k, start, end, rk, id`` for each piece that an interval of ``covers`` covers (of several with the lowest
    rank the least ``id``; spans have none), with ``_better``, the number
    of ``spans`` over it whose rank is smaller than that, and ``_next``, the largest of those ranks.  ``spans`` cut
    pieces, too.  The break points of a range are the ends that lie in it, so only the intervals are moved, once:
    to the ranges of their ends, spans to all that they cover.  The last piece of a key in a range has no ``end``;
    ``_first`` marks the first break point of each, which comes also uncovered (``rk`` null).
    """
    both = covers.select("k", "s", "e", "rk", "id", F.lit(False).alias("_span"))
    if spans is not None:
        both = both.unionByName(spans.select("k", "s", "e", "rk", F.lit(None).cast("bigint").alias("id"), F.lit(True).alias("_span")))
    both = both.select("k", *[F.col(c).cast("bigint").alias(c) for c in ("s", "e", "rk", "id")], "_span").where("k IS NOT NULL")
    ranges = _Ranges(both.limit(0), both, ["k"], "s", "s", "e")
    sided = both.withColumn("_from", ranges.of("s")).withColumn("_to", ranges.of("e"))
    low, high = F.least("_from", "_to"), F.greatest("_from", "_to")
    homes = F.when(F.col("_span") & (F.col("s") < F.col("e")), F.sequence(low, high)).otherwise(F.array_distinct(F.array("_from", "_to")))
    marked = sided.select("k", "s", "e", "rk", "id", "_span", F.explode(homes).alias("_range"), "_from", "_to").select(
        "k", "s", "e", "rk", "id", "_span", "_range", (F.col("_from") == F.col("_range")).alias("_ps"), (F.col("_to") == F.col("_range")).alias("_pe")
    )
    long = sided.where("NOT _span AND s < e AND rk IS NOT NULL").select("k", "_from", "_to", F.struct("rk", "id").alias("_v_rk"))
    whole = _between(long, ["k"], {"rk": ("min", "rk")}).select(
        "k", F.col("_s").alias("s"), F.col("_e").alias("e"), "_v_rk.rk", "_v_rk.id", F.lit(False).alias("_span"), "_range",
        F.lit(False).alias("_ps"), F.lit(False).alias("_pe"),
    )
    kind = covers.schema["k"]
    schema = T.StructType([kind, *T.StructType.fromDDL(_SWEPT).fields])
    some = spans is not None

    def meet(rows: pa.Table) -> pa.Table:
        key = rows.column("k").combine_chunks().dictionary_encode()
        codes, s, e, rk = key.indices.to_numpy(), rows.column("s"), rows.column("e"), rows.column("rk")
        known = {}
        for name, column in (("s", s), ("e", e), ("rk", rk)):
            known[name] = column.is_valid().to_numpy()
        s, e, rk = (pc.fill_null(x, 0).to_numpy().astype(np.int64) for x in (s, e, rk))
        starts, ends = rows.column("_ps").to_numpy() & known["s"], rows.column("_pe").to_numpy() & known["e"]
        pos = np.unique(np.concatenate([s[starts], e[ends]]))
        width = len(pos) + 1
        points = np.unique(np.concatenate([codes[starts].astype(np.int64) * width + np.searchsorted(pos, s[starts]), codes[ends].astype(np.int64) * width + np.searchsorted(pos, e[ends])]))
        if not len(points):
            return to_arrow_schema(schema).empty_table()
        own, x = points // width, pos[points % width]
        span, valid = rows.column("_span").to_numpy(), known["s"] & known["e"] & known["rk"] & (s < e)

        def runs(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            base = codes[which].astype(np.int64) * width
            return np.searchsorted(points, base + np.searchsorted(pos, s[which])), np.searchsorted(points, base + np.searchsorted(pos, e[which])), rk[which]

        # Ranks and ids as one number: the place of the interval in their order.
        first, last, _ = runs(valid & ~span)
        ids = pc.fill_null(rows.column("id"), _LEAST).to_numpy()[valid & ~span]
        order = np.lexsort((ids, rk[valid & ~span]))
        lowest, covered = _folded(len(points), first[order], last[order], np.arange(len(order)), "min")
        chosen = order[lowest[covered]]
        owner, name = np.zeros(len(points), np.int64), np.full(len(points), _LEAST, np.int64)
        owner[covered], name[covered] = rk[valid & ~span][chosen], ids[chosen]
        better, after = np.zeros(len(points), np.int64), np.full(len(points), -1, np.int64)
        if some:
            place = np.cumsum(np.concatenate([[0], covered]))
            first, last, values = runs(valid & span)
            better[covered], after[covered] = _below(place[first], place[last], values, owner[covered])
        begins = np.concatenate([[True], own[1:] != own[:-1]])
        closes = np.concatenate([own[1:] != own[:-1], [True]])
        kept = covered | begins
        column = lambda values, none: pa.array(values[kept], mask=none[kept])
        return pa.table([
            key.dictionary.take(pa.array(own[kept])), pa.array(x[kept]), column(np.concatenate([x[1:], [0]]), closes), column(owner, ~covered), column(name, name == _LEAST),
            pa.array(better[kept]), column(after, after < 0), pa.array(np.full(int(kept.sum()), rows.column("_range")[0].as_py(), np.int32)), pa.array(begins[kept]),
        ], schema=to_arrow_schema(schema))

    tasks = task_count(covers.sparkSession)
    return marked.unionByName(whole).repartition(tasks, "_range").groupBy("_range").applyInArrow(meet, schema)


def merge_intervals(df: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Disjoint union of half-open intervals per key."""
    distinct = df.select(*by, start, end).distinct()
    return (
        islands(distinct, by, start, end)
        .groupBy(*by, "island")
        .agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("island")
    )
