"""Running values over an ordering, without putting a whole group into one task.

A plain window over ``partitionBy(k).orderBy(o)`` sorts all rows of a key in a
single task.  ``prefix_scan`` range-partitions on ``(key, order)`` instead, so a
hot key is spread over many tasks, computes the running value inside each range
and adds what the earlier ranges of the same key contribute.  Rows are moved and
written once: the values inside a range are taken while its sorted rows pass in
Arrow batches.  Only the key at the end of a range can go on in the next one, so
the carried table has one row per range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from helixframe.session import cut_lineage, task_count

KINDS = ("rank", "sum", "max_before", "last", "lag")


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    now, before = column[1:], column[:-1]
    differ = pc.fill_null(pc.not_equal(now, before), False).to_numpy(zero_copy_only=False)
    if column.null_count:
        differ = differ | (now.is_null().to_numpy(zero_copy_only=False) != before.is_null().to_numpy(zero_copy_only=False))
    return differ


def _running_sum(column: pa.Array, begin: np.ndarray, before) -> tuple[pa.Array, object]:
    """Sum up to each row from ``begin``, where its group starts; -1 goes on from ``before``."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    filled = pc.fill_null(column, 0).to_numpy(zero_copy_only=False)
    zero = np.concatenate([[0], np.cumsum(valid)])
    some = zero[1:] > zero[np.maximum(begin, 0)]
    if before is not None:
        some |= begin < 0
    start = 0 if before is None else before
    if filled.dtype.kind == "f":
        # Added in order inside each group, as rounding depends on it.
        sums = filled.astype(np.float64)
        edges = [0, *np.flatnonzero(begin == np.arange(len(begin))).tolist(), len(begin)]
        for low, high in zip(edges, edges[1:]):
            if high > low:
                if begin[low] < 0:
                    sums[low] += start
                sums[low:high] = np.cumsum(sums[low:high])
    else:
        upto = np.concatenate([[0], np.cumsum(filled.astype(np.int64))])
        sums = upto[1:] - upto[np.maximum(begin, 0)] + np.where(begin < 0, start, 0)
    out = pa.array(sums, mask=~some)
    return out, out[-1].as_py()


def _taken(column: pa.Array, before: pa.Array | None, at: np.ndarray) -> pa.Array:
    """Values at the places; -1 is the value from before, -2 none."""
    if before is None:
        before = pa.nulls(1, column.type)
    return pa.concat_arrays([before, column]).take(pa.array(at + 1, mask=at < -1))


def _run(batches: Iterator[pa.RecordBatch], by: Sequence[str], outs: dict, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Running values inside each range; ``_range_head`` and ``_range_tail`` mark the first row of a key and the last one of a range."""
    held, last, state = None, None, {}
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        place = np.arange(n)
        new, fresh = np.zeros(n, bool), np.zeros(n, bool)
        for c in [*by, "_range"]:
            column = batch.column(c)
            joined = pa.concat_arrays([column[:1] if last is None else last[c], column])
            fresh = _changes(joined)
            new |= fresh
        if last is None:
            new[0] = True
        begin = np.maximum.accumulate(np.where(new, place, -1))
        found = []
        for name, (kind, value) in outs.items():
            column = None if value is None else batch.column(value)
            before = state.get(name)
            if kind == "rank":
                local = place - begin + np.where(begin < 0, before or 0, 1)
                state[name] = int(local[-1])
                found.append(pa.array(local))
            elif kind == "sum":
                local, state[name] = _running_sum(column, begin, before)
                found.append(local)
            elif kind == "last":
                seen = np.maximum.accumulate(np.where(column.is_valid().to_numpy(zero_copy_only=False), place, -1))
                local = _taken(column, before, np.where(seen >= begin, seen, -2))
                state[name] = local[-1:]
                found.append(local)
            elif kind == "lag":
                found.append(_taken(column, before, np.where(new, -2, place - 1)))
                state[name] = column[-1:]
            else:
                # Values by size, groups in order above them: the running maximum stays inside its group.
                whole = pa.concat_arrays([pa.nulls(1, column.type) if before is None else before, column])
                order = np.zeros(n + 1, np.int64)
                order[pc.array_sort_indices(whole).to_numpy()] = np.arange(1, n + 2)
                order[whole.is_null().to_numpy(zero_copy_only=False)] = 0
                group = np.concatenate([[0], np.cumsum(new)])
                top = np.maximum.accumulate(group * (n + 2) + order) % (n + 2)
                where = np.full(n + 2, -2, np.int64)
                where[order] = np.arange(-1, n)
                where[0] = -2
                found.append(_taken(column, before, np.where(new, -2, where[top[:-1]])))
                state[name] = _taken(column, before, where[top[-1:]])
        # A row is the last one of its range if the next one, perhaps in the next batch, lies in another.
        if held is not None:
            yield _marked(held, bool(fresh[0]), names)
        tail = np.zeros(n, bool)
        tail[:-1] = fresh[1:]
        held = [*batch.columns, *found, pa.array(new), tail]
        last = {c: batch.column(c)[-1:] for c in [*by, "_range"]}
    if held is not None:
        yield _marked(held, True, names)


def _marked(columns: list, end: bool, names: Sequence[str]) -> pa.RecordBatch:
    columns[-1][-1] = end
    return pa.RecordBatch.from_arrays([*columns[:-1], pa.array(columns[-1])], list(names))


def prefix_scan(df: DataFrame, by: Sequence[str], order: Sequence[Column | tuple[Column, str]], keep_range: bool = False,
                **outs: tuple[str, str | None]) -> DataFrame:
    """Add running columns.  ``outs`` maps a new column to ``(kind, column)``.

    ``rank``        1-based row number inside the key (column is None)
    ``sum``         running sum including the current row
    ``max_before``  largest value among the earlier rows
    ``last``        latest non-null value up to and including the current row
    ``lag``         value of the row before

    ``order`` must order the rows of a key totally; wrap a key in ``desc`` to reverse it.
    ``keep_range`` leaves the range number in the result, so that a second scan
    over the same key and order runs on it without cutting ranges again.
    """
    by = list(by)
    for kind, _ in outs.values():
        if kind not in KINDS:
            raise ValueError(f"unknown running value {kind!r}")
    keys = [o if isinstance(o, tuple) else (o, "asc") for o in order]
    directions = [o.desc() if d == "desc" else o.asc() for o, d in keys]
    again = "_range" in df.columns
    if again:
        ranged = df.repartition(task_count(df.sparkSession), "_range").sortWithinPartitions("_range", *by, *directions)
    else:
        ranged = df.repartitionByRange(*[F.col(c) for c in by], *directions).withColumn("_range", F.spark_partition_id())
        ranged = ranged.sortWithinPartitions(*[F.col(c) for c in by], *directions)
    kinds = {name: T.LongType() if kind == "rank" else df.select(F.sum(value) if kind == "sum" else F.col(value)).schema[0].dataType
             for name, (kind, value) in outs.items()}
    schema = T.StructType([
        *ranged.schema.fields, *[T.StructField(f"_l_{name}", t) for name, t in kinds.items()],
        T.StructField("_range_head", T.BooleanType()), T.StructField("_range_tail", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _run(batches, by, outs, schema.names)

    scanned = ranged.mapInArrow(run, schema)
    # The range number is stored with the rows, so every later stage and every
    # retried task sees the same assignment; a second scan finds it stored.
    scanned = scanned if again else cut_lineage(scanned)

    so_far = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, 0)
    carried = []
    for name, (kind, value) in outs.items():
        here = F.col(f"_l_{name}")
        if kind in ("rank", "sum"):
            carried.append(F.sum(here).over(so_far).alias(f"_c_{name}"))
        elif kind == "max_before":
            carried.append(F.max(F.greatest(here, value)).over(so_far).alias(f"_c_{name}"))
        elif kind == "last":
            carried.append(F.last(here, ignorenulls=True).over(so_far).alias(f"_c_{name}"))
        else:
            carried.append(F.col(value).alias(f"_c_{name}"))
    following = F.lead("_range").over(W.partitionBy(F.lit(0)).orderBy("_range"))
    carry = scanned.where("_range_tail").select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], following.alias("_k_range"), *carried
    ).where("_k_range IS NOT NULL")

    final = []
    for name, (kind, _) in outs.items():
        here, before = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind == "rank":
            final.append((here + F.coalesce(before, F.lit(0))).alias(name))
        elif kind == "sum":
            final.append(F.when(before.isNull(), here).when(here.isNull(), before).otherwise(here + before).alias(name))
        elif kind == "max_before":
            final.append(F.greatest(here, before).alias(name))
        elif kind == "last":
            final.append(F.coalesce(here, before).alias(name))
        else:
            final.append(F.when(F.col("_range_head"), before).otherwise(here).alias(name))
    kept = [c for c in df.columns if c != "_range"] + (["_range"] if keep_range else [])
    # A key may be null, and its rows stay.
    same = F.col("_range") == F.col("_k_range")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    # One row for each range at most.
    return scanned.join(F.broadcast(carry), same, "left").select(*kept, *final)


def rank_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rn") -> DataFrame:
    """1-based row number inside ``by`` (or overall when ``by`` is empty)."""
    return prefix_scan(df, by, order, **{name: ("rank", None)})


def islands(df: DataFrame, by: Sequence[str], start: str, end: str, gap: int = 0, name: str = "island") -> DataFrame:
    """Number the runs of intervals of a key whose distance to all earlier ones is at most ``gap``.

    Intervals are half open; touching intervals join when ``gap`` is 0.
    """
    order = [F.col(start), F.col(end), *[F.col(c) for c in df.columns if c not in (*by, start, end)]]
    reach = prefix_scan(df, by, order, keep_range=True, _reach=("max_before", end))
    opened = reach.withColumn(
        "_open", F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + gap), 1).otherwise(0)
    )
    return prefix_scan(opened, by, order, **{name: ("sum", "_open")}).drop("_reach", "_open")


def segments(df: DataFrame, by: Sequence[str], order: Sequence[Column], looks: Sequence[str], joins: Callable[[dict, dict], pa.Array],
             value: str, name: str) -> DataFrame:
    """Adds the least ``value`` (a bigint) of the run of neighbours that a row belongs to.

    ``joins`` tells from the columns ``looks`` of the rows before and of the rows, as Arrow
    arrays, whether a row belongs to the run of the row before it in its key.  Rows are moved
    and written once: runs inside a range are settled while its sorted rows pass, and only
    the first and the last row of every range come to the driver to join runs over the edges.
    The rows of one run in one range are held until it ends.
    """
    by, looks = list(by), list(looks)
    ranged = df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id())
    ranged = ranged.sortWithinPartitions(*[F.col(c) for c in by], *order)
    extra = [T.StructField(name, T.LongType()), T.StructField("_range_edge", T.IntegerType()), T.StructField("_range_end", T.IntegerType())]
    schema = T.StructType([*ranged.schema.fields, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _segments(batches, by, looks, joins, value, schema.names)

    found = cut_lineage(ranged.mapInArrow(run, schema))
    edges = found.where("_range_end > 0").select("_range", "_range_edge", "_range_end", name, *dict.fromkeys([*by, *looks])).orderBy("_range", "_range_end").toArrow()
    settled = df.sparkSession.createDataFrame(_over_edges(edges, by, looks, joins, name), "_range_at int, _range_which int, _range_least bigint")
    here = found.join(F.broadcast(settled), (F.col("_range") == F.col("_range_at")) & (F.col("_range_edge") == F.col("_range_which")), "left")
    return here.select(*df.columns, F.coalesce("_range_least", name).alias(name))


def _joined(before: dict, now: dict, by: Sequence[str], joins: Callable) -> np.ndarray:
    """Whether rows of the same key join those before them."""
    same = pc.fill_null(joins(before, now), False).to_numpy(zero_copy_only=False).copy()
    for c in by:
        equal = pc.fill_null(pc.equal(now[c], before[c]), False).to_numpy(zero_copy_only=False)
        same &= equal | (now[c].is_null().to_numpy(zero_copy_only=False) & before[c].is_null().to_numpy(zero_copy_only=False))
    return same


def _segments(batches: Iterator[pa.RecordBatch], by, looks, joins, value: str, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """``_range_edge``: 1 in the first run of a range, 2 in its last one if that is another; ``_range_end``: 1 first row, 2 last row, 3 both."""
    held, least, runs, last = [], 0, 0, None
    seen = list(dict.fromkeys([*by, *looks]))

    def closed(edge: int, over: bool) -> Iterator[pa.RecordBatch]:
        for i, part in enumerate(held):
            n = part.num_rows
            end = np.zeros(n, np.int32)
            end[0] += edge == 1 and i == 0
            end[-1] += 2 * (over and i == len(held) - 1)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(np.full(n, least)), pa.array(np.full(n, edge, np.int32)), pa.array(end)], list(names))

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        now = {c: batch.column(c) for c in seen}
        whole = {c: pa.concat_arrays([now[c][:1] if last is None else last[c], now[c]]) for c in seen}
        opens = ~_joined({c: x[:-1] for c, x in whole.items()}, now, by, joins)
        if last is None:
            opens[0] = True
        last = {c: x[-1:] for c, x in now.items()}
        values = batch.column(value).to_numpy().astype(np.int64)
        at = np.flatnonzero(opens)
        if len(at) == 0:
            held.append(batch)
            least = min(least, int(values.min()))
            continue
        if at[0]:
            held.append(batch.slice(0, at[0]))
            least = min(least, int(values[: at[0]].min()))
        if held:
            yield from closed(1 if runs == 1 else 0, False)
        lows = np.minimum.reduceat(values, at)
        begin = at[0]
        if not runs and len(at) > 1:
            held, least = [batch.slice(0, at[1])], int(lows[0])
            yield from closed(1, False)
            begin = at[1]
        if at[-1] > begin:
            inner = at[at >= begin]
            part = batch.slice(begin, at[-1] - begin)
            spread = np.repeat(lows[at >= begin][:-1], np.diff(inner))
            none = pa.array(np.zeros(len(spread), np.int32))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spread), none, none], list(names))
        held, least, runs = [batch.slice(at[-1])], int(lows[-1]), runs + len(at)
    if held:
        yield from closed(1 if runs == 1 else 2, True)


def _over_edges(edges: pa.Table, by, looks, joins, name: str) -> list[tuple[int, int, int]]:
    """``(range, edge, least value)`` of the first and last runs of all ranges, joined over the edges."""
    if not edges.num_rows:
        return []
    first, last = edges.filter(pc.not_equal(edges["_range_end"], 2)), edges.filter(pc.greater_equal(edges["_range_end"], 2))
    columns = list(dict.fromkeys([*by, *looks]))
    take = lambda table, low, high: {c: table.column(c).combine_chunks()[low:high] for c in columns}
    count = first.num_rows
    joined = _joined(take(last, 0, count - 1), take(first, 1, count), by, joins) if count > 1 else np.zeros(0, bool)
    group, members, number = {}, {}, -1
    for i, (at, low, high, edge) in enumerate(zip(
        first["_range"].to_pylist(), first[name].to_pylist(), last[name].to_pylist(), last["_range_edge"].to_pylist(), strict=True
    )):
        number += not (i and joined[i - 1])
        group[at, 1] = number
        members[number] = min(members.get(number, low), low)
        if edge == 2:
            number += 1
            group[at, 2], members[number] = number, high
    return [(at, edge, members[n]) for (at, edge), n in group.items()]


def desc(column: Column | str) -> tuple[Column, str]:
    """Marks an order key of ``prefix_scan`` as descending."""
    return (F.col(column) if isinstance(column, str) else column, "desc")
