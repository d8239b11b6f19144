"""Rows per position, moved as runs.

A table with one row per position of a key is many times larger than what it says.
``packed`` turns neighbouring rows, where they are, into runs of consecutive
positions: letters as one text, whole numbers as one list.  Runs end at the edges
of blocks of positions, so ``unpacked`` needs one block of a key at a time, and a
long key fills many blocks.  Only runs are moved and written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from helixframe.operators.ordered import _changes
from helixframe.session import task_count

#: Positions that a task unpacks at a time; at least one block.
LIMIT = 1 << 20


def packed(rows: DataFrame, key: str, pos: str, values: Sequence[str], size: int, before: int = 0, after: int = 0,
           sums: Callable[[dict], dict] | None = None, made: tuple[DataFrame, Callable] | None = None) -> DataFrame:
    """``key, _block, _at, _n, values``: runs of ``_n`` rows from position ``_at`` within blocks of ``size`` positions.

    A row is copied to the blocks in which frames from ``before`` positions back to
    ``after`` positions ahead need it.  A missing value or one that is not a single
    ASCII letter is a run of its own.  ``sums`` makes bigint columns per row, from
    the values, that are added up over each run (named with a leading ``_s_``).
    ``made`` is a table and the function of Arrow batches that makes ``rows`` of it: they
    are packed where they are made, and never pass Spark one by one.
    """
    kinds = {v: rows.schema[v].dataType for v in values}
    texts = [v for v in values if isinstance(kinds[v], T.StringType)]
    extra = [f"_s_{c}" for c in sums({v: pa.array([], pa.string() if v in texts else pa.int64()) for v in values})] if sums else []
    schema = T.StructType([
        rows.schema[key], T.StructField("_block", T.LongType()), T.StructField("_at", T.LongType()), T.StructField("_n", T.LongType()),
        *[T.StructField(v, T.StringType() if v in texts else T.ArrayType(kinds[v])) for v in values], *[T.StructField(c, T.LongType()) for c in extra],
    ])
    behind, ahead = -(-after // size), -(-before // size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column(pos).to_numpy(zero_copy_only=False).astype(np.int64)
            block = (place - 1) // size
            columns = {v: batch.column(v) for v in values}
            odd = np.zeros(len(place), bool)
            for v in texts:
                odd |= pc.fill_null(pc.not_equal(pc.binary_length(columns[v]), 1), True).to_numpy(zero_copy_only=False)
            new = np.concatenate([[True], _changes(batch.column(key)) | (np.diff(place) != 1) | (np.diff(block) != 0) | odd[1:] | odd[:-1]])
            counted = {f"_s_{c}": x for c, x in (sums(columns) if sums else {}).items()}
            for shift in range(-behind, ahead + 1):
                begins = new
                if shift:
                    wanted = ((place - after - 1) // size <= block + shift) & ((place + before - 1) // size >= block + shift)
                    kept = np.flatnonzero(wanted)
                    begins = new[kept] | np.concatenate([[True], np.diff(kept) != 1])[: len(kept)]
                else:
                    kept = np.arange(len(place))
                if not len(kept):
                    continue
                at = np.flatnonzero(begins)
                ends = np.append(at[1:], len(kept)).astype(np.int32)
                offsets = pa.array(np.append(at, len(kept)).astype(np.int32))
                out = [batch.column(key).take(pa.array(kept[at])), pa.array(block[kept[at]] + shift), pa.array(place[kept[at]]), pa.array((ends - at).astype(np.int64))]
                for v in values:
                    part = columns[v].take(pa.array(kept)) if shift else columns[v]
                    lists = pa.ListArray.from_arrays(offsets, part)
                    # A missing letter is a run of its own, and its text stays missing.
                    out.append(pc.binary_join(lists, "") if v in texts else lists)
                for c in extra:
                    out.append(pa.array(np.add.reduceat(counted[c][kept], at).astype(np.int64)))
                yield pa.RecordBatch.from_arrays(out, schema.names)

    if made:
        source, maker = made
        return source.mapInArrow(lambda batches: run(maker(batches)), schema)
    return rows.select(key, pos, *values).mapInArrow(run, schema)


def unpacked(runs: DataFrame, key: str, values: Sequence[str], kernel: Callable, schema: T.StructType) -> DataFrame:
    """What ``kernel`` makes of whole blocks: of ``Blocks`` with their rows in order of position, then of the values."""
    wanted = [key, "_block"]
    dealt = runs.repartition(task_count(runs.sparkSession), *wanted).sortWithinPartitions(*wanted, "_at", *values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, wanted):
            yield from kernel(Blocks(table, wanted, values))

    return dealt.mapInArrow(run, schema)


def _whole(batches: Iterator[pa.RecordBatch], by: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Runs of whole blocks, of about ``LIMIT`` positions."""
    held, count = [], 0
    for batch in batches:
        sizes = batch.column("_n").to_numpy()
        share = np.cumsum(sizes) // LIMIT
        edges = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:]):
            if low == high:
                continue
            held.append(batch.slice(low, high - low))
            count += int(sizes[low:high].sum())
            if count < LIMIT:
                continue
            part = _one(held)
            new = np.zeros(part.num_rows - 1, bool)
            for c in by:
                new |= _changes(part.column(c))
            at = np.flatnonzero(new) + 1
            if len(at):
                yield part.slice(0, at[-1])
                part = part.slice(at[-1])
            held, count = [part], int(pc.sum(part.column("_n")).as_py())
    if held:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(parts).combine_chunks()
    return table.to_batches()[0]


class Blocks:
    """Rows of some blocks: ``row`` names the run of each, ``pos`` its position, ``begin`` and ``end`` bound its block."""

    def __init__(self, runs: pa.RecordBatch, by: Sequence[str], values: Sequence[str]):
        sizes, at = runs.column("_n").to_numpy(), runs.column("_at").to_numpy()
        self.runs, n = runs, int(sizes.sum())
        first = np.cumsum(sizes) - sizes
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.pos = at[self.row] + np.arange(n) - first[self.row]
        new = np.zeros(len(sizes), bool)
        new[:1] = True
        for c in by:
            new[1:] |= _changes(runs.column(c))
        group = (np.cumsum(new) - 1)[self.row]
        self.values = {v: _letters(runs.column(v), sizes) if pa.types.is_string(runs.column(v).type) else runs.column(v).flatten() for v in values}
        step = np.diff(self.pos)
        if ((step < 0) & (np.diff(group) == 0)).any():
            # Positions that come several times: their rows go side by side, in the order of their values.
            order = np.lexsort([*(_sortable(x) for x in reversed(self.values.values())), self.pos, group])
            self.row, self.pos, group = self.row[order], self.pos[order], group[order]
            self.values = {v: x.take(pa.array(order)) for v, x in self.values.items()}
        opens = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))[: n and None]
        self.begin = opens[group] if n else np.zeros(0, np.int64)
        self.end = np.append(opens[1:], n)[group] if n else np.zeros(0, np.int64)

    def of_run(self, column: str) -> pa.Array:
        """A column of the runs, for every row."""
        return self.runs.column(column).take(pa.array(self.row))


def _sortable(values: pa.Array) -> np.ndarray:
    """Nulls first."""
    if pa.types.is_string(values.type):
        return np.array([x or "" for x in values.to_pylist()], dtype=str)
    return pc.fill_null(values, 0).to_numpy(zero_copy_only=False) + 0.5 * values.is_valid().to_numpy(zero_copy_only=False)


def joined(rows: DataFrame, key: str, pos: str, letters: Sequence[str], size: int, runs: DataFrame | None = None) -> DataFrame:
    """One row per key: the letters of all its rows in order of position, as one text per column.

    ``runs`` are the packed rows, if they are there already.
    """
    runs = packed(rows, key, pos, letters, size) if runs is None else runs.select(key, "_block", "_at", "_n", *letters)
    schema = T.StructType([rows.schema[key], T.StructField("_block", T.LongType()), *[T.StructField(c, T.StringType()) for c in letters]])

    def kernel(b: Blocks):
        opens = np.flatnonzero(b.begin == np.arange(len(b.begin)))
        offsets = pa.array(np.append(opens, len(b.begin)).astype(np.int32))
        texts = [pc.binary_join(pa.ListArray.from_arrays(offsets, pc.fill_null(b.values[c], "")), "") for c in letters]
        yield pa.RecordBatch.from_arrays([b.of_run(c).take(pa.array(opens)) for c in (key, "_block")] + texts, schema.names)

    blocks = unpacked(runs, key, letters, kernel, schema).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_block", *letters))).alias("_x"))
    return blocks.select(key, *[F.array_join(F.transform("_x", lambda x: x[c]), "").alias(c) for c in letters])


def _letters(texts: pa.Array, sizes: np.ndarray) -> pa.Array:
    """One letter of the runs' texts per row; the text of a run of one row is its value."""
    lengths = pc.fill_null(pc.binary_length(texts), -1).to_numpy(zero_copy_only=False)
    if (lengths == sizes).all():
        data = "".join(texts.to_pylist()).encode()
        return pa.StringArray.from_buffers(len(data), pa.py_buffer(np.arange(len(data) + 1, dtype=np.int32)), pa.py_buffer(data))
    out: list = []
    for text, size in zip(texts.to_pylist(), sizes.tolist()):
        out.extend([text] if size == 1 else text)
    return pa.array(out, pa.string())
