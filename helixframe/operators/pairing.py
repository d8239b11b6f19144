"""All-pairs work as an equi join on a task grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from helixframe.session import grid_side

#: Rows of one side that meet in a cell, about.
CELL_ROWS = 1000


def _side(table: DataFrame) -> int:
    """Cells grow in number with the data, not in size; small tables fill one shuffle."""
    return max(grid_side(table.sparkSession), -(-table.count() // CELL_ROWS))


def _sides(left: DataFrame, right: DataFrame) -> tuple[int, int]:
    rows, columns = (max(1, -(-t.count() // CELL_ROWS)) for t in (left, right))
    width = grid_side(left.sparkSession) ** 2
    return rows, max(columns, -(-width // rows))


def unordered_pairs(df: DataFrame, key: str, include_self: bool = True, side: int | None = None) -> DataFrame:
    """Every unordered pair of rows once, as structs ``lo`` and ``hi`` with ``lo.key <= hi.key``.

    Only the cells of the upper triangle are filled, so a pair is never made twice.
    """
    side = side or _side(df)
    row = F.struct(*df.columns)
    lane = F.pmod(F.xxhash64(key), F.lit(side)).cast("int")
    laned = df.select(row.alias("_x"), lane.alias("_lane"))
    a = laned.select(F.col("_x").alias("_a"), F.col("_lane").alias("_row"), F.explode(F.sequence("_lane", F.lit(side - 1))).alias("_col"))
    b = laned.select(F.col("_x").alias("_b"), F.col("_lane").alias("_col"), F.explode(F.sequence(F.lit(0), F.col("_lane"))).alias("_row"))
    cells = side * (side + 1) // 2
    met = a.repartition(cells, "_row", "_col").join(b.repartition(cells, "_row", "_col"), ["_row", "_col"])
    one, other = F.col("_a")[key], F.col("_b")[key]
    # Inside a cell of the diagonal both orders meet; elsewhere only one of them exists.
    once = (F.col("_row") < F.col("_col")) | ((one <= other) if include_self else (one < other))
    first = one <= other
    return met.where(once).select(
        F.when(first, F.col("_a")).otherwise(F.col("_b")).alias("lo"), F.when(first, F.col("_b")).otherwise(F.col("_a")).alias("hi")
    )


def grid_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, side: int | None = None) -> DataFrame:
    """Every left row next to every right row, spread evenly over the cells of a grid.

    Left rows take a grid row by hash of their id and are repeated along it;
    right rows take a grid column.  Each pair meets in exactly one cell, so the
    join key is uniform whatever the data looks like, and a row is copied once
    per block of the other side.  A few left rows against a large right side
    leave the right side uncopied.  ``side`` fixes both sides of the grid.
    """
    rows, columns = (side, side) if side else _sides(left, right)
    a = left.withColumn("_row", F.pmod(F.xxhash64(left_id), F.lit(rows)).cast("int")).withColumn(
        "_col", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))
    )
    b = right.withColumn("_col", F.pmod(F.xxhash64(right_id), F.lit(columns)).cast("int")).withColumn(
        "_row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))
    )
    # A fixed partition count: the join makes far more rows than it reads, so the
    # cells must not be merged by the size of their input.
    cells = rows * columns
    return a.repartition(cells, "_row", "_col").join(b.repartition(cells, "_row", "_col"), ["_row", "_col"]).drop("_row", "_col")
