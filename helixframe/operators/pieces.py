"""Sequences as pieces: ``(seq_id, offset, text)`` rows of bounded size.

Every piece of a sequence but the last has exactly ``PIECE`` letters, ``offset``
counts from 0.  No operator needs a whole sequence in one row: what runs over the
edge of a piece takes a lap, the first letters of the piece with the next key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from helixframe.session import task_count

PIECE = 1 << 13


def cut(sequences: DataFrame, size: int = PIECE) -> DataFrame:
    """Pieces of ``(seq_id, seq)`` rows, in one pass over each; other columns are repeated."""
    rest = [c for c in sequences.columns if c != "seq"]
    found = F.regexp_extract_all("seq", F.lit(f".{{1,{size}}}"), F.lit(0))
    return sequences.where(F.length("seq") > 0).select(*rest, F.posexplode(found).alias("_i", "text")).select(
        *rest, (F.col("_i").cast("bigint") * size).alias("offset"), "text"
    )


def of(sequences: DataFrame) -> DataFrame:
    """Pieces as they are; rows with a whole ``seq`` are cut."""
    return cut(sequences) if "seq" in sequences.columns else sequences


def with_lap(pieces: DataFrame, lap: int, size: int = PIECE) -> DataFrame:
    """``seq_id, offset, own, text``: each piece followed by up to ``lap`` letters of the next one.

    Pieces are dealt out evenly, and stay so: what is done per letter costs far
    more than moving it once.
    """
    if lap > size:
        raise ValueError(f"a lap of {lap} letters is longer than a piece of {size}")
    tasks = task_count(pieces.sparkSession)
    own = pieces.select(F.col("seq_id").cast("bigint").alias("seq_id"), "offset", F.length("text").alias("own"), "text")
    if not lap:
        return own.repartition(tasks, "seq_id", "offset")
    heads = pieces.where("offset > 0").select(
        F.col("seq_id").cast("bigint").alias("seq_id"), (F.col("offset") - size).alias("offset"), F.substring("text", 1, lap).alias("_ahead")
    )
    joined = own.repartition(tasks, "seq_id", "offset").join(heads.repartition(tasks, "seq_id", "offset"), ["seq_id", "offset"], "left")
    return joined.select("seq_id", "offset", "own", F.concat("text", F.coalesce("_ahead", F.lit(""))).alias("text"))


def tiles(pieces: DataFrame, lap: int, tile: int, size: int = PIECE) -> DataFrame:
    """The same for tiles of ``tile`` letters; ``tile`` divides ``size``."""
    if size % tile:
        raise ValueError(f"tiles of {tile} letters do not fill a piece of {size}")
    whole = with_lap(pieces, lap, size)
    if tile == size:
        return whole
    inside = whole.select("*", F.explode(F.sequence(F.lit(0), F.col("own") - 1, F.lit(tile))).alias("_o"))
    return inside.select(
        "seq_id", (F.col("offset") + F.col("_o")).alias("offset"), F.least(F.lit(tile), F.col("own") - F.col("_o")).alias("own"),
        F.substring(F.col("text"), F.col("_o") + 1, F.lit(tile + lap)).alias("text"),
    )


def lengths(pieces: DataFrame) -> DataFrame:
    """``seq_id, n`` of every sequence that has letters."""
    return pieces.groupBy("seq_id").agg(F.sum(F.length("text")).cast("bigint").alias("n"))


def joined(pieces: DataFrame) -> DataFrame:
    """``seq_id, seq``: the letters of every sequence in one row again."""
    parts = pieces.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("offset", "text"))).alias("_p"))
    return parts.select("seq_id", F.array_join(F.transform("_p", lambda p: p["text"]), "").alias("seq"))
