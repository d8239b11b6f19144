"""Sequence scanning and site sets.

Sequences are cut into overlapping chunks, so one long sequence becomes many
rows; a window belongs to the chunk it starts in.  Scores are sums of log-odds in
whole millionths and the threshold test is integer arithmetic, so a hit never
depends on summation order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from helixframe.operators.pieces import PIECE, tiles
from helixframe.operators.profiles import BASES
from helixframe.operators.ranges import stab
from helixframe.session import task_count

UNIT = 1_000_000
CHUNK = 1 << 17
# Letters within which small chunks are cut.
BLOCK = 1 << 13
# Most packed profiles that travel to the tasks with the code; a larger library is
# joined to the sequences in blocks of this size.
LIBRARY_LIMIT = 2_000
BLOCK_LETTERS = 1 << 21  # letters scored at once in a task
NO_BASE = -(1 << 40)

HITS = "seq_id bigint, matrix_id string, start bigint, end bigint, strand int, score double, rel_score double, site string"
COUNTS = "seq_id bigint, matrix_id string, level int, n bigint"
LIBRARY = ["matrix_id", "width", "cells", "low", "high"]

# Degenerate letters of consensus words.
WORD_LETTERS = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "K": "GT", "M": "AC", "S": "CG", "W": "AT", "N": "ACGT",
}


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def composition(sequences: DataFrame) -> tuple[float, ...]:
    """Share of each base over all sequences: four numbers from one aggregate."""
    letters = "seq" if "seq" in sequences.columns else "text"
    row = sequences.agg(
        *[F.sum(F.length(letters) - F.length(F.translate(letters, b.upper(), ""))).alias(b) for b in BASES],
        F.sum(F.length(letters)).alias("whole"),
    ).first()
    return tuple(row[b] / row["whole"] for b in BASES)


def pack_pwm(pwm: DataFrame) -> DataFrame:
    """One row per matrix: width, cells in whole millionths (four per column) and attainable range."""
    units = [F.round(F.col(b) * UNIT).cast("bigint").alias(b) for b in BASES]
    rows = pwm.select("matrix_id", "pos", F.array(*units).alias("c"))
    packed = rows.groupBy("matrix_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("cs"),
        F.sum(F.array_min("c")).alias("low"),
        F.sum(F.array_max("c")).alias("high"),
    )
    return packed.select(
        "matrix_id", F.size("cs").alias("width"), F.flatten(F.transform("cs", lambda x: x["c"])).alias("cells"), "low", "high"
    )


def pack_words(words: DataFrame) -> DataFrame:
    """Consensus words ``(matrix_id, word)`` as 0/1 matrices whose highest score means a match."""
    letters = F.split("word", "")

    def allowed(base: str) -> Column:
        codes = "".join(code for code, bases in WORD_LETTERS.items() if base in bases)
        return lambda x: F.when(x.rlike(f"^[{codes}]$"), F.lit(1)).otherwise(F.lit(0)).cast("bigint")

    tests = [allowed(b) for b in "ACGT"]
    return words.where(F.length("word") > 0).select(
        "matrix_id",
        F.length("word").alias("width"),
        F.flatten(F.transform(letters, lambda x: F.array(*[t(x) for t in tests]))).alias("cells"),
        F.lit(0).cast("bigint").alias("low"),
        F.length("word").cast("bigint").alias("high"),
    )


def chunked(sequences: DataFrame, lap: int, size: int = CHUNK) -> DataFrame:
    """``(seq_id, offset, own, text)``: ``own`` windows start in the chunk, ``lap`` letters follow it.

    Chunks are dealt out evenly: what is done per letter costs far more than
    moving it once, and neither one long sequence nor one large file part should
    decide how long the stage takes.  ``substring`` counts letters from the start
    of its text, so a sequence is cut into blocks in one pass and chunks are taken
    from the blocks: the work grows with the letters, not with their square.
    Sequences that come as pieces are never put together; their chunks are no longer
    than a piece.
    """
    if "seq" not in sequences.columns:
        return tiles(sequences, lap, min(size, PIECE))
    block = size * -(-max(BLOCK, lap) // size)
    blocks = sequences.where(F.length("seq") > 0).select(
        F.col("seq_id").cast("bigint").alias("seq_id"), F.regexp_extract_all("seq", F.lit(f".{{1,{block}}}"), F.lit(0)).alias("_b")
    )
    ahead = lambda i: F.coalesce(F.substring(F.get("_b", i + 1), 1, lap), F.lit(""))
    dealt = blocks.select(
        "seq_id",
        F.inline(F.transform("_b", lambda b, i: F.struct((i.cast("bigint") * block).alias("_at"), F.length(b).alias("_n"), F.concat(b, ahead(i)).alias("_t")))),
    ).repartition(task_count(sequences.sparkSession), "seq_id", "_at")
    inside = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(size))).alias("_o"))
    return inside.select(
        "seq_id",
        (F.col("_at") + F.col("_o")).alias("offset"),
        F.least(F.lit(size), F.col("_n") - F.col("_o")).alias("own"),
        F.substring(F.col("_t"), F.col("_o") + 1, F.lit(size + lap)).alias("text"),
    )


def scan(sequences: DataFrame, library: DataFrame, percent: int = 80, both_strands: bool = True, known: DataFrame | None = None) -> DataFrame:
    """Every window of every sequence against every matrix; hits reach ``percent`` of the score range.

    ``known`` has ``seq_id`` and bigint columns without nulls that the hits of a sequence
    shall have too: they are joined to the chunks, which are far fewer than the hits.
    """
    carried = [c for c in known.columns if c != "seq_id"] if known is not None else []
    schema = ", ".join([HITS, *[f"{c} bigint" for c in carried]])
    return _run(sequences, library, partial(_hits, percent=percent, both=both_strands, carried=carried), schema, known)


def count_hits(sequences: DataFrame, library: DataFrame, percents: tuple[int, ...], both_strands: bool = True) -> DataFrame:
    """Hits per sequence and matrix at each threshold, counted inside the scan."""
    return _run(sequences, library, partial(_counts, percents=percents, both=both_strands), COUNTS).groupBy(
        "seq_id", "matrix_id", "level"
    ).agg(F.sum("n").alias("n"))


def _run(sequences: DataFrame, library: DataFrame, kernel, schema: str, known: DataFrame | None = None) -> DataFrame:
    size, widest = library.agg(F.count(F.lit(1)), F.max("width")).first()
    chunks = chunked(sequences, max((widest or 1) - 1, 0))
    if known is not None:
        # Dealt out again, as one long sequence must not be scanned in one task.
        chunks = chunks.join(known, "seq_id").repartition(task_count(sequences.sparkSession), "seq_id", "offset")
    if size <= LIBRARY_LIMIT:
        profiles = _profiles(pd.DataFrame([tuple(r) for r in library.select(*LIBRARY).collect()], columns=LIBRARY))
        return chunks.mapInArrow(partial(_scan_all, profiles=profiles, kernel=kernel), schema)
    return _run_blocks(chunks, library, size, kernel, schema)


def _run_blocks(chunks: DataFrame, library: DataFrame, size: int, kernel, schema: str, lanes: int | None = None) -> DataFrame:
    """The same for any size of library: blocks of matrices meet lanes of chunks.

    A group holds one block of the library and one lane of chunks; the lane count
    keeps a lane to a bounded number of letters.
    """
    blocks = -(-size // LIBRARY_LIMIT)
    if lanes is None:
        letters = chunks.agg(F.sum(F.length("text"))).first()[0] or 1
        lanes = -(-letters // (32 * BLOCK_LETTERS))
    spread = chunks.withColumn("lane", F.pmod(F.xxhash64("seq_id", "offset"), F.lit(lanes)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    shelves = library.withColumn("block", F.pmod(F.xxhash64("matrix_id"), F.lit(blocks)).cast("int")).withColumn(
        "lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))
    )
    left, right = spread.groupBy("block", "lane"), shelves.groupBy("block", "lane")
    return left.cogroup(right).applyInArrow(partial(_scan_group, kernel=kernel, wanted=to_arrow_schema(T.StructType.fromDDL(schema))), schema)


def _scan_group(chunks: pa.Table, library: pa.Table, kernel, wanted: pa.Schema) -> pa.Table:
    if not chunks.num_rows or not library.num_rows:
        return wanted.empty_table()
    return pa.Table.from_batches([b.cast(wanted) for b in _scan_all(iter([chunks]), _profiles(library.to_pandas()), kernel)], wanted)


def _profiles(library: pd.DataFrame) -> list[tuple]:
    """Per matrix: name, range, and score tables of both strands with a fifth row for other letters."""
    out = []
    for name, width, cells, low, high in library[LIBRARY].itertuples(index=False):
        grid = np.asarray(cells, dtype=np.int64).reshape(int(width), 4)
        given = np.column_stack([grid, np.full(len(grid), NO_BASE)])
        turned = np.column_stack([grid[::-1, ::-1], np.full(len(grid), NO_BASE)])
        out.append((name, int(low), int(high), given, turned))
    return out


_CODES = np.full(256, 4, np.uint8)
_CODES[np.frombuffer(b"ACGTacgt", np.uint8)] = [0, 1, 2, 3, 0, 1, 2, 3]
_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[np.frombuffer(b"ACGTacgt", np.uint8)] = np.frombuffer(b"TGCAtgca", np.uint8)


def _scan_all(batches: Iterator[pa.RecordBatch], profiles, kernel) -> Iterator[pa.RecordBatch]:
    for taken in batches:
        batch = taken.to_pandas()
        sizes = batch["text"].str.len().to_numpy()
        block = np.cumsum(sizes) // BLOCK_LETTERS
        for number in np.unique(block):
            rows = batch[block == number]
            # One letter array for the block; a separator ends every chunk.
            letters = np.frombuffer(("\n".join(rows["text"]) + "\n").encode("ascii", "replace"), np.uint8)
            length = rows["text"].str.len().to_numpy()
            first = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
            place = np.repeat(np.arange(len(rows)), length + 1)
            local = np.arange(len(letters)) - first[place]
            owned = local < rows["own"].to_numpy()[place]
            held = {
                "letters": letters, "words": _words(_CODES[letters]), "place": place, "local": local, "owned": owned,
                "seq_id": rows["seq_id"].to_numpy(), "offset": rows["offset"].to_numpy(), "rows": rows,
            }
            yield from kernel(held, profiles)


def _words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each letter with the two after it as one number below 125, and with the five after it as one below 15,625."""
    padded = np.concatenate([codes, [4] * 5]).astype(np.int32)
    threes = padded[:-2] * 25 + padded[1:-1] * 5 + padded[2:]
    return threes[:-3], threes[:-3] * 125 + threes[3:]


def _three(table: np.ndarray) -> np.ndarray:
    """Sums of up to three columns for every word of three letters."""
    three = np.zeros((3, 5), np.int64)
    three[: len(table)] = table
    return (three[0][:, None, None] + three[1][None, :, None] + three[2]).ravel()


def _scores(words: tuple[np.ndarray, np.ndarray], table: np.ndarray) -> np.ndarray:
    """Score of every window, six columns per lookup, three at its end."""
    threes, sixes = words
    n = len(threes) - len(table) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    total = None
    for j in range(0, len(table), 6):
        if len(table) - j > 3:
            part = (_three(table[j:j + 3])[:, None] + _three(table[j + 3:j + 6])).ravel().take(sixes[j:j + n], mode="clip")
        else:
            part = _three(table[j:]).take(threes[j:j + n], mode="clip")
        total = part if total is None else np.add(total, part, out=total)
    return total


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _strands(given, turned, both):
    return ((1, given), (-1, turned)) if both else ((1, given),)


def _hits(held, profiles, percent, both, carried=()):
    for name, low, high, given, turned in profiles:
        least = low + -(-percent * (high - low) // 100)
        for strand, table in _strands(given, turned, both):
            score = _scores(held["words"], table)
            at = np.flatnonzero(score >= least)
            at = at[held["owned"][at]]
            if not len(at):
                continue
            width = len(table)
            place = held["place"][at]
            start = held["offset"][place] + held["local"][at] + 1
            words = held["letters"][at[:, None] + np.arange(width)]
            if strand < 0:
                words = _COMPLEMENT[words][:, ::-1]
            ends = np.arange(len(at) + 1, dtype=np.int32) * width
            sites = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(words)))
            yield pa.RecordBatch.from_arrays([
                pa.array(held["seq_id"][place]), pa.repeat(pa.scalar(name, pa.string()), len(at)), pa.array(start), pa.array(start + width - 1),
                pa.array(np.full(len(at), strand, np.int32)), pa.array(score[at] / UNIT), pa.array((score[at] - low) / max(high - low, 1)), sites,
                *[pa.array(held["rows"][c].to_numpy()[place]) for c in carried],
            ], [*_names(HITS), *carried])


def _counts(held, profiles, percents, both):
    rows, levels = len(held["seq_id"]), np.sort(np.asarray(percents, np.int64))
    for name, low, high, given, turned in profiles:
        # Smallest score that reaches each level.
        cuts = low + -(-levels * (high - low) // 100)
        reached = np.zeros((rows, len(levels) + 1), np.int64)
        for _, table in _strands(given, turned, both):
            score = _scores(held["words"], table)
            at = np.nonzero((score >= cuts[0]) & held["owned"][:len(score)])[0]
            slot = held["place"][at] * (len(levels) + 1) + np.searchsorted(cuts, score[at], side="right")
            reached += np.bincount(slot, minlength=reached.size).reshape(reached.shape)
        n = reached[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
        row, level = np.nonzero(n)
        if len(row):
            yield pa.RecordBatch.from_arrays([
                pa.array(held["seq_id"][row]), pa.repeat(pa.scalar(name, pa.string()), len(row)),
                pa.array(levels[level].astype(np.int32)), pa.array(n[row, level]),
            ], _names(COUNTS))


# ---- site sets --------------------------------------------------------------------------


def hits_per_kb(counts: DataFrame, sequences: DataFrame, group: str) -> DataFrame:
    """Hits per 1,000 letters, both strands, per sequence set, matrix and threshold; one decimal."""
    letters = "seq" if "seq" in sequences.columns else "text"
    sizes = sequences.groupBy(group).agg(F.sum(F.length(letters)).alias("letters"))
    summed = counts.join(sequences.select("seq_id", group).distinct(), "seq_id").groupBy(group, "matrix_id", "level").agg(F.sum("n").alias("n"))
    return summed.join(sizes, group).select(
        group, "matrix_id", "level", F.round(F.col("n") * 1000 / F.col("letters"), 1).alias("per_kb")
    )


def site_counts(sites: DataFrame) -> DataFrame:
    return sites.groupBy("matrix_id", "site").agg(F.count(F.lit(1)).alias("n"))


def split_flanks(sites: DataFrame) -> DataFrame:
    """Lower-case flanks and capital core of each site; flanks padded to the longest of the matrix plus five."""
    shape = r"^([acgtn]*)([ACGTN]*)([acgtn]*)$"
    parts = sites.withColumns({
        "flank5": F.regexp_extract("site", shape, 1),
        "core": F.regexp_extract("site", shape, 2),
        "flank3": F.regexp_extract("site", shape, 3),
    })
    longest = parts.groupBy("matrix_id").agg((F.max(F.greatest(F.length("flank5"), F.length("flank3"))) + 5).alias("_w"))
    joined = parts.join(longest, "matrix_id")
    return joined.withColumns({
        "flank5": F.lpad("flank5", F.col("_w"), F.lit(" ")), "flank3": F.rpad("flank3", F.col("_w"), F.lit(" ")),
    }).drop("_w")


def without_sites(matrices: DataFrame, sites: DataFrame) -> DataFrame:
    return matrices.join(sites.select("matrix_id").distinct(), "matrix_id", "left_anti")


def region_class(hits: DataFrame, features: DataFrame) -> DataFrame:
    """Adds ``region`` of the hit start: 0 none, 1 exon, 2 open reading frame."""
    ranked = features.where("kind IN ('exon', 'orf')").withColumn("_r", F.when(F.col("kind") == "orf", 2).otherwise(1))
    found = stab(hits, ranked, ["seq_id"], "start", "f_start", "f_end", region=("max", "_r"))
    return found.withColumn("region", F.coalesce("region", F.lit(0)))


def exclude_coding(hits: DataFrame, features: DataFrame) -> DataFrame:
    """Hits whose start lies in no open reading frame."""
    return region_class(hits, features.where("kind = 'orf'")).where("region = 0").drop("region")


def in_view(hits: DataFrame, start: int, end: int) -> DataFrame:
    return hits.where((F.col("start") >= start) & (F.col("start") < end))


def original_position(pos: Column, length: Column, strand: Column) -> Column:
    """Position on the strand the sequence was given in."""
    return F.when(strand == -1, length - pos + 1).otherwise(pos)


def original_sign(sign: Column, strand: Column) -> Column:
    return F.when(strand == -1, -sign).otherwise(sign)


def sensitivity(known: DataFrame, hits: DataFrame) -> DataFrame:
    """Share of the known sites ``(seq_id, matrix_id, k_start, k_end)`` that a hit of the matrix overlaps."""
    spans = hits.select("seq_id", "matrix_id", "start", "end").distinct()
    overlap = (F.col("start") <= F.col("k_end")) & (F.col("end") >= F.col("k_start"))
    found = known.alias("k").join(
        spans.alias("h"),
        (F.col("k.seq_id") == F.col("h.seq_id")) & (F.col("k.matrix_id") == F.col("h.matrix_id")) & overlap,
        "left_semi",
    )
    return found.agg(F.count(F.lit(1)).alias("found")).withColumn("known", known.agg(F.count(F.lit(1))).scalar()).select(
        "known", "found", (F.col("found") / F.col("known")).alias("share")
    )


def conservation_rate(reference: DataFrame, other: DataFrame) -> DataFrame:
    """Occurrences ``(seq_id, matrix_id, apos)`` that the other species has at the same alignment position, per matrix."""
    keys = ["seq_id", "matrix_id", "apos"]
    met = reference.join(other.select(*keys, F.lit(1).alias("_c")), keys, "left")
    return met.groupBy("matrix_id").agg(F.count(F.lit(1)).alias("n"), F.count("_c").alias("conserved")).withColumn(
        "rate", F.col("conserved") / F.col("n")
    )
