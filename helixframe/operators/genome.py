"""Genome chunks, lifting, masking, seeds and alignment scoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from helixframe.operators import extension, pieces
from helixframe.operators.footprint import framed
from helixframe.operators.ordered import desc, prefix_scan
from helixframe.operators.pairing import grid_pairs
from helixframe.operators.pieces import PIECE, tiles
from helixframe.operators.ranges import merge_intervals
from helixframe.session import cut_lineage

# Substitution scores (rows and columns A C G T) and run parameters per distance.
SUBSTITUTION = {
    "near": ((90, -330, -236, -356), (-330, 100, -318, -236), (-236, -318, 100, -330), (-356, -236, -330, 90)),
    "medium": ((91, -114, -31, -123), (-114, 100, -125, -31), (-31, -125, 100, -114), (-123, -31, -114, 91)),
    "far": ((91, -90, -25, -100), (-90, 100, -100, -25), (-25, -100, 100, -90), (-100, -25, -90, 91)),
}
# distance, gap open, gap extend, ungapped threshold, gapped threshold, lowest chain score, linear gap
PRESETS = [
    ("near", 600, 150, 4500, 3000, 5000, "medium"),
    ("medium", 400, 30, 3000, 3000, 3000, "medium"),
    ("far", 400, 30, 2200, 6000, 5000, "loose"),
]
SEED = "1110100110010101111"
# Target places of a word beyond which it starts no seed.
MASKING = {"near": 254, "medium": 50, "far": 50}


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PRESETS, "distance string, gap_open int, gap_extend int, hsp int, gapped int, min_chain int, linear_gap string"
    )


def substitutions(spark: SparkSession) -> DataFrame:
    rows = [
        (distance, x, y, grid[i][j])
        for distance, grid in SUBSTITUTION.items() for i, x in enumerate("ACGT") for j, y in enumerate("ACGT")
    ]
    return spark.createDataFrame(rows, "distance string, b1 string, b2 string, s int")


def chunks(sizes: DataFrame, size: int, lap: int = 0) -> DataFrame:
    """Half-open overlapping chunks of the sequences longer than ``size + lap``."""
    cut = sizes.where(F.col("size") > size + lap).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(size).cast("bigint"))).alias("start")
    )
    return cut.withColumn("end", F.least(F.col("start") + size + lap, F.col("size")))


def chunk_name() -> Column:
    return F.concat(F.col("seq_id").cast("string"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))


def pack_small(sizes: DataFrame, chunk: int, lap: int = 0, limit: int = 0, by_size: bool = True) -> DataFrame:
    """Part number of every sequence that is not cut, filled greedily in order per genome.

    A part closes when the next sequence would take it over ``chunk`` or it has
    ``limit`` members.  Where a part that starts at a given sequence must end
    follows from running sizes alone, so each sequence first gets a pointer to
    the next start; the starts actually used are those reached from the first
    one, found by doubling the pointers.  No genome is walked in one task.
    """
    order = [desc("size"), F.col("seq_id")] if by_size else [F.col("seq_id")]
    small = sizes.where(F.col("size") <= chunk + lap)
    ranked = cut_lineage(prefix_scan(small, ["genome"], order, rn=("rank", None), upto=("sum", "size")))
    none = F.lit(None).cast("bigint")
    ends = ranked.select("genome", F.col("upto").alias("v"), F.lit(1).alias("kind"), F.col("rn").alias("j"), none.alias("i"))
    asks = ranked.select(
        "genome", (F.col("upto") - F.col("size") + chunk).alias("v"), F.lit(0).alias("kind"), none.alias("j"), F.col("rn").alias("i")
    )
    # Read from large running sums to small: the last one seen is the smallest above the question.
    seen = prefix_scan(
        ends.unionByName(asks), ["genome"], [desc("v"), F.col("kind"), desc(F.coalesce("j", F.lit(0))), F.col("i")], nxt=("last", "j")
    )
    step = F.when(F.col("nxt").isNotNull(), F.greatest(F.col("nxt"), F.col("i") + 1))
    if limit:
        step = F.least(F.coalesce(step, F.col("i") + limit), F.col("i") + limit)
    jump = cut_lineage(seen.where("kind = 0").select("genome", "i", step.alias("to")).where("to IS NOT NULL"))
    starts = cut_lineage(ranked.where("rn = 1").select("genome", F.col("rn").alias("i")))
    while not jump.isEmpty():
        reached = starts.join(jump, ["genome", "i"]).select("genome", F.col("to").alias("i"))
        starts = cut_lineage(starts.unionByName(reached).distinct())
        onward = jump.select("genome", F.col("i").alias("to"), F.col("to").alias("far"))
        jump = cut_lineage(jump.join(onward, ["genome", "to"]).select("genome", "i", F.col("far").alias("to")))
    marks = starts.select("genome", F.col("i").alias("rn"), F.lit(1).alias("_new"))
    flagged = ranked.join(marks, ["genome", "rn"], "left").withColumn("_new", F.coalesce("_new", F.lit(0)))
    return prefix_scan(flagged, ["genome"], [F.col("rn")], part=("sum", "_new")).select("genome", "seq_id", "size", "part")


def lift_table(names: DataFrame, sizes: DataFrame) -> DataFrame:
    """Lift records of chunk names ``seq:start-end``; an unknown sequence is reported in ``error``."""
    shape = r"^(\d+):(\d+)-(\d+)$"
    parsed = names.select(
        "chunk", *[F.regexp_extract("chunk", shape, i).cast("bigint").alias(n) for i, n in ((1, "seq_id"), (2, "offset"), (3, "_e"))]
    )
    known = sizes.select("seq_id", F.col("size").alias("seq_size"))
    joined = parsed.join(known, "seq_id", "left")
    return joined.select(
        "chunk", "offset", (F.col("_e") - F.col("offset")).alias("size"), "seq_id", "seq_size",
        F.when(F.col("seq_size").isNull(), "no size").alias("error"),
    )


def lift_up(results: DataFrame, lift: DataFrame, unknown: str = "error") -> DataFrame:
    """Chunk coordinates ``(chunk, start, end)`` to sequence coordinates.

    Results of unknown chunks are kept unchanged with ``carry``; with ``error``
    they are marked in ``status`` and keep no coordinates.
    """
    joined = results.join(lift.select("chunk", F.col("seq_id").cast("string").alias("_seq"), "offset"), "chunk", "left")
    known = F.col("offset").isNotNull()
    if unknown == "carry":
        shift = F.coalesce("offset", F.lit(0))
        return joined.select(
            "result_id", F.coalesce("_seq", "chunk").alias("seq"),
            (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"), F.lit("ok").alias("status"),
        )
    return joined.select(
        "result_id", F.col("_seq").alias("seq"), (F.col("start") + F.col("offset")).alias("start"),
        (F.col("end") + F.col("offset")).alias("end"), F.when(known, "ok").otherwise("unknown chunk").alias("status"),
    )


def soft_mask(sequences: DataFrame, intervals: DataFrame, size: int = 1024) -> DataFrame:
    """``seq_id, offset, text``: tiles of ``size`` letters, those inside closed 1-based intervals
    ``(seq_id, start, end)`` in lower case.

    A tile meets only the merged intervals that touch it, whose number is bounded by its length.
    """
    half_open = intervals.select("seq_id", "start", (F.col("end") + 1).alias("stop"))
    merged = merge_intervals(half_open, ["seq_id"], "start", "stop")
    first, last = F.floor((F.col("start") - 1) / size), F.floor((F.col("stop") - 2) / size)
    clipped = merged.select("seq_id", "start", "stop", F.explode(F.sequence(first, last)).alias("tile")).select(
        "seq_id", (F.col("tile") * size).alias("offset"),
        F.struct(
            F.greatest(F.col("start") - F.col("tile") * size, F.lit(1)).cast("int").alias("s"),
            F.least(F.col("stop") - F.col("tile") * size, F.lit(size + 1)).cast("int").alias("e"),
        ).alias("iv"),
    ).groupBy("seq_id", "offset").agg(F.collect_list("iv").alias("ivs"))
    masked = F.aggregate(
        F.coalesce("ivs", F.array().cast("array<struct<s:int,e:int>>")),
        F.col("text"),
        lambda t, iv: F.concat(
            F.substring(t, F.lit(1), iv["s"] - 1), F.lower(F.substring(t, iv["s"], iv["e"] - iv["s"])),
            F.substring(t, iv["e"], F.lit(size)),
        ),
    )
    return tiles(pieces.of(sequences), 0, size).join(clipped, ["seq_id", "offset"], "left").select("seq_id", "offset", masked.alias("text"))


def sequence_pairs(targets: DataFrame, queries: DataFrame) -> DataFrame:
    return grid_pairs(targets.select("t_name"), queries.select("q_name"), "t_name", "q_name")


def file_states(log: DataFrame, marker: str) -> DataFrame:
    """Whether the last line of each file is the end marker."""
    last = log.groupBy("file_id").agg(F.max_by("line", "line_no").alias("last_line"), F.count(F.lit(1)).alias("lines"))
    return last.withColumn("complete", F.col("last_line") == marker)


def alignment_scores(alignment: DataFrame, spark: SparkSession) -> DataFrame:
    """Score of every alignment under each distance: substitutions minus affine gap runs.

    The two tables joined here are the fixed 48-row and 3-row parameters.
    """
    gap = F.when(F.col("c1").isin("-", "."), 1).when(F.col("c2").isin("-", "."), 2).otherwise(0)
    order = W.partitionBy("aln_id", "_block").orderBy("apos")
    near = framed(alignment.withColumn("_gap", gap), "apos", 1, 0)
    opens = ((F.col("_gap") > 0) & (F.col("_gap") != F.coalesce(F.lag("_gap").over(order), F.lit(0)))).cast("int")
    marked = near.withColumn("_open", opens).where("_own")
    # Letters are counted per alignment before the parameters come in.
    counted = marked.groupBy("aln_id", F.upper("c1").alias("b1"), F.upper("c2").alias("b2")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_open").alias("opens"), F.sum((F.col("_gap") > 0).cast("int")).alias("gaps")
    )
    table = F.broadcast(substitutions(spark))
    every = counted.select("*", F.explode(F.array(*[F.lit(d) for d in SUBSTITUTION])).alias("distance"))
    joined = every.join(table, ["distance", "b1", "b2"], "left")
    sums = joined.groupBy("aln_id", "distance").agg(
        F.sum(F.coalesce("s", F.lit(0)) * F.col("n")).alias("matched"), F.sum("opens").alias("opens"), F.sum("gaps").alias("gaps")
    )
    costs = F.broadcast(presets(spark).select("distance", "gap_open", "gap_extend"))
    return sums.join(costs, "distance").select(
        "aln_id", "distance", (F.col("matched") - F.col("opens") * F.col("gap_open") - F.col("gaps") * F.col("gap_extend")).alias("score")
    )


def seed_words(sequences: DataFrame, both_strands: bool = False, flanked: bool = False, wanted: np.ndarray | None = None) -> DataFrame:
    """``(seq_id, strand, pos, word)``: the letters at the twelve care positions of every 19-letter window, as a number.

    ``pos`` is where the window begins on the strand the sequence is given in; with ``both_strands`` each window also has
    the word that is read on the other strand (-1), where ``pos`` counts on the reverse complement.  Windows with other
    letters than ACGT have none.  ``flanked`` adds ``near``, the letters around the window as ``extension.near`` packs
    them; ``wanted`` tells for every word, bit by bit, whether it is asked for.
    """
    span = len(SEED)
    care = [i for i, bit in enumerate(SEED) if bit == "1"]
    codes = np.full(256, 4, np.uint8)
    codes[np.frombuffer(b"ACGT", np.uint8)] = range(4)
    names = ["seq_id", "strand", "pos", "word", *(["near"] if flanked else [])]
    # With flanks a window belongs to the piece that has the letters before it too.
    ahead = extension.FLANK if flanked else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)) >> 20
            edges = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                if low < high:
                    yield from part(batch.slice(low, high - low))

    def part(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)
        letters = codes[np.frombuffer("".join(batch.column("text").to_pylist()).encode(), np.uint8)]
        if len(letters) < span:
            return
        # Every window of the joined letters; those over the end of their text, or begun in its lap, fall out.
        bad = np.concatenate([[0], np.cumsum(letters > 3)])
        count = len(letters) - span + 1
        begin = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(sizes)), sizes)[:count]
        place = np.arange(count) - begin[row]
        own = np.minimum(batch.column("own").to_numpy()[row] + ahead, sizes[row] - span + 1)
        offset = batch.column("offset").to_numpy()
        kept = np.flatnonzero((place < own) & (place >= np.where(offset > 0, ahead, 0)[row]) & (bad[span : span + count] == bad[:count]))
        wide = letters.astype(np.int64)
        for strand in (1, -1) if both_strands else (1,):
            word = np.zeros(len(kept), np.int64)
            for i, at in enumerate(care):
                letter = wide[kept + at] if strand > 0 else 3 - wide[kept + (span - 1 - at)]
                word |= letter << (2 * i)
            here = kept
            if wanted is not None:
                asked = (wanted[word >> 3] >> (word & 7).astype(np.uint8) & 1).astype(bool)
                here, word = kept[asked], word[asked]
            seq, pos = batch.column("seq_id").take(pa.array(row[here])), offset[row[here]] + place[here] + 1
            at = pos if strand > 0 else batch.column("n").to_numpy()[row[here]] - pos - (span - 2)
            out = [seq, pa.array(np.full(len(here), strand, np.int32)), pa.array(at), pa.array(word)]
            if flanked:
                out.append(extension.near(letters, here, place[here], sizes[row[here]], strand, batch.column("whole").to_numpy(zero_copy_only=False)[row[here]], span))
            yield pa.RecordBatch.from_arrays(out, names)

    letters = pieces.of(sequences)
    windows = tiles(letters, span - 1 + 2 * ahead, PIECE).where(F.length("text") >= span)
    if both_strands or flanked:
        # The length is joined to the pieces, which are few, not to the words or their matches.
        known = letters.groupBy(F.col("seq_id").cast("bigint").alias("seq_id")).agg(
            F.sum(F.length("text")).cast("bigint").alias("n"), (F.count(F.lit(1)) == F.count_distinct("offset")).alias("whole")
        )
        windows = windows.join(known, "seq_id")
    else:
        windows = windows.withColumn("n", F.lit(None).cast("bigint")).withColumn("whole", F.lit(True))
    schema = "seq_id bigint, strand int, pos bigint, word bigint" + (", near binary" if flanked else "")
    return windows.select("seq_id", "offset", F.col("own").cast("bigint").alias("own"), "text", "n", "whole").mapInArrow(run, schema)


def _word_bits(words: DataFrame) -> np.ndarray:
    """One bit for each of the 4**12 words: two megabytes, however many sequences there are."""
    size = 32_768
    parts = words.groupBy(F.floor(F.col("word") / size).cast("int").alias("part")).agg(F.bitmap_construct_agg((F.col("word") % size)).alias("bits")).collect()
    bits = np.zeros(4 ** SEED.count("1") // 8, np.uint8)
    for part, held in parts:
        bits[part * size // 8 :][: len(held)] = np.frombuffer(held, np.uint8)
    return bits


def seed_matches(targets: DataFrame, queries: DataFrame, masking: int, transition: bool = False, flanked: bool = False) -> DataFrame:
    """Positions of target and query, on either strand of the query, that share a spaced word.

    Words at more than ``masking`` target positions are left out, as in the
    aligner option of that name.  ``transition`` also accepts one A-G or C-T change.
    On strand -1 ``q_pos`` counts on the reverse complement.  Sequences come as pieces
    or as rows with ``seq``.  ``flanked`` adds the letters around both places, ``t_near`` and ``q_near``,
    from which ``ungapped_hsps`` tells most matches that lead nowhere without reading a sequence.
    """
    near = lambda side: [F.col("near").alias(f"{side}_near")] if flanked else []
    # Counted first, so that a word that is frequent in the target meets nothing.
    rare = seed_words(targets).groupBy("word").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= masking).select("word")
    # Words that are not asked for are not moved: the target's frequent ones, and the query's that meet nothing.
    wanted = _word_bits(rare)
    t = seed_words(targets, flanked=flanked, wanted=wanted)
    t = t.select("word", F.col("seq_id").alias("t_id"), F.col("pos").alias("t_pos"), *near("t"))
    # A query word that may change meets other words than its own.
    q = seed_words(queries, both_strands=True, flanked=flanked, wanted=None if transition else wanted)
    q = q.select("word", F.col("seq_id").alias("q_id"), (F.col("strand") * F.col("pos")).alias("_at"), *near("q"))
    if transition:
        # Letters are two bits, and the second one tells A from G and C from T.
        flips = [F.col("word").bitwiseXOR(F.lit(2 << (2 * i)).cast("bigint")) for i in range(SEED.count("1"))]
        q = q.select(F.explode(F.array("word", *flips)).alias("word"), *[c for c in q.columns if c != "word"])
    # Nothing follows the join on words: the matches, by far the largest table, are not moved again.
    met = t.join(q, "word").withColumn("strand", F.signum("_at").cast("int")).withColumn("q_pos", F.abs("_at"))
    return met.select("t_id", "t_pos", "q_id", "strand", "q_pos", *(["t_near", "q_near"] if flanked else []))


def drop_off(distance: str) -> int:
    """Fall of the score that ends an ungapped extension: ten times the score of A against A."""
    return 10 * SUBSTITUTION[distance][0][0]


def ungapped_hsps(seeds: DataFrame, targets: DataFrame, queries: DataFrame, distance: str, threshold: int) -> DataFrame:
    """``t_id, q_id, strand, diag, t_start, t_end, score``: ungapped segments around seeds, at or above ``threshold``.

    See ``extension``: overlapping seeds of a diagonal are extended to both sides until the score has dropped.
    Seeds with the letters around them (``seed_matches(flanked=True)``) are judged by those first.
    """
    if "t_near" in seeds.columns:
        seeds = extension.promising(seeds, SEED, SUBSTITUTION[distance], drop_off(distance), threshold)
    return extension.segments(
        seeds, pieces.of(targets), pieces.of(queries), len(SEED), SUBSTITUTION[distance], drop_off(distance), threshold
    )
