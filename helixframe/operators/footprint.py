"""Comparative footprint operators on pairwise alignments and gene annotation.

Alignments come as one row per position: ``(aln_id, apos, c1, c2)`` with ``-`` or
``.`` for a gap.  An alignment may be of any length: running values and sliding
frames work on blocks of positions, and no window spans an alignment.  Rows move
as runs (``operators/runs``); what a block needs of those before it comes as one
row per block.  ``framed`` copies single rows at the edges of blocks.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from helixframe.operators.ordered import prefix_scan, rank_rows
from helixframe.operators.ranges import stab
from helixframe.operators.runs import Blocks, packed, unpacked
from helixframe.operators.scanning import revcomp
from helixframe.session import cut_lineage

MIN_VIEW = 500  # fixed value: narrowest default view
#: Positions of an alignment in one block of a sliding frame.
FRAME_ROWS = 1 << 16


def is_base(column: str) -> Column:
    return ~F.col(column).isin("-", ".")


def framed(rows: DataFrame, pos: str, before: int, after: int, size: int | None = None) -> DataFrame:
    """Rows with ``_block``, blocks of ``size`` positions of an alignment, and ``_own``, whether it is the row's block.

    A row is copied to the neighbouring blocks in which frames from ``before`` rows back to ``after`` rows ahead need it.
    """
    size = size or FRAME_ROWS
    block = lambda x: F.floor((x - 1) / size)
    spread = rows.withColumn("_block", F.explode(F.sequence(block(F.col(pos) - after), block(F.col(pos) + before))))
    return spread.withColumn("_own", F.col("_block") == block(F.col(pos)))


def _bases(column: pa.Array) -> np.ndarray:
    """``is_base`` of an Arrow column, false where it is null."""
    gap = pc.is_in(column, value_set=pa.array(["-", "."]))
    return pc.and_(column.is_valid(), pc.invert(gap)).to_numpy(zero_copy_only=False)


def _beside_blocks(runs: DataFrame, known: DataFrame) -> DataFrame:
    """Runs with what is ``known(aln_id, _block)`` of their block, if anything."""
    known = known.withColumnsRenamed({"aln_id": "_k_aln", "_block": "_k_block"})
    same = F.col("aln_id").eqNullSafe(F.col("_k_aln")) & (F.col("_block") == F.col("_k_block"))
    return runs.join(known, same, "left").drop("_k_aln", "_k_block")


def alignment_runs(alignment: DataFrame, made: tuple | None = None) -> DataFrame:
    """The rows of an alignment as runs with their numbers of bases, written once for index and strings.

    ``made`` tells what the rows are made of (``runs.packed``).
    """

    def counts(columns):
        return {f"c{n}": _bases(columns[f"c{n}"]) for n in (1, 2)}

    return cut_lineage(packed(alignment, "aln_id", "apos", ["c1", "c2"], FRAME_ROWS, sums=counts, made=made))


def alignment_index(alignment: DataFrame, runs: DataFrame | None = None, places: bool | str = False) -> DataFrame:
    """Adds the ungapped positions ``p1`` and ``p2``; null in gaps.

    ``runs`` are the ``alignment_runs``, if they are there already.  With ``places`` the
    same index comes as runs in which position and ``apos`` go up together: ``which``
    sequence, ``aln_id, _block, _at, _n, apos``, ``_n`` bases from position ``_at`` and
    row ``apos`` within blocks of ``FRAME_ROWS`` positions of the sequence.  With ``places``
    ``"p2"`` they lead from the first sequence to positions ``p2`` of the second one instead.
    """
    plain = set(alignment.columns) == {"aln_id", "apos", "c1", "c2"}
    if places and not plain:
        raise ValueError("places are told of the columns aln_id, apos, c1 and c2 alone")
    if not plain:
        marked = alignment.withColumn("_b1", is_base("c1").cast("int")).withColumn("_b2", is_base("c2").cast("int"))
        counted = prefix_scan(marked, ["aln_id"], [F.col("apos")], p1=("sum", "_b1"), p2=("sum", "_b2"))
        return counted.select(*alignment.columns, *[F.when(F.col(f"_b{n}") == 1, F.col(f"p{n}")).cast("int").alias(f"p{n}") for n in (1, 2)])

    runs = alignment_runs(alignment) if runs is None else runs
    before = W.partitionBy("aln_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = runs.groupBy("aln_id", "_block").agg(F.sum("_s_c1").alias("n1"), F.sum("_s_c2").alias("n2"))
    ahead = blocks.select("aln_id", "_block", *[F.sum(f"n{n}").over(before).alias(f"_from{n}") for n in (1, 2)]).where("_from1 IS NOT NULL")
    schema = T.StructType([*[alignment.schema[c] for c in alignment.columns], *[T.StructField(p, T.IntegerType()) for p in ("p1", "p2")]])
    apos = pa.int32() if alignment.schema["apos"].dataType == T.IntegerType() else pa.int64()

    def counted(b: Blocks, n: int):
        base = _bases(b.values[f"c{n}"])
        upto = np.concatenate([[0], np.cumsum(base)])
        return base, upto[1:] - upto[b.begin] + pc.fill_null(b.of_run(f"_from{n}"), 0).to_numpy(zero_copy_only=False)

    def kernel(b: Blocks):
        found = {"aln_id": b.of_run("aln_id"), "apos": pa.array(b.pos).cast(apos), **b.values}
        for n in (1, 2):
            base, count = counted(b, n)
            found[f"p{n}"] = pa.array(count.astype(np.int32), mask=~base)
        yield pa.RecordBatch.from_arrays([found[c] for c in schema.names], schema.names)

    if not places:
        return unpacked(_beside_blocks(runs, ahead), "aln_id", ["c1", "c2"], kernel, schema)
    size = FRAME_ROWS
    across = places == "p2"
    whole = T.StructType([
        T.StructField("which", T.IntegerType()), alignment.schema["aln_id"],
        *[T.StructField(c, T.LongType()) for c in ("_block", "_at", "_n", "p2" if across else "apos")],
    ])

    def together(b: Blocks):
        sides = [counted(b, n) for n in (1, 2)]
        for n, (base, count) in enumerate(sides[:1] if across else sides, 1):
            rows = np.flatnonzero(base & sides[1][0] if across else base)
            if not len(rows):
                continue
            at, place, begin = count[rows], (sides[1][1] if across else b.pos)[rows], b.begin[rows]
            block = (at - 1) // size
            new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(place) != 1) | (np.diff(block) != 0) | (np.diff(begin) != 0)])
            opens = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(opens), n, np.int32)), b.runs.column("aln_id").take(pa.array(b.row[rows[opens]])), pa.array(block[opens]),
                pa.array(at[opens]), pa.array(np.diff(np.append(opens, len(rows)))), pa.array(place[opens]),
            ], whole.names)

    return unpacked(_beside_blocks(runs, ahead), "aln_id", ["c1", "c2"], together, whole)


def placed(points: DataFrame, places: DataFrame, which: int, key: str, pos: str, value: str = "apos", keep: bool = False) -> DataFrame:
    """Points with the ``apos`` at which their position ``pos`` of a sequence stands; those without one fall out.

    ``places`` are the runs of ``alignment_index``, ``value`` what they lead to.  The runs and
    points of a block of positions are read once in order, so that no row per position is made
    or moved, nor sent to the driver.  With ``keep`` points without a place get null.
    """
    runs = places.where(F.col("which") == which).select(
        F.col("aln_id").alias("_key"), "_block", F.col("_at").alias("_p"), F.struct("_at", "_n", value).alias("_run")
    )
    known = F.col(key).isNotNull() & F.col(pos).isNotNull()
    asked = points.where(known).select(
        F.col(key).alias("_key"), F.floor((F.col(pos) - 1) / FRAME_ROWS).alias("_block"), F.col(pos).cast("bigint").alias("_p"),
        F.struct(*[F.col(c) for c in points.columns]).alias("_point"),
    )
    both = runs.unionByName(asked, allowMissingColumns=True)
    upto = W.partitionBy("_key", "_block").orderBy("_p", F.col("_point").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    met = both.withColumn("_run", F.last("_run", ignorenulls=True).over(upto)).where("_point IS NOT NULL")
    inside, place = F.col("_p") < F.col("_run._at") + F.col("_run._n"), F.col(f"_run.{value}") + F.col("_p") - F.col("_run._at")
    if not keep:
        return met.where(inside).select("_point.*", place.alias(value))
    none = points.where(~known).withColumn(value, F.lit(None).cast("bigint"))
    return met.select("_point.*", F.when(inside, place).alias(value)).unionByName(none)


def strip_gaps(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("-")), F.lit("."))


def lookup(points: DataFrame, places: DataFrame, source: str, target: str) -> DataFrame:
    """Maps ``(aln_id, source)`` to ``target`` by equality; null when there is no such position.

    ``places`` are the runs of ``alignment_index`` that lead to ``target``.
    """
    met = placed(points, places, int(source[1:]), "aln_id", source, target, keep=True)
    return met.withColumn(target, F.col(target).cast("int"))


def nearest_mapped(index: DataFrame, source: str, target: str) -> DataFrame:
    """For every ``source`` position, the nearest ``target`` at or below and at or above it."""
    known = index.where(F.col(source).isNotNull()).select("aln_id", source, target)
    runs = cut_lineage(packed(known, "aln_id", source, [target], FRAME_ROWS))
    there = F.filter(target, lambda x: x.isNotNull())
    ends = runs.select("aln_id", "_block", "_at", there.alias("x")).where(F.size("x") > 0)
    ends = ends.groupBy("aln_id", "_block").agg(
        F.min_by(F.get("x", F.lit(0)), "_at").alias("first"), F.max_by(F.element_at("x", -1), "_at").alias("last")
    )
    # A block without targets has a row too, as its rows ask both neighbours.
    blocks = runs.select("aln_id", "_block").distinct()
    blocks = _beside_blocks(blocks, ends)
    back, ahead = (W.partitionBy("aln_id").orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in ("_block", F.desc("_block")))
    asked = blocks.select(
        "aln_id", "_block", F.last("last", ignorenulls=True).over(back).alias("_lower"), F.last("first", ignorenulls=True).over(ahead).alias("_higher")
    ).where("_lower IS NOT NULL OR _higher IS NOT NULL")
    kind = known.schema[target].dataType
    schema = T.StructType([known.schema["aln_id"], known.schema[source], T.StructField("lower", kind), T.StructField("higher", kind)])
    place = pa.int32() if known.schema[source].dataType == T.IntegerType() else pa.int64()

    def kernel(b: Blocks):
        values = b.values[target]
        valid, at = values.is_valid().to_numpy(zero_copy_only=False), np.arange(len(values))
        below = np.maximum.accumulate(np.where(valid, at, -1))
        above = np.minimum.accumulate(np.where(valid, at, len(at))[::-1])[::-1]
        lower, higher = (values.take(pa.array(x, mask=~inside)) for x, inside in ((below, below >= b.begin), (above, above < b.end)))
        lower, higher = pc.coalesce(lower, b.of_run("_lower")), pc.coalesce(higher, b.of_run("_higher"))
        yield pa.RecordBatch.from_arrays([b.of_run("aln_id"), pa.array(b.pos).cast(place), lower, higher], schema.names)

    both = unpacked(_beside_blocks(runs, asked), "aln_id", [target], kernel, schema)
    return both.withColumn("lower", F.coalesce("lower", F.lit(1)))


def identity() -> Column:
    return (F.upper("c1") == F.upper("c2")).cast("int")


def conservation(index: DataFrame, window: int = 50, which: int = 1) -> DataFrame:
    """Percent identity around each base of one sequence; the divisor stays ``window`` at the ends."""
    p = f"p{which}"
    half = window // 2
    back = window - 1 - half
    rows = index.where(F.col(p).isNotNull()).select("aln_id", F.col(p).alias("pos"), identity().cast("string").alias("_same"))
    size = FRAME_ROWS
    runs = packed(rows, "aln_id", "pos", ["_same"], size, back, half)
    schema = T.StructType([rows.schema["aln_id"], rows.schema["pos"], T.StructField("conservation", T.DoubleType())])
    place = pa.int32() if rows.schema["pos"].dataType == T.IntegerType() else pa.int64()

    def kernel(b: Blocks):
        at = np.arange(len(b.pos))
        low, high = np.maximum(at - back, b.begin), np.minimum(at + half + 1, b.end)
        same, known = (
            np.concatenate([[0], np.cumsum(x.to_numpy(zero_copy_only=False))])
            for x in (pc.fill_null(pc.equal(b.values["_same"], "1"), False), b.values["_same"].is_valid())
        )
        own = (b.pos - 1) // size == b.of_run("_block").to_numpy()
        share = pa.array((same[high] - same[low]) * 100 / window, mask=known[high] == known[low])
        columns = [b.of_run("aln_id"), pa.array(b.pos).cast(place), share]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(own)) for c in columns], schema.names)

    return unpacked(runs, "aln_id", ["_same"], kernel, schema)


def conservation_cutoff(profile: DataFrame, share: float = 0.9) -> DataFrame:
    """Element ``int(share * n)`` of the ascending profile of each alignment.

    A profile has few different values, so they are counted first.
    """
    counts = profile.groupBy("aln_id", "conservation").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(W.partitionBy("aln_id").orderBy("conservation"))
    whole = F.sum("_c").over(W.partitionBy("aln_id"))
    chosen = counts.select("aln_id", "conservation", upto.alias("_upto"), (F.floor(whole * share) + 1).alias("_k")).where("_upto >= _k")
    return chosen.groupBy("aln_id").agg(F.min("conservation").alias("cutoff"))


def conserved_regions(profile: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Maximal runs of positions at or above the cutoff."""
    high = profile.join(cutoffs, "aln_id").where("conservation >= cutoff").select("aln_id", "pos")
    ranked = rank_rows(high, ["aln_id"], [F.col("pos")], "_rn")
    return ranked.groupBy("aln_id", (F.col("pos") - F.col("_rn")).alias("_run")).agg(
        F.min("pos").alias("r_start"), F.max("pos").alias("r_end")
    ).drop("_run")


def paired_sites(hits1: DataFrame, hits2: DataFrame, index: DataFrame, profile: DataFrame, cutoffs: DataFrame,
                 compat: bool = False, orfs: DataFrame | None = None, places: DataFrame | None = None) -> DataFrame:
    """Hits of the same matrix and strand order at the same alignment position in both sequences.

    Hits of a matrix at one position pair off in order.  The conservation at the
    start in the first sequence must reach the cutoff; ``compat`` reads the
    conservation of the next base instead.  With ``orfs(aln_id, f_start, f_end)``
    pairs that start inside one of them in the first sequence are left out.  ``places`` are
    the runs of the index (``alignment_index``), if they are there: hits are looked up in those.
    """
    def ordered(hits: DataFrame, which: int) -> DataFrame:
        order = W.partitionBy("aln_id", "apos", "matrix_id").orderBy("strand", "start", "end")
        if places is not None:
            there = placed(hits, places, which, "aln_id", "start").withColumn("apos", F.col("apos").cast(index.schema["apos"].dataType))
        else:
            where = index.where(F.col(f"p{which}").isNotNull()).select("aln_id", "apos", F.col(f"p{which}").alias("start"))
            # The index looks as small to the planner as the runs it is made of.
            there = hits.join(where.hint("merge"), ["aln_id", "start"])
        return there.withColumn("_rn", F.row_number().over(order))

    # Positions that reach the cutoff are few, and they meet the hits first.  Their profile moves as runs.
    runs = packed(profile.select("aln_id", "pos", "conservation"), "aln_id", "pos", ["conservation"], FRAME_ROWS)
    high = runs.hint("merge").join(cutoffs, "aln_id").select("aln_id", "_at", "cutoff", F.posexplode("conservation").alias("_i", "conservation"))
    high = high.where("conservation >= cutoff").select("aln_id", (F.col("_at") + F.col("_i") - (1 if compat else 0)).alias("start"))
    # Runs look small to the planner, their rows are not: they are not to be broadcast.
    kept = ordered(hits1.join(high.hint("merge"), ["aln_id", "start"]), 1)
    columns = ["start", "end", "strand", "score", "site"]
    one = kept.select("aln_id", "apos", "matrix_id", "_rn", *[F.col(c).alias(f"{c}1") for c in columns])
    two = ordered(hits2, 2).select("aln_id", "apos", "matrix_id", F.col("_rn").alias("_rn2"), *[F.col(c).alias(f"{c}2") for c in columns])
    # Both sides lie by place and matrix already; the order numbers are compared there, and nothing moves again.
    pairs = one.join(two.hint("merge"), ["aln_id", "apos", "matrix_id"]).where(F.col("_rn") - F.col("_rn2") == 0).drop("_rn", "_rn2")
    if orfs is None:
        return pairs
    inside = stab(pairs, orfs.withColumn("_one", F.lit(1)), ["aln_id"], "start1", "f_start", "f_end", _in=("max", "_one"))
    return inside.where("_in IS NULL").drop("_in")


def overlap_span(index: DataFrame, least: int = MIN_VIEW) -> DataFrame:
    """First and last position with both sequences present, widened to ``least`` and clipped."""
    both = F.col("p1").isNotNull() & F.col("p2").isNotNull()
    spans = index.groupBy("aln_id").agg(
        F.min(F.when(both, F.col("apos"))).alias("s"), F.max(F.when(both, F.col("apos"))).alias("e"), F.max("apos").alias("n")
    )
    narrow = F.col("e") - F.col("s") < least
    start = F.when(F.col("s").isNull(), 1).when(narrow, F.floor(F.col("s") + (F.col("e") - F.col("s")) / 2 - least / 2)).otherwise(F.col("s"))
    moved = spans.withColumn("_s", start.cast("int"))
    end = F.when(F.col("s").isNull(), F.col("n")).when(
        narrow, F.floor(F.col("_s") + (F.col("e") - F.col("_s")) / 2 + least / 2)
    ).otherwise(F.col("e"))
    return moved.select(
        "aln_id", F.greatest("_s", F.lit(1)).alias("view_start"), F.least(end.cast("int"), F.col("n")).alias("view_end")
    )


def view_range(requests: DataFrame, places: DataFrame) -> DataFrame:
    """User ranges ``(aln_id, r_from, r_to)`` on sequence 1, put in order, clipped and mapped to the alignment.

    ``places`` are the runs of ``alignment_index``.
    """
    sizes = places.where("which = 1").groupBy("aln_id").agg(F.max(F.col("_at") + F.col("_n") - 1).alias("_n"))
    low, high = F.least("r_from", "r_to"), F.greatest("r_from", "r_to")
    clipped = requests.join(sizes, "aln_id").select(
        "aln_id", "r_from", "r_to",
        F.least(F.greatest(low, F.lit(1)), F.col("_n")).alias("_s"), F.least(F.greatest(high, F.lit(1)), F.col("_n")).alias("_e"),
    )
    first = placed(clipped, places, 1, "aln_id", "_s").withColumnRenamed("apos", "start_at")
    both = placed(first, places, 1, "aln_id", "_e").withColumnRenamed("apos", "end_at")
    return both.select("aln_id", "r_from", "r_to", F.col("start_at").cast("int").alias("start_at"), F.col("end_at").cast("int").alias("end_at"))


def alignment_blocks(index: DataFrame, width: int = 60) -> DataFrame:
    """Text blocks of both rows with identity bars and a ruler mark every ten positions."""
    marks = index.select(
        "aln_id", F.floor((F.col("apos") - 1) / width).cast("int").alias("block"),
        F.struct(
            "apos", "c1", "c2",
            F.when((identity() == 1) & is_base("c1"), "|").otherwise(" ").alias("bar"),
            F.when(F.col("apos") % 10 == 0, "+").otherwise(" ").alias("tick"),
        ).alias("x"),
    )
    packed = marks.groupBy("aln_id", "block").agg(F.array_sort(F.collect_list("x")).alias("xs"))

    def line(field: str) -> Column:
        return F.array_join(F.transform("xs", lambda x: x[field]), "")

    return packed.select("aln_id", "block", line("tick").alias("ruler"), line("c1").alias("row1"), line("bar").alias("bars"), line("c2").alias("row2"))


# ---- genes and transcripts --------------------------------------------------------------


def longest_orf(candidates: DataFrame) -> DataFrame:
    """Longest ``(cdna, o_from, o_to)`` per cDNA; reversed numbers mean the minus strand."""
    size = F.abs(F.col("o_to") - F.col("o_from")) + 1
    best = F.max_by(F.struct("o_from", "o_to"), F.struct(size, -F.col("o_from"), -F.col("o_to")))
    chosen = candidates.groupBy("cdna").agg(best.alias("o")).select("cdna", "o.*")
    return chosen.select(
        "cdna", F.least("o_from", "o_to").alias("start"), F.greatest("o_from", "o_to").alias("end"),
        F.when(F.col("o_from") <= F.col("o_to"), 1).otherwise(-1).alias("strand"),
        (F.abs(F.col("o_to") - F.col("o_from")) + 1).alias("length"),
    )


def exon_table(lines: DataFrame) -> DataFrame:
    """Numbered exon pairs from report lines ``(report, line_no, line)``.

    Reports that mention a reversed EST carry cDNA coordinates from the other
    end; ``cdna_length`` turns them.
    """
    turned = F.max(F.col("line").contains("reversed est and forward genome")).over(W.partitionBy("report"))
    col = F.split(F.col("line"), r"\s+")
    rows = lines.withColumn("_rev", turned).where(F.col("line").rlike(r"^Exon\s"))
    number = F.row_number().over(W.partitionBy("report").orderBy("line_no"))
    parsed = rows.select(
        "report", number.cast("bigint").alias("exon"), "_rev", "cdna_length",
        *[col.getItem(i).cast("bigint").alias(n) for i, n in ((3, "g_start"), (4, "g_end"), (6, "_c1"), (7, "_c2"))],
    )
    return parsed.select(
        "report", "exon", "g_start", "g_end",
        F.when(F.col("_rev"), F.col("cdna_length") - F.col("_c2") + 1).otherwise(F.col("_c1")).alias("c_start"),
        F.when(F.col("_rev"), F.col("cdna_length") - F.col("_c1") + 1).otherwise(F.col("_c2")).alias("c_end"),
        F.when(F.col("_rev"), -1).otherwise(1).alias("strand"),
    )


def orf_on_gene(exons: DataFrame, orfs: DataFrame) -> DataFrame:
    """Gene segments of an open reading frame given in exon-base order.

    ``exons(gene, e_start, e_end)`` are disjoint; an exon covers the cDNA offsets
    after all exons before it, and the frame is clipped to what they cover.
    """
    size = F.col("e_end") - F.col("e_start") + 1
    before = W.partitionBy("gene").orderBy("e_start").rowsBetween(W.unboundedPreceding, -1)
    laid = exons.withColumn("_c0", F.coalesce(F.sum(size).over(before), F.lit(0))).withColumn("_n", size)
    met = laid.join(orfs, "gene")
    first = F.greatest(F.col("o_start"), F.col("_c0") + 1)
    last = F.least(F.col("o_end"), F.col("_c0") + F.col("_n"))
    return met.where(first <= last).select(
        "gene", (F.col("e_start") + first - F.col("_c0") - 1).alias("start"), (F.col("e_start") + last - F.col("_c0") - 1).alias("end")
    )


def promoter_window(maps: DataFrame, rel_start: int, rel_end: int, end: str = "5prime") -> DataFrame:
    """Genome range of a window relative to an end of ``(t_start, t_end, strand)`` transcripts."""
    zero = 1 if rel_start * rel_end < 0 else 0
    minus = F.col("strand") == -1
    if end == "3prime":
        low, high = F.col("t_start"), F.col("t_end")
    else:
        low, high = F.col("t_end"), F.col("t_start")
    return maps.withColumn("w_start", F.when(minus, low - rel_end).otherwise(high + rel_start + zero)).withColumn(
        "w_end", F.when(minus, low - rel_start - zero).otherwise(high + rel_end)
    )


def transcription_start() -> Column:
    return F.when(F.col("strand") == -1, F.col("t_end")).otherwise(F.col("t_start"))


def first_mapping(mappings: DataFrame) -> DataFrame:
    """First genome mapping per accession, by arg-min."""
    others = [c for c in mappings.columns if c != "acc"]
    best = mappings.groupBy("acc").agg(F.min_by(F.struct(*others), F.struct("t_start", "map_id")).alias("m"))
    return best.select("acc", "m.*")


def fetch_sequence(ranges: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """Letters of ``(range_id, seq_id, start, end, strand)`` from chunks ``(seq_id, chunk_no, text)`` of ``size`` letters."""
    needed = ranges.withColumn(
        "chunk_no", F.explode(F.sequence(F.floor((F.col("start") - 1) / size), F.floor((F.col("end") - 1) / size)))
    )
    base = F.col("chunk_no") * size
    first = F.greatest(F.col("start") - base, F.lit(1)).cast("int")
    last = F.least(F.col("end") - base, F.lit(size)).cast("int")
    pieces = needed.join(chunks, ["seq_id", "chunk_no"]).select(
        "range_id", "strand", "chunk_no", F.substring(F.col("text"), first, last - first + 1).alias("piece")
    )
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "piece")))
    joined = pieces.groupBy("range_id", "strand").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("seq"))
    return joined.select("range_id", F.when(F.col("strand") == -1, revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))


def ortholog_pairs(genes: DataFrame, words: list[str], species1: str, species2: str, mode: str = "AND") -> DataFrame:
    """Genes whose description matches the words in both species, with how many entries did."""
    tests = [F.lower("description").contains(w.lower()) for w in words]
    found = genes.where(F.col("species").isin(species1, species2)).where(reduce(and_ if mode == "AND" else or_, tests))
    counts = found.groupBy("gene_id").agg(
        F.count(F.when(F.col("species") == species1, 1)).alias("n1"), F.count(F.when(F.col("species") == species2, 1)).alias("n2")
    )
    return counts.where("n1 > 0 AND n2 > 0")


def transcripts_per_gene(genes: DataFrame, mappings: DataFrame) -> DataFrame:
    """One row per accession of a gene with its first mapping and the gene's accession count."""
    sizes = genes.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n_transcripts"))
    return genes.select("gene_id", "acc").join(first_mapping(mappings), "acc", "left").join(sizes, "gene_id")
