"""Profile (count matrix) operators.

The working form is wide: one row per matrix column with the four counts
``a, c, g, t``.  It takes one aggregation from the long cell table, and almost
every operator is then a projection over that row.  A matrix has at most a few
hundred columns, so per-matrix windows are small by construction.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from helixframe.operators.ordered import rank_rows

BASES = ("a", "c", "g", "t")
UNIFORM = (0.25, 0.25, 0.25, 0.25)
# Pseudocount weight, count scale, edge-information threshold and
# consensus shares of the profile toolkit.
PSEUDO = 0.001
COUNT_SCALE = 30
MIN_INFO = 0.4
SINGLE_SHARE, DOUBLE_SHARE = 0.6, 0.8


def total(columns=BASES) -> Column:
    return reduce(add, [F.col(c) for c in columns])


def wide(cells: DataFrame, key: str = "matrix_id", value: str = "n") -> DataFrame:
    """Long cells to one row per matrix column; absent cells are 0."""
    picks = [
        F.coalesce(F.sum(F.when(F.col("base") == b.upper(), F.col(value))), F.lit(0.0)).alias(b) for b in BASES
    ]
    return cells.groupBy(key, "pos").agg(*picks)


def long(profile: DataFrame, value: str = "n", extra: tuple[str, ...] = ()) -> DataFrame:
    """Wide rows to one row per cell."""
    cells = F.array(*[F.struct(F.lit(b.upper()).alias("base"), F.col(b).alias(value)) for b in BASES])
    return profile.select("matrix_id", "pos", *extra, F.inline(cells))


def normalise(counts: DataFrame) -> DataFrame:
    whole = total()
    return counts.select("matrix_id", "pos", *[(F.col(b) / whole).alias(b) for b in BASES])


def pseudo_frequencies(counts: DataFrame, background=UNIFORM, weight: float = PSEUDO) -> DataFrame:
    """``(n + weight * background) / (total + weight)``."""
    whole = total() + weight
    return counts.select(
        "matrix_id", "pos", *[((F.col(b) + weight * p) / whole).alias(b) for b, p in zip(BASES, background)]
    )


def log_odds(frequencies: DataFrame, background=UNIFORM) -> DataFrame:
    return frequencies.select(
        "matrix_id", "pos", *[F.log2(F.col(b) / p).alias(b) for b, p in zip(BASES, background)]
    )


def scan_pwm(counts: DataFrame, background=UNIFORM) -> DataFrame:
    """Log-odds for sequence scanning, with a pseudocount of ``sqrt(total)`` per column.

    The small weight of ``pseudo_frequencies`` would put one unseen base some 17
    bits down and make every relative threshold meaningless.
    """
    whole = total()
    root = F.sqrt(whole)
    return counts.select(
        "matrix_id", "pos", *[F.log2((F.col(b) + root * p) / (whole + root) / p).alias(b) for b, p in zip(BASES, background)]
    )


def counts_of(frequencies: DataFrame, scale: int = COUNT_SCALE) -> DataFrame:
    return frequencies.select(
        "matrix_id", "pos", *[F.floor(F.col(b) * scale).cast("double").alias(b) for b in BASES]
    )


def information(columns=BASES, letters: float = 4.0) -> Column:
    """Column information ``log2(letters) + sum f log2 f`` for frequency columns."""
    terms = [F.when(F.col(c) > 0, F.col(c) * F.log2(c)).otherwise(0.0) for c in columns]
    return F.log2(F.lit(float(letters))) + reduce(add, terms)


def column_ic(counts: DataFrame) -> DataFrame:
    return normalise(counts).select("matrix_id", "pos", information().alias("ic"))


def total_ic(counts: DataFrame) -> DataFrame:
    return column_ic(counts).groupBy("matrix_id").agg(F.sum("ic").alias("total_ic"))


def consensus_letter(columns=BASES) -> Column:
    """One consensus letter from four shares: a single base, else a two-base code, else N.

    Among two-base codes with the same share, the later of Y R W S K M is taken.
    """
    a, c, g, t = [F.col(x) for x in columns]
    letter = F.lit("N")
    for code, pair in (("Y", c + t), ("R", a + g), ("W", a + t), ("S", c + g), ("K", g + t), ("M", a + c)):
        rivals = F.greatest(c + t, a + g, a + t, c + g, g + t, a + c)
        letter = F.when((pair >= DOUBLE_SHARE) & (pair >= rivals), code).otherwise(letter)
    single = (
        F.when(a >= SINGLE_SHARE, "A")
        .when(c >= SINGLE_SHARE, "C")
        .when(g >= SINGLE_SHARE, "G")
        .when(t >= SINGLE_SHARE, "T")
    )
    return F.coalesce(single, letter)


def consensus(counts: DataFrame, digits: int = 12) -> DataFrame:
    """Consensus string per matrix; a ``gap`` column, when present, lowers the letter."""
    shares = counts.select(
        "*", *[F.round(F.col(b) / total(), digits).alias(f"_{b}") for b in BASES]
    ).withColumn("letter", consensus_letter([f"_{b}" for b in BASES]))
    if "gap" in counts.columns:
        shares = shares.withColumn("letter", F.when(F.col("gap") > 0, F.lower("letter")).otherwise(F.col("letter")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "letter")))
    return shares.groupBy("matrix_id").agg(F.array_join(F.transform(ordered, lambda x: x["letter"]), "").alias("consensus"))


def reverse_complement(profile: DataFrame) -> DataFrame:
    width = F.max("pos").over(W.partitionBy("matrix_id"))
    return profile.select(
        "matrix_id",
        (width + 1 - F.col("pos")).cast("int").alias("pos"),
        F.col("t").alias("a"),
        F.col("g").alias("c"),
        F.col("c").alias("g"),
        F.col("a").alias("t"),
    )


def score_range(pwm: DataFrame) -> DataFrame:
    """Lowest and highest attainable score of a log-odds matrix."""
    return pwm.groupBy("matrix_id").agg(
        F.sum(F.least(*BASES)).alias("min_score"), F.sum(F.greatest(*BASES)).alias("max_score")
    )


def relative_score(score: Column, low: Column, high: Column) -> Column:
    """Percent of the attainable range, rounded half up."""
    return F.floor((score - low) / (high - low) * 100 + 0.5).cast("int")


def concat_matrices(profile: DataFrame, order: DataFrame) -> DataFrame:
    """All columns laid end to end in the order given by ``order(matrix_id, sel_order)``."""
    placed = profile.join(order, "matrix_id")
    return rank_rows(placed, [], [F.col("sel_order"), F.col("pos")], "new_pos").withColumn(
        "new_pos", (F.col("new_pos") - 1).cast("int")
    )


def _draw(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("matrix_id"), F.col("pos").cast("string")))


def permute_within(profile: DataFrame, seed: int) -> DataFrame:
    """Column order of each matrix reshuffled by a seeded hash."""
    slot = F.row_number().over(W.partitionBy("matrix_id").orderBy(_draw(seed), "pos"))
    return profile.select("matrix_id", slot.cast("int").alias("pos"), *BASES)


def permute_across(profile: DataFrame, seed: int) -> DataFrame:
    """Columns dealt out again over all matrices; every matrix keeps its width."""
    slots = rank_rows(profile.select("matrix_id", "pos"), [], [F.col("matrix_id"), F.col("pos")])
    drawn = rank_rows(profile.select(_draw(seed).alias("_h"), *BASES, "matrix_id", "pos"), [],
                      [F.col("_h"), F.col("matrix_id"), F.col("pos")])
    return slots.join(drawn.select("rn", *BASES), "rn").select("matrix_id", "pos", *BASES)


def trim_edges(counts: DataFrame, min_len: int) -> DataFrame:
    """Matrix columns left after stripping weak columns outside the best window.

    The window is the first of ``min_len`` columns with the highest summed
    information (window starts run to ``width - min_len - 1``).  Columns left and
    right of it go while they are contiguous from the edge and carry less than
    0.4 bits, or are gapped in more than half of the members.
    """
    per = W.partitionBy("matrix_id")
    by_pos = per.orderBy("pos")
    gapped = F.col("gap") > F.floor(F.col("members") / 2) if "gap" in counts.columns else F.lit(False)
    ic = F.round(_ic_from_counts(), 9)
    marked = (
        counts.withColumn("_ic", ic)
        .withColumn("_weak", ((F.col("_ic") < MIN_INFO) | gapped).cast("int"))
        .withColumn("_w", F.max("pos").over(per))
        .withColumn("_win", F.round(F.sum("_ic").over(by_pos.rowsBetween(0, min_len - 1)), 9))
        .withColumn("_win", F.when((F.col("pos") <= F.col("_w") - min_len) & (F.col("_win") > 0), F.col("_win")))
    )
    best = F.max_by("pos", F.struct(F.col("_win"), -F.col("pos"))).over(per)
    has = F.max("_win").over(per).isNotNull()
    whole = F.col("_w") <= min_len
    bounds = marked.withColumn("_first", F.when(whole | ~has, F.lit(1)).otherwise(best)).withColumn(
        "_stop", F.when(whole, F.col("_w") + 1).when(~has, F.col("_w")).otherwise(best + min_len)
    )
    left_run = F.min("_weak").over(by_pos.rowsBetween(W.unboundedPreceding, 0))
    right_run = F.min("_weak").over(by_pos.rowsBetween(0, W.unboundedFollowing))
    drop = ((F.col("pos") < F.col("_first")) & (left_run == 1)) | ((F.col("pos") >= F.col("_stop")) & (right_run == 1))
    return bounds.withColumn("_drop", drop).where(~F.col("_drop")).select(*counts.columns)


def _ic_from_counts() -> Column:
    whole = total()
    terms = [F.when(F.col(b) > 0, F.col(b) / whole * F.log2(F.col(b) / whole)).otherwise(0.0) for b in BASES]
    return F.lit(2.0) + reduce(add, terms)


# Histogram edges of the fitting statistics.
WIDTH_EDGES = (3, 5, 8, 10, 12, 14, 16, 25)
DEPTH_EDGES = (0, 5, 10, 20, 40, 80, 160, 1000)


def edge_bin(value: Column, edges) -> Column:
    """Lower edge of the bin ``[edge, next edge)``; null outside all bins."""
    chosen = F.lit(None).cast("int")
    for edge in edges[:-1]:
        chosen = F.when(value >= edge, edge).otherwise(chosen)
    return F.when(value < edges[-1], chosen)


def width_histogram(counts: DataFrame) -> DataFrame:
    widths = counts.groupBy("matrix_id").agg(F.max("pos").alias("w"))
    binned = widths.select(edge_bin(F.col("w"), WIDTH_EDGES).alias("bin")).where("bin IS NOT NULL")
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def depth_histogram(counts: DataFrame) -> DataFrame:
    """Column totals in coarse bins and in unit bins 0..50, and the average depth of a matrix."""
    depth = counts.select("matrix_id", total().alias("depth"))
    coarse = edge_bin(F.col("depth"), DEPTH_EDGES)
    unit = F.least(F.floor("depth"), F.lit(50)).cast("int")
    kinds = F.array(
        F.struct(F.lit("coarse").alias("kind"), coarse.alias("bin")), F.struct(F.lit("unit").alias("kind"), unit.alias("bin"))
    )
    counted = (
        depth.select(F.inline(kinds)).where("bin IS NOT NULL").groupBy("kind", "bin").agg(F.count(F.lit(1)).cast("double").alias("value"))
    )
    per_matrix = depth.groupBy("matrix_id").agg(F.avg("depth").alias("depth"))
    average = per_matrix.agg(F.avg("depth").alias("value")).select(
        F.lit("average").alias("kind"), F.lit(None).cast("int").alias("bin"), "value"
    )
    return counted.unionByName(average)


def edge_class(counts: DataFrame) -> DataFrame:
    """Each column with its distance class from the nearer edge, 0..5."""
    width = F.max("pos").over(W.partitionBy("matrix_id"))
    return counts.withColumn("edge_class", F.least(F.col("pos") - 1, width - F.col("pos"), F.lit(5)).cast("int"))


def edge_class_stats(counts: DataFrame) -> DataFrame:
    """Per edge class: share of invariant columns and share of zero cells in the others."""
    zeros = reduce(add, [(F.col(b) == 0).cast("int") for b in BASES])
    flagged = edge_class(counts).withColumn("_z", zeros).withColumn("_inv", (zeros == 3).cast("double"))
    return flagged.groupBy("edge_class").agg(
        F.avg("_inv").alias("invariant_share"),
        F.try_divide(F.sum(F.when(F.col("_inv") == 0, F.col("_z"))).cast("double"), F.sum(1 - F.col("_inv")) * 4).alias("zero_share"),
    )


def conditional_cells(counts: DataFrame, bins: int = 5) -> DataFrame:
    """Histogram of non-zero cell shares given the summed share of the cells drawn before.

    ``drawn`` is how many cells came before (0, 1 or 2); every ordered choice of
    distinct cells contributes, invariant columns do not.
    """
    low, high = 0.0001, 0.99999  # fixed values: histogram range
    whole = total()
    none = F.lit(0.0)
    draws = [(0, none, k) for k in BASES]
    draws += [(1, F.col(k), m) for k in BASES for m in BASES if k != m]
    draws += [(2, F.col(k) + F.col(n), m) for k in BASES for n in BASES for m in BASES if len({k, n, m}) == 3]
    structs = [
        F.struct(F.lit(d).alias("drawn"), (g / whole).alias("given"), (F.col(m) / whole).alias("share"))
        for d, g, m in draws
    ]
    zeros = reduce(add, [(F.col(b) == 0).cast("int") for b in BASES])
    edge = F.when(F.col("edge_class") == 0, "edge").otherwise("inner")
    return (
        edge_class(counts)
        .where(zeros < 3)
        .select(edge.alias("place"), F.inline(F.array(*structs)))
        .where((F.col("share") >= low) & (F.col("share") < high))
        .groupBy(
            "place",
            "drawn",
            F.floor(F.col("given") * bins).cast("int").alias("given_bin"),
            F.floor((F.col("share") - low) / ((high - low) / bins)).cast("int").alias("share_bin"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def min_ic_filter(totals: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Matrices whose total information reaches ``threshold`` bits."""
    return totals.where(F.col("total_ic") >= threshold)


def profile_from_aligned(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Residue frequency per position, within the group and over all rows.

    ``text`` holds aligned strings of one length per group.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    whole = rows.agg(F.count(F.lit(1)).alias("_whole"))
    cells = (
        rows.select(key, F.posexplode(F.split(text, "")).alias("_p", "base"))
        .groupBy(key, (F.col("_p") + 1).alias("pos"), "base")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return cells.join(sizes, key).select(
        key, "pos", "base", (F.col("_n") / F.col("_size")).alias("freq"), (F.col("_n") / whole.scalar()).alias("freq_overall")
    )


def residue_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Long residue counts of aligned protein rows."""
    return (
        rows.where(F.length(text) > 0)
        .select(key, F.posexplode(F.split(text, "")).alias("_p", "res"))
        .groupBy(key, (F.col("_p") + 1).alias("pos"), "res")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )


def residue_information(residues: DataFrame, key: str) -> DataFrame:
    """``log2 20 + sum f log2 f`` per position, from sums alone: no window is needed."""
    logs = residues.groupBy(key, "pos").agg(F.sum("n").alias("w"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return logs.select(key, "pos", (F.log2(F.lit(20.0)) + F.col("s") / F.col("w") - F.log2("w")).alias("ic"))
