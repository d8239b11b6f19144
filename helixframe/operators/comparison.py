"""Profile-to-profile comparison, score statistics and matching."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from helixframe.functions.metrics import METRICS, pcc
from helixframe.functions.special import normal_cdf_udf
from helixframe.operators import kernels
from helixframe.operators.ordered import desc, prefix_scan
from helixframe.operators.pairing import grid_pairs, unordered_pairs
from helixframe.operators.profiles import BASES, PSEUDO, total
from helixframe.session import task_count

# Length classes of the score statistics and the distance floor.
MIN_LEN, MAX_LEN = 5, 24
DISTANCE_FLOOR = 0.001

PAIR_SCHEMA = (
    "a string, b string, len1 int, len2 int, score double, forward boolean, i1 int, i2 int, "
    "span int, gaps int, path array<struct<i:int,j:int>>"
)


def pack(counts: DataFrame) -> DataFrame:
    """One row per matrix: counts ``n`` and pseudocount frequencies ``f``, four per column, in order."""
    whole = total() + PSEUDO
    columns = counts.select(
        "matrix_id",
        F.struct(
            "pos",
            F.array(*[F.col(b) for b in BASES]).alias("n"),
            F.array(*[(F.col(b) + PSEUDO * 0.25) / whole for b in BASES]).alias("f"),
        ).alias("c"),
    )
    ordered = columns.groupBy("matrix_id").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    return ordered.select(
        "matrix_id",
        F.size("cs").alias("width"),
        F.flatten(F.transform("cs", lambda c: c["n"])).alias("n"),
        F.flatten(F.transform("cs", lambda c: c["f"])).alias("f"),
    )


def pair_up(left: DataFrame, right: DataFrame | None = None, include_self: bool = True) -> DataFrame:
    """Packed profiles side by side.  Without ``right``, each unordered pair once."""
    if right is None:
        pairs = unordered_pairs(left.select("matrix_id", "n", "f"), "matrix_id", include_self)
        return pairs.select(
            F.col("lo.matrix_id").alias("a"), F.col("lo.n").alias("n1"), F.col("lo.f").alias("f1"),
            F.col("hi.matrix_id").alias("b"), F.col("hi.n").alias("n2"), F.col("hi.f").alias("f2"),
        )
    a = left.select(F.col("matrix_id").alias("a"), F.col("n").alias("n1"), F.col("f").alias("f1"))
    b = right.select(F.col("matrix_id").alias("b"), F.col("n").alias("n2"), F.col("f").alias("f2"))
    return grid_pairs(a, b, "a", "b")


def align_pairs(pairs: DataFrame, method: str = "ungapped", metric: str = "pcc", paths: bool = False, **options) -> DataFrame:
    """Alignment of every packed pair, as given and with the first profile reverse-complemented.

    The given orientation wins only with a higher score.
    """
    kernel = partial(_align_batches, method=method, metric=metric, paths=paths, options=options)
    return pairs.mapInPandas(kernel, PAIR_SCHEMA)


def _align_batches(batches: Iterator[pd.DataFrame], method, metric, paths, options) -> Iterator[pd.DataFrame]:
    for batch in batches:
        shapes = list(zip(batch["f1"].map(len) // 4, batch["f2"].map(len) // 4))
        groups: dict[tuple[int, int], list[int]] = {}
        for row, shape in enumerate(shapes):
            groups.setdefault(shape, []).append(row)
        parts = []
        for shape, rows in groups.items():
            # Small blocks keep the score tables of wide profiles in memory.
            block = max(1, 2_000_000 // (shape[0] * shape[1]))
            for at in range(0, len(rows), block):
                parts.append(_align_block(batch.iloc[rows[at:at + block]], *shape, method, metric, paths, options))
        if parts:
            yield pd.concat(parts, ignore_index=True)


def _align_block(rows: pd.DataFrame, w1, w2, method, metric, paths, options) -> pd.DataFrame:
    def stack(column, width):
        return np.stack(rows[column].to_numpy()).astype(float).reshape(len(rows), width, 4)

    one = {"n": stack("n1", w1), "f": stack("f1", w1)}
    two = {"n": stack("n2", w2), "f": stack("f2", w2)}
    def flip(profile):
        return {k: v[:, ::-1, ::-1] for k, v in profile.items()}

    # The library scanner turns the second profile, the other methods the first.
    turned = (one, flip(two)) if method == "scan" else (flip(one), two)
    align = kernels.METHODS[method]
    as_given = align(kernels.units(METRICS[metric](one, two)), **options)
    reverse = align(kernels.units(METRICS[metric](*turned)), **options)
    forward = as_given[0] > reverse[0]
    score, end_i, end_j = (np.where(forward, x, y) for x, y in zip(as_given[:3], reverse[:3]))
    steps = np.where(forward[:, None, None], as_given[3], reverse[3])
    seen_i, seen_j = kernels.walk(end_i, end_j, steps)
    far = 1 << 30
    return pd.DataFrame({
        "a": rows["a"].to_numpy(),
        "b": rows["b"].to_numpy(),
        "len1": np.int32(w1),
        "len2": np.int32(w2),
        "score": score / kernels.UNIT,
        "forward": forward,
        "i1": np.where(seen_i > 0, seen_i, far).min(axis=1, initial=far) % far,
        "i2": np.where(seen_j > 0, seen_j, far).min(axis=1, initial=far) % far,
        "span": (seen_i >= 0).sum(axis=1),
        "gaps": ((seen_i == 0) | (seen_j == 0)).sum(axis=1),
        "path": [_path(i, j) if paths else None for i, j in zip(seen_i, seen_j)],
    })


def _path(i: np.ndarray, j: np.ndarray) -> list[dict[str, int]]:
    return [{"i": int(x), "j": int(y)} for x, y in zip(i[::-1], j[::-1]) if x >= 0]


def mirror(pairs: DataFrame) -> DataFrame:
    """Adds the swapped row of every pair ``(a, b, len1, len2, score)``; a self pair stays single."""
    swapped = pairs.where("a <> b").select(
        F.col("b").alias("a"), F.col("a").alias("b"), F.col("len2").alias("len1"), F.col("len1").alias("len2"), "score"
    )
    return pairs.select("a", "b", "len1", "len2", "score").unionByName(swapped)


def clamp_length(column: Column) -> Column:
    return F.greatest(F.least(column, F.lit(MAX_LEN)), F.lit(MIN_LEN)).cast("int")


def score_distribution(pairs: DataFrame) -> DataFrame:
    """Score statistics per clamped pair of lengths, from pairs of distinct profiles, both orders."""
    both = F.array(F.struct(F.col("len1").alias("x"), F.col("len2").alias("y")),
                   F.struct(F.col("len2").alias("x"), F.col("len1").alias("y")))
    seen = pairs.where("a <> b").select("score", F.inline(both))
    return seen.groupBy(clamp_length(F.col("x")).alias("len1"), clamp_length(F.col("y")).alias("len2")).agg(
        F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("sd"),
        F.count(F.lit(1)).alias("n"),
        F.min("score").alias("min"),
        F.max("score").alias("max"),
    )


def with_z(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Adds ``z``; a standard deviation of 0 counts as 1 and an unseen length pair has mean 0.

    The statistics table has at most one row per pair of length classes, 20 x 20.
    """
    stats = table.select(
        F.col("len1").alias("_x"), F.col("len2").alias("_y"), "mean",
        F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0).alias("sd"), F.col("min").alias("low"),
    )
    joined = pairs.join(
        F.broadcast(stats),
        (clamp_length(F.col("len1")) == F.col("_x")) & (clamp_length(F.col("len2")) == F.col("_y")),
        "left",
    )
    filled = joined.fillna({"mean": 0.0, "sd": 1.0, "low": 0.0})
    return filled.withColumn("z", (F.col("score") - F.col("mean")) / F.col("sd")).drop("_x", "_y")


def with_p(scored: DataFrame) -> DataFrame:
    return scored.withColumn("p", normal_cdf_udf("z"))


def transform_distance(score: Column, low: Column, high: Column) -> Column:
    """``-ln`` of the score's place between ``low`` and ``high``; ``-ln 0.001`` at or below ``low``."""
    share = F.coalesce(F.try_divide(score - low, high - low), F.lit(1.0))
    return -F.log(F.when(share <= 0, DISTANCE_FLOOR).otherwise(share))


def top_matches(scored: DataFrame, k: int = 5) -> DataFrame:
    """Best ``k`` library entries per query by ``z``; the earlier entry wins ties."""
    order = W.partitionBy("a").orderBy(F.col("z").desc(), F.col("b"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(scored: DataFrame, value: str = "score") -> DataFrame:
    """The best ``b`` of every ``a``, by arg-max; the smaller ``b`` wins ties."""
    best = scored.groupBy("a").agg(F.min_by(F.struct("b", value), F.struct(-F.col(value), F.col("b"))).alias("m"))
    return best.select("a", "m.*")


def family_accuracy(scored: DataFrame, family: DataFrame) -> DataFrame:
    """Share of profiles whose best other match has their family, and the mean score of those."""
    best = nearest(scored.where("a <> b"))
    of = family.select("matrix_id", "family")
    judged = best.join(of.toDF("a", "fa"), "a").join(of.toDF("b", "fb"), "b")
    same = F.col("fa") == F.col("fb")
    return judged.agg(F.avg(same.cast("int")).alias("accuracy"), F.avg(F.when(same, F.col("score"))).alias("mean_score"))


def fp_curve(scored: DataFrame, window: int) -> DataFrame:
    """Running true and false positives by falling score, the false share in percent and its moving average.

    The moving average reads the running sum ``window`` rows back through a join
    on the row number, so no task needs the whole ordering.
    """
    hits = scored.withColumn("_tp", F.col("label").cast("bigint"))
    ranked = prefix_scan(hits, [], [desc("score"), F.col("id")], keep_range=True, rn=("rank", None), tp=("sum", "_tp"))
    curve = ranked.withColumn("fp", F.col("rn") - F.col("tp")).withColumn("fp_rate", F.col("fp") / F.col("rn") * 100)
    summed = prefix_scan(curve, [], [F.col("rn")], _s=("sum", "fp_rate"))
    back = summed.select((F.col("rn") + window + 1).alias("rn"), F.col("_s").alias("_b"))
    smooth = (F.col("_s") - F.coalesce("_b", F.lit(0.0))) / F.least(F.col("rn"), F.lit(window + 1))
    return summed.join(back, "rn", "left").withColumn("smooth", smooth).drop("_s", "_b", "_tp")


def first_past(curve: DataFrame, levels=(0.1, 0.5, 1.0, 5.0, 10.0)) -> DataFrame:
    """First row and its true positives at which the false share passes each level."""
    wanted = F.array(*[F.lit(x) for x in levels])
    passed = curve.select("rn", "tp", "fp_rate", F.explode(wanted).alias("level")).where(F.col("fp_rate") > F.col("level"))
    return passed.groupBy("level").agg(F.min("rn").alias("rn"), F.min_by("tp", "rn").alias("tp"))


def weighted_profile(columns: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Normalised weighted mean of aligned columns ``(cluster, pos, a, c, g, t, weight)``."""
    sums = columns.groupBy(cluster, "pos").agg(
        *[F.sum(F.col(b) * F.col("weight")).alias(b) for b in BASES]
    )
    return sums.select(cluster, "pos", *[(F.col(b) / total()).alias(b) for b in BASES])


def update_profiles(profiles: DataFrame, members: DataFrame, siblings: DataFrame) -> DataFrame:
    """New cluster profile from the old one, its members and the members of its sibling cluster.

    Fixed values: the old profile counts 1, a member 0.1, a sibling's member 0.1 / 8.
    """
    columns = ["cluster", "pos", *BASES]
    old = profiles.select(*columns, F.lit(1.0).alias("weight"))
    own = members.select(*columns, F.lit(0.1).alias("weight"))
    near = members.join(siblings, "cluster").select(
        F.col("sibling").alias("cluster"), "pos", *BASES, F.lit(0.1 / 8).alias("weight")
    )
    return weighted_profile(old.unionByName(own).unionByName(near))


def assign_nearest(profile: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cluster profile with the highest mean column correlation per matrix, on aligned positions.

    Columns meet on their position, so only columns that overlap are compared.
    Few positions are there to join on, so the matrices are dealt into lanes and
    the cluster profiles repeated in each.
    """
    lanes = task_count(profile.sparkSession)
    lane = F.pmod(F.xxhash64("matrix_id"), F.lit(lanes)).cast("int")
    mine = profile.select("matrix_id", "pos", lane.alias("_lane"), *[F.col(b).alias(f"m_{b}") for b in BASES])
    every = clusters.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    scored = mine.join(every, ["pos", "_lane"]).select(
        "matrix_id", "cluster",
        F.round(pcc([F.col(f"m_{b}") for b in BASES], [F.col(b) for b in BASES]), 9).alias("s"),
    )
    means = scored.groupBy("matrix_id", "cluster").agg(F.avg("s").alias("score"))
    best = F.max_by(F.struct("cluster", "score"), F.struct(F.round("score", 9), -F.col("cluster")))
    return means.groupBy("matrix_id").agg(best.alias("m")).select("matrix_id", "m.*")


def column_histogram(frequencies: DataFrame, interval: float) -> DataFrame:
    """Histogram of the correlation of every column with every other one, ends clamped at -3 and 3.

    Equal columns are folded into one weighted row before pairing.
    """
    folded = frequencies.groupBy(*[F.round(b, 12).alias(b) for b in BASES]).agg(F.count(F.lit(1)).alias("m"))
    ids = F.xxhash64(*BASES)
    left = folded.select(ids.alias("x"), F.struct(*BASES, "m").alias("l"))
    right = folded.select(ids.alias("y"), F.struct(*BASES, "m").alias("r"))
    pairs = grid_pairs(left, right, "x", "y")
    same = reduce(and_, [F.col("l")[b] == F.col("r")[b] for b in BASES])
    score = F.round(pcc([F.col("l")[b] for b in BASES], [F.col("r")[b] for b in BASES]), 9)
    last = int(6 / interval)
    slot = F.greatest(F.least(F.floor((score + 3) / interval), F.lit(last)), F.lit(0)).cast("int")
    weight = F.col("l.m") * F.when(same, F.col("r.m") - 1).otherwise(F.col("r.m"))
    counted = pairs.groupBy(slot.alias("bin")).agg(F.sum(weight).alias("n"))
    return counted.where("n > 0")


def path_strings(aligned: DataFrame, given: DataFrame, turned: DataFrame) -> DataFrame:
    """Adds the consensus letters of both sides along the path, ``-`` in gaps."""
    text = given.toDF("a", "_given").join(turned.toDF("a", "_turned"), "a")
    other = given.toDF("b", "_other")
    rows = aligned.join(text, "a").join(other, "b").withColumn("_one", F.when(F.col("forward"), F.col("_given")).otherwise(F.col("_turned")))

    def letters(source: str, side: str) -> Column:
        return F.array_join(
            F.transform("path", lambda c: F.when(c[side] == 0, "-").otherwise(F.substring(F.col(source), c[side], F.lit(1)))), ""
        )

    return rows.withColumn("row1", letters("_one", "i")).withColumn("row2", letters("_other", "j")).drop(
        "_given", "_turned", "_other", "_one"
    )


def grid_view(scored: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Name by name grid of E values, ``-`` on the diagonal.  ``names`` fixes the columns."""
    text = F.when(F.col("a") == F.col("b"), "-").otherwise(F.format_string("%.4f", F.round(1 - F.col("p"), 4)))
    cells = scored.select("a", "b", text.alias("e"))
    grouped = cells.groupBy("a")
    return (grouped.pivot("b", names) if names else grouped.pivot("b")).agg(F.max("e"))
