"""Clustering by merge rounds, trees, merged profiles and mutual information."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from helixframe.functions.metrics import pcc
from helixframe.operators.profiles import BASES, MIN_INFO, information, total
from helixframe.session import cut_lineage, task_count

CORE_COLUMNS, EDGE_WINDOW = 6, 4  # fixed values: shortest familial profile, protected window
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


def upgma(distances: DataFrame) -> DataFrame:
    """Average-linkage merges of every group of ``(grp, a, b, d)``, one row per unordered pair.

    All pairs that are each other's nearest neighbour merge in the same round;
    average linkage never makes a merged pair closer to a third node, so this
    gives the tree of one-at-a-time merging up to ties.  Each round is a few
    joins over the shrinking pair table, written to shared storage.
    Result: ``(grp, step, node, left, right, height, members, newick)``.
    """
    pairs = cut_lineage(distances.select("grp", "a", "b", F.col("d").cast("double").alias("d")))
    names = pairs.select("grp", F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = cut_lineage(
        names.select("grp", "node", F.lit(1).cast("bigint").alias("members"), F.lit(0.0).alias("height"), F.col("node").alias("newick"))
    )
    merged: list[DataFrame] = []
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select("grp", F.col("b").alias("a"), F.col("a").alias("b"), "d"))
        nearest = both.groupBy("grp", "a").agg(F.min(F.struct(F.round("d", 9).alias("r"), "b", "d")).alias("m"))
        best = nearest.select("grp", "a", F.col("m.b").alias("b"), F.col("m.d").alias("d"))
        mutual = best.join(best.select("grp", F.col("a").alias("b"), F.col("b").alias("a")), ["grp", "a", "b"]).where("a < b")
        left = nodes.select("grp", F.col("node").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("members", "height", "newick")])
        right = nodes.select("grp", F.col("node").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("members", "height", "newick")])
        height = F.col("d") / 2
        joined = cut_lineage(
            mutual.join(left, ["grp", "a"]).join(right, ["grp", "b"]).select(
                "grp",
                F.concat(F.lit(f"n{len(merged) + 1}_"), "a").alias("node"),
                F.col("a").alias("left"),
                F.col("b").alias("right"),
                height.alias("height"),
                (F.col("a_members") + F.col("b_members")).alias("members"),
                F.format_string(
                    "(%s:%.6f,%s:%.6f)", "a_newick", height - F.col("a_height"), "b_newick", height - F.col("b_height")
                ).alias("newick"),
            )
        )
        merged.append(joined.select("*", F.lit(len(merged) + 1).alias("round")))
        gone = joined.select("grp", "node", F.explode(F.array("left", "right")).alias("old"))
        named = nodes.select("grp", F.col("node").alias("old"), "members").join(gone, ["grp", "old"], "left").select(
            "grp", "old", F.coalesce("node", "old").alias("new"), "members"
        )
        x = named.toDF("grp", "a", "x", "nx")
        y = named.toDF("grp", "b", "y", "ny")
        weight = F.col("nx") * F.col("ny")
        moved = pairs.join(x, ["grp", "a"]).join(y, ["grp", "b"]).where("x <> y")
        pairs = cut_lineage(
            moved.groupBy("grp", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(
                (F.sum(F.col("d") * weight) / F.sum(weight)).alias("d")
            )
        )
        kept = nodes.join(gone.select("grp", F.col("old").alias("node")), ["grp", "node"], "left_anti")
        nodes = cut_lineage(kept.unionByName(joined.select(*nodes.columns)))
    if not merged:  # no pairs, no merges
        return distances.select("grp").limit(0).select(
            "grp", F.lit(0).alias("step"), *[F.lit("").alias(c) for c in ("node", "left", "right")],
            F.lit(0.0).alias("height"), F.lit(0).cast("bigint").alias("members"), F.lit("").alias("newick"),
        )
    everything = reduce(DataFrame.unionByName, merged)
    step = F.row_number().over(W.partitionBy("grp").orderBy("height", "round", "node"))
    return everything.withColumn("step", step).drop("round")


def newick(merges: DataFrame) -> DataFrame:
    """Text of the finished tree of each group."""
    return merges.groupBy("grp").agg(F.concat(F.max_by("newick", F.struct("members", "height")), F.lit(";")).alias("tree"))


def leaf_closure(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All ``(node, leaf)`` pairs of ``(node, child)`` edges, a leaf under itself included.

    Ancestor links double in length each round, so the rounds grow with the
    logarithm of the depth.
    """
    keys = list(keys)
    parents = edges.select(*keys, F.col("child").alias("x"), F.col("node").alias("up"))
    tops = edges.select(*keys, F.col("node").alias("x")).distinct()
    leaves = parents.join(tops, [*keys, "x"], "left_anti").select(*keys, F.col("x").alias("leaf"))
    jump = cut_lineage(parents)
    found = cut_lineage(leaves.select(*keys, F.col("leaf").alias("x"), "leaf"))
    while not jump.isEmpty():
        higher = found.join(jump, [*keys, "x"]).select(*keys, F.col("up").alias("x"), "leaf")
        found = cut_lineage(found.unionByName(higher))
        further = jump.select(*keys, F.col("x").alias("up"), F.col("up").alias("top"))
        jump = cut_lineage(
            jump.join(further, [*keys, "up"]).select(*keys, "x", F.col("top").alias("up"))
        )
    return found.select(*keys, F.col("x").alias("node"), "leaf")


def cut_tree(merges: DataFrame, closure: DataFrame, cuts: Sequence[tuple[int, Column]]) -> DataFrame:
    """Cluster of every leaf when the tree is cut into ``k`` clusters.

    ``merges(node, step)`` counts steps from 1; a cut at ``k`` undoes the last
    ``k - 1`` of them, so the cluster is the last ancestor merged before that.
    ``cuts`` lists the wanted cuts as ``(k, last step)``.  An ancestor holds its
    leaf from its own step until the next ancestor's, so every cut picks one row.
    """
    placed = closure.join(merges.select("node", "step"), "node", "left").withColumn("step", F.coalesce("step", F.lit(0)))
    spans = placed.withColumn("_next", F.lead("step").over(W.partitionBy("leaf").orderBy("step")))
    spans = spans.withColumns({f"_c{k}": last for k, last in cuts})
    picked = F.array(*[
        F.when((F.col("step") <= F.col(f"_c{k}")) & (F.col("_next").isNull() | (F.col("_next") > F.col(f"_c{k}"))), F.lit(k))
        for k, _ in cuts
    ])
    return spans.select("leaf", F.col("node").alias("cluster"), F.explode(picked).alias("k")).where("k IS NOT NULL").select("k", "leaf", "cluster")


def calinski_harabasz(membership: DataFrame, distances: DataFrame) -> DataFrame:
    """Log variant of the index per cut: ``(ln B / (k - 1)) / (ln W / (n - k))``.

    W sums ``d(a, b) * d(b, a)`` over the unordered pairs inside clusters, B the
    squared mean distances over the unordered pairs of clusters.
    ``distances(a, b, d)`` holds both orders.
    """
    n = membership.select("leaf").distinct().agg(F.count(F.lit(1)))
    ca = membership.select("k", F.col("leaf").alias("a"), F.col("cluster").alias("ca"))
    cb = membership.select("k", F.col("leaf").alias("b"), F.col("cluster").alias("cb"))
    back = distances.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("d").alias("r"))
    pairs = distances.where("a < b").join(back, ["a", "b"]).join(ca, "a").join(cb, ["k", "b"])
    by_clusters = pairs.groupBy("k", F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(
        F.sum(F.col("d") * F.col("r")).alias("w"), F.avg((F.col("d") + F.col("r")) / 2).alias("m")
    )
    inside = F.col("x") == F.col("y")
    sums = by_clusters.groupBy("k").agg(
        F.sum(F.when(inside, F.col("w"))).alias("w"), F.sum(F.when(~inside, F.col("m") * F.col("m"))).alias("b")
    )
    size = n.scalar()
    usable = sums.where((F.col("k") > 1) & (F.col("k") < size))
    return usable.select("k", ((F.log("b") / (F.col("k") - 1)) / (F.log("w") / (size - F.col("k")))).alias("ch"))


def optimal_clusters(index: DataFrame) -> DataFrame:
    return index.agg(F.max_by("k", F.struct("ch", -F.col("k"))).alias("k"), F.max("ch").alias("ch"))


def homogeneity(labelled: DataFrame) -> DataFrame:
    """Per cluster of ``(cluster, family)`` rows: share of ordered member pairs of one family, and the mean over clusters."""
    sizes = labelled.groupBy("cluster", "family").agg(F.count(F.lit(1)).alias("n"))
    per = sizes.groupBy("cluster").agg(
        (F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n").cast("double"), F.lit(2.0))).alias("homogeneity"),
        F.sum("n").alias("members"),
    )
    return per.withColumn("mean_homogeneity", per.agg(F.avg("homogeneity")).scalar())


def internal_similarity(membership: DataFrame, scored: DataFrame) -> DataFrame:
    """Mean over the members of a cluster of their mean ``p`` to its members, a member's own counting 1."""
    a = membership.select("cluster", F.col("matrix_id").alias("a"))
    b = membership.select("cluster", F.col("matrix_id").alias("b"))
    inside = scored.join(a, "a").join(b, ["cluster", "b"])
    own = inside.withColumn("p", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.col("p")))
    means = own.groupBy("cluster", "a").agg(F.avg("p").alias("m"))
    return means.groupBy("cluster").agg(F.avg("m").alias("similarity"), F.count(F.lit(1)).alias("members"))


def leave_one_out(members: DataFrame) -> DataFrame:
    """For each member, the cluster profile that correlates best with it when it is left out of its own.

    ``members(matrix_id, cluster, pos, a, c, g, t)`` are aligned.  Leaving out is
    subtraction from the cluster sums.  Clusters of one member take part only as
    rivals.  Result: ``(matrix_id, cluster, predicted)``.
    """
    sums = members.groupBy("cluster", "pos").agg(*[F.sum(b).alias(f"s_{b}") for b in BASES], F.count(F.lit(1)).alias("n"))
    sizes = members.select("matrix_id", "cluster").distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    tested = members.join(sizes, "cluster").where("size > 1").drop("size")
    # Few positions are there to join on, so the members are dealt into lanes and the profiles repeated in each.
    lanes = task_count(members.sparkSession)
    dealt = tested.withColumn("_lane", F.pmod(F.xxhash64("matrix_id"), F.lit(lanes)).cast("int"))
    rivals = sums.withColumnRenamed("cluster", "rival").withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    met = dealt.join(rivals, ["pos", "_lane"])
    own = F.col("rival") == F.col("cluster")
    left = [F.when(own, F.col(f"s_{b}") - F.col(b)).otherwise(F.col(f"s_{b}")).alias(f"r_{b}") for b in BASES]
    present = F.col("n") - F.when(own, 1).otherwise(0)
    columns = met.where(present > 0).select("matrix_id", "cluster", "rival", *BASES, *left)
    whole = reduce(add, [F.col(f"r_{b}") for b in BASES])
    score = F.round(pcc([F.col(b) for b in BASES], [F.col(f"r_{b}") / whole for b in BASES]), 9)
    means = columns.groupBy("matrix_id", "cluster", "rival").agg(F.avg(score).alias("s"))
    best = F.max_by("rival", F.struct(F.round("s", 9), -F.col("rival")))
    return means.groupBy("matrix_id", "cluster").agg(best.alias("predicted"))


# ---- merged profiles --------------------------------------------------------------------


def merge_mean(members: DataFrame) -> DataFrame:
    """Mean of aligned member columns; a member without the column adds 0.25 to each base and one gap."""
    return _merge(members.withColumn("weight", F.lit(1.0)), gap_cell=0.25)


def merge_weighted(members: DataFrame) -> DataFrame:
    """The same with supplied ``weight`` over the total weight; a gap still adds 0.25."""
    whole = members.select("matrix_id", "weight").distinct().agg(F.sum("weight"))
    return _merge(members.withColumn("weight", F.col("weight") / whole.scalar()), gap_cell=0.25)


def merge_by_similarity(members: DataFrame, scored: DataFrame) -> DataFrame:
    """Members weighted by their mean ``p`` to the others; gaps are skipped and weak edges trimmed."""
    return trim_merged(_merge(members.drop("weight").join(similarity_weights(members, scored), ["cluster", "matrix_id"]), 0.0))


def similarity_weights(members: DataFrame, scored: DataFrame, others_only: bool = False) -> DataFrame:
    """Summed ``p`` of each member to the other members over the cluster size (or size - 1)."""
    inside = members.select("cluster", "matrix_id").distinct()
    sizes = inside.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    a, b = inside.toDF("cluster", "a"), inside.toDF("cluster", "b")
    sums = scored.where("a <> b").join(a, "a").join(b, ["cluster", "b"]).groupBy("cluster", "a").agg(F.sum("p").alias("p"))
    by = F.col("size") - 1 if others_only else F.col("size")
    return sums.join(sizes, "cluster").select("cluster", F.col("a").alias("matrix_id"), (F.col("p") / by).alias("weight"))


def _merge(members: DataFrame, gap_cell: float) -> DataFrame:
    sizes = members.select("cluster", "matrix_id").distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    sums = members.groupBy("cluster", "pos").agg(
        *[F.sum(F.col(b) * F.col("weight")).alias(b) for b in BASES], F.count(F.lit(1)).alias("_present")
    )
    gapped = sums.join(sizes, "cluster").withColumn("gaps", F.col("members") - F.col("_present"))
    filled = gapped.select("cluster", "pos", "members", "gaps", *[(F.col(b) + F.col("gaps") * gap_cell).alias(b) for b in BASES])
    return filled.select("cluster", "pos", "members", "gaps", *[(F.col(b) / total()).alias(b) for b in BASES])


def trim_merged(profile: DataFrame) -> DataFrame:
    """Strips weak or mostly gapped columns from both ends, keeping a protected window of four."""
    per = W.partitionBy("cluster")
    by_pos = per.orderBy("pos")
    weak = ((F.round(information(), 9) < MIN_INFO) | (F.col("gaps") > F.col("members") / 2)).cast("int")
    marked = profile.withColumn("_weak", weak).withColumn("_len", F.max("pos").over(per))
    left = F.min("_weak").over(by_pos.rowsBetween(W.unboundedPreceding, 0))
    right = F.min("_weak").over(by_pos.rowsBetween(0, W.unboundedFollowing))
    cut = marked.withColumn("_l", ((left == 1) & (F.col("pos") < F.col("_len") - EDGE_WINDOW)).cast("int")).withColumn("_r", right)
    first = F.sum("_l").over(per)
    return (
        cut.withColumn("_first", first)
        .where((F.col("_l") == 0) & ~((F.col("_r") == 1) & (F.col("pos") > F.col("_first") + EDGE_WINDOW + 1)))
        .select(*profile.columns)
    )


def star_placements(membership: DataFrame, pairs: DataFrame, scored: DataFrame) -> DataFrame:
    """Where every member of a cluster lands on its anchor: ``(cluster, matrix_id, forward, shift, weight)``.

    The anchor is the member with the highest mean ``p`` to the others.  ``pairs``
    are ungapped alignments, one row per unordered pair, that may turn their
    first profile; a turned anchor is read as a turned member.
    """
    weights = similarity_weights(membership, scored, others_only=True)
    anchor = weights.groupBy("cluster").agg(
        F.min_by("matrix_id", F.struct(-F.round("weight", 9), F.col("matrix_id"))).alias("anchor")
    )
    placed = weights.join(anchor, "cluster")
    as_first = pairs.select(
        F.col("a").alias("anchor"), F.col("b").alias("matrix_id"), "forward",
        F.when(F.col("forward"), F.col("i1") - F.col("i2"))
        .otherwise((F.col("len1") - F.col("i1")) - (F.col("len2") - F.col("i2"))).alias("shift"),
    )
    as_second = pairs.where("a <> b").select(
        F.col("b").alias("anchor"), F.col("a").alias("matrix_id"), "forward", (F.col("i2") - F.col("i1")).alias("shift")
    )
    links = as_first.where("anchor <> matrix_id").unionByName(as_second)
    joined = placed.join(links, ["anchor", "matrix_id"], "left")
    return joined.select(
        "cluster", "matrix_id", F.coalesce("forward", F.lit(True)).alias("forward"),
        F.coalesce("shift", F.lit(0)).alias("shift"), "weight",
    )


def familial_star(placements: DataFrame, given: DataFrame, turned: DataFrame) -> DataFrame:
    """Weighted profile of the placed members: six core columns, extended both ways
    while a column carries over 0.4 bits or half of the members."""
    columns = given.withColumn("forward", F.lit(True)).unionByName(turned.withColumn("forward", F.lit(False)))
    laid = placements.join(columns, ["matrix_id", "forward"]).withColumn("pos", F.col("pos") + F.col("shift"))
    sizes = placements.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    sums = laid.groupBy("cluster", "pos").agg(
        *[F.sum(F.col(b) * F.col("weight")).alias(b) for b in BASES], F.count(F.lit(1)).alias("covered")
    )
    shares = sums.join(sizes, "cluster").select(
        "cluster", "pos", "covered", "members", *[(F.col(b) / total()).alias(b) for b in BASES]
    )
    fits = (F.round(information(), 9) > MIN_INFO) | (F.col("covered") >= F.col("members") / 2)
    side = F.when(F.col("pos") < 1, "left").when(F.col("pos") > CORE_COLUMNS, "right").otherwise("core")
    away = F.when(F.col("pos") < 1, 1 - F.col("pos")).otherwise(F.col("pos") - CORE_COLUMNS)
    marked = shares.withColumn("_side", side).withColumn("_away", away).withColumn("_fits", fits.cast("int"))
    run = W.partitionBy("cluster", "_side").orderBy("_away")
    # Columns further out count only while the run from the core is unbroken.
    unbroken = marked.withColumn("_run", F.sum("_fits").over(run.rowsBetween(W.unboundedPreceding, 0)))
    return unbroken.where((F.col("_side") == "core") | (F.col("_run") == F.col("_away"))).select(
        "cluster", "pos", "covered", *BASES
    )


def report(membership: DataFrame, merged: DataFrame) -> DataFrame:
    """One row per member with the size of its cluster and the cluster's merged consensus."""
    sizes = membership.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    return membership.join(sizes, "cluster").join(merged, "cluster").select(
        "cluster", "matrix_id", "members", (F.col("members") == 1).alias("single"), "consensus"
    )


# ---- mutual information -----------------------------------------------------------------


def joint_frequencies(dna: DataFrame, protein: DataFrame) -> DataFrame:
    """Mean over members of base share times residue share, per DNA column i and protein column j.

    ``dna(member, pos, a, c, g, t)`` and ``protein(member, pos, res, f)``.  A base
    with share 0, or a DNA column the member lacks, counts 0.25.
    """
    both = dna.select("member").distinct().join(protein.select("member").distinct(), "member")
    width = dna.agg(F.max("pos"))
    n = both.agg(F.count(F.lit(1)))
    grid = both.select("member", F.explode(F.sequence(F.lit(1), width.scalar())).alias("pos"))
    cells = F.array(*[
        F.struct(F.lit(b.upper()).alias("base"), F.when(F.col(b) > 0, F.col(b)).otherwise(0.25).alias("f")) for b in BASES
    ])
    bases = grid.join(dna, ["member", "pos"], "left").select("member", F.col("pos").alias("i"), F.inline(cells))
    residues = protein.select("member", F.col("pos").alias("j"), "res", F.col("f").alias("r"))
    met = bases.join(residues, "member")
    return met.groupBy("i", "j", "base", "res").agg((F.sum(F.col("f") * F.col("r")) / n.scalar()).alias("p"))


def mutual_information(joint: DataFrame, merged: DataFrame, domain: DataFrame) -> DataFrame:
    """``sum p log2(p / (p_base p_residue))`` per pair of columns.

    ``merged(pos, base, f)`` is the merged DNA profile, ``domain(pos, res, f)``
    the residue shares over all members.
    """
    fb = merged.select(F.col("pos").alias("i"), "base", F.col("f").alias("fb")).where("fb > 0")
    fr = domain.select(F.col("pos").alias("j"), "res", F.col("f").alias("fr")).where("fr > 0")
    terms = joint.where("p > 0").join(fb, ["i", "base"]).join(fr, ["j", "res"])
    return terms.groupBy("i", "j").agg(
        F.sum(F.col("p") * F.log2(F.col("p") / (F.col("fb") * F.col("fr")))).alias("mi")
    )


def base_preference(joint: DataFrame) -> DataFrame:
    """P(base | residue) per column pair; uniform for residues never seen there."""
    letters = F.explode(F.array(*[F.lit(x) for x in RESIDUES])).alias("res")
    slots = joint.select("i", "j").distinct().select("i", "j", letters)
    bases = slots.select("*", F.explode(F.array(*[F.lit(b.upper()) for b in BASES])).alias("base"))
    sums = joint.groupBy("i", "j", "res").agg(F.sum("p").alias("s"))
    full = bases.join(joint, ["i", "j", "res", "base"], "left").join(sums, ["i", "j", "res"], "left")
    share = F.when(F.coalesce("s", F.lit(0.0)) == 0, 0.25).otherwise(F.coalesce("p", F.lit(0.0)) / F.col("s"))
    return full.select("i", "j", "res", "base", share.alias("pref"))
