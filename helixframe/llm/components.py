"""Connected components of a table of links, in a logarithmic number of rounds.

Every round each component that has a link to a smaller one joins the smallest
such neighbour, chains of joins are followed by pointer doubling, and the
members are relabelled.  A component with a link either joins another or is
joined, so their number halves at least.  All tables stay distributed; each
round is written to the shared folder and the next starts from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from helixframe.session import cut_lineage


def join_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (``node, comp``) after merging along ``links`` (``a, b``).

    ``comp`` is the smallest node of a component.  Links to unknown nodes, to
    itself, repeated and null ones change nothing.
    """
    first = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    second = labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    open_links = cut_lineage(_between(links.join(first, "a").join(second, "b").select("ca", "cb")))
    moved = None
    while not open_links.isEmpty():
        both = open_links.unionByName(open_links.select(F.col("cb").alias("ca"), F.col("ca").alias("cb")))
        parent = both.groupBy(F.col("ca").alias("comp")).agg(F.min("cb").alias("parent")).where("parent < comp")
        parent = _roots(cut_lineage(parent))
        # Where everything that has moved so far stands now.
        if moved is None:
            moved = parent
        else:
            now = moved.join(parent.select(F.col("comp").alias("parent"), F.col("parent").alias("_to")), "parent", "left")
            moved = cut_lineage(now.select("comp", F.coalesce("_to", "parent").alias("parent")).unionByName(parent))
        for side in ("ca", "cb"):
            step = parent.select(F.col("comp").alias(side), F.col("parent").alias("_to"))
            open_links = open_links.join(step, side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
        open_links = cut_lineage(_between(open_links))
    if moved is None:
        return labels
    after = labels.join(moved, "comp", "left").select("node", F.coalesce("parent", "comp").alias("comp"))
    return cut_lineage(after)


def _between(pairs: DataFrame) -> DataFrame:
    """Different components only, each pair once, the smaller first."""
    ordered = pairs.where("ca <> cb").select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"))
    return ordered.distinct()


def _roots(parent: DataFrame) -> DataFrame:
    """Follow ``parent`` to the end of every chain; it always decreases, so chains end."""
    while True:
        up = parent.select(F.col("comp").alias("parent"), F.col("parent").alias("_up"))
        if parent.join(up, "parent", "left_semi").isEmpty():
            return parent
        jumped = parent.join(up, "parent", "left").select("comp", F.coalesce("_up", "parent").alias("parent"))
        parent = cut_lineage(jumped)
