"""Mixing sources to target weights by weighted fair queueing.

Every source holds its documents in shuffled order, once for each pass that a
target may take.  A copy finishes at the source's running size divided by its
target weight; all copies are sorted by that virtual time and the mix takes
them until the budget is spent, so that every source is ahead or behind by
less than one document.  Targets share the budget by weight; none is above
``PASSES`` times its source's size, and what a capped source cannot take goes
to the others by weight.

Running sums go over ranges of the order, so neither a large source nor the
whole table is ever sorted in one task.  The shuffle order is an md5 of pass and
id, which makes reruns agree.

Results: a null source is a source of its own, the last.  A null or empty text
has size 0 and takes no room.  Repeated rows are queued one by one.  Copies that
tie go by source, pass, hash, id and size; rows equal in all of them are
interchangeable.  An empty table gives an empty mix; a table without words takes
nothing.  Other columns pass through ``mix`` untouched; clashing helper names
are replaced by none, since helpers live in tables of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from helixframe.llm.common import query, table
from helixframe.operators.ordered import prefix_scan, rank_rows
from helixframe.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix holds this many hundredths of all sizes.
BUDGET = 150
PASSES = 2


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def source_targets(sized: DataFrame, weights=WEIGHTS, budget: int = BUDGET, passes: int = PASSES) -> DataFrame:
    """``source, rank, source_size, target`` from rows with ``source`` and ``size``.

    Sorted by cap over weight, the sources up to some place are capped and the
    rest share what is left by weight; the level at which the first source stays
    below its cap is the common one.
    """
    sources = cut_lineage(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = rank_rows(sources, [], [F.col("source").isNull(), F.col("source")], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (((F.col("rank") - 1) % len(weights)) + 1).cast("int"))
    capped = cut_lineage(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * passes))
    capped = capped.withColumn("ratio", F.col("cap") / F.col("weight"))
    run = prefix_scan(capped, [], [F.col("ratio"), F.col("rank")], cap_upto=("sum", "cap"), weight_upto=("sum", "weight"))
    run = cut_lineage(run)
    total = run.agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight"), F.sum("source_size").alias("size")).first()
    if total["size"]:
        room = F.lit(float(total["size"])) * budget / 100 - (F.col("cap_upto") - F.col("cap"))
        level = room / (F.lit(total["weight"]) - (F.col("weight_upto") - F.col("weight")))
        first = run.select("ratio", "rank", level.alias("level")).where("level <= ratio").orderBy("ratio", "rank").first()
        share = F.col("weight") * F.lit(first["level"] if first else float("inf"))
    else:
        share = F.lit(0.0)
    return run.select("source", "rank", "source_size", F.least(F.col("cap").cast("double"), share).alias("target"))


def queue(sized: DataFrame, targets: DataFrame, budget: int = BUDGET, passes: int = PASSES) -> DataFrame:
    """Copies that the mix takes, as ``uid, pass, finish``; ``sized`` has ``uid, doc_id, source, size``."""
    known = targets.withColumnRenamed("source", "_source")
    queued = (
        sized.join(known, F.col("source").eqNullSafe(F.col("_source")))
        .select("uid", "doc_id", "size", "rank", "target", F.explode(F.array(*[F.lit(p) for p in range(1, passes + 1)])).alias("pass"))
        .withColumn("draw", F.md5(F.concat_ws("|", F.col("pass").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    )
    order = [F.col(c) for c in ("pass", "draw", "doc_id", "size", "uid")]
    own = prefix_scan(queued, ["rank"], order, upto=("sum", "size"))
    finish = F.when(F.col("target") > 0, F.col("upto") / F.col("target")).otherwise(0.0)
    timed = own.withColumn("finish", finish)
    every = prefix_scan(timed, [], [F.col(c) for c in ("finish", "rank", "pass", "draw", "doc_id", "size", "uid")], spent=("sum", "size"))
    limit = targets.agg((F.sum("source_size") * budget / 100).alias("b")).first()["b"] or 0.0
    return every.where((F.col("spent") <= limit) & (F.col("target") > 0)).select("uid", "pass", "finish")


def numbered(docs: DataFrame, extra: dict[str, Column]) -> DataFrame:
    """Rows with a number of their own, stored so that it stays theirs."""
    return cut_lineage(docs.withColumns({"uid": F.monotonically_increasing_id(), **extra}))


def mix(docs: DataFrame, weights=WEIGHTS, budget: int = BUDGET, passes: int = PASSES) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` (``doc_id, text, source`` and any others), each as often as it is taken."""
    packed = numbered(docs.select(F.struct(*docs.columns).alias("row")), {"size": words(F.col("row.text"))})
    sized = packed.select("uid", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "size")
    taken = queue(sized, source_targets(sized, weights, budget, passes), budget, passes)
    return packed.join(taken.select("uid"), "uid").select("row.*")


@query(
    "op1_source_mix",
    f"""
    WITH d AS (SELECT row_number() OVER () AS uid, doc_id, source,
                 CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
            row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM d GROUP BY source),
    w AS (SELECT *, CAST(CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, source_size * 2 AS cap FROM s),
    r AS (SELECT *, cap / weight AS ratio, sum(cap) OVER o - cap AS cap_before, sum(weight) OVER o - weight AS weight_before,
            sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
          FROM w WINDOW o AS (ORDER BY cap / weight, rank)),
    l AS (SELECT *, (CAST(total AS DOUBLE) * 150 / 100 - CAST(cap_before AS DOUBLE)) / (weights - weight_before) AS level FROM r),
    v AS (SELECT arg_min(level, struct_pack(a := ratio, b := rank)) AS v FROM l WHERE level <= ratio),
    t AS (SELECT source, rank, source_size, least(CAST(cap AS DOUBLE), weight * v) AS target FROM l, v),
    q AS (SELECT uid, doc_id, size, rank, target, pass, md5(concat(pass, '|', coalesce(CAST(doc_id AS VARCHAR), ''))) AS draw
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (SELECT unnest([1, 2]) AS pass)),
    o AS (SELECT *, sum(size) OVER (PARTITION BY rank ORDER BY pass, draw, doc_id, size, uid) / target AS finish FROM q WHERE target > 0),
    e AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, pass, draw, doc_id, size, uid) AS spent FROM o),
    k AS (SELECT uid, sum(size) AS taken FROM e WHERE spent <= (SELECT sum(size) * 150 / 100 FROM d) GROUP BY uid)
    SELECT d.doc_id, d.size, t.source_size, t.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN k USING (uid)
    """,
)
def op1(spark, sf_dir):
    """What the mix of all documents takes of each."""
    documents = table(spark, sf_dir, "documents")
    sized = numbered(documents.select("doc_id", "source", words(F.col("text")).alias("size")), {})
    targets = source_targets(sized)
    taken = queue(sized, targets).groupBy("uid").agg(F.count(F.lit(1)).alias("times"))
    known = targets.withColumnRenamed("source", "_source")
    return (
        sized.join(known, F.col("source").eqNullSafe(F.col("_source")))
        .join(taken, "uid", "left")
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("times", F.lit(0))).alias("taken"))
    )
