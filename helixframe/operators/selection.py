"""Catalogue selection: lookups, versions, boolean search, tag pivots and input checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from helixframe.operators.ordered import rank_rows

# Sequence alphabet and the length limits of the two input forms.
ALPHABET = "ACGTWSKMPUYBDHWN"
MAX_FOOTPRINT, MAX_SCAN = 10_000, 20_000


def select_listed(df: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` occurs in the one-column table ``wanted``."""
    return df.join(wanted.toDF(column).distinct(), column, "left_semi")


def latest_versions(matrix: DataFrame) -> DataFrame:
    """Newest version per base id, by arg-max so each key is combined before the shuffle."""
    others = [c for c in matrix.columns if c not in ("base_id", "version")]
    newest = matrix.groupBy("base_id").agg(F.max_by(F.struct("version", *others), "version").alias("m"))
    return newest.select("base_id", "m.*").select(*matrix.columns)


def all_versions(matrix: DataFrame) -> DataFrame:
    counts = matrix.groupBy("base_id").agg(F.count(F.lit(1)).alias("n_versions"))
    return matrix.join(counts, "base_id")


def browse(matrix: DataFrame, collection: str, sort_by: str, species: DataFrame | None = None,
           tax: DataFrame | None = None, tax_group: str | None = None) -> DataFrame:
    kept = matrix.where(F.col("collection") == collection)
    if tax_group is not None:
        group = tax.where(F.col("tax_group") == tax_group).select("tax_id")
        kept = kept.join(species.join(group, "tax_id", "left_semi"), "id", "left_semi")
    return kept.orderBy(sort_by, "id")


def collection_ordinals(matrix: DataFrame, main: str) -> DataFrame:
    """0 for the main collection, then the others in alphabetical order."""
    names = matrix.select("collection").distinct()
    ranked = rank_rows(names, [], [(F.col("collection") != main).cast("int"), F.col("collection")], "ordinal")
    return ranked.withColumn("ordinal", (F.col("ordinal") - 1).cast("int"))


def search(matrix: DataFrame, species: DataFrame, *, ids: Sequence[int] | None = None, name: str | None = None,
           tax_id: int | None = None, class_no: int | None = None, collection: str | None = None,
           every_version: bool = True) -> DataFrame:
    """Conjunction of the given options; a missing option does not filter."""
    clauses = []
    if ids is not None:
        clauses.append(F.col("id").isin(*ids))
    if name is not None:
        clauses.append(F.col("name") == name)
    if class_no is not None:
        clauses.append(F.col("class_no") == class_no)
    if collection is not None:
        clauses.append(F.col("collection") == collection)
    base = matrix if every_version else latest_versions(matrix)
    found = base.where(reduce(and_, clauses)) if clauses else base
    if tax_id is not None:
        found = found.join(species.where(F.col("tax_id") == tax_id), "id", "left_semi")
    return found


def field_ids(matrix: DataFrame, species: DataFrame, tax: DataFrame, field: str, value: str) -> DataFrame:
    """Ids that match one search clause; a comma list is an OR."""
    wanted = [v.strip() for v in value.split(",")]
    if field == "species":
        named = tax.where(F.col("species").isin(*wanted)).select("tax_id")
        return species.join(named, "tax_id", "left_semi").select("id").distinct()
    return matrix.where(F.col(field).cast("string").isin(*wanted)).select("id")


def search_boolean(matrix: DataFrame, species: DataFrame, tax: DataFrame,
                   first: tuple[str, str], *rest: tuple[str, str, str]) -> DataFrame:
    """Clauses combined strictly left to right with AND, OR, NOT."""
    found = field_ids(matrix, species, tax, *first)
    for operator, field, value in rest:
        other = field_ids(matrix, species, tax, field, value)
        if operator == "AND":
            found = found.intersect(other)
        elif operator == "OR":
            found = found.union(other).distinct()
        elif operator == "NOT":
            found = found.subtract(other)
        else:
            raise ValueError(f"unknown operator {operator!r}")
    return found


def result_status(found: DataFrame) -> DataFrame:
    """One row that reports an empty result instead of failing on it."""
    return found.limit(1).agg(F.when(F.count(F.lit(1)) > 0, "ok").otherwise("no matches").alias("status"))


def select_by_dimension(matrix: DataFrame, dimension: DataFrame, keys: DataFrame) -> DataFrame:
    """Matrices linked by ``dimension(id, value)`` to any of ``keys(value)``, one row per id, sorted."""
    linked = dimension.join(keys, "value", "left_semi").select("id").distinct()
    return matrix.join(linked, "id", "left_semi").orderBy("id")


def names_per_group(matrix: DataFrame, group: str) -> DataFrame:
    """Sorted distinct names of each group, as rows with their rank."""
    distinct = matrix.select(group, "name").distinct()
    return rank_rows(distinct, [group], [F.col("name")], "ord")


def project_keys(matrix: DataFrame, tags: DataFrame, keys: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """One column per display key; repeated tags are joined with commas.

    ``methods`` are keys answered by the matrix table itself and win over tags of
    the same name.
    """
    from_tags = [k for k in keys if k not in methods]
    lists = tags.where(F.col("tag").isin(*from_tags)).groupBy("id").pivot("tag", from_tags).agg(
        F.array_join(F.array_sort(F.collect_list("val")), ",")
    )
    if len(from_tags) == 1:
        lists = lists.toDF("id", from_tags[0])
    own = matrix.select("id", *[F.col(k).cast("string").alias(k) for k in keys if k in methods])
    return own.join(lists, "id", "left").select("id", *keys)


# Link texts of the catalogue page.
LINKS = {
    "medline": '<a target=_blank href=http://www.ncbi.nlm.nih.gov/entrez/query.fcgi?cmd=search&db=pubmed&term=%s>%s</a>',
    "acc": '<a target=_blank href=http://www.ncbi.nlm.nih.gov/entrez/query.fcgi?cmd=search&db=protein&term=%s.&doptcmdl=Brief>%s</a> ',
    "pazar_tf_id": "<a target=_blank href=http://www.pazar.info/cgi-bin/tf_search.cgi?geneID=%s&excluded=none>%s</a>",
}
SHOWN = {"pazar_tf_id": "Pazar ID"}


def shown_key(key: Column) -> Column:
    """Name under which a tag is shown."""
    for kind, name in SHOWN.items():
        key = F.when(key == kind, name).otherwise(key)
    return key


def render_tag(key: Column, val: Column, links: Mapping[str, str] = LINKS) -> Column:
    """Display text of a tag: a link for the known kinds, and a blank after each comma."""
    text = val
    for kind, pattern in links.items():
        text = F.when(key == kind, F.format_string(pattern.replace("%s", "%1$s"), val)).otherwise(text)
    return F.regexp_replace(text, ",", ", ")


def species_names(lists: DataFrame, tax: DataFrame) -> DataFrame:
    """Names for ``(id, tax_ids)`` lists, in list order.

    ``-`` stays; an unknown id is skipped in a longer list and shown as ``-`` when alone.
    """
    items = lists.select("id", F.size("tax_ids").alias("n"), F.posexplode("tax_ids").alias("ord", "item"))
    known = tax.select(F.col("tax_id").cast("string").alias("item"), "species")
    named = items.join(known, "item", "left").withColumn("text", F.when(F.col("item") == "-", "-").otherwise(F.col("species")))
    kept = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("ord", "text"))))
    joined = named.groupBy("id").agg(F.array_join(F.transform(kept, lambda x: x["text"]), ",").alias("names"), F.max("n").alias("n"))
    return joined.select("id", F.when((F.col("n") == 1) & (F.col("names") == ""), "-").otherwise(F.col("names")).alias("names"))


def validate(sequences: DataFrame, limit: int = MAX_SCAN) -> DataFrame:
    """Adds ``reason``: null for a valid sequence.  A ``header`` column must not be blank."""
    headed = F.trim(F.coalesce("header", F.lit(""))) != "" if "header" in sequences.columns else F.lit(True)
    return sequences.withColumn(
        "reason",
        F.when(~headed, "no header")
        .when(F.length("seq") == 0, "empty")
        .when(F.length("seq") > limit, "too long")
        .when(~F.col("seq").rlike(f"^[{ALPHABET}]+$"), "unknown letter"),
    )


def truncate(seq: Column, limit: int = MAX_FOOTPRINT) -> Column:
    return F.substring(seq, 1, limit)


def pattern_filter(df: DataFrame, column: str, patterns: Sequence[str], mode: str = "any") -> DataFrame:
    tests = [F.col(column).rlike(p) for p in patterns]
    return df.where(reduce(or_ if mode == "any" else and_, tests))


def valid_chromosomes(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).contains("chr") & ~F.col(column).contains("_"))


def missing_names(requested: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Requested names that do not exist; empty when the check passes."""
    return requested.select(column).distinct().join(known.select(column), column, "left_anti")
