"""Catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import profiles, selection as s
from helixframe.plans.registry import query, r6, view

ALL = "id, base_id, version, collection, name, class_no"


@query("matrix_by_id", f"SELECT {ALL} FROM f4_matrix WHERE id IN (SELECT doc_id FROM labels)")
def matrix_by_id(fx):
    return s.select_listed(fx.matrix, fx.table("labels").select("doc_id"), "id")


@query("matrix_latest_version", f"SELECT {ALL} FROM f4_matrix QUALIFY row_number() OVER (PARTITION BY base_id ORDER BY version DESC)=1")
def matrix_latest_version(fx):
    return s.latest_versions(fx.matrix)


@query("matrix_all_versions", f"SELECT {ALL}, count(*) OVER (PARTITION BY base_id) AS n_versions FROM f4_matrix")
def matrix_all_versions(fx):
    return s.all_versions(fx.matrix)


@query("browse_collection", f"""SELECT {ALL} FROM f4_matrix WHERE collection='STANDARD' AND id IN
    (SELECT id FROM f4_species JOIN f4_tax USING (tax_id) WHERE tax_group=(SELECT min(tax_group) FROM f4_tax))""")
def browse_collection(fx):
    first = fx.tax.agg(F.min("tax_group")).first()[0]
    return s.browse(fx.matrix, "STANDARD", "name", fx.species, fx.tax, first)


@query("collection_ordinal", """SELECT collection, CAST(row_number() OVER (ORDER BY collection<>'STANDARD', collection)-1 AS INT) AS ordinal
    FROM (SELECT DISTINCT collection FROM f4_matrix)""")
def collection_ordinal(fx):
    return s.collection_ordinals(fx.matrix, "STANDARD")


@query("search_by_options", f"""SELECT {ALL} FROM (SELECT * FROM f4_matrix QUALIFY version = max(version) OVER (PARTITION BY base_id))
    WHERE id IN (SELECT id FROM f4_species WHERE tax_id=3)
    UNION ALL SELECT {ALL} FROM f4_matrix WHERE class_no=7 AND collection='SMALL'""")
def search_by_options(fx):
    newest = s.search(fx.matrix, fx.species, tax_id=3, every_version=False)
    return newest.unionByName(s.search(fx.matrix, fx.species, class_no=7, collection="SMALL"))


@query("search_boolean", """SELECT id FROM f4_matrix WHERE (class_no=3 OR collection='PROMO')
    AND id NOT IN (SELECT id FROM f4_species JOIN f4_tax USING (tax_id) WHERE species='NATION_4')""")
def search_boolean(fx):
    return s.search_boolean(
        fx.matrix, fx.species, fx.tax, ("class_no", "3"), ("OR", "collection", "PROMO"), ("NOT", "species", "NATION_4")
    )


@query("search_multi_value", "SELECT id FROM f4_matrix WHERE collection IN ('LARGE','SMALL','PROMO') AND class_no IN (1,2,3,4)")
def search_multi_value(fx):
    return s.search_boolean(
        fx.matrix, fx.species, fx.tax, ("collection", "LARGE, SMALL,PROMO"), ("AND", "class_no", "1, 2, 3, 4")
    )


@query("empty_result_guard", """SELECT 'known' AS probe, CASE WHEN count(*)>0 THEN 'ok' ELSE 'no matches' END AS status
    FROM f4_matrix WHERE collection='PROMO'
    UNION ALL SELECT 'unknown', CASE WHEN count(*)>0 THEN 'ok' ELSE 'no matches' END FROM f4_matrix WHERE collection='NONE'""")
def empty_result_guard(fx):
    known = s.result_status(s.search(fx.matrix, fx.species, collection="PROMO"))
    unknown = s.result_status(s.search(fx.matrix, fx.species, collection="NONE"))
    return known.select(F.lit("known").alias("probe"), "status").unionByName(
        unknown.select(F.lit("unknown").alias("probe"), "status")
    )


view("v_total_ic", """SELECT matrix_id, sum(ic) AS total_ic FROM (SELECT matrix_id, pos,
    2 + sum(CASE WHEN n>0 THEN n/w*log2(n/w) ELSE 0 END) AS ic
    FROM (SELECT *, sum(n) OVER (PARTITION BY matrix_id,pos) AS w FROM f3_cell) GROUP BY 1,2) GROUP BY 1""")


@query("min_ic_filter", f"""SELECT matrix_id, {r6('total_ic')} AS total_ic FROM v_total_ic
    WHERE total_ic >= (SELECT avg(total_ic) FROM v_total_ic)""")
def min_ic_filter(fx):
    from helixframe.session import cut_lineage

    totals = cut_lineage(profiles.total_ic(profiles.wide(fx.cell)))
    threshold = totals.agg(F.avg("total_ic")).first()[0]
    return profiles.min_ic_filter(totals, threshold).withColumn("total_ic", F.round("total_ic", 6))


@query("select_by_dimension", f"""SELECT {ALL} FROM f4_matrix WHERE id IN (SELECT id FROM f4_species JOIN f4_tax USING (tax_id)
    WHERE species IN (SELECT species FROM f4_tax WHERE tax_id IN (0,1)))""")
def select_by_dimension(fx):
    named = fx.species.join(fx.tax, "tax_id").select("id", F.col("species").alias("value"))
    keys = fx.tax.where("tax_id IN (0, 1)").select(F.col("species").alias("value"))
    return s.select_by_dimension(fx.matrix, named, keys)


@query("distinct_dimension", """SELECT DISTINCT 'class' AS dim, CAST(class_no AS VARCHAR) AS value FROM f4_matrix
    UNION ALL SELECT DISTINCT 'name', name FROM f4_matrix UNION ALL SELECT DISTINCT 'species', species FROM f4_tax
    UNION ALL SELECT DISTINCT 'supergroup', tax_group FROM f4_tax""")
def distinct_dimension(fx):
    dims = F.array(
        F.struct(F.lit("class").alias("dim"), F.col("class_no").cast("string").alias("value")),
        F.struct(F.lit("name").alias("dim"), F.col("name").alias("value")),
    )
    groups = F.array(
        F.struct(F.lit("species").alias("dim"), F.col("species").alias("value")),
        F.struct(F.lit("supergroup").alias("dim"), F.col("tax_group").alias("value")),
    )
    every = fx.matrix.select(F.inline(dims)).unionByName(fx.tax.select(F.inline(groups)))
    return every.distinct().orderBy("dim", F.upper("value"), "value")


@query("names_per_group", """SELECT class_no, name, row_number() OVER (PARTITION BY class_no ORDER BY name) AS ord
    FROM (SELECT DISTINCT class_no, name FROM f4_matrix)""")
def names_per_group(fx):
    return s.names_per_group(fx.matrix, "class_no")


@query("dynamic_key_projection", """SELECT m.id, m.name, CAST(m.class_no AS VARCHAR) AS class_no, t.tax_id, t.species
    FROM f4_matrix m LEFT JOIN (SELECT id, string_agg(CAST(tax_id AS VARCHAR), ',' ORDER BY CAST(tax_id AS VARCHAR)) AS tax_id,
      string_agg(species, ',' ORDER BY species) AS species FROM f4_species JOIN f4_tax USING (tax_id) GROUP BY id) t ON m.id=t.id""")
def dynamic_key_projection(fx):
    tags = fx.species.join(fx.tax, "tax_id").select(
        "id",
        F.inline(
            F.array(
                F.struct(F.lit("tax_id").alias("tag"), F.col("tax_id").cast("string").alias("val")),
                F.struct(F.lit("species").alias("tag"), F.col("species").alias("val")),
                F.struct(F.lit("name").alias("tag"), F.lit("hidden").alias("val")),
            )
        ),
    )
    return s.project_keys(fx.matrix, tags, ["name", "class_no", "tax_id", "species"], ["name", "class_no"])


@query("tag_link_render", f"""SELECT id, key, replace(CASE key WHEN 'medline' THEN replace('{s.LINKS["medline"]}', '%s', val)
    WHEN 'acc' THEN replace('{s.LINKS["acc"]}', '%s', val) WHEN 'pazar_tf_id' THEN replace('{s.LINKS["pazar_tf_id"]}', '%s', val)
    ELSE val END, ',', ', ') AS text, CASE key WHEN 'pazar_tf_id' THEN 'Pazar ID' ELSE key END AS shown
    FROM (SELECT id, CASE id%4 WHEN 0 THEN 'medline' WHEN 1 THEN 'acc' WHEN 3 THEN 'pazar_tf_id' ELSE 'comment' END AS key,
      CASE id%4 WHEN 2 THEN name || ',' || base_id ELSE CAST(id AS VARCHAR) END AS val FROM f4_matrix)""")
def tag_link_render(fx):
    kind = F.col("id") % 4
    key = F.when(kind == 0, "medline").when(kind == 1, "acc").when(kind == 3, "pazar_tf_id").otherwise("comment")
    val = F.when(kind == 2, F.concat_ws(",", "name", "base_id")).otherwise(F.col("id").cast("string"))
    tags = fx.matrix.select("id", key.alias("key"), val.alias("val"))
    return tags.select("id", "key", s.render_tag(F.col("key"), F.col("val")).alias("text"), s.shown_key(F.col("key")).alias("shown"))


@query("species_to_id", """SELECT c_custkey, species, tax_id FROM
    (SELECT c_custkey, 'NATION_' || CAST(c_custkey%30 AS VARCHAR) AS species FROM customer) LEFT JOIN f4_tax USING (species)""")
def species_to_id(fx):
    asked = fx.table("customer").select(
        "c_custkey", F.concat(F.lit("NATION_"), (F.col("c_custkey") % 30).cast("string")).alias("species")
    )
    return asked.join(fx.tax.select("species", "tax_id"), "species", "left").select("c_custkey", "species", "tax_id")


@query("species_names", """WITH items AS (SELECT c_custkey AS id, 0 AS ord, CAST(c_nationkey AS VARCHAR) AS item FROM customer
      UNION ALL SELECT c_custkey, 1, CASE WHEN c_custkey%7=0 THEN '-' ELSE CAST(c_custkey%40 AS VARCHAR) END FROM customer WHERE c_custkey%3<>0),
    named AS (SELECT i.id, i.ord, CASE WHEN item='-' THEN '-' ELSE t.species END AS txt FROM items i
      LEFT JOIN f4_tax t ON i.item=CAST(t.tax_id AS VARCHAR))
    SELECT id, coalesce(string_agg(txt, ',' ORDER BY ord), CASE WHEN count(*)=1 THEN '-' ELSE '' END) AS names FROM named GROUP BY id""")
def species_names(fx):
    second = F.when(F.col("c_custkey") % 7 == 0, "-").otherwise((F.col("c_custkey") % 40).cast("string"))
    first = F.col("c_nationkey").cast("string")
    lists = fx.table("customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 3 != 0, F.array(first, second)).otherwise(F.array(first)).alias("tax_ids"),
    )
    return s.species_names(lists, fx.tax)


# Headers are the first word of a description line; every seventh sequence has none.
@query("validate_sequence", """SELECT form, seq_id, CASE WHEN seq_id%7=0 THEN 'no header' WHEN length(seq)=0 THEN 'empty' WHEN length(seq)>2000 THEN 'too long'
    WHEN NOT regexp_matches(seq, '^[ABCDGHKMNPSTUWY]+$') THEN 'unknown letter' END AS reason
    FROM (SELECT 'text' AS form, doc_id AS seq_id, upper(regexp_replace(text,'[^A-Za-z]','','g')) AS seq FROM documents
      UNION ALL SELECT 'dna', seq_id, seq FROM f1_sequence)""")
def validate_sequence(fx):
    letters = fx.table("documents").select(
        F.lit("text").alias("form"), F.col("doc_id").alias("seq_id"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq")
    )
    every = letters.unionByName(fx.sequence.select(F.lit("dna").alias("form"), "seq_id", "seq"))
    headed = every.withColumn("header", F.when(F.col("seq_id") % 7 == 0, " ").otherwise(F.col("seq_id").cast("string")))
    return s.validate(headed, 2000).select("form", "seq_id", "reason")


@query("truncate_sequence", "SELECT seq_id, substr(seq,1,10000) AS seq, length(seq)>10000 AS cut FROM f1_sequence")
def truncate_sequence(fx):
    return fx.sequence.select(
        "seq_id", s.truncate(F.col("seq")).alias("seq"), (F.length("seq") > s.MAX_FOOTPRINT).alias("cut")
    )


@query("pattern_filter", """SELECT acc, 'any' AS mode FROM f9_gene WHERE regexp_matches(description,'[Tt]he') OR regexp_matches(description,'eau')
    UNION ALL SELECT acc, 'all' FROM f9_gene WHERE regexp_matches(description,'[Tt]he') AND regexp_matches(description,'on')""")
def pattern_filter(fx):
    hit = s.pattern_filter(fx.gene, "description", ["[Tt]he", "eau"], "any").select("acc", F.lit("any").alias("mode"))
    return hit.unionByName(
        s.pattern_filter(fx.gene, "description", ["[Tt]he", "on"], "all").select("acc", F.lit("all").alias("mode"))
    )


@query("valid_chroms", """SELECT chrom FROM (SELECT CASE WHEN s_suppkey%4=3 THEN 'scaffold' ELSE 'chr' END || CAST(s_suppkey AS VARCHAR)
    || CASE WHEN s_suppkey%5=0 THEN '_random' ELSE '' END AS chrom FROM supplier) WHERE contains(chrom,'chr') AND NOT contains(chrom,'_')""")
def valid_chroms(fx):
    names = fx.table("supplier").select(
        F.concat(
            F.when(F.col("s_suppkey") % 4 == 3, "scaffold").otherwise("chr"),
            F.col("s_suppkey").cast("string"),
            F.when(F.col("s_suppkey") % 5 == 0, "_random").otherwise(""),
        ).alias("chrom")
    )
    return s.valid_chromosomes(names, "chrom")


@query("membership_check", "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT id FROM f4_matrix WHERE class_no>10)")
def membership_check(fx):
    requested = fx.table("lineitem").select(F.col("l_partkey").alias("id"))
    return s.missing_names(requested, fx.matrix.where("class_no > 10"), "id")
