"""Source and sink round trips: each plan prints a derived table and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import profiles, runs
from helixframe.operators.footprint import FRAME_ROWS
from helixframe.operators.selection import select_listed
from helixframe.plans.comparison import score_table
from helixframe.plans.registry import query, r6, view
from helixframe.session import scratch_path
from helixframe.sources import readers, writers

view("f3_grid", """SELECT m.matrix_id, m.pos, b.base, coalesce(c.n, 0.0) AS n
    FROM (SELECT DISTINCT matrix_id, pos FROM f3_cell) m
    CROSS JOIN (SELECT unnest(['A','C','G','T']) AS base) b
    LEFT JOIN f3_cell c ON c.matrix_id=m.matrix_id AND c.pos=m.pos AND c.base=b.base""")
view("f3_wide", """SELECT matrix_id, pos, max(CASE WHEN base='A' THEN n END) AS a, max(CASE WHEN base='C' THEN n END) AS c,
    max(CASE WHEN base='G' THEN n END) AS g, max(CASE WHEN base='T' THEN n END) AS t FROM f3_grid GROUP BY 1,2""")
view("f3_text", """SELECT matrix_id, base, string_agg(CAST(CAST(n AS BIGINT) AS VARCHAR), ' ' ORDER BY pos) AS line
    FROM f3_grid GROUP BY 1,2""")


@query("src_matrix_store", """SELECT m.id, m.base_id, m.version, m.collection, m.name, m.class_no,
    count(s.tax_id) AS n_species, count(t.species) AS n_named
    FROM f4_matrix m LEFT JOIN f4_species s ON m.id=s.id LEFT JOIN f4_tax t ON s.tax_id=t.tax_id GROUP BY ALL""")
def src_matrix_store(fx):
    path = scratch_path(fx.spark, "store")
    writers.dump_table(fx.matrix, f"{path}/matrix")
    writers.dump_table(profiles.long(profiles.wide(fx.cell), "val").select("matrix_id", "base", "pos", "val"),
                       f"{path}/matrix_cell", "matrix_id")
    writers.dump_table(fx.species.select("id", F.lit("tax_id").alias("tag"), F.col("tax_id").cast("string").alias("val")),
                       f"{path}/matrix_annotation")
    writers.dump_table(fx.tax.select("tax_id", "species"), f"{path}/tax", "tax_id")
    store = readers.read_store(fx.spark, path)
    tags = store["matrix_annotation"].where("tag = 'tax_id'").select("id", F.col("val").cast("int").alias("tax_id"))
    named = tags.join(store["tax"], "tax_id", "left").groupBy("id").agg(
        F.count("tax_id").alias("n_species"), F.count("species").alias("n_named")
    )
    zero = F.lit(0).cast("bigint")
    return store["matrix"].join(named, "id", "left").select(
        "id", "base_id", "version", "collection", "name", "class_no",
        F.coalesce("n_species", zero).alias("n_species"), F.coalesce("n_named", zero).alias("n_named"),
    )


@query("src_packaged_store", """SELECT collection AS store, count(*) AS n, min(id) AS first_id FROM f4_matrix GROUP BY 1""")
def src_packaged_store(fx):
    root = scratch_path(fx.spark, "packages")
    fx.matrix.withColumn("package", F.col("collection")).write.partitionBy("package").parquet(root)
    named = readers.read_packaged(fx.spark, root, r"/package=([^/]+)/[^/]*$")
    return named.groupBy("store").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("sink_table_dump", "SELECT id, base_id, version, collection, name, class_no FROM f4_matrix")
def sink_table_dump(fx):
    path = scratch_path(fx.spark, "dump")
    writers.dump_table(fx.matrix, path)
    return fx.spark.read.schema(readers.STORE_SCHEMAS["matrix"]).csv(path, sep="\t")


@query("src_matrix_text", "SELECT matrix_id, pos, base, n FROM f3_grid")
def src_matrix_text(fx):
    path = scratch_path(fx.spark, "matrix-text")
    writers.write_matrix_text(profiles.wide(fx.cell), path, "bracketed")
    return readers.read_matrix_text(fx.spark, path)[0]


@query("src_transfac", "SELECT matrix_id, pos, base, n FROM f3_grid")
def src_transfac(fx):
    path = scratch_path(fx.spark, "transfac")
    writers.write_matrix_text(profiles.wide(fx.cell), path, "transfac")
    return readers.read_transfac(fx.spark, path).select("matrix_id", "pos", "base", "n")


@query("sink_matrix_format", """SELECT matrix_id, 'raw' AS form, string_agg(line, chr(10) ORDER BY base) AS text FROM f3_text GROUP BY 1
    UNION ALL SELECT matrix_id, 'bracketed', string_agg(base || ' [' || line || ']', chr(10) ORDER BY base) FROM f3_text GROUP BY 1
    UNION ALL SELECT matrix_id, 'transfac', 'DE ' || matrix_id || chr(10) || string_agg(concat_ws(' ', CAST(pos-1 AS VARCHAR),
      CAST(CAST(a AS BIGINT) AS VARCHAR), CAST(CAST(c AS BIGINT) AS VARCHAR), CAST(CAST(g AS BIGINT) AS VARCHAR),
      CAST(CAST(t AS BIGINT) AS VARCHAR)), chr(10) ORDER BY pos) || chr(10) || 'XX' FROM f3_wide GROUP BY 1""")
def sink_matrix_format(fx):
    counts = profiles.wide(fx.cell)
    printed = [
        writers.format_matrices(counts, form).select("matrix_id", F.lit(form).alias("form"), "text")
        for form in writers.FORMATS
    ]
    return printed[0].unionByName(printed[1]).unionByName(printed[2])


@query("sink_matrix_dir", "SELECT matrix_id, line FROM f3_text")
def sink_matrix_dir(fx):
    path = scratch_path(fx.spark, "matrix-dir")
    writers.write_matrix_dir(profiles.wide(fx.cell), path)
    return fx.spark.read.text(path).select("matrix_id", F.col("value").alias("line"))


FASTA_PIECE = 1000


@query("src_fasta", f"""SELECT CAST(seq_id AS VARCHAR) AS header, CAST(o AS BIGINT) AS "offset", substr(seq, CAST(o+1 AS INT), {FASTA_PIECE}) AS text
    FROM (SELECT seq_id, seq, unnest(range(0, length(seq), {FASTA_PIECE})) AS o FROM f1_sequence)""")
def src_fasta(fx):
    path = scratch_path(fx.spark, "fasta")
    header = F.concat(F.col("seq_id").cast("string"), F.lit(" "), F.col("lang"))
    noisy = fx.pieces.withColumn("text", F.regexp_replace(F.lower("text"), "(.{10})(?=.)", "$1 7"))
    writers.write_fasta(noisy, header, path)
    return readers.read_fasta_pieces(fx.spark, path, FASTA_PIECE).select("header", "offset", "text")


@query("src_sites", "SELECT matrix_id, CAST(seq_id AS VARCHAR) AS header, translate(site, 'T', 'N') AS site FROM f2_site")
def src_sites(fx):
    path = scratch_path(fx.spark, "sites")
    unknown = F.translate("site", "T", "X")
    # Several files per set, so that a large set is written by several tasks.
    records = fx.site.select(
        "matrix_id", writers.fasta_text(F.col("seq_id").cast("string"), unknown).alias("value"), (F.col("site_at") % 8).alias("_spread")
    )
    records.repartition("matrix_id", "_spread").drop("_spread").write.partitionBy("matrix_id").text(path)
    return readers.read_sites(fx.spark, path, r"/matrix_id=([^/]+)/[^/]*$")


view("f7_strings", """SELECT aln_id, string_agg(c1, '' ORDER BY apos) AS seq1, string_agg(c2, '' ORDER BY apos) AS seq2
    FROM f7_alignment GROUP BY 1""")


def alignment_strings(fx):
    """Both gapped strings of each alignment; an alignment has a bounded number of positions."""
    whole = runs.joined(fx.alignment, "aln_id", "apos", ["c1", "c2"], FRAME_ROWS, fx.kept.get("alignment_runs"))
    return whole.select(
        "aln_id",
        F.concat(F.lit("a"), F.col("aln_id").cast("string")).alias("name1"),
        F.col("c1").alias("seq1"),
        F.concat(F.lit("b"), F.col("aln_id").cast("string")).alias("name2"),
        F.col("c2").alias("seq2"),
    )


@query("src_alignment", """SELECT 'a' || CAST(aln_id AS VARCHAR) AS name1, seq1, 'b' || CAST(aln_id AS VARCHAR) AS name2, seq2
    FROM f7_strings""")
def src_alignment(fx):
    path = scratch_path(fx.spark, "alignment")
    dotted = alignment_strings(fx).withColumn("seq1", F.translate("seq1", "-", "."))
    writers.write_alignment(dotted, path)
    return readers.read_alignment(fx.spark, path)


@query("sink_alignment", """SELECT aln_id, CAST((apos-1)//60 AS INT) AS block_no, string_agg(c1, '' ORDER BY apos) AS row1,
    string_agg(c2, '' ORDER BY apos) AS row2 FROM f7_alignment GROUP BY 1,2""")
def sink_alignment(fx):
    return writers.alignment_rows(alignment_strings(fx)).select("aln_id", "block_no", "row1", "row2")


@query("src_seq_sizes", "SELECT CAST(seq_id AS VARCHAR) AS name, size FROM f6_size")
def src_seq_sizes(fx):
    path = scratch_path(fx.spark, "sizes")
    fx.size.select(F.concat_ws(" ", "seq_id", "size").alias("value")).write.text(path)
    return readers.read_seq_sizes(fx.spark, path)


@query("src_blocks", "SELECT * FROM f5_block")
def src_blocks(fx):
    path = scratch_path(fx.spark, "blocks")
    fx.block.write.csv(path, sep="\t")
    return readers.read_blocks(fx.spark, path)


@query("score_dist_io", f"""SELECT CAST(len1 AS INT) AS len1, CAST(len2 AS INT) AS len2, {r6('avg(score)+1e-9')} AS mean, {r6('stddev_pop(score)')} AS sd, count(*) AS n,
    {r6('min(score)')} AS min, {r6('max(score)')} AS max FROM pair_scores_both GROUP BY 1,2""")
def score_dist_io(fx):
    path = scratch_path(fx.spark, "scores")
    score_table(fx).write.csv(path, sep="\t")
    return readers.read_score_table(fx.spark, path)


@query("collections_dim", """SELECT collection, CAST(count(*) AS VARCHAR) || ' profiles' AS description,
    string_agg(DISTINCT base_id, ',' ORDER BY base_id) AS browse_keys, count(DISTINCT base_id) AS n_keys
    FROM f4_matrix GROUP BY 1""")
def collections_dim(fx):
    path = scratch_path(fx.spark, "collections")
    keys = fx.matrix.groupBy("collection").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("base_id")), ",").alias("keys")
    )
    entry = F.concat_ws(
        "\n",
        F.lit("# one sub-database"),
        F.lit("START_ENTRY"),
        F.concat(F.lit("COLLECTION\t"), "collection"),
        F.lit("DESCRIPTION\tsuperseded"),
        F.concat(F.lit("BROWSE_KEYS\t"), "keys"),
        F.concat(F.lit("DESCRIPTION\t"), F.col("n").cast("string"), F.lit(" profiles")),
        F.lit("END_ENTRY"),
    )
    keys.select(entry.alias("value")).write.text(path)
    return readers.read_collections(fx.spark, path).select(
        "collection", "description", F.array_join("browse_keys", ",").alias("browse_keys"),
        F.size("browse_keys").cast("bigint").alias("n_keys"),
    )


@query("src_id_list", "SELECT id, name FROM f4_matrix WHERE name IN (SELECT name FROM f4_matrix WHERE class_no = 7)")
def src_id_list(fx):
    path = scratch_path(fx.spark, "names")
    wanted = fx.matrix.where("class_no = 7").select(F.concat(F.lit("  "), "name", F.lit(" ")).alias("value"))
    wanted.write.text(path)
    return select_listed(fx.matrix, readers.read_id_list(fx.spark, path), "name").select("id", "name")


@query("sink_name_list", "SELECT DISTINCT name AS value FROM f4_matrix WHERE collection = 'PROMO'")
def sink_name_list(fx):
    path = scratch_path(fx.spark, "name-list")
    writers.write_names(fx.matrix.where("collection = 'PROMO'"), "name", path)
    return fx.spark.read.text(path)
