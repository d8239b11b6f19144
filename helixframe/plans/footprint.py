"""Comparative footprint queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import footprint as f, pieces, scanning as s
from helixframe.operators.profiles import BASES
from helixframe.plans.registry import query, r6, view
from helixframe.plans.scanning import PERCENT, library, word_library
from helixframe.session import cut_lineage

view("v_idx", """SELECT *, CAST(CASE WHEN c1<>'-' THEN sum(CAST(c1<>'-' AS INT)) OVER (PARTITION BY aln_id ORDER BY apos) END AS INT) AS p1,
    CAST(CASE WHEN c2<>'-' THEN sum(CAST(c2<>'-' AS INT)) OVER (PARTITION BY aln_id ORDER BY apos) END AS INT) AS p2 FROM f7_alignment""")
for _n in (1, 2):
    view(f"v_cons{_n}", f"""SELECT aln_id, p{_n} AS pos, sum(CAST(upper(c1)=upper(c2) AS INT)) OVER
        (PARTITION BY aln_id ORDER BY p{_n} ROWS BETWEEN 24 PRECEDING AND 25 FOLLOWING)*100/50.0 AS conservation
        FROM v_idx WHERE p{_n} IS NOT NULL""")
view("v_cutoff", """SELECT aln_id, conservation AS cutoff FROM (SELECT *, row_number() OVER (PARTITION BY aln_id ORDER BY conservation) AS r,
    count(*) OVER (PARTITION BY aln_id) AS n FROM v_cons1) WHERE r=floor(n*0.9)+1""")


def alignment_runs(fx):
    """Written once; index and strings read them."""
    if "alignment_runs" not in fx.kept:
        fx.kept["alignment_runs"] = f.alignment_runs(fx.alignment, fx.alignment_made)
    return fx.kept["alignment_runs"]


def index(fx, places=False):
    return f.alignment_index(fx.alignment, alignment_runs(fx), places)


@query("alignment_index", "SELECT aln_id, apos, c1, c2, p1, p2 FROM v_idx")
def alignment_index(fx):
    return index(fx)


@query("strip_gaps", """SELECT aln_id, coalesce(string_agg(c1,'' ORDER BY apos) FILTER (c1<>'-'),'') AS seq1,
    coalesce(string_agg(c2,'' ORDER BY apos) FILTER (c2<>'-'),'') AS seq2 FROM f7_alignment GROUP BY 1""")
def strip_gaps(fx):
    from helixframe.plans.sources import alignment_strings

    return alignment_strings(fx).select(
        "aln_id", f.strip_gaps(F.col("seq1")).alias("seq1"), f.strip_gaps(F.col("seq2")).alias("seq2")
    )


def _points(fx):
    """Positions asked of the alignments: one per event."""
    return fx.table("events").select(
        F.col("event_id"), F.col("user_id").alias("aln_id"), (F.col("event_id") % 500 + 1).cast("int").alias("p1")
    )


view("v_points", "SELECT event_id, user_id AS aln_id, CAST(event_id%500+1 AS INT) AS p1 FROM events")


@query("coord_lookup", """SELECT event_id, p.aln_id, p.p1, i.p2 FROM v_points p LEFT JOIN v_idx i ON i.aln_id=p.aln_id AND i.p1=p.p1""")
def coord_lookup(fx):
    return f.lookup(_points(fx), index(fx, places="p2"), "p1", "p2").select("event_id", "aln_id", "p1", "p2")


@query("coord_lookup_asof", """SELECT aln_id, p1, coalesce(last_value(p2 IGNORE NULLS) OVER (PARTITION BY aln_id ORDER BY p1),1) AS lower,
    first_value(p2 IGNORE NULLS) OVER (PARTITION BY aln_id ORDER BY p1 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS higher
    FROM v_idx WHERE p1 IS NOT NULL""")
def coord_lookup_asof(fx):
    return f.nearest_mapped(index(fx), "p1", "p2")


@query("identity_marks", "SELECT aln_id, apos, CAST(upper(c1)=upper(c2) AS INT) AS match FROM f7_alignment")
def identity_marks(fx):
    return fx.alignment.select("aln_id", "apos", f.identity().alias("match"))


@query("conservation_profile", f"""SELECT 1 AS which, aln_id, pos, {r6('conservation')} AS conservation FROM v_cons1
    UNION ALL SELECT 2, aln_id, pos, {r6('conservation')} FROM v_cons2""")
def conservation_profile(fx):
    positions = index(fx)
    parts = [
        f.conservation(positions, 50, n).select(F.lit(n).alias("which"), "aln_id", "pos", F.round("conservation", 6).alias("conservation"))
        for n in (1, 2)
    ]
    return parts[0].unionByName(parts[1])


@query("conservation_cutoff", f"SELECT aln_id, {r6('cutoff')} AS cutoff FROM v_cutoff")
def conservation_cutoff(fx):
    return f.conservation_cutoff(f.conservation(index(fx))).withColumn("cutoff", F.round("cutoff", 6))


@query("conserved_regions", """SELECT aln_id, min(pos) AS r_start, max(pos) AS r_end FROM (SELECT aln_id, pos,
    pos-row_number() OVER (PARTITION BY aln_id ORDER BY pos) AS g FROM v_cons1 JOIN v_cutoff USING (aln_id) WHERE conservation>=cutoff) GROUP BY aln_id, g""")
def conserved_regions(fx):
    profile = f.conservation(index(fx))
    return f.conserved_regions(profile, f.conservation_cutoff(profile))


# Scan of both ungapped sequences of every alignment.
for _n in (1, 2):
    view(f"v_aletters{_n}", f"SELECT aln_id AS seq_id, pos, c1, " + ", ".join(
        f"lead(c1,{j - 1}) OVER (PARTITION BY aln_id ORDER BY pos) AS c{j}" for j in range(2, 13))
        + f" FROM (SELECT aln_id, p{_n} AS pos, CAST(strpos('ACGT', c{_n}) AS INT) AS c1 FROM v_idx WHERE p{_n} IS NOT NULL)")
_TOTAL = "+".join(f"CASE WHEN w>={j} THEN l{j}[c{j}] ELSE 0 END" for j in range(1, 13))
_WHOLE = "CASE w " + " ".join(f"WHEN {j} THEN c{j}" for j in range(1, 13)) + " END"
for _n in (1, 2):
    for _tag, _lib in (("v_ahit", "v_scan_lib"), ("v_aword", "v_wscan_lib")):
        view(f"{_tag}{_n}", f"""SELECT seq_id AS aln_id, pos AS start, pos+w-1 AS "end", matrix_id, strand, s FROM
            (SELECT seq_id, pos, matrix_id, strand, w, lo, hi, CAST({_TOTAL} AS BIGINT) AS s FROM v_aletters{_n}, {_lib} WHERE {_WHOLE} IS NOT NULL)
            WHERE (s-lo)*100>={PERCENT if _tag == 'v_ahit' else 100}*(hi-lo)""" + (" AND strand=1" if _tag == "v_aword" else ""))


def aligned_sequence(fx, which):
    from helixframe.plans.sources import alignment_strings

    if "strings" not in fx.kept:
        alignment_runs(fx)
        fx.kept["strings"] = cut_lineage(alignment_strings(fx).select("aln_id", "seq1", "seq2"))
    return fx.kept["strings"].select(F.col("aln_id").alias("seq_id"), f.strip_gaps(F.col(f"seq{which}")).alias("seq"))


def aligned_hits(fx, which):
    name = f"aligned_hits{which}"
    if name not in fx.kept:
        fx.kept[name] = s.scan(aligned_sequence(fx, which), library(fx), PERCENT).withColumnRenamed("seq_id", "aln_id")
    return fx.kept[name]


def pairs(fx):
    positions = index(fx)
    profile = f.conservation(positions)
    places = cut_lineage(index(fx, places=True))
    return f.paired_sites(aligned_hits(fx, 1), aligned_hits(fx, 2), positions, profile, f.conservation_cutoff(profile), places=places)


for _n in (1, 2):
    view(f"v_aplace{_n}", f"""SELECT h.*, i.apos, row_number() OVER (PARTITION BY h.aln_id, i.apos, matrix_id ORDER BY strand) AS rn
        FROM v_ahit{_n} h JOIN v_idx i ON i.aln_id=h.aln_id AND i.p{_n}=h.start""")
view("v_paired", """SELECT x.aln_id, x.apos, x.matrix_id, x.start AS start1, y.start AS start2, x."end" AS end1, y."end" AS end2,
    x.strand AS strand1, y.strand AS strand2, x.s AS s1, y.s AS s2
    FROM v_aplace1 x JOIN v_aplace2 y ON y.aln_id=x.aln_id AND y.apos=x.apos AND y.matrix_id=x.matrix_id AND y.rn=x.rn
    JOIN v_cons1 c ON c.aln_id=x.aln_id AND c.pos=x.start JOIN v_cutoff k ON k.aln_id=x.aln_id WHERE conservation>=cutoff""")


@query("paired_sites", """SELECT aln_id, apos, matrix_id, CAST(start1 AS BIGINT) AS start1, CAST(start2 AS BIGINT) AS start2,
    CAST(strand1 AS INT) AS strand1, CAST(strand2 AS INT) AS strand2 FROM v_paired""")
def paired_sites(fx):
    return pairs(fx).select("aln_id", "apos", "matrix_id", "start1", "start2", "strand1", "strand2")


@query("hit_pair_table", f"""SELECT p.aln_id, matrix_id, CAST(start1 AS BIGINT) AS start1, CAST(end1 AS BIGINT) AS end1, {r6('s1/1000000.0')} AS score1, CAST(strand1 AS INT) AS strand1,
    CAST(start2 AS BIGINT) AS start2, CAST(end2 AS BIGINT) AS end2, {r6('s2/1000000.0')} AS score2, CAST(strand2 AS INT) AS strand2,
    CAST(coalesce(region,0) AS INT) AS region FROM v_paired p LEFT JOIN (SELECT seq_id, pos, max(CASE kind WHEN 'orf' THEN 2 ELSE 1 END) AS region FROM
      (SELECT DISTINCT aln_id AS seq_id, start1 AS pos FROM v_paired) JOIN f10_feature f USING (seq_id)
      WHERE kind IN ('exon','orf') AND pos BETWEEN f_start AND f_end GROUP BY 1,2) r ON r.seq_id=p.aln_id AND r.pos=start1""")
def hit_pair_table(fx):
    # Written once: the lookup of regions and the final order read the pairs several times.
    flat = cut_lineage(pairs(fx).drop("site1", "site2")).withColumn("seq_id", F.col("aln_id")).withColumn("start", F.col("start1"))
    table = s.region_class(flat, fx.feature).select(
        "aln_id", "matrix_id", "start1", "end1", F.round("score1", 6).alias("score1"), "strand1",
        "start2", "end2", F.round("score2", 6).alias("score2"), "strand2", "region",
    )
    return table.orderBy("aln_id", "start1", "matrix_id")


@query("filtering_ratio", f"""SELECT (SELECT count(*) FROM v_paired) AS filtered, (SELECT count(*) FROM v_ahit1) AS single,
    {r6('(SELECT count(*) FROM v_paired)/CAST((SELECT count(*) FROM v_ahit1) AS DOUBLE)')} AS ratio""")
def filtering_ratio(fx):
    # The only hits that are read twice.
    fx.kept["aligned_hits1"] = cut_lineage(aligned_hits(fx, 1).select("aln_id", "matrix_id", "start", "end", "strand", "score", "site"))
    single = aligned_hits(fx, 1).agg(F.count(F.lit(1)))
    return pairs(fx).agg(F.count(F.lit(1)).alias("filtered")).withColumn("single", single.scalar()).select(
        "filtered", "single", F.round(F.col("filtered") / F.col("single"), 6).alias("ratio")
    )


@query("conservation_rate", f"""SELECT matrix_id, n, conserved, {r6('conserved/CAST(n AS DOUBLE)')} AS rate FROM
    (SELECT x.matrix_id, count(*) AS n, count(y.apos) AS conserved FROM
      (SELECT h.aln_id, h.matrix_id, i.apos FROM v_aword1 h JOIN v_idx i ON i.aln_id=h.aln_id AND i.p1=h.start) x LEFT JOIN
      (SELECT h.aln_id, h.matrix_id, i.apos FROM v_aword2 h JOIN v_idx i ON i.aln_id=h.aln_id AND i.p2=h.start) y
      ON y.aln_id=x.aln_id AND y.matrix_id=x.matrix_id AND y.apos=x.apos GROUP BY 1)""")
def conservation_rate(fx):
    positions = cut_lineage(index(fx, places=True))
    packed = word_library(fx)

    def occurrences(which):
        found = s.scan(aligned_sequence(fx, which), packed, 100, both_strands=False).select("seq_id", "matrix_id", "start")
        return f.placed(found, positions, which, "seq_id", "start").select("seq_id", "matrix_id", "apos")

    return s.conservation_rate(occurrences(1), occurrences(2)).withColumn("rate", F.round("rate", 6))


view("v_span", """SELECT aln_id, min(CASE WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN apos END) AS s,
    max(CASE WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN apos END) AS e, max(apos) AS n FROM v_idx GROUP BY 1""")


@query("overlap_span", """SELECT aln_id, CAST(greatest(ns,1) AS INT) AS view_start,
    CAST(least(CASE WHEN s IS NULL THEN n WHEN e-s<500 THEN floor(ns+(e-ns)/2.0+250) ELSE e END, n) AS INT) AS view_end FROM
    (SELECT *, CASE WHEN s IS NULL THEN 1 WHEN e-s<500 THEN floor(s+(e-s)/2.0-250) ELSE s END AS ns FROM v_span)""")
def overlap_span(fx):
    return f.overlap_span(index(fx))


@query("view_range", """SELECT q.aln_id, q.r_from, q.r_to, a.apos AS start_at, b.apos AS end_at FROM
    (SELECT r.*, least(greatest(least(r_from,r_to),1),n) AS s, least(greatest(greatest(r_from,r_to),1),n) AS e FROM
      (SELECT user_id AS aln_id, CAST(event_id%450-20 AS INT) AS r_from, CAST((event_id*7)%450-20 AS INT) AS r_to FROM events) r
      JOIN (SELECT aln_id, max(p1) AS n FROM v_idx GROUP BY 1) USING (aln_id)) q
    JOIN v_idx a ON a.aln_id=q.aln_id AND a.p1=s JOIN v_idx b ON b.aln_id=q.aln_id AND b.p1=e""")
def view_range(fx):
    asked = fx.table("events").select(
        F.col("user_id").alias("aln_id"), (F.col("event_id") % 450 - 20).cast("int").alias("r_from"),
        ((F.col("event_id") * 7) % 450 - 20).cast("int").alias("r_to"),
    )
    return f.view_range(asked, cut_lineage(index(fx, places=True)))


@query("alignment_blocks", """SELECT aln_id, CAST((apos-1)//60 AS INT) AS block, string_agg(CASE WHEN apos%10=0 THEN '+' ELSE ' ' END,'' ORDER BY apos) AS ruler,
    string_agg(c1,'' ORDER BY apos) AS row1, string_agg(CASE WHEN c1=c2 AND c1<>'-' THEN '|' ELSE ' ' END,'' ORDER BY apos) AS bars,
    string_agg(c2,'' ORDER BY apos) AS row2 FROM v_idx GROUP BY 1,2""")
def alignment_blocks(fx):
    return f.alignment_blocks(index(fx))


# ---- genes ------------------------------------------------------------------------------


@query("longest_orf", """SELECT seq_id AS cdna, f_start AS start, f_end AS "end", strand, f_end-f_start+1 AS length FROM f10_feature WHERE kind='orf'
    QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY f_end-f_start DESC, CASE WHEN strand=1 THEN f_start ELSE f_end END,
      CASE WHEN strand=1 THEN f_end ELSE f_start END)=1""")
def longest_orf(fx):
    forward = F.col("strand") == 1
    candidates = fx.feature.where("kind = 'orf'").select(
        F.col("seq_id").alias("cdna"),
        F.when(forward, F.col("f_start")).otherwise(F.col("f_end")).alias("o_from"),
        F.when(forward, F.col("f_end")).otherwise(F.col("f_start")).alias("o_to"),
    )
    return f.longest_orf(candidates)


@query("exon_table", """SELECT report, row_number() OVER (PARTITION BY report ORDER BY line_no) AS exon, g_start, g_end,
    CASE WHEN rev THEN 1000-c2+1 ELSE c1 END AS c_start, CASE WHEN rev THEN 1000-c1+1 ELSE c2 END AS c_end, CASE WHEN rev THEN -1 ELSE 1 END AS strand
    FROM (SELECT seq_id AS report, feature_id AS line_no, f_start AS g_start, f_end AS g_end, f_start+3 AS c1, f_end+3 AS c2, seq_id%4=0 AS rev, kind FROM f10_feature
      ) WHERE kind='exon'""")
def exon_table(fx):
    exon = F.concat_ws(" ", F.lit("Exon  99 100.0"), "f_start", "f_end", F.lit("chr"), F.col("f_start") + 3, F.col("f_end") + 3, F.lit("est"))
    lines = fx.feature.select(
        F.col("seq_id").alias("report"), F.col("feature_id").alias("line_no"),
        F.when(F.col("kind") == "exon", exon).otherwise("Span 1 2").alias("line"),
    )
    head = fx.feature.where("seq_id % 4 = 0").select(F.col("seq_id").alias("report")).distinct().select(
        "report", F.lit(-1).cast("bigint").alias("line_no"), F.lit("Note Best alignment is between reversed est and forward genome").alias("line")
    )
    return f.exon_table(lines.unionByName(head).withColumn("cdna_length", F.lit(1000).cast("bigint")))


view("v_exon", """SELECT gene, min(e_start) AS e_start, max(e_end) AS e_end FROM (SELECT *, sum(o) OVER (PARTITION BY gene ORDER BY e_start, e_end, id) AS g FROM
    (SELECT *, CASE WHEN e_start<=max(e_end) OVER (PARTITION BY gene ORDER BY e_start, e_end, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)+1 THEN 0 ELSE 1 END AS o
     FROM (SELECT seq_id AS gene, f_start AS e_start, f_end AS e_end, feature_id AS id FROM f10_feature WHERE kind='exon'))) GROUP BY gene, g""")


@query("orf_on_gene", """SELECT gene, CAST(e_start+greatest(o_start,c0+1)-c0-1 AS BIGINT) AS start, CAST(e_start+least(o_end,c0+n)-c0-1 AS BIGINT) AS "end" FROM
    (SELECT *, e_end-e_start+1 AS n, coalesce(sum(e_end-e_start+1) OVER (PARTITION BY gene ORDER BY e_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS c0 FROM v_exon)
    JOIN (SELECT seq_id AS gene, min(f_start) AS o_start, max(f_end) AS o_end FROM f10_feature WHERE kind='orf' GROUP BY 1) USING (gene)
    WHERE greatest(o_start,c0+1)<=least(o_end,c0+n)""")
def orf_on_gene(fx):
    from helixframe.operators.ranges import merge_intervals

    raw = fx.feature.where("kind = 'exon'").select(
        F.col("seq_id").alias("gene"), F.col("f_start").alias("e_start"), (F.col("f_end") + 1).alias("e_end")
    )
    exons = merge_intervals(raw, ["gene"], "e_start", "e_end").withColumn("e_end", F.col("e_end") - 1)
    orfs = fx.feature.where("kind = 'orf'").groupBy(F.col("seq_id").alias("gene")).agg(
        F.min("f_start").alias("o_start"), F.max("f_end").alias("o_end")
    )
    return f.orf_on_gene(exons, orfs)


def mappings(fx):
    return fx.feature.select(
        F.col("seq_id").alias("acc"), F.col("feature_id").alias("map_id"), "kind", F.col("f_start").alias("t_start"),
        F.col("f_end").alias("t_end"), "strand",
    )


@query("promoter_window", """SELECT feature_id AS map_id, '5prime' AS rel, CASE WHEN strand=-1 THEN f_end-100 ELSE f_start-500+1 END AS w_start,
    CASE WHEN strand=-1 THEN f_end+500-1 ELSE f_start+100 END AS w_end FROM f10_feature
    UNION ALL SELECT feature_id, '3prime', CASE WHEN strand=-1 THEN f_start-200 ELSE f_end+50 END, CASE WHEN strand=-1 THEN f_start-50 ELSE f_end+200 END FROM f10_feature""")
def promoter_window(fx):
    upstream = f.promoter_window(mappings(fx), -500, 100).withColumn("rel", F.lit("5prime"))
    tail = f.promoter_window(mappings(fx), 50, 200, "3prime").withColumn("rel", F.lit("3prime"))
    return upstream.unionByName(tail).select("map_id", "rel", "w_start", "w_end")


@query("transcription_start", "SELECT feature_id AS map_id, CASE WHEN strand=-1 THEN f_end ELSE f_start END AS tss FROM f10_feature")
def transcription_start(fx):
    return mappings(fx).select("map_id", f.transcription_start().alias("tss"))


view("v_first", """SELECT seq_id AS acc, feature_id AS map_id, kind, f_start AS t_start, f_end AS t_end, strand FROM f10_feature
    QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY f_start, feature_id)=1""")


@query("transcript_mapping", "SELECT acc, map_id, kind, t_start, t_end, strand FROM v_first")
def transcript_mapping(fx):
    return f.first_mapping(mappings(fx))


@query("fetch_genome_seq", """SELECT feature_id AS range_id, CASE WHEN strand=-1 THEN reverse(translate(sub,'ACGT','TGCA')) ELSE sub END AS seq FROM
    (SELECT feature_id, strand, substr(seq, CAST(f_start AS INT), CAST(f_end-f_start+1 AS INT)) AS sub, length(seq) AS n, f_start
     FROM f10_feature JOIN f1_sequence USING (seq_id)) WHERE f_start<=n""")
def fetch_genome_seq(fx):
    size = 128
    chunks = pieces.tiles(fx.pieces, 0, size).select("seq_id", F.floor(F.col("offset") / size).alias("chunk_no"), "text")
    lengths = pieces.lengths(fx.pieces)
    ranges = fx.feature.join(lengths, "seq_id").where("f_start <= n").select(
        F.col("feature_id").alias("range_id"), "seq_id", F.col("f_start").alias("start"), F.col("f_end").alias("end"), "strand"
    )
    return f.fetch_sequence(ranges, chunks, size)


@query("ortholog_pairs", """SELECT gene_id, count(*) FILTER (species='en') AS n1, count(*) FILTER (species='de') AS n2 FROM f9_gene
    WHERE species IN ('en','de') AND contains(lower(description),'er') AND contains(lower(description),'st') GROUP BY 1 HAVING n1>0 AND n2>0""")
def ortholog_pairs(fx):
    return f.ortholog_pairs(fx.gene, ["ER", "st"], "en", "de", "AND")


@query("transcripts_per_gene", """SELECT g.gene_id, g.acc, map_id, t_start, t_end, count(*) OVER (PARTITION BY g.gene_id) AS n_transcripts
    FROM f9_gene g LEFT JOIN v_first m ON m.acc=g.acc""")
def transcripts_per_gene(fx):
    return f.transcripts_per_gene(fx.gene, mappings(fx)).select("gene_id", "acc", "map_id", "t_start", "t_end", "n_transcripts")
