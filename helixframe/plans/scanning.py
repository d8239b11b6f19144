"""Sequence scanning and site set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import comparison as c, profiles as p, scanning as s
from helixframe.operators.profiles import BASES
from helixframe.plans.comparison import _pcc_sql, families
from helixframe.plans.profiles import counts
from helixframe.plans.registry import query, r6, view
from helixframe.session import cut_lineage, scratch_path
from helixframe.sources import readers, writers

PERCENT = 80
LEVELS = (100, 95, 90, 85, 80, 75, 70, 65, 60)

view("v_letters", """SELECT seq_id, pos, c1, """ + ", ".join(
    f"lead(c1,{j - 1}) OVER (PARTITION BY seq_id ORDER BY pos) AS c{j}" for j in range(2, 13))
    + """ FROM (SELECT seq_id, pos, CAST(strpos('ACGT', substr(seq, CAST(pos AS INT), 1)) AS INT) AS c1
      FROM (SELECT seq_id, seq, unnest(range(1,length(seq)+1)) AS pos FROM f1_sequence))""")


def scan_views(tag, cells):
    """Oracle of a scan with the integer cells ``(matrix_id, pos, a, c, g, t)`` of the view ``cells``."""
    view(f"{tag}_lib", f"""SELECT matrix_id, 1 AS strand, w, lo, hi, {", ".join(f"l{j}" for j in range(1, 13))} FROM
        (SELECT matrix_id, max(pos) AS w, sum(least(a,c,g,t)) AS lo, sum(greatest(a,c,g,t)) AS hi,
        {", ".join(f"max(CASE WHEN pos={j} THEN [a,c,g,t] END) AS l{j}" for j in range(1, 13))} FROM {cells} GROUP BY 1)
        UNION ALL SELECT matrix_id, -1 AS strand, w, lo, hi, {", ".join(f"l{j}" for j in range(1, 13))} FROM
        (SELECT matrix_id, max(w) AS w, sum(least(a,c,g,t)) AS lo, sum(greatest(a,c,g,t)) AS hi,
        {", ".join(f"max(CASE WHEN w+1-pos={j} THEN [t,g,c,a] END) AS l{j}" for j in range(1, 13))}
        FROM (SELECT *, max(pos) OVER (PARTITION BY matrix_id) AS w FROM {cells}) GROUP BY 1)""")
    total = "+".join(f"CASE WHEN w>={j} THEN l{j}[c{j}] ELSE 0 END" for j in range(1, 13))
    whole = "CASE w " + " ".join(f"WHEN {j} THEN c{j}" for j in range(1, 13)) + " END"
    view(f"{tag}_score", f"""SELECT seq_id, pos, matrix_id, strand, w, lo, hi, CAST({total} AS BIGINT) AS s
        FROM v_letters, {tag}_lib WHERE {whole} IS NOT NULL""")


view("v_bg", "SELECT " + ", ".join(
    f"CAST(sum(length(seq)-length(replace(seq,'{b.upper()}',''))) AS DOUBLE)/sum(length(seq)) AS p{b}" for b in BASES) + " FROM f1_sequence")
view("v_spwm", "SELECT matrix_id, pos, " + ", ".join(f"log2(({b}+sqrt(w)*p{b})/(w+sqrt(w))/p{b}) AS {b}" for b in BASES) + " FROM f3_total, v_bg")
view("v_cells", "SELECT matrix_id, pos, " + ", ".join(f"CAST(round({b}*1000000) AS BIGINT) AS {b}" for b in BASES) + " FROM v_spwm")
scan_views("v_scan", "v_cells")
view("v_hit", f"""SELECT h.seq_id, matrix_id, pos AS start, pos+w-1 AS "end", strand, CAST(s AS DOUBLE)/1000000 AS score,
    CAST(s-lo AS DOUBLE)/CAST(hi-lo AS DOUBLE) AS rel_score, CASE WHEN strand=1 THEN substr(seq,CAST(pos AS INT),CAST(w AS INT))
    ELSE reverse(translate(substr(seq,CAST(pos AS INT),CAST(w AS INT)),'ACGT','TGCA')) END AS site
    FROM v_scan_score h JOIN f1_sequence q ON q.seq_id=h.seq_id WHERE (s-lo)*100>={PERCENT}*(hi-lo)""")


def pwm(fx):
    return p.scan_pwm(counts(fx), s.composition(fx.pieces))


def library(fx):
    if "library" not in fx.kept:
        fx.kept["library"] = cut_lineage(s.pack_pwm(pwm(fx)))
    return fx.kept["library"]


def hits(fx):
    """Scan of all sequences, written once and read by the site plans."""
    if "hits" not in fx.kept:
        fx.kept["hits"] = cut_lineage(s.scan(fx.pieces, library(fx), PERCENT))
    return fx.kept["hits"]


@query("seq_revcomp", "SELECT seq_id, reverse(translate(seq,'ACGT','TGCA')) AS rc FROM f1_sequence")
def seq_revcomp(fx):
    return fx.sequence.select("seq_id", s.revcomp(F.col("seq")).alias("rc"))


_HIT_SQL = f"""SELECT seq_id, matrix_id, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", CAST(strand AS INT) AS strand,
    {r6('score')} AS score, {r6('rel_score')} AS rel_score, site FROM v_hit"""


def _rounded_hits(df):
    return df.withColumn("score", F.round("score", 6)).withColumn("rel_score", F.round("rel_score", 6))


@query("scan_sequences", _HIT_SQL)
def scan_sequences(fx):
    found = s.scan(fx.pieces, library(fx), PERCENT)
    return _rounded_hits(found).orderBy("seq_id", "start", "matrix_id", "strand")


# A pasted log-odds matrix: whole numbers, widths as in the profile store.
view("v_user", "SELECT matrix_id, pos, " + ", ".join(f"CAST(round({b}*100)/100*1000000 AS BIGINT) AS {b}" for b in BASES)
     + " FROM v_spwm WHERE matrix_id=(SELECT min(matrix_id) FROM v_spwm)")
scan_views("v_uscan", "v_user")


@query("scan_user_matrix", f"""SELECT h.seq_id, CAST(pos AS BIGINT) AS start, CAST(strand AS INT) AS strand, {r6('CAST(s AS DOUBLE)/1000000')} AS score
    FROM v_uscan_score h WHERE (s-lo)*100>={PERCENT}*(hi-lo)""")
def scan_user_matrix(fx):
    matrices = pwm(fx)
    first = matrices.agg(F.min("matrix_id")).scalar()
    path = scratch_path(fx.spark, "user-matrix")
    pasted = matrices.where(F.col("matrix_id") == first).select(
        "matrix_id", "pos", *[(F.round(F.col(b) * 100) / 100).alias(b) for b in BASES]
    )
    writers.write_matrix_text(pasted, path)
    cells, _ = readers.read_matrix_text(fx.spark, path)
    found = s.scan(fx.pieces, s.pack_pwm(p.wide(cells)), PERCENT)
    return found.select("seq_id", "start", "strand", F.round("score", 6).alias("score"))


@query("hits_per_kb", f"""SELECT source, matrix_id, CAST(level AS INT) AS level, round(n*1000.0/letters, 1) AS per_kb FROM
    (SELECT source, matrix_id, level, count(*) AS n FROM v_scan_score h JOIN f1_sequence q USING (seq_id)
     JOIN (SELECT unnest([{",".join(map(str, LEVELS))}]) AS level) ON (s-lo)*100>=level*(hi-lo) GROUP BY ALL)
    JOIN (SELECT source, CAST(sum(length(seq)) AS DOUBLE) AS letters FROM f1_sequence GROUP BY 1) USING (source)""")
def hits_per_kb(fx):
    return s.hits_per_kb(s.count_hits(fx.pieces, library(fx), LEVELS), fx.pieces, "source")


view("v_word", "SELECT matrix_id, string_agg(letter, '' ORDER BY pos) AS word FROM v_letter GROUP BY 1")
view("v_wordcells", "SELECT matrix_id, CAST(pos AS INT) AS pos, " + ", ".join(
    "CASE WHEN contains('" + "".join(k for k, v in s.WORD_LETTERS.items() if b.upper() in v)
    + f"', substr(word, CAST(pos AS INT), 1)) THEN 1 ELSE 0 END AS {b}" for b in BASES)
    + " FROM (SELECT matrix_id, word, unnest(range(1,length(word)+1)) AS pos FROM v_word)")
scan_views("v_wscan", "v_wordcells")


def words(fx):
    return p.consensus(counts(fx)).withColumnRenamed("consensus", "word")


def word_library(fx):
    """Written once: a scan reads its library several times."""
    if "word_library" not in fx.kept:
        fx.kept["word_library"] = cut_lineage(s.pack_words(words(fx)))
    return fx.kept["word_library"]


@query("consensus_scan", "SELECT seq_id, matrix_id, count(*) AS n FROM v_wscan_score WHERE strand=1 AND s=w GROUP BY ALL")
def consensus_scan(fx):
    found = s.count_hits(fx.pieces, word_library(fx), (100,), both_strands=False)
    return found.select("seq_id", "matrix_id", "n")


view("v_pairmean", """SELECT a, b, fwd, i-j AS diag, CAST(floor(sum(sc)/CAST(least(w1,w2) AS DOUBLE)) AS BIGINT) AS m FROM
    (SELECT x.matrix_id AS a, y.matrix_id AS b, x.fwd, x.w AS w1, y.w AS w2, x.pos AS i, y.pos AS j,
       CAST(round((""" + _pcc_sql("x.", "y.") + """)*1000000) AS BIGINT) AS sc FROM v_full_turn x JOIN v_full_prof y ON x.matrix_id<y.matrix_id)
    GROUP BY a, b, fwd, i-j, w1, w2 HAVING count(*)=least(w1,w2)""")
view("v_annot", """SELECT a, b, max(m)/1000000.0 AS score FROM v_pairmean GROUP BY 1,2""")


@query("cross_collection_annotation", f"""SELECT a, b, {r6('score')} AS score FROM
    (SELECT a, b, score FROM v_annot UNION ALL SELECT b, a, score FROM v_annot) v
    JOIN v_family x ON x.matrix_id=a JOIN v_family y ON y.matrix_id=b
    WHERE x.family<>y.family AND score>0.8 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b)=1""")
def cross_collection_annotation(fx):
    pairs = c.pair_up(c.pack(counts(fx)), include_self=False)
    scored = c.mirror(c.align_pairs(pairs, "contained", "pcc"))
    of = families(fx).select("matrix_id", "family")
    other = scored.join(of.toDF("a", "fa"), "a").join(of.toDF("b", "fb"), "b").where("fa <> fb AND score > 0.8")
    return c.nearest(other).select("a", "b", F.round("score", 6).alias("score"))


@query("site_counts", "SELECT matrix_id, site, count(*) AS n FROM f2_site GROUP BY 1,2")
def site_counts(fx):
    return s.site_counts(fx.site)


view("v_flanked", """SELECT matrix_id, seq_id, lower(substr(site,1,CAST(seq_id%3 AS INT))) || substr(site,CAST(seq_id%3 AS INT)+1,4)
    || lower(substr(site,CAST(seq_id%3 AS INT)+5)) AS site FROM f2_site""")
view("v_flank", """SELECT matrix_id, seq_id, regexp_extract(site,'^([acgt]*)([ACGT]*)([acgt]*)$',1) AS f5,
    regexp_extract(site,'^([acgt]*)([ACGT]*)([acgt]*)$',2) AS core, regexp_extract(site,'^([acgt]*)([ACGT]*)([acgt]*)$',3) AS f3 FROM v_flanked""")


@query("site_flank_split", """SELECT matrix_id, seq_id, lpad(f5,w,' ') AS flank5, core, rpad(f3,w,' ') AS flank3 FROM
    (SELECT *, CAST(max(greatest(length(f5),length(f3))) OVER (PARTITION BY matrix_id)+5 AS INT) AS w FROM v_flank)""")
def site_flank_split(fx):
    skip = (F.col("seq_id") % 3).cast("int")
    mixed = F.concat(
        F.lower(F.substring(F.col("site"), F.lit(1), skip)),
        F.substring(F.col("site"), skip + 1, F.lit(4)),
        F.lower(F.substring(F.col("site"), skip + 5, F.lit(99))),
    )
    flanked = fx.site.select("matrix_id", "seq_id", mixed.alias("site"))
    return s.split_flanks(flanked).select("matrix_id", "seq_id", "flank5", "core", "flank3")


@query("missing_sites_flag", """SELECT matrix_id FROM (SELECT 'src' || CAST(id AS VARCHAR) AS matrix_id FROM f4_matrix)
    WHERE matrix_id NOT IN (SELECT matrix_id FROM f2_site)""")
def missing_sites_flag(fx):
    catalogue = fx.matrix.select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("matrix_id"))
    return s.without_sites(catalogue, fx.site)


view("v_region", """SELECT h.*, coalesce(r.region,0) AS region FROM v_hit h LEFT JOIN
    (SELECT seq_id, pos, max(CASE kind WHEN 'orf' THEN 2 ELSE 1 END) AS region FROM
      (SELECT DISTINCT seq_id, start AS pos FROM v_hit) x JOIN f10_feature f USING (seq_id)
     WHERE kind IN ('exon','orf') AND pos BETWEEN f_start AND f_end GROUP BY 1,2) r ON r.seq_id=h.seq_id AND r.pos=h.start""")


@query("site_region_class", """SELECT seq_id, matrix_id, CAST(start AS BIGINT) AS start, CAST(strand AS INT) AS strand, CAST(region AS INT) AS region FROM v_region""")
def site_region_class(fx):
    return s.region_class(hits(fx), fx.feature).select("seq_id", "matrix_id", "start", "strand", "region")


@query("exclude_coding_hits", """SELECT seq_id, matrix_id, CAST(start AS BIGINT) AS start, CAST(strand AS INT) AS strand FROM v_region WHERE region<>2""")
def exclude_coding_hits(fx):
    return s.exclude_coding(hits(fx), fx.feature).select("seq_id", "matrix_id", "start", "strand")


@query("hits_in_view", """SELECT seq_id, matrix_id, CAST(start AS BIGINT) AS start, CAST(strand AS INT) AS strand FROM v_hit WHERE start>=100 AND start<300""")
def hits_in_view(fx):
    return s.in_view(hits(fx), 100, 300).select("seq_id", "matrix_id", "start", "strand")


@query("strand_coordinates", """SELECT h.seq_id, matrix_id, CAST(start AS BIGINT) AS start, CAST(strand AS INT) AS strand,
    CAST(CASE WHEN h.seq_id%2=1 THEN length(seq)-start+1 ELSE start END AS BIGINT) AS given_pos,
    CAST(CASE WHEN h.seq_id%2=1 THEN -strand ELSE strand END AS INT) AS given_strand FROM v_hit h JOIN f1_sequence USING (seq_id)""")
def strand_coordinates(fx):
    turned = F.when(F.col("seq_id") % 2 == 1, -1).otherwise(1)
    found = s.scan(fx.pieces, library(fx), PERCENT, known=fx.letters).withColumn("seq_strand", turned)
    return found.select(
        "seq_id", "matrix_id", "start", "strand",
        s.original_position(F.col("start"), F.col("length"), F.col("seq_strand")).alias("given_pos"),
        s.original_sign(F.col("strand"), F.col("seq_strand")).alias("given_strand"),
    )


@query("site_sensitivity", f"""SELECT count(*) AS known, CAST(sum(CASE WHEN found THEN 1 ELSE 0 END) AS BIGINT) AS found,
    {r6('avg(CASE WHEN found THEN 1.0 ELSE 0.0 END)')} AS share FROM (SELECT EXISTS (SELECT 1 FROM v_hit h WHERE h.seq_id=k.seq_id
      AND h.matrix_id=k.matrix_id AND h.start<k.site_at+length(k.site) AND h."end">=k.site_at) AS found FROM f2_site k)""")
def site_sensitivity(fx):
    known = fx.site.select(
        "seq_id", "matrix_id", F.col("site_at").alias("k_start"), (F.col("site_at") + F.length("site") - 1).alias("k_end")
    )
    return s.sensitivity(known, hits(fx)).withColumn("share", F.round("share", 6))
