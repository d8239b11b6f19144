"""Profile queries: arithmetic, information, consensus, permutations, statistics, mixture prior."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import mixture, profiles as p
from helixframe.operators.profiles import BASES
from helixframe.plans.registry import query, r6, view

view("f3_total", "SELECT *, a+c+g+t AS w FROM f3_wide")
view("v_freq", "SELECT matrix_id, pos, " + ", ".join(f"({b}+0.001*0.25)/(w+0.001) AS {b}" for b in BASES) + " FROM f3_total")
view("v_pwm", "SELECT matrix_id, pos, " + ", ".join(f"log2({b}/0.25) AS {b}" for b in BASES) + " FROM v_freq")
view("v_share", "SELECT matrix_id, pos, " + ", ".join(f"{b}/w AS {b}" for b in BASES) + " FROM f3_total")
view("v_ic", "SELECT matrix_id, pos, 2+" + "+".join(f"CASE WHEN {b}>0 THEN {b}*log2({b}) ELSE 0 END" for b in BASES)
     + " AS ic FROM v_share")


def _rounded(df):
    return df.select("matrix_id", "pos", *[F.round(b, 6).alias(b) for b in BASES])


def _sql(name):
    return "SELECT matrix_id, pos, " + ", ".join(f"{r6(b)} AS {b}" for b in BASES) + f" FROM {name}"


def counts(fx):
    return p.wide(fx.cell)


@query("profile_from_aligned", f"""SELECT matrix_id, pos, base, {r6('n/g.size')} AS freq, {r6('n/t.size')} AS freq_overall
    FROM f3_cell JOIN (SELECT matrix_id, count(*) AS size FROM f2_site GROUP BY 1) g USING (matrix_id)
    CROSS JOIN (SELECT count(*) AS size FROM f2_site) t""")
def profile_from_aligned(fx):
    return p.profile_from_aligned(fx.site, "matrix_id", "site").select(
        "matrix_id", "pos", "base", F.round("freq", 6).alias("freq"), F.round("freq_overall", 6).alias("freq_overall")
    )


@query("matrix_normalise", _sql("v_share"))
def matrix_normalise(fx):
    return _rounded(p.normalise(counts(fx)))


@query("matrix_pseudo_freq", _sql("v_freq"))
def matrix_pseudo_freq(fx):
    return _rounded(p.pseudo_frequencies(counts(fx)))


@query("matrix_pwm", _sql("v_pwm"))
def matrix_pwm(fx):
    return _rounded(p.log_odds(p.pseudo_frequencies(counts(fx))))


@query("freq_to_counts", "SELECT matrix_id, pos, " + ", ".join(f"CAST(floor({b}*30) AS DOUBLE) AS {b}" for b in BASES) + " FROM v_freq")
def freq_to_counts(fx):
    return p.counts_of(p.pseudo_frequencies(counts(fx)))


@query("column_ic", f"SELECT matrix_id, pos, {r6('ic')} AS ic FROM v_ic")
def column_ic(fx):
    return p.column_ic(counts(fx)).withColumn("ic", F.round("ic", 6))


@query("matrix_total_ic", f"SELECT matrix_id, {r6('sum(ic)')} AS total_ic FROM v_ic GROUP BY 1")
def matrix_total_ic(fx):
    return p.total_ic(counts(fx)).withColumn("total_ic", F.round("total_ic", 6))


view("v_residue", """SELECT member, pos, res, CAST(count(*) AS DOUBLE) AS n FROM
    (SELECT member, CAST(i AS INT) AS pos, substr(aligned, CAST(i AS INT), 1) AS res FROM f12_protein, range(1,11) r(i)
     WHERE i<=length(aligned)) GROUP BY 1,2,3""")
view("v_residue_ic", """SELECT member, pos, log2(20.0)+sum(n/w*log2(n/w)) AS ic FROM
    (SELECT *, sum(n) OVER (PARTITION BY member,pos) AS w FROM v_residue) GROUP BY 1,2""")


@query("protein_column_ic", f"SELECT member, pos, {r6('ic')} AS ic FROM v_residue_ic")
def protein_column_ic(fx):
    return p.residue_information(p.residue_counts(fx.protein, "member", "aligned"), "member").withColumn("ic", F.round("ic", 6))


view("v_letter", """SELECT matrix_id, pos, CASE WHEN a>=0.6 THEN 'A' WHEN c>=0.6 THEN 'C' WHEN g>=0.6 THEN 'G' WHEN t>=0.6 THEN 'T'
    WHEN best<0.8 THEN 'N' WHEN a+c=best THEN 'M' WHEN g+t=best THEN 'K' WHEN c+g=best THEN 'S' WHEN a+t=best THEN 'W'
    WHEN a+g=best THEN 'R' ELSE 'Y' END AS letter FROM
    (SELECT *, greatest(a+c,g+t,c+g,a+t,a+g,c+t) AS best FROM
      (SELECT matrix_id, pos, round(a,12) AS a, round(c,12) AS c, round(g,12) AS g, round(t,12) AS t FROM v_share))""")


@query("consensus_iupac", "SELECT matrix_id, string_agg(letter, '' ORDER BY pos) AS consensus FROM v_letter GROUP BY 1")
def consensus_iupac(fx):
    return p.consensus(counts(fx))


view("v_width", "SELECT matrix_id, max(pos) AS w FROM f3_cell GROUP BY 1")


@query("matrix_revcomp", """SELECT matrix_id, CAST(w+1-pos AS INT) AS pos, t AS a, g AS c, c AS g, a AS t
    FROM f3_wide JOIN v_width USING (matrix_id)""")
def matrix_revcomp(fx):
    return p.reverse_complement(counts(fx))


view("v_range", """SELECT matrix_id, sum(least(a,c,g,t)) AS min_score, sum(greatest(a,c,g,t)) AS max_score FROM v_pwm GROUP BY 1""")


@query("matrix_min_max_score", f"SELECT matrix_id, {r6('min_score')} AS min_score, {r6('max_score')} AS max_score FROM v_range")
def matrix_min_max_score(fx):
    found = p.score_range(p.log_odds(p.pseudo_frequencies(counts(fx))))
    return found.select("matrix_id", F.round("min_score", 6).alias("min_score"), F.round("max_score", 6).alias("max_score"))


@query("relative_score", """SELECT matrix_id, seq_id, site_at, CAST(floor((score-min_score)/(max_score-min_score)*100+0.5) AS INT) AS rel
    FROM (SELECT matrix_id, seq_id, site_at, sum(CASE substr(site,pos,1) WHEN 'A' THEN a WHEN 'C' THEN c WHEN 'G' THEN g ELSE t END) AS score
      FROM f2_site JOIN v_pwm USING (matrix_id) GROUP BY 1,2,3) JOIN v_range USING (matrix_id)""")
def relative_score(fx):
    pwm = p.log_odds(p.pseudo_frequencies(counts(fx)))
    letters = fx.site.select("matrix_id", "seq_id", "site_at", F.posexplode(F.split("site", "")).alias("i", "base"))
    cells = p.long(pwm, "s")
    scored = (
        letters.withColumn("pos", F.col("i") + 1)
        .join(cells, ["matrix_id", "pos", "base"])
        .groupBy("matrix_id", "seq_id", "site_at")
        .agg(F.sum("s").alias("score"))
    )
    rel = p.relative_score(F.col("score"), F.col("min_score"), F.col("max_score"))
    return scored.join(p.score_range(pwm), "matrix_id").select("matrix_id", "seq_id", "site_at", rel.alias("rel"))


@query("matrix_concat", """SELECT matrix_id, pos, CAST(row_number() OVER (ORDER BY CAST(substr(matrix_id,4) AS INT) DESC, pos)-1 AS INT) AS new_pos
    FROM f3_wide""")
def matrix_concat(fx):
    order = fx.site.select("matrix_id", (-F.substring("matrix_id", 4, 10).cast("int")).alias("sel_order")).distinct()
    return p.concat_matrices(counts(fx), order).select("matrix_id", "pos", "new_pos")


@query("permute_columns_intra", """SELECT matrix_id, CAST(row_number() OVER (PARTITION BY matrix_id
    ORDER BY md5('11:'||matrix_id||':'||CAST(pos AS VARCHAR)), pos) AS INT) AS pos, a, c, g, t FROM f3_wide""")
def permute_columns_intra(fx):
    return p.permute_within(counts(fx), 11)


@query("permute_columns_inter", """SELECT s.matrix_id, s.pos, d.a, d.c, d.g, d.t FROM
    (SELECT matrix_id, pos, row_number() OVER (ORDER BY matrix_id, pos) AS rn FROM f3_wide) s JOIN
    (SELECT *, row_number() OVER (ORDER BY md5('11:'||matrix_id||':'||CAST(pos AS VARCHAR)), matrix_id, pos) AS rn FROM f3_wide) d
    USING (rn)""")
def permute_columns_inter(fx):
    return p.permute_across(counts(fx), 11)


def trim_views(tag, source, min_len):
    view(f"{tag}_ic", f"""SELECT m.*, round(2+{"+".join(f"CASE WHEN {b}>0 THEN {b}/(a+c+g+t)*log2({b}/(a+c+g+t)) ELSE 0 END" for b in BASES)},9) AS ic,
        max(pos) OVER (PARTITION BY matrix_id) AS w FROM {source} m""")
    view(f"{tag}_best", f"""SELECT matrix_id, arg_max(pos, (win, -pos)) AS first FROM
        (SELECT matrix_id, pos, w, round(sum(ic) OVER (PARTITION BY matrix_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {min_len - 1} FOLLOWING),9) AS win
         FROM {tag}_ic) WHERE pos<=w-{min_len} AND win>0 GROUP BY 1""")
    view(f"{tag}", f"""SELECT matrix_id, pos, a, c, g, t FROM (SELECT i.*,
        CASE WHEN w<={min_len} OR first IS NULL THEN 1 ELSE first END AS f,
        CASE WHEN w<={min_len} THEN w+1 WHEN first IS NULL THEN w ELSE first+{min_len} END AS s,
        min(CASE WHEN ic<0.4 THEN 1 ELSE 0 END) OVER (PARTITION BY matrix_id ORDER BY pos) AS lrun,
        min(CASE WHEN ic<0.4 THEN 1 ELSE 0 END) OVER (PARTITION BY matrix_id ORDER BY pos DESC) AS rrun
        FROM {tag}_ic i LEFT JOIN {tag}_best USING (matrix_id)) WHERE NOT (pos<f AND lrun=1) AND NOT (pos>=s AND rrun=1)""")


trim_views("v_trim", "f3_wide", 4)


@query("trim_low_ic_edges", "SELECT matrix_id, pos, a, c, g, t FROM v_trim")
def trim_low_ic_edges(fx):
    return p.trim_edges(counts(fx), 4)


def _bins(value, edges):
    cases = " ".join(f"WHEN {value}>={e} THEN {e}" for e in reversed(edges[:-1]))
    return f"CASE WHEN {value}>={edges[-1]} THEN NULL {cases} END"


@query("width_histogram", f"""SELECT CAST(bin AS INT) AS bin, count(*) AS n FROM
    (SELECT {_bins('w', p.WIDTH_EDGES)} AS bin FROM v_width) WHERE bin IS NOT NULL GROUP BY 1""")
def width_histogram(fx):
    return p.width_histogram(counts(fx))


@query("depth_histogram", f"""SELECT kind, CAST(bin AS INT) AS bin, CAST(count(*) AS DOUBLE) AS value FROM
    (SELECT 'coarse' AS kind, {_bins('w', p.DEPTH_EDGES)} AS bin FROM f3_total
     UNION ALL SELECT 'unit', CASE WHEN w>50 THEN 50 ELSE floor(w) END FROM f3_total) WHERE bin IS NOT NULL GROUP BY 1,2
    UNION ALL SELECT 'average', NULL, {r6('avg(m)')} FROM (SELECT matrix_id, avg(w) AS m FROM f3_total GROUP BY 1)""")
def depth_histogram(fx):
    return p.depth_histogram(counts(fx)).withColumn("value", F.round("value", 6))


view("v_edge", """SELECT t.*, CAST(least(pos-1, v.w-pos, 5) AS INT) AS edge_class,
    CAST(a=0 AS INT)+CAST(c=0 AS INT)+CAST(g=0 AS INT)+CAST(t=0 AS INT) AS z FROM f3_total t JOIN v_width v USING (matrix_id)""")


@query("edge_class_stats", f"""SELECT edge_class, {r6('avg(CASE WHEN z=3 THEN 1.0 ELSE 0.0 END)')} AS invariant_share,
    {r6('sum(CASE WHEN z<3 THEN z ELSE 0 END)/sum(CASE WHEN z<3 THEN 4.0 ELSE 0 END)')} AS zero_share FROM v_edge GROUP BY 1""")
def edge_class_stats(fx):
    return p.edge_class_stats(counts(fx)).select(
        "edge_class", F.round("invariant_share", 6).alias("invariant_share"), F.round("zero_share", 6).alias("zero_share")
    )


@query("conditional_cell_hist", """WITH cells AS (SELECT e.matrix_id, e.pos, b.base, CASE b.base WHEN 'A' THEN a WHEN 'C' THEN c WHEN 'G' THEN g ELSE t END AS n,
      CASE WHEN edge_class=0 THEN 'edge' ELSE 'inner' END AS place, a+c+g+t AS total FROM v_edge e CROSS JOIN (SELECT unnest(['A','C','G','T']) AS base) b WHERE z<3),
    draws AS (SELECT place, 0 AS drawn, 0.0 AS given, n/total AS share FROM cells
      UNION ALL SELECT x.place, 1, x.n/x.total, y.n/x.total FROM cells x JOIN cells y ON x.matrix_id=y.matrix_id AND x.pos=y.pos AND x.base<>y.base
      UNION ALL SELECT x.place, 2, (x.n+y.n)/x.total, z.n/x.total FROM cells x JOIN cells y ON x.matrix_id=y.matrix_id AND x.pos=y.pos AND x.base<>y.base
        JOIN cells z ON x.matrix_id=z.matrix_id AND x.pos=z.pos AND z.base<>x.base AND z.base<>y.base)
    SELECT place, CAST(drawn AS INT) AS drawn, CAST(floor(given*5) AS INT) AS given_bin,
      CAST(floor((share-0.0001)/((CAST(0.99999 AS DOUBLE)-0.0001)/5)) AS INT) AS share_bin, count(*) AS n FROM draws
    WHERE share>=0.0001 AND share<0.99999 GROUP BY ALL""")
def conditional_cell_hist(fx):
    return p.conditional_cells(counts(fx))


view("v_mix", """SELECT CAST(row_number() OVER (ORDER BY lang)-1 AS INT) AS k, n/sum(n) OVER () AS pmix,
    0.5+10.0*na/l AS a_a, 0.5+10.0*nc/l AS a_c, 0.5+10.0*ng/l AS a_g, 0.5+10.0*nt/l AS a_t FROM
    (SELECT lang, count(*) AS n, sum(length(seq)) AS l, sum(length(seq)-length(replace(seq,'A',''))) AS na,
     sum(length(seq)-length(replace(seq,'C',''))) AS nc, sum(length(seq)-length(replace(seq,'G',''))) AS ng,
     sum(length(seq)-length(replace(seq,'T',''))) AS nt FROM f1_sequence GROUP BY lang)""")


def mixture_components(fx):
    """One component per language, from its letter composition."""
    from helixframe.operators.ordered import rank_rows

    per = fx.sequence.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length("seq")).alias("l"),
        *[F.sum(F.length("seq") - F.length(F.translate("seq", b.upper(), ""))).alias(f"n_{b}") for b in BASES],
    )
    whole = fx.sequence.agg(F.count(F.lit(1)).alias("whole"))
    return rank_rows(per, [], [F.col("lang")], "rn").select(
        (F.col("rn") - 1).cast("int").alias("k"),
        (F.col("n") / whole.scalar()).alias("pmix"),
        *[(F.lit(0.5) + F.lit(10.0) * F.col(f"n_{b}") / F.col("l")).alias(f"a_{b}") for b in BASES],
    )


@query("mixture_responsibility", f"""WITH lw AS (SELECT matrix_id, pos, k, ln(pmix)+lgamma(s)-lgamma(w+s)
      +lgamma(a+a_a)-lgamma(a_a)+lgamma(c+a_c)-lgamma(a_c)+lgamma(g+a_g)-lgamma(a_g)+lgamma(t+a_t)-lgamma(a_t) AS lw
      FROM f3_total CROSS JOIN (SELECT *, a_a+a_c+a_g+a_t AS s FROM v_mix)),
    top AS (SELECT *, max(lw) OVER (PARTITION BY matrix_id,pos) AS mx FROM lw),
    ll AS (SELECT *, mx+ln(sum(exp(lw-mx)) OVER (PARTITION BY matrix_id,pos)) AS ll FROM top)
    SELECT matrix_id, pos, k, {r6('exp(lw-ll)')} AS gamma, {r6('ll')} AS ll FROM ll""")
def mixture_responsibility(fx):
    found = mixture.responsibilities(counts(fx), mixture_components(fx))
    return found.select("matrix_id", "pos", "k", F.round("gamma", 6).alias("gamma"), F.round("ll", 6).alias("ll"))


@query("mixture_fit")
def mixture_fit(fx):
    start = [
        mixture.Component(r["pmix"], (r["a_a"], r["a_c"], r["a_g"], r["a_t"]))
        for r in sorted(mixture_components(fx).collect())
    ]
    mix, history = mixture.fit(counts(fx), start)
    rows = [(k, c.share, *c.alpha, history[-1]) for k, c in enumerate(mix)]
    schema = "k int, pmix double, a_a double, a_c double, a_g double, a_t double, ll double"
    return fx.spark.createDataFrame(rows, schema)
