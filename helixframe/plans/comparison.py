"""Column metrics and profile-to-profile comparison queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from helixframe.functions import metrics as m
from helixframe.operators import comparison as c, profiles as p
from helixframe.operators.pairing import grid_pairs
from helixframe.operators.profiles import BASES
from helixframe.plans.profiles import counts
from helixframe.plans.registry import query, r6, view
from helixframe.session import cut_lineage

# ---- column metrics on neighbouring columns of a matrix ---------------------------------

view("v_next", "SELECT x.matrix_id, x.pos, " + ", ".join(
    f"x.{b} AS n1{b}, y.{b} AS n2{b}, fx.{b} AS f1{b}, fy.{b} AS f2{b}, wx.{b} AS w1{b}, wy.{b} AS w2{b}" for b in BASES)
    + """ FROM f3_wide x JOIN f3_wide y ON x.matrix_id=y.matrix_id AND y.pos=x.pos+1
    JOIN v_freq fx ON fx.matrix_id=x.matrix_id AND fx.pos=x.pos JOIN v_freq fy ON fy.matrix_id=x.matrix_id AND fy.pos=x.pos+1
    JOIN v_pwm wx ON wx.matrix_id=x.matrix_id AND wx.pos=x.pos JOIN v_pwm wy ON wy.matrix_id=x.matrix_id AND wy.pos=x.pos+1""")


def neighbours(fx):
    """Counts, frequencies and log-odds of each column and the next one of its matrix."""
    whole = p.total() + p.PSEUDO
    freq = {b: (F.col(b) + p.PSEUDO * 0.25) / whole for b in BASES}
    columns = counts(fx).select(
        "matrix_id", "pos", *[F.col(b).alias(f"n1{b}") for b in BASES], *[freq[b].alias(f"f1{b}") for b in BASES]
    ).withColumns({f"w1{b}": F.log2(F.col(f"f1{b}") / 0.25) for b in BASES})
    names = [f"{kind}1{b}" for kind in "nfw" for b in BASES]
    following = F.lead(F.struct(*[F.col(n).alias(n.replace("1", "2")) for n in names])).over(
        W.partitionBy("matrix_id").orderBy("pos")
    )
    return columns.withColumn("_next", following).where("_next IS NOT NULL").select("*", "_next.*").drop("_next")


def _cells(kind):
    return [F.col(kind + b) for b in BASES]


def _metric_plan(expression):
    return lambda fx: neighbours(fx).select("matrix_id", "pos", F.round(expression(), 6).alias("score"))


def _pcc_sql(x, y):
    """Pearson correlation of two 4-cell columns whose cell names start with x and y."""
    m1, m2 = "(" + "+".join(x + b for b in BASES) + ")/4", "(" + "+".join(y + b for b in BASES) + ")/4"
    num = "+".join(f"({x}{b}-{m1})*({y}{b}-{m2})" for b in BASES)
    d1 = "+".join(f"({x}{b}-{m1})*({x}{b}-{m1})" for b in BASES)
    d2 = "+".join(f"({y}{b}-{m2})*({y}{b}-{m2})" for b in BASES)
    return f"CASE WHEN ({num})=0 OR ({d1})*({d2})=0 THEN 0.0 ELSE ({num})/sqrt(({d1})*({d2})) END"


def _ssd_sql(x, y):
    return "2.0-(" + "+".join(f"({x}{b}-{y}{b})*({x}{b}-{y}{b})" for b in BASES) + ")"


_ALLR = ("(" + "+".join(f"n2{b}*w1{b}" for b in BASES) + "+" + "+".join(f"n1{b}*w2{b}" for b in BASES) + ")/("
         + "+".join(f"n1{b}+n2{b}" for b in BASES) + ")")
_KL = "10-(" + "+".join(
    f"CASE WHEN f1{b}=0 OR f2{b}=0 THEN 0 ELSE f1{b}*ln(f1{b}/f2{b})+f2{b}*ln(f2{b}/f1{b}) END" for b in BASES) + ")/2"
_T1, _T2 = "(" + "+".join(f"n1{b}" for b in BASES) + ")", "(" + "+".join(f"n2{b}" for b in BASES) + ")"
_CHI = "+".join(
    f"power(n1{b}+1-({_T1}+4)*(n1{b}+n2{b}+2)/({_T1}+{_T2}+8),2)/(({_T1}+4)*(n1{b}+n2{b}+2)/({_T1}+{_T2}+8))"
    f"+power(n2{b}+1-({_T2}+4)*(n1{b}+n2{b}+2)/({_T1}+{_T2}+8),2)/(({_T2}+4)*(n1{b}+n2{b}+2)/({_T1}+{_T2}+8))" for b in BASES)


def _metric_sql(expression):
    return f"SELECT matrix_id, pos, {r6(expression)} AS score FROM v_next"


def _upper_tail(x):
    """P(Z > x) for x >= 0 through the odd-factorial series, as a correlated sum over the term table."""
    return (f"0.5-(SELECT sum(exp((2*k+1)*ln(greatest({x},1e-300))-lf-({x})*({x})/2)) FROM v_series)/sqrt(2*pi())")


view("v_series", "SELECT k, (k+1)*ln(2.0)+lgamma(k+1.5)-0.5*ln(pi()) AS lf FROM (SELECT unnest(range(0,20000)) AS k)")

query("col_pcc", _metric_sql(_pcc_sql("f1", "f2")))(_metric_plan(lambda: m.pcc(_cells("f1"), _cells("f2"))))
query("col_allr", _metric_sql(_ALLR))(
    _metric_plan(lambda: m.allr(_cells("n1"), _cells("w1"), _cells("n2"), _cells("w2"))))
query("col_allr_ll", _metric_sql(f"greatest({_ALLR},-2)"))(
    _metric_plan(lambda: m.allr_ll(_cells("n1"), _cells("w1"), _cells("n2"), _cells("w2"))))
query("col_ssd", _metric_sql(_ssd_sql("f1", "f2")))(_metric_plan(lambda: m.ssd(_cells("f1"), _cells("f2"))))
query("col_kl", _metric_sql(_KL))(_metric_plan(lambda: m.kl(_cells("f1"), _cells("f2"))))
query("col_chi2", f"""SELECT matrix_id, pos, {r6("2*(" + _upper_tail("r") + ")+sqrt(2/pi())*r*exp(-r*r/2)")} AS score
    FROM (SELECT matrix_id, pos, sqrt({_CHI}) AS r FROM v_next)""")(
    _metric_plan(lambda: m.chi2(_cells("n1"), _cells("n2"))))


@query("column_score_histogram", f"""SELECT CAST(least(greatest(floor((s+3)/0.25),0),24) AS INT) AS bin, count(*) AS n FROM
    (SELECT round({_pcc_sql('x.', 'y.')},9) AS s FROM v_freq x JOIN v_freq y ON x.matrix_id<>y.matrix_id OR x.pos<>y.pos) GROUP BY 1""")
def column_score_histogram(fx):
    return c.column_histogram(p.pseudo_frequencies(counts(fx)), 0.25)


# ---- pairs ------------------------------------------------------------------------------


def pair_views(tag, source, score_sql):
    """Oracle of the ungapped pair alignment over the profile view ``source`` (matrix_id, pos, a, c, g, t)."""
    view(f"{tag}_prof", f"SELECT *, max(pos) OVER (PARTITION BY matrix_id) AS w FROM {source}")
    view(f"{tag}_turn", f"""SELECT matrix_id, true AS fwd, pos, a, c, g, t, w FROM {tag}_prof
        UNION ALL SELECT matrix_id, false, w+1-pos, t, g, c, a, w FROM {tag}_prof""")
    view(f"{tag}_cell", f"""SELECT x.matrix_id AS a, y.matrix_id AS b, x.fwd, x.w AS w1, y.w AS w2, x.pos AS i, y.pos AS j,
        CAST(round(({score_sql('x.', 'y.')})*1000000) AS BIGINT) AS s FROM {tag}_turn x JOIN {tag}_prof y ON x.matrix_id<=y.matrix_id""")
    view(f"{tag}_sum", f"""SELECT *, sum(s) OVER (PARTITION BY a,b,fwd,i-j ORDER BY i) AS ps FROM {tag}_cell""")
    view(f"{tag}_run", f"""SELECT *, ps-least(0, min(ps) OVER (PARTITION BY a,b,fwd,i-j ORDER BY i)) AS ms FROM {tag}_sum""")
    view(f"{tag}_len", f"""SELECT *, i-coalesce(max(CASE WHEN ms=0 THEN i END) OVER (PARTITION BY a,b,fwd,i-j ORDER BY i),
        greatest(i-j,0)) AS span FROM {tag}_run""")
    view(f"{tag}_top", f"""SELECT * FROM {tag}_len QUALIFY row_number() OVER (PARTITION BY a,b,fwd ORDER BY ms DESC, i, j)=1""")
    view(f"{tag}", f"""SELECT a, b, CAST(w1 AS INT) AS len1, CAST(w2 AS INT) AS len2, ms/1000000.0 AS score, fwd AS forward,
        CAST(CASE WHEN span=0 THEN 0 ELSE i-span+1 END AS INT) AS i1, CAST(CASE WHEN span=0 THEN 0 ELSE j-span+1 END AS INT) AS i2,
        CAST(span AS INT) AS span FROM {tag}_top QUALIFY row_number() OVER (PARTITION BY a,b ORDER BY ms DESC, fwd)=1""")


_TRIMMED = ("SELECT matrix_id, CAST(pos-min(pos) OVER (PARTITION BY matrix_id)+1 AS INT) AS pos, "
            + ", ".join(f"({b}+0.00025)/(a+c+g+t+0.001) AS {b}" for b in BASES) + " FROM v_trim")
view("v_core", _TRIMMED)
pair_views("v_pair", "v_core", _pcc_sql)
pair_views("v_full", "v_freq", _ssd_sql)
view("v_both", """SELECT a, b, len1, len2, score FROM v_pair UNION ALL SELECT b, a, len2, len1, score FROM v_pair WHERE a<>b""")
view("pair_scores_both", """SELECT least(greatest(len1,5),24) AS len1, least(greatest(len2,5),24) AS len2, score
    FROM v_both WHERE a<>b""")
view("v_dist", """SELECT len1, len2, avg(score) AS mean, stddev_pop(score) AS sd, count(*) AS n, min(score) AS low, max(score) AS high
    FROM pair_scores_both GROUP BY 1,2""")
view("v_z", """SELECT v.*, (score-coalesce(mean,0))/(CASE WHEN sd>0 THEN sd ELSE 1 END) AS z, coalesce(low,0.0) AS low FROM v_both v LEFT JOIN v_dist d
    ON least(greatest(v.len1,5),24)=d.len1 AND least(greatest(v.len2,5),24)=d.len2""")


def core_pairs(fx):
    """Ungapped alignment of all pairs of edge-trimmed profiles, materialised once per table folder."""
    if "core_pairs" not in fx.kept:
        packed = c.pack(p.trim_edges(counts(fx), 4))
        fx.kept["core_pairs"] = cut_lineage(c.align_pairs(c.pair_up(packed)).drop("path"))
    return fx.kept["core_pairs"]


def score_table(fx):
    # Scores are whole millionths, so a mean of few can lie between two; both engines then round up.
    found = c.score_distribution(core_pairs(fx))
    return found.select(
        "len1", "len2", F.round(F.col("mean") + 1e-9, 6).alias("mean"), F.round("sd", 6).alias("sd"), "n",
        F.round("min", 6).alias("min"), F.round("max", 6).alias("max"),
    )


def scored_pairs(fx):
    """All ordered pairs with their z."""
    return c.with_z(c.mirror(core_pairs(fx)), c.score_distribution(core_pairs(fx)))


@query("pair_ungapped_local", f"SELECT a, b, len1, len2, {r6('score')} AS score, forward, i1, i2, span FROM v_pair")
def pair_ungapped_local(fx):
    packed = c.pack(p.trim_edges(counts(fx), 4))
    return c.align_pairs(c.pair_up(packed)).select(
        "a", "b", "len1", "len2", F.round("score", 6).alias("score"), "forward", "i1", "i2", "span"
    )


@query("pair_gapped_align")
def pair_gapped_align(fx):
    pairs = c.pair_up(c.pack(counts(fx)))
    runs = [
        c.align_pairs(pairs, "scan", "ssd", gap_open=3.0, gap_extend=0.01).withColumn("method", F.lit("scan")),
        c.align_pairs(pairs, "sw", "pcc").withColumn("method", F.lit("sw")),
        c.align_pairs(pairs, "nw", "pcc").withColumn("method", F.lit("nw")),
        c.align_pairs(pairs, "swa", "pcc").withColumn("method", F.lit("swa")),
    ]
    every = runs[0].unionByName(runs[1]).unionByName(runs[2]).unionByName(runs[3])
    return every.select("method", "a", "b", F.round("score", 6).alias("score"), "forward", "i1", "i2", "span", "gaps")


@query("pair_best_orientation", """SELECT a, b, max(CASE WHEN fwd THEN ms END) > max(CASE WHEN NOT fwd THEN ms END) AS forward,
    round(max(ms)/1000000.0,6) AS score FROM v_full_top GROUP BY 1,2""")
def pair_best_orientation(fx):
    found = c.align_pairs(c.pair_up(c.pack(counts(fx))), "ungapped", "ssd")
    return found.select("a", "b", "forward", F.round("score", 6).alias("score"))


@query("pair_alignment_path")
def pair_alignment_path(fx):
    packed = c.pack(counts(fx))
    found = c.align_pairs(c.pair_up(packed), "swa", "pcc", paths=True)
    return c.path_strings(found, p.consensus(counts(fx)), p.consensus(p.reverse_complement(counts(fx)))).select(
        "a", "b", "forward", "gaps", F.size("path").alias("columns"), "row1", "row2"
    )


# Oracle of one profile against the library with one gap run: running sums P along the diagonals
# of every entry and orientation, also at the borders, where P is 0.  From a point (i, j) an
# alignment gains what P still rises to.  It gets there along its diagonal, out of a gap behind a
# point of the same row or column, or out of a gap from the border, which only pays extensions.
_OPEN, _EXTEND = 3_000_000, 10_000
view("v_lib_cell", f"""SELECT y.matrix_id AS b, y.fwd, x.w AS w1, y.w AS w2, x.pos AS i, y.pos AS j,
    CAST(round(({_ssd_sql('x.', 'y.')})*1000000) AS BIGINT) AS s
    FROM v_full_prof x JOIN v_full_turn y ON x.matrix_id=(SELECT min(matrix_id) FROM v_full_prof)""")
view("v_lib_point", """SELECT *, sum(s) OVER (PARTITION BY b,fwd,i-j ORDER BY i) AS p FROM (SELECT * FROM v_lib_cell
    UNION ALL SELECT DISTINCT b, fwd, w1, w2, i, 0, 0 FROM v_lib_cell UNION ALL SELECT DISTINCT b, fwd, w1, w2, 0, j, 0 FROM v_lib_cell
    UNION ALL SELECT DISTINCT b, fwd, w1, w2, 0, 0, 0 FROM v_lib_cell)""")
view("v_lib_start", f"""SELECT *, max(p) OVER (PARTITION BY b,fwd,i-j ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)-p AS gain,
    CASE WHEN i>0 AND j>0 THEN greatest(-{_EXTEND}*i, -{_EXTEND}*j,
      max(p+{_EXTEND}*i) OVER (PARTITION BY b,fwd,j ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)-{_OPEN}-{_EXTEND}*(i-1),
      max(p+{_EXTEND}*j) OVER (PARTITION BY b,fwd,i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)-{_OPEN}-{_EXTEND}*(j-1))
    END AS after_gap FROM v_lib_point""")
view("v_lib", """SELECT b, w1, w2, max(greatest(CASE WHEN i>0 AND j>0 THEN p END, after_gap, after_gap+gain))/1000000.0 AS score
    FROM v_lib_start GROUP BY 1,2,3""")


@query("compare_to_library", f"""SELECT (SELECT min(matrix_id) FROM v_full_prof) AS query, b AS target, {r6('score')} AS score,
    {r6('100*score/(2*least(w1,w2))')} AS pct FROM v_lib""")
def compare_to_library(fx):
    """One profile against every entry, gapped, with the library scanner's method."""
    library = c.pack(counts(fx))
    first = library.agg(F.min("matrix_id")).scalar()
    pairs = c.pair_up(library.where(F.col("matrix_id") == first), library)
    found = c.align_pairs(pairs, "scan", "ssd", gap_open=_OPEN / 1e6, gap_extend=_EXTEND / 1e6)
    percent = F.col("score") * 100 / (F.least("len1", "len2") * 2)
    return found.select(
        F.col("a").alias("query"), F.col("b").alias("target"), F.round("score", 6).alias("score"), F.round(percent, 6).alias("pct")
    ).orderBy(F.col("score").desc(), "query", "target")


@query("score_distribution", f"""SELECT CAST(len1 AS INT) AS len1, CAST(len2 AS INT) AS len2, {r6('mean+1e-9')} AS mean, {r6('sd')} AS sd, n,
    {r6('low')} AS min, {r6('high')} AS max FROM v_dist""")
def score_distribution(fx):
    return score_table(fx)


@query("score_z", f"SELECT a, b, {r6('score')} AS score, {r6('z')} AS z FROM v_z")
def score_z(fx):
    return scored_pairs(fx).select("a", "b", F.round("score", 6).alias("score"), F.round("z", 6).alias("z"))


view("v_p", f"""SELECT *, CASE WHEN z>=0 THEN 1-({_upper_tail('abs(z)')}) ELSE {_upper_tail('abs(z)')} END AS p FROM v_z""")


@query("score_p", f"SELECT a, b, {r6('p')} AS p, {r6('1-p')} AS e FROM v_p")
def score_p(fx):
    found = c.with_p(scored_pairs(fx))
    return found.select("a", "b", F.round("p", 6).alias("p"), F.round(1 - F.col("p"), 6).alias("e"))


@query("score_dist_transform", f"""SELECT v.a, v.b, {r6("-ln(CASE WHEN (s.score+t.score)/2=low THEN 1 WHEN (v.score-low)/((s.score+t.score)/2-low)<=0 THEN 0.001 ELSE (v.score-low)/((s.score+t.score)/2-low) END)")} AS dist
    FROM v_z v JOIN v_pair s ON s.a=v.a AND s.b=v.a JOIN v_pair t ON t.a=v.b AND t.b=v.b""")
def score_dist_transform(fx):
    own = core_pairs(fx).where("a = b").select("a", "score")
    joined = scored_pairs(fx).join(own.toDF("a", "self_a"), "a").join(own.toDF("b", "self_b"), "b")
    dist = c.transform_distance(F.col("score"), F.col("low"), (F.col("self_a") + F.col("self_b")) / 2)
    return joined.select("a", "b", F.round(dist, 6).alias("dist"))


@query("pairwise_table", f"SELECT a, b, {r6('score')} AS score, {r6('z')} AS z, {r6('p')} AS p, round(-ln(p),4)+0.0 AS dist FROM v_p")
def pairwise_table(fx):
    found = c.with_p(scored_pairs(fx))
    return found.select(
        "a", "b", F.round("score", 6).alias("score"), F.round("z", 6).alias("z"), F.round("p", 6).alias("p"),
        F.round(-F.log("p"), 4).alias("dist"),
    )


@query("pairwise_matrix_view", "SELECT a, " + ", ".join(
    f"""max(CASE WHEN b='src{i}' THEN CASE WHEN a=b THEN '-' ELSE printf('%.4f', round(1-p,4)+0.0) END END) AS src{i}""" for i in range(20))
    + " FROM v_p GROUP BY a")
def pairwise_matrix_view(fx):
    return c.grid_view(c.with_p(scored_pairs(fx)))


@query("similarity_top_k", f"""SELECT a, b, {r6('score')} AS score, CAST(rank AS INT) AS rank FROM
    (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(z,9) DESC, b) AS rank FROM v_z) WHERE rank<=5""")
def similarity_top_k(fx):
    found = c.top_matches(scored_pairs(fx).withColumn("z", F.round("z", 9)), 5)
    return found.select("a", "b", F.round("score", 6).alias("score"), "rank")


view("v_family", """SELECT matrix_id, CAST(substr(matrix_id,4) AS INT)%3 AS family, CAST(substr(matrix_id,4) AS INT)%4 AS cluster
    FROM v_width""")


def families(fx):
    """Family and cluster labels of the matrices, from the number in their name."""
    number = F.substring("matrix_id", 4, 10).cast("int")
    return fx.site.select("matrix_id").distinct().select(
        "matrix_id", (number % 3).alias("family"), (number % 4).alias("cluster")
    )


@query("nearest_family_accuracy", f"""SELECT {r6('avg(CASE WHEN x.family=y.family THEN 1.0 ELSE 0.0 END)')} AS accuracy,
    {r6('avg(CASE WHEN x.family=y.family THEN score END)')} AS mean_score
    FROM (SELECT * FROM v_both WHERE a<>b QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b)=1) n
    JOIN v_family x ON x.matrix_id=a JOIN v_family y ON y.matrix_id=b""")
def nearest_family_accuracy(fx):
    found = c.family_accuracy(c.mirror(core_pairs(fx)), families(fx))
    return found.select(F.round("accuracy", 6).alias("accuracy"), F.round("mean_score", 6).alias("mean_score"))


view("v_fp", """SELECT *, rn-tp AS fp, (rn-tp)/CAST(rn AS DOUBLE)*100 AS fp_rate FROM (SELECT id, score, label,
    row_number() OVER (ORDER BY score DESC, id) AS rn, CAST(sum(label) OVER (ORDER BY score DESC, id) AS BIGINT) AS tp FROM f11_scored)""")


@query("fp_rate_curve", f"""SELECT rn, tp, fp, {r6('fp_rate')} AS fp_rate,
    {r6('avg(fp_rate) OVER (ORDER BY rn ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)')} AS smooth, CAST(first.level AS DOUBLE) AS level
    FROM v_fp LEFT JOIN (SELECT min(rn) AS first_rn, max(level) AS level FROM (SELECT level, min(rn) AS rn FROM v_fp
      JOIN (SELECT unnest([0.1,0.5,1.0,5.0,10.0]) AS level) ON fp_rate>level GROUP BY level) GROUP BY rn) first ON rn=first_rn""")
def fp_rate_curve(fx):
    curve = cut_lineage(c.fp_curve(fx.scored, 20))
    first = c.first_past(curve).groupBy("rn").agg(F.max("level").alias("level"))
    return curve.join(first, "rn", "left").select(
        "rn", "tp", "fp", F.round("fp_rate", 6).alias("fp_rate"), F.round("smooth", 6).alias("smooth"), "level"
    )


view("v_member", "SELECT matrix_id, pos, a, c, g, t, cluster, family FROM v_freq JOIN v_family USING (matrix_id)")
view("v_cluster_profile", "SELECT cluster, pos, " + ", ".join(f"{b}/(a+c+g+t) AS {b}" for b in BASES)
     + " FROM (SELECT cluster, pos, " + ", ".join(f"sum({b}) AS {b}" for b in BASES) + " FROM v_member GROUP BY 1,2)")


def members(fx):
    """Profile columns with cluster and family labels; positions count as aligned."""
    return p.pseudo_frequencies(counts(fx)).join(families(fx), "matrix_id")


def cluster_profiles(fx):
    return c.weighted_profile(members(fx).withColumn("weight", F.lit(1.0)))


@query("nearest_profile_assign", f"""SELECT matrix_id, cluster, {r6('score')} AS score FROM
    (SELECT matrix_id, k.cluster, avg(round({_pcc_sql('m.', 'k.')},9)) AS score FROM v_freq m JOIN v_cluster_profile k USING (pos) GROUP BY 1,2)
    QUALIFY row_number() OVER (PARTITION BY matrix_id ORDER BY round(score,9) DESC, cluster)=1""")
def nearest_profile_assign(fx):
    found = c.assign_nearest(p.pseudo_frequencies(counts(fx)), cluster_profiles(fx))
    return found.select("matrix_id", "cluster", F.round("score", 6).alias("score"))


@query("profile_update", "SELECT cluster, pos, " + ", ".join(f"{r6(f'{b}/(a+c+g+t)')} AS {b}" for b in BASES)
       + " FROM (SELECT cluster, pos, " + ", ".join(f"sum({b}*w) AS {b}" for b in BASES) + """ FROM (
       SELECT cluster, pos, a, c, g, t, 1.0 AS w FROM v_cluster_profile
       UNION ALL SELECT cluster, pos, a, c, g, t, 0.1 FROM v_member
       UNION ALL SELECT cluster+1-2*(cluster%2), pos, a, c, g, t, 0.1/8 FROM v_member) GROUP BY 1,2)""")
def profile_update(fx):
    sibling = families(fx).select("cluster", (F.col("cluster") + 1 - F.col("cluster") % 2 * 2).alias("sibling")).distinct()
    return c.update_profiles(cluster_profiles(fx), members(fx), sibling).select(
        "cluster", "pos", *[F.round(b, 6).alias(b) for b in BASES]
    )
