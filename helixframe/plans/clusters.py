"""Clustering, merged profile and mutual information queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from helixframe.operators import clusters as k, comparison as c, profiles as p
from helixframe.operators.profiles import BASES
from helixframe.plans.comparison import _pcc_sql, cluster_profiles, core_pairs, families, members, scored_pairs
from helixframe.plans.profiles import counts
from helixframe.plans.registry import query, r6, view
from helixframe.session import cut_lineage

# A tree over the parts in heap order: leaves n..2n-1, node i merges 2i and 2i+1 at step n-i.
view("v_tree", """SELECT CAST(p_partkey AS BIGINT) AS node, n-p_partkey AS step, 2*p_partkey AS l, 2*p_partkey+1 AS r, n
    FROM part, (SELECT count(*) AS n FROM part) WHERE p_partkey>=1""")
view("v_closure", """SELECT a.node, l.leaf FROM (SELECT p_partkey+n AS leaf FROM part, (SELECT count(*) AS n FROM part)) l
    JOIN (SELECT unnest(range(0,40)) AS lev) d ON (l.leaf >> d.lev) >= 1
    JOIN (SELECT node FROM v_tree UNION ALL SELECT p_partkey+n FROM part, (SELECT count(*) AS n FROM part)) a ON a.node=(l.leaf >> d.lev)""")


def part_tree(fx):
    part = fx.table("part").select(F.col("p_partkey").alias("i"))
    n = part.agg(F.count(F.lit(1))).scalar()
    return part.where("i >= 1").select(
        F.col("i").alias("node"), (n - F.col("i")).alias("step"), F.inline(
            F.array(F.struct((F.col("i") * 2).alias("child")), F.struct((F.col("i") * 2 + 1).alias("child")))
        )
    )


def part_closure(fx):
    if "part_closure" not in fx.kept:
        fx.kept["part_closure"] = k.leaf_closure(part_tree(fx).select("node", "child"))
    return fx.kept["part_closure"]


view("v_up_pair0", """SELECT v.a, v.b, -ln(CASE WHEN (s.score+t.score)/2=low THEN 1 WHEN (v.score-low)/((s.score+t.score)/2-low)<=0 THEN 0.001
    ELSE (v.score-low)/((s.score+t.score)/2-low) END) AS d FROM v_z v JOIN v_pair s ON s.a=v.a AND s.b=v.a JOIN v_pair t ON t.a=v.b AND t.b=v.b WHERE v.a<v.b""")
view("v_up_node0", "SELECT DISTINCT unnest([a, b]) AS node, 1 AS members, CAST(0 AS DOUBLE) AS height FROM v_up_pair0")
view("v_up_text0", "SELECT node, node AS newick FROM v_up_node0")
#: Merge rounds that the oracle writes out: one fewer than there are sources.
ROUNDS = 19
for _r in range(1, ROUNDS + 1):
    _last = _r - 1
    view(f"v_up_best{_r}", f"""SELECT a, b, d FROM (SELECT a, b, d FROM v_up_pair{_last} UNION ALL SELECT b, a, d FROM v_up_pair{_last})
        QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b, d)=1""")
    view(f"v_up_merge{_r}", f"""SELECT 'n{_r}_'||x.a AS node, x.a AS l, x.b AS r, x.d/2 AS height, CAST(m.members+n.members AS BIGINT) AS members, {_r} AS round,
        printf('(%s:%.6f,%s:%.6f)', tm.newick, x.d/2-m.height, tn.newick, x.d/2-n.height) AS newick
        FROM v_up_best{_r} x JOIN v_up_best{_r} y ON y.a=x.b AND y.b=x.a JOIN v_up_node{_last} m ON m.node=x.a JOIN v_up_node{_last} n ON n.node=x.b
        JOIN v_up_text{_last} tm ON tm.node=x.a JOIN v_up_text{_last} tn ON tn.node=x.b WHERE x.a<x.b""")
    view(f"v_up_name{_r}", f"""SELECT n.node AS old, coalesce(g.node, n.node) AS new, n.members FROM v_up_node{_last} n
        LEFT JOIN (SELECT node, unnest([l, r]) AS old FROM v_up_merge{_r}) g ON g.old=n.node""")
    view(f"v_up_pair{_r}", f"""SELECT least(x.new, y.new) AS a, greatest(x.new, y.new) AS b, sum(d*x.members*y.members)/sum(x.members*y.members) AS d
        FROM v_up_pair{_last} p JOIN v_up_name{_r} x ON x.old=p.a JOIN v_up_name{_r} y ON y.old=p.b WHERE x.new<>y.new GROUP BY 1,2""")
    view(f"v_up_node{_r}", f"""SELECT old AS node, n.members, height FROM v_up_name{_r} n JOIN v_up_node{_last} o ON o.node=n.old WHERE old=new
        UNION ALL SELECT node, members, height FROM v_up_merge{_r}""")
    view(f"v_up_text{_r}", f"SELECT node, newick FROM v_up_text{_last} UNION ALL SELECT node, newick FROM v_up_merge{_r}")
view("v_up_all", " UNION ALL ".join(f"SELECT * FROM v_up_merge{_r}" for _r in range(1, ROUNDS + 1)))


@query("cluster_upgma", f"""SELECT 'all' AS grp, CAST(row_number() OVER (ORDER BY height, round, node) AS INT) AS step, node, l AS "left", r AS "right",
    {r6('height')} AS height, members FROM v_up_all""")
def cluster_upgma(fx):
    return matrix_merges(fx).select("grp", "step", "node", "left", "right", F.round("height", 6).alias("height"), "members")


def matrix_distances(fx):
    """Both orders of the transformed score distance between distinct matrices."""
    own = core_pairs(fx).where("a = b").select("a", "score")
    joined = scored_pairs(fx).where("a <> b").join(own.toDF("a", "self_a"), "a").join(own.toDF("b", "self_b"), "b")
    dist = c.transform_distance(F.col("score"), F.col("low"), (F.col("self_a") + F.col("self_b")) / 2)
    return joined.select("a", "b", dist.alias("d"))


def matrix_merges(fx):
    if "matrix_merges" not in fx.kept:
        pairs = matrix_distances(fx).where("a < b").select(F.lit("all").alias("grp"), "a", "b", "d")
        fx.kept["matrix_merges"] = cut_lineage(k.upgma(pairs))
    return fx.kept["matrix_merges"]


@query("tree_leaf_closure", "SELECT DISTINCT node, leaf FROM v_closure")
def tree_leaf_closure(fx):
    return k.leaf_closure(part_tree(fx).select("node", "child"))


@query("tree_newick", "SELECT 'all' AS grp, newick||';' AS tree FROM v_up_all ORDER BY members DESC, height DESC LIMIT 1")
def tree_newick(fx):
    return k.newick(matrix_merges(fx))


CUTS = tuple(range(2, 9))


def _cuts(n):
    return [(k, n - k) for k in CUTS]


@query("cut_tree", """SELECT CAST(k AS INT) AS k, leaf, arg_max(node, step) AS cluster FROM
    (SELECT c.leaf, c.node, coalesce(t.step, 0) AS step, (SELECT count(*) FROM part) AS n FROM v_closure c LEFT JOIN v_tree t USING (node)),
    (SELECT unnest(range(2,9)) AS k) WHERE step<=n-k GROUP BY 1,2""")
def cut_tree(fx):
    merges = part_tree(fx).select("node", "step").distinct()
    n = fx.table("part").agg(F.count(F.lit(1))).scalar()
    return k.cut_tree(merges, part_closure(fx), _cuts(n))


view("v_leaf", "SELECT matrix_id, CAST(substr(matrix_id,4) AS BIGINT)+(SELECT count(*) FROM v_width) AS leaf FROM v_width")
view("v_cut", """SELECT k, matrix_id, arg_min(anc, anc) AS cluster FROM (SELECT l.matrix_id, l.leaf >> lev AS anc, n, k FROM v_leaf l,
    (SELECT unnest(range(0,20)) AS lev), (SELECT unnest(range(2,9)) AS k), (SELECT count(*) AS n FROM v_width)
    WHERE (l.leaf >> lev)>=1) WHERE anc>=n OR n-anc<=n-k GROUP BY 1,2""")
view("v_d", """SELECT v.a, v.b, -ln(CASE WHEN (s.score+t.score)/2=low THEN 1
      WHEN (v.score-low)/((s.score+t.score)/2-low)<=0 THEN 0.001 ELSE (v.score-low)/((s.score+t.score)/2-low) END) AS d
    FROM v_z v JOIN v_pair s ON s.a=v.a AND s.b=v.a JOIN v_pair t ON t.a=v.b AND t.b=v.b WHERE v.a<>v.b""")
view("v_ch", """SELECT CAST(k AS INT) AS k, (ln(b)/(k-1))/(ln(w)/(n-k)) AS ch FROM
    (SELECT k, sum(CASE WHEN x=y THEN w END) AS w, sum(CASE WHEN x<>y THEN m*m END) AS b FROM
      (SELECT i.k, least(i.cluster,j.cluster) AS x, greatest(i.cluster,j.cluster) AS y, sum(d.d*e.d) AS w, avg((d.d+e.d)/2) AS m
       FROM v_d d JOIN v_d e ON d.a=e.b AND d.b=e.a JOIN v_cut i ON i.matrix_id=d.a JOIN v_cut j ON j.matrix_id=d.b AND i.k=j.k
       WHERE d.a<d.b GROUP BY 1,2,3) GROUP BY 1), (SELECT count(*) AS n FROM v_width) WHERE k<n""")


def matrix_membership(fx):
    """Clusters of the matrices at each cut of a heap-ordered tree over their numbers."""
    leaves = families(fx).select("matrix_id", F.substring("matrix_id", 4, 10).cast("bigint").alias("i"))
    n = leaves.agg(F.count(F.lit(1))).scalar()
    steps = leaves.where("i >= 1").select(F.col("i").alias("node"), (n - F.col("i")).alias("step"))
    edges = steps.select("node", F.explode(F.array(F.col("node") * 2, F.col("node") * 2 + 1)).alias("child"))
    cut = k.cut_tree(steps, k.leaf_closure(edges), _cuts(n))
    return cut.join(leaves.select("matrix_id", (F.col("i") + n).alias("leaf")), "leaf").select(
        "k", F.col("matrix_id").alias("leaf"), "cluster"
    )


def cut_index(fx):
    if "cut_index" not in fx.kept:
        fx.kept["cut_index"] = cut_lineage(k.calinski_harabasz(cut_lineage(matrix_membership(fx)), matrix_distances(fx)))
    return fx.kept["cut_index"]


@query("cluster_index_ch", f"SELECT k, {r6('ch')} AS ch FROM v_ch")
def cluster_index_ch(fx):
    return cut_index(fx).withColumn("ch", F.round("ch", 6))


@query("optimal_clusters", f"SELECT k, {r6('ch')} AS ch FROM v_ch QUALIFY row_number() OVER (ORDER BY ch DESC, k)=1")
def optimal_clusters(fx):
    return k.optimal_clusters(cut_index(fx)).withColumn("ch", F.round("ch", 6))


@query("cluster_homogeneity", f"""SELECT collection AS cluster, {r6('h')} AS homogeneity, CAST(m AS BIGINT) AS members, {r6('avg(h) OVER ()')} AS mean_homogeneity FROM
    (SELECT collection, sum(n*n)/power(sum(n),2) AS h, sum(n) AS m FROM (SELECT collection, class_no, count(*) AS n FROM f4_matrix GROUP BY 1,2) GROUP BY 1)""")
def cluster_homogeneity(fx):
    labelled = fx.matrix.select(F.col("collection").alias("cluster"), F.col("class_no").alias("family"))
    return k.homogeneity(labelled).select(
        "cluster", F.round("homogeneity", 6).alias("homogeneity"), "members", F.round("mean_homogeneity", 6).alias("mean_homogeneity")
    )


def p_pairs(fx):
    if "p_pairs" not in fx.kept:
        fx.kept["p_pairs"] = cut_lineage(c.with_p(scored_pairs(fx)))
    return fx.kept["p_pairs"]


@query("cluster_internal_similarity", f"""SELECT cluster, {r6('avg(m)')} AS similarity, count(*) AS members FROM
    (SELECT i.cluster, a, avg(CASE WHEN a=b THEN 1 ELSE p END) AS m FROM v_p JOIN v_family i ON i.matrix_id=a
     JOIN v_family j ON j.matrix_id=b AND i.cluster=j.cluster GROUP BY 1,2) GROUP BY 1""")
def cluster_internal_similarity(fx):
    return k.internal_similarity(families(fx), p_pairs(fx)).withColumn("similarity", F.round("similarity", 6))


view("v_clsum", "SELECT cluster, pos, count(*) AS n, " + ", ".join(f"sum({b}) AS {b}" for b in BASES) + " FROM v_member GROUP BY 1,2")
view("v_rival", "SELECT m.matrix_id, m.cluster, r.cluster AS rival, m.pos, " + ", ".join(f"m.{b} AS m{b}" for b in BASES) + ", " + ", ".join(
    f"(r.{b}-CASE WHEN r.cluster=m.cluster THEN m.{b} ELSE 0 END)/(r.a+r.c+r.g+r.t-CASE WHEN r.cluster=m.cluster THEN m.a+m.c+m.g+m.t ELSE 0 END) AS r{b}"
    for b in BASES) + """ FROM v_member m JOIN v_clsum r USING (pos)
    WHERE r.n-CASE WHEN r.cluster=m.cluster THEN 1 ELSE 0 END>0 AND m.cluster IN (SELECT cluster FROM v_family GROUP BY 1 HAVING count(*)>1)""")


@query("leave_one_out_cluster", f"""SELECT matrix_id, cluster, rival AS predicted FROM
    (SELECT matrix_id, cluster, rival, avg(round({_pcc_sql('m', 'r')},9)) AS s FROM v_rival GROUP BY 1,2,3)
    QUALIFY row_number() OVER (PARTITION BY matrix_id ORDER BY round(s,9) DESC, rival)=1""")
def leave_one_out_cluster(fx):
    return k.leave_one_out(members(fx))


@query("merged_profile_mean", "SELECT cluster, pos, size-n AS gaps, " + ", ".join(
    f"{r6(f'({b}+0.25*(size-n))/size')} AS {b}" for b in BASES) + """ FROM (SELECT cluster, pos, count(*) AS n,
    """ + ", ".join(f"sum({b}) AS {b}" for b in BASES) + """ FROM v_member GROUP BY 1,2) JOIN
    (SELECT cluster, count(*) AS size FROM v_family GROUP BY 1) USING (cluster)""")
def merged_profile_mean(fx):
    return _rounded(k.merge_mean(members(fx)))


def _rounded(df, *extra):
    return df.select("cluster", "pos", *(extra or ("gaps",)), *[F.round(b, 6).alias(b) for b in BASES])


view("v_weight", """SELECT i.cluster, a AS matrix_id, sum(p) AS p, size FROM v_p JOIN v_family i ON i.matrix_id=a
    JOIN v_family j ON j.matrix_id=b AND i.cluster=j.cluster JOIN (SELECT cluster, count(*) AS size FROM v_family GROUP BY 1) s ON s.cluster=i.cluster
    WHERE a<>b GROUP BY ALL""")
view("v_swm", "SELECT cluster, pos, size, size-n AS gaps, " + ", ".join(f"{b}/(a+c+g+t) AS {b}" for b in BASES)
     + " FROM (SELECT m.cluster, pos, max(size) AS size, count(*) AS n, " + ", ".join(f"sum({b}*p/size) AS {b}" for b in BASES)
     + " FROM v_member m JOIN v_weight w ON w.matrix_id=m.matrix_id GROUP BY 1,2)")
_IC = "round(2+" + "+".join(f"CASE WHEN {b}>0 THEN {b}*log2({b}) ELSE 0 END" for b in BASES) + ",9)"


@query("merged_profile_similarity_weighted", "SELECT cluster, pos, gaps, " + ", ".join(f"{r6(b)} AS {b}" for b in BASES) + f""" FROM
    (SELECT *, sum(l) OVER (PARTITION BY cluster) AS first FROM
      (SELECT *, CASE WHEN lrun=1 AND pos-1 < len-1-4 THEN 1 ELSE 0 END AS l FROM
        (SELECT *, max(pos) OVER (PARTITION BY cluster) AS len, min(weak) OVER (PARTITION BY cluster ORDER BY pos) AS lrun,
          min(weak) OVER (PARTITION BY cluster ORDER BY pos DESC) AS rrun FROM
          (SELECT *, CASE WHEN {_IC}<0.4 OR gaps>size/2 THEN 1 ELSE 0 END AS weak FROM v_swm))))
    WHERE l=0 AND NOT (rrun=1 AND pos-1>first+4)""")
def merged_profile_similarity_weighted(fx):
    return _rounded(k.merge_by_similarity(members(fx), p_pairs(fx)))


@query("merged_profile_user_weighted", "SELECT cluster, pos, size-n AS gaps, " + ", ".join(
    f"{r6(f'({b}+0.25*(size-n))/(a+c+g+t+(size-n))')} AS {b}" for b in BASES) + """ FROM (SELECT cluster, pos, count(*) AS n,
    """ + ", ".join(f"sum({b}*w) AS {b}" for b in BASES) + """ FROM v_member JOIN (SELECT matrix_id, wt/sum(wt) OVER () AS w FROM
      (SELECT matrix_id, 1.0+CAST(substr(matrix_id,4) AS INT)%5 AS wt FROM v_width)) USING (matrix_id) GROUP BY 1,2) JOIN
    (SELECT cluster, count(*) AS size FROM v_family GROUP BY 1) USING (cluster)""")
def merged_profile_user_weighted(fx):
    weight = F.lit(1.0) + F.substring("matrix_id", 4, 10).cast("int") % 5
    return _rounded(k.merge_weighted(members(fx).withColumn("weight", weight)))


view("v_anchor", """SELECT cluster, matrix_id AS anchor FROM v_weight
    QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(p/(size-1),9) DESC, matrix_id)=1""")
view("v_place", """SELECT w.cluster, w.matrix_id, p/(size-1) AS weight, size, coalesce(x.forward, y.forward, true) AS forward,
    CASE WHEN w.matrix_id=anchor THEN 0 WHEN x.a IS NOT NULL THEN
      CASE WHEN x.forward THEN x.i1-x.i2 ELSE (x.len1-x.i1)-(x.len2-x.i2) END ELSE y.i2-y.i1 END AS shift
    FROM v_weight w JOIN v_anchor n USING (cluster) LEFT JOIN v_pair x ON x.a=anchor AND x.b=w.matrix_id AND x.a<>x.b
    LEFT JOIN v_pair y ON y.b=anchor AND y.a=w.matrix_id AND y.a<>y.b""")
view("v_coreturn", """SELECT matrix_id, true AS forward, pos, a, c, g, t FROM v_core UNION ALL
    SELECT matrix_id, false, max(pos) OVER (PARTITION BY matrix_id)+1-pos, t, g, c, a FROM v_core""")
view("v_star", "SELECT cluster, pos, covered, size, " + ", ".join(f"{b}/(a+c+g+t) AS {b}" for b in BASES)
     + " FROM (SELECT cluster, pos+shift AS pos, count(*) AS covered, max(size) AS size, "
     + ", ".join(f"sum({b}*weight) AS {b}" for b in BASES) + " FROM v_place JOIN v_coreturn USING (matrix_id, forward) GROUP BY 1,2)")


@query("familial_profile_star", "WITH fit AS (SELECT *, (" + _IC + """>0.4 OR covered>=size/2) AS ok FROM v_star)
    SELECT f.cluster, CAST(f.pos AS INT) AS pos, covered, """ + ", ".join(f"{r6('f.' + b)} AS {b}" for b in BASES) + """ FROM fit f WHERE
      f.pos BETWEEN 1 AND 6
      OR (f.pos<1 AND (SELECT count(*) FROM fit x WHERE x.cluster=f.cluster AND x.pos>=f.pos AND x.pos<1 AND x.ok)=1-f.pos)
      OR (f.pos>6 AND (SELECT count(*) FROM fit x WHERE x.cluster=f.cluster AND x.pos<=f.pos AND x.pos>6 AND x.ok)=f.pos-6)""")
def familial_profile_star(fx):
    core = p.trim_edges(counts(fx), 4)
    first = F.min("pos").over(W.partitionBy("matrix_id"))
    based = p.pseudo_frequencies(core.withColumn("pos", (F.col("pos") - first + 1).cast("int")))
    placed = k.star_placements(families(fx), core_pairs(fx), p_pairs(fx))
    return _rounded(k.familial_star(placed, based, p.reverse_complement(based)), "covered")


view("v_cl_letter", """SELECT cluster, pos, CASE WHEN a>=0.6 THEN 'A' WHEN c>=0.6 THEN 'C' WHEN g>=0.6 THEN 'G' WHEN t>=0.6 THEN 'T'
    WHEN best<0.8 THEN 'N' WHEN a+c=best THEN 'M' WHEN g+t=best THEN 'K' WHEN c+g=best THEN 'S' WHEN a+t=best THEN 'W'
    WHEN a+g=best THEN 'R' ELSE 'Y' END AS letter FROM
    (SELECT *, greatest(a+c,g+t,c+g,a+t,a+g,c+t) AS best FROM
      (SELECT cluster, pos, round(a,12) AS a, round(c,12) AS c, round(g,12) AS g, round(t,12) AS t FROM v_cluster_profile))""")


@query("cluster_report", """SELECT cluster, matrix_id, count(*) OVER (PARTITION BY cluster) AS members,
    count(*) OVER (PARTITION BY cluster)=1 AS single, consensus FROM v_family JOIN
    (SELECT cluster, string_agg(letter,'' ORDER BY pos) AS consensus FROM v_cl_letter GROUP BY 1) USING (cluster)""")
def cluster_report(fx):
    merged = cluster_profiles(fx).withColumnRenamed("cluster", "matrix_id")
    return k.report(families(fx), p.consensus(merged).withColumnRenamed("matrix_id", "cluster"))


# ---- mutual information -----------------------------------------------------------------

view("v_prot", """SELECT member, pos, res, n/sum(n) OVER (PARTITION BY member, pos) AS f FROM v_residue""")
view("v_mem", "SELECT DISTINCT matrix_id AS member FROM v_freq WHERE matrix_id IN (SELECT member FROM v_prot)")
view("v_dna", """SELECT g.member, g.i, b.base, CASE b.base WHEN 'A' THEN a WHEN 'C' THEN c WHEN 'G' THEN g ELSE t END AS f0
    FROM (SELECT member, unnest(range(1, (SELECT max(pos) FROM v_freq)+1)) AS i FROM v_mem) g
    CROSS JOIN (SELECT unnest(['A','C','G','T']) AS base) b LEFT JOIN v_freq f ON f.matrix_id=g.member AND f.pos=g.i""".replace("THEN g ELSE", "THEN f.g ELSE"))
view("v_joint", """SELECT CAST(i AS INT) AS i, p.pos AS j, base, res, sum(CASE WHEN f0>0 THEN f0 ELSE 0.25 END*p.f)/(SELECT count(*) FROM v_mem) AS p
    FROM v_dna d JOIN v_prot p ON p.member=d.member GROUP BY ALL""")
view("v_allmerged", """SELECT CAST(i AS INT) AS i, base, avg(coalesce(f0,0.25)) AS f FROM v_dna GROUP BY ALL""")
view("v_domain", "SELECT pos AS j, res, sum(n)/sum(sum(n)) OVER (PARTITION BY pos) AS f FROM v_residue GROUP BY pos, res")
view("v_mi", """SELECT x.i, x.j, sum(p*log2(p/(m.f*d.f))) AS mi FROM v_joint x JOIN v_allmerged m ON m.i=x.i AND m.base=x.base
    JOIN v_domain d ON d.j=x.j AND d.res=x.res WHERE p>0 AND m.f>0 AND d.f>0 GROUP BY ALL""")


def _residues(fx):
    """Residue counts of all members, written once: the texts are read for them a single time."""
    if "residues" not in fx.kept:
        fx.kept["residues"] = cut_lineage(p.residue_counts(fx.protein, "member", "aligned"))
    return fx.kept["residues"]


def _protein(fx):
    residues = _residues(fx)
    sums = residues.groupBy("member", "pos").agg(F.sum("n").alias("w"))
    return residues.join(sums, ["member", "pos"]).select("member", "pos", "res", (F.col("n") / F.col("w")).alias("f"))


def _domain(fx):
    cells = _residues(fx).groupBy("pos", "res").agg(F.sum("n").alias("n"))
    sums = cells.groupBy("pos").agg(F.sum("n").alias("w"))
    return cells.join(sums, "pos").select("pos", "res", (F.col("n") / F.col("w")).alias("f"))


def _dna(fx):
    if "dna" not in fx.kept:
        fx.kept["dna"] = cut_lineage(p.pseudo_frequencies(counts(fx)).withColumnRenamed("matrix_id", "member"))
    return fx.kept["dna"]


def joint(fx):
    if "joint" not in fx.kept:
        fx.kept["joint"] = cut_lineage(k.joint_frequencies(_dna(fx), _protein(fx)))
    return fx.kept["joint"]


def information_pairs(fx):
    one = _dna(fx).join(_residues(fx).select("member").distinct(), "member", "left_semi").select(
        F.lit(0).alias("cluster"), F.col("member").alias("matrix_id"), "pos", *BASES
    )
    merged = p.long(k.merge_mean(one).withColumnRenamed("cluster", "matrix_id"), "f").select("pos", "base", "f")
    return k.mutual_information(joint(fx), merged, _domain(fx))


@query("mutual_information", f"SELECT i, j, {r6('mi')} AS mi FROM v_mi")
def mutual_information(fx):
    return information_pairs(fx).withColumn("mi", F.round("mi", 6))


@query("mutual_information_scaled", f"""SELECT i, m.j, {r6('mi*ic/log2(20.0)')} AS mi FROM v_mi m JOIN
    (SELECT j, log2(20.0)+sum(f*log2(f)) AS ic FROM v_domain GROUP BY 1) d ON d.j=m.j""")
def mutual_information_scaled(fx):
    ic = _domain(fx).groupBy(F.col("pos").alias("j")).agg((F.log2(F.lit(20.0)) + F.sum(F.col("f") * F.log2("f"))).alias("ic"))
    scaled = F.col("mi") * F.col("ic") / F.log2(F.lit(20.0))
    return information_pairs(fx).join(ic, "j").select("i", "j", F.round(scaled, 6).alias("mi"))


@query("base_preference_by_residue", f"""SELECT g.i, g.j, g.res, g.base, {r6('CASE WHEN coalesce(s,0)=0 THEN 0.25 ELSE coalesce(p,0)/s END')} AS pref FROM
    (SELECT DISTINCT i, j, r.res, b.base FROM v_joint CROSS JOIN (SELECT unnest(string_split('A C D E F G H I K L M N P Q R S T V W Y',' ')) AS res) r
      CROSS JOIN (SELECT unnest(['A','C','G','T']) AS base) b) g
    LEFT JOIN v_joint x ON x.i=g.i AND x.j=g.j AND x.res=g.res AND x.base=g.base
    LEFT JOIN (SELECT i, j, res, sum(p) AS s FROM v_joint GROUP BY ALL) t ON t.i=g.i AND t.j=g.j AND t.res=g.res""")
def base_preference_by_residue(fx):
    return k.base_preference(joint(fx)).withColumn("pref", F.round("pref", 6))
