"""Queries of rankings, statistics, Markov chains and trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxcell.functions.lineage import cut
from fluxcell.operators import graph, markers, markov, matrix, rank, stats, trajectory, trees
from fluxcell.operators import vectorfield as V
from fluxcell.plans import bindings as B
from fluxcell.plans import labelling
from fluxcell.plans.graph_queries import KNN, RING, knn, r, ring, us

QUERIES, SQL = {}, {}

DENSE = B.COUNTS_SQL + """, c AS (SELECT s_suppkey AS cell_id, s_nationkey::VARCHAR AS grp FROM supplier),
dx AS (SELECT cell_id, gene_id, spliced - unspliced AS value, spliced + unspliced AS total FROM dense)"""


def query(sql: str | None = None, prefix: str = DENSE):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {prefix.strip()}\n{sql}"
        return f

    return add


def dense(spark, d, value="s - u"):
    return us(spark, d).select("cell_id", "gene_id", F.expr(value).alias("value"))


@query(
    """, m AS (SELECT grp, gene_id, avg(value) AS value FROM dx JOIN c USING (cell_id) GROUP BY ALL)
    SELECT grp, gene_id, round(value, 6) + 0.0 AS value,
    row_number() OVER (PARTITION BY grp ORDER BY value DESC, gene_id)::INTEGER AS rank FROM m"""
)
def rank_genes(spark, d):
    return rank.rank_genes(dense(spark, d), B.cells(spark, d)).select("grp", "gene_id", r("value"), "rank")


@query(
    """, m AS (SELECT grp, gene_id, avg(abs(value)) AS value FROM dx JOIN c USING (cell_id) GROUP BY ALL)
    SELECT grp, gene_id, round(value, 6) AS value,
    row_number() OVER (PARTITION BY grp ORDER BY value DESC, gene_id)::INTEGER AS rank FROM m"""
)
def rank_velocity_genes_abs(spark, d):
    g = rank.rank_genes(dense(spark, d), B.cells(spark, d), absolute=True)
    return g.select("grp", "gene_id", r("value"), "rank")


@query(
    """, m AS (SELECT grp, gene_id, avg(value) AS value FROM dx JOIN c USING (cell_id) GROUP BY ALL)
    SELECT grp, gene_id, round(value, 6) + 0.0 AS value,
    row_number() OVER (PARTITION BY gene_id ORDER BY value DESC, grp)::INTEGER AS rank FROM m"""
)
def rank_cell_groups(spark, d):
    return rank.rank_cell_groups(dense(spark, d), B.cells(spark, d)).select("grp", "gene_id", r("value"), "rank")


@query(
    """, m AS (SELECT grp, gene_id, avg(total) AS value FROM dx JOIN c USING (cell_id) GROUP BY ALL)
    SELECT grp, gene_id, round(value, 6) AS value FROM m
    QUALIFY row_number() OVER (PARTITION BY grp ORDER BY value DESC, gene_id) <= 3"""
)
def top_markers(spark, d):
    m = dense(spark, d, "s + u").join(B.cells(spark, d), "cell_id").groupBy("grp", "gene_id").agg(F.avg("value").alias("value"))
    return rank.top_n(m, "grp", [F.desc("value"), F.col("gene_id")], 3).select("grp", "gene_id", r("value"))


TESTS = """tests AS (SELECT c_custkey AS id, c_mktsegment AS family,
  round((c_custkey * 7919 % 1000 + 1) / 1000.0, 3)::DOUBLE AS p FROM customer),
k AS (SELECT *, count(*) OVER (PARTITION BY family) AS n, rank() OVER (PARTITION BY family ORDER BY p) AS lo,
  count(*) OVER (PARTITION BY family, p) AS same FROM tests)"""


def _tests(spark, d):
    p = F.round((F.col("c_custkey") * 7919 % 1000 + 1) / 1000.0, 3)
    return B.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("family"), p.alias("p"))


@query("SELECT id, family, p, round(least(1.0, p * n / (lo + (same - 1) / 2.0)), 6) AS q FROM k", TESTS)
def bh_simple(spark, d):
    return rank.bh_simple(_tests(spark, d)).select("id", "family", "p", r("q"))


@query(
    """, raw AS (SELECT *, p * n / (lo + same - 1) AS raw FROM k)
    SELECT id, family, p, round(least(1.0, min(raw) OVER (PARTITION BY family ORDER BY p DESC
    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS q FROM raw""",
    TESTS,
)
def bh_monotone(spark, d):
    return rank.bh_monotone(_tests(spark, d)).select("id", "family", "p", r("q"))


@query(
    """, s AS (SELECT c_mktsegment AS family, c_acctbal AS score, c_nationkey < 12 AS truth FROM customer),
    k2 AS (SELECT *, rank() OVER (PARTITION BY family ORDER BY score) + (count(*) OVER (PARTITION BY family, score) - 1) / 2.0 AS r FROM s)
    SELECT family, round((sum(r) FILTER (WHERE truth) - count(*) FILTER (WHERE truth) * (count(*) FILTER (WHERE truth) + 1) / 2.0)
      / (count(*) FILTER (WHERE truth) * count(*) FILTER (WHERE NOT truth)), 6) AS auc FROM k2 GROUP BY family""",
    TESTS,
)
def roc_auc(spark, d):
    c = B.table(spark, d, "customer")
    s = c.select(F.col("c_mktsegment").alias("family"), F.col("c_acctbal").alias("score"), (F.col("c_nationkey") < 12).alias("truth"))
    return rank.roc_auc(s).select("family", r("auc"))


JAC = DENSE + """, jac AS (
  SELECT c.grp, a.cell_id, a.gene_id AS effector, b.gene_id AS regulator, a.value * b.value / 1000.0 - 0.5 AS value
  FROM dx a JOIN dx b USING (cell_id) JOIN c USING (cell_id)
), jm AS (SELECT grp, effector, regulator, avg(value) AS value FROM jac GROUP BY ALL)"""


def _jacobian(spark, d):
    x = dense(spark, d)
    a = x.select("cell_id", F.col("gene_id").alias("effector"), F.col("value").alias("a"))
    b = x.select("cell_id", F.col("gene_id").alias("regulator"), F.col("value").alias("b"))
    j = a.join(b, "cell_id").join(B.cells(spark, d), "cell_id")
    return j.select("grp", "cell_id", "effector", "regulator", (F.col("a") * F.col("b") / 1000.0 - 0.5).alias("value"))


@query(
    """SELECT grp, effector, regulator, round(value, 6) + 0.0 AS value,
    row_number() OVER (PARTITION BY grp, effector ORDER BY round(value, 9) DESC, regulator)::INTEGER AS rank FROM jm""", JAC
)
def rank_jacobian_full(spark, d):
    j = rank.rank_jacobian(_jacobian(spark, d), "full reg")
    return j.select("grp", "effector", "regulator", r("value"), "rank")


@query(
    """SELECT grp, effector, regulator, round(value, 6) + 0.0 AS value,
    row_number() OVER (PARTITION BY grp, regulator ORDER BY round(value, 9) DESC, effector)::INTEGER AS rank FROM jm""", JAC
)
def rank_jacobian_effectors(spark, d):
    j = rank.rank_jacobian(_jacobian(spark, d), "full eff")
    return j.select("grp", "effector", "regulator", r("value"), "rank")


@query(
    """, nm AS (SELECT grp, effector, regulator, value / nullif(max(abs(value)) OVER (PARTITION BY effector, regulator), 0) AS value FROM jm)
    SELECT grp, effector, regulator, round(value, 6) + 0.0 AS value,
    row_number() OVER (PARTITION BY grp ORDER BY round(value, 9) DESC NULLS LAST, effector, regulator)::INTEGER AS rank FROM nm""", JAC
)
def rank_jacobian_pairs(spark, d):
    j = rank.rank_jacobian(_jacobian(spark, d), "int", normalize=True)
    return j.select("grp", "effector", "regulator", r("value"), "rank")


@query(
    """, rg AS (SELECT grp, regulator, avg(value) AS value FROM jm GROUP BY ALL)
    SELECT grp, regulator, round(value, 6) + 0.0 AS value,
    row_number() OVER (PARTITION BY grp ORDER BY round(value, 9) DESC, regulator)::INTEGER AS rank FROM rg""", JAC
)
def rank_jacobian_regulators(spark, d):
    return rank.rank_jacobian(_jacobian(spark, d), "reg").select("grp", "regulator", r("value"), "rank")


@query(
    """, sw AS (SELECT a.grp, a.effector, a.regulator, a.value * b.value AS value FROM jm a JOIN jm b
      ON a.grp = b.grp AND a.effector = b.regulator AND a.regulator = b.effector
      WHERE a.effector < a.regulator AND a.value < 0 AND b.value < 0)
    SELECT grp, effector, regulator, round(value, 6) AS value FROM sw""", JAC
)
def rank_jacobian_switch(spark, d):
    return rank.rank_jacobian(_jacobian(spark, d), "switch").select("grp", "effector", "regulator", r("value"))


@query(
    """, z AS (SELECT regulator, effector, avg(value) AS value FROM jac GROUP BY ALL),
    y AS (SELECT regulator, effector, (value - avg(value) OVER (PARTITION BY regulator)) / nullif(stddev_pop(value) OVER (PARTITION BY regulator), 0) AS zr,
      (value - avg(value) OVER (PARTITION BY effector)) / nullif(stddev_samp(value) OVER (PARTITION BY effector), 0) AS zc FROM z)
    SELECT regulator, effector, round(sqrt(greatest(0, coalesce(zr, 0)) ** 2 + greatest(0, coalesce(zc, 0)) ** 2), 6) AS z FROM y""", JAC
)
def network_clr(spark, d):
    m = _jacobian(spark, d).groupBy("regulator", "effector").agg(F.avg("value").alias("value"))
    return rank.clr_scores(m).select("regulator", "effector", r("z"))


@query(
    """SELECT grp, regulator, effector, round(value, 6) + 0.0 AS value FROM jm
    QUALIFY row_number() OVER (PARTITION BY grp ORDER BY abs(value) DESC, regulator, effector) <= 5""",
    JAC.replace("avg(value) AS value FROM jac", "round(avg(value), 9) AS value FROM jac"),
)
def regulatory_network(spark, d):
    m = _jacobian(spark, d).groupBy("grp", "regulator", "effector").agg(F.round(F.avg("value"), 9).alias("value"))
    return rank.regulatory_network(m, 5).select("grp", "regulator", "effector", r("value"))


@query(
    """SELECT cell_id, effector[7:7] AS effector_set, regulator[7:7] AS regulator_set, round(sum(value), 6) + 0.0 AS value
    FROM jac GROUP BY ALL""", JAC
)
def aggregate_effects(spark, d):
    j = _jacobian(spark, d)
    sets = lambda c: j.select(F.substring(c, 7, 1).alias("set"), F.col(c).alias("gene")).distinct()
    return rank.aggregate_effects(j, sets("regulator"), sets("effector")).select("cell_id", "effector_set", "regulator_set", r("value"))


@query(
    """, l AS (SELECT p_brand AS source, p_type AS gene, row_number() OVER (PARTITION BY p_brand ORDER BY min(p_size), p_type) - 1 AS position
      FROM part GROUP BY p_brand, p_type), k AS (SELECT source, count(*) AS k FROM l GROUP BY ALL)
    SELECT gene, round(sum(1 - position / k) / (SELECT count(*) FROM k), 6) AS priority FROM l JOIN k USING (source) GROUP BY gene"""
)
def tf_priority(spark, d):
    from pyspark.sql import Window

    p = B.table(spark, d, "part").groupBy(F.col("p_brand").alias("source"), F.col("p_type").alias("gene")).agg(F.min("p_size").alias("m"))
    l = p.withColumn("position", F.row_number().over(Window.partitionBy("source").orderBy("m", "gene")) - 1)  # noqa: E741
    return rank.tf_priority(l).select("gene", r("priority"))


@query(
    """, mu AS (SELECT gene_id, avg(total) AS mu, var_pop(total) AS var FROM dx GROUP BY gene_id),
    q AS (SELECT a.gene_id, sum(w * (a.total - mu) * (b.total - mu)) AS num FROM ring JOIN dx a ON a.cell_id = i
      JOIN dx b ON b.cell_id = j AND b.gene_id = a.gene_id JOIN mu ON mu.gene_id = a.gene_id GROUP BY a.gene_id),
    k4 AS (SELECT dx.gene_id, avg((total - mu) ** 4) / any_value(var) ** 2 AS k FROM dx JOIN mu USING (gene_id) GROUP BY dx.gene_id),
    bo AS (SELECT i, j, w FROM ring UNION ALL SELECT j, i, w FROM ring),
    ws AS (SELECT (SELECT count(*)::DOUBLE FROM supplier) AS n, (SELECT sum(w) FROM ring) AS s0,
      (SELECT sum(w * w) / 2 FROM (SELECT sum(w) AS w FROM bo GROUP BY i, j)) AS s1, (SELECT sum(s * s) FROM (SELECT sum(w) AS s FROM bo GROUP BY i)) AS s2),
    mi AS (SELECT gene_id, k, num / (s0 * var) AS i, -1 / (n - 1) AS ei, n, s0, s1, s2 FROM q JOIN mu USING (gene_id) JOIN k4 USING (gene_id) CROSS JOIN ws)
    SELECT gene_id, round(i, 6) AS moran_i, round((i - ei) / sqrt((n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - ei * ei), 4) AS z,
    round((i - ei) / sqrt((n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - k * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0))
      / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - ei * ei), 4) AS z_rand FROM mi""",
    DENSE + RING.replace(B.COUNTS_SQL, ""),
)
def morans_i(spark, d):
    got = stats.morans_i(B.total_layer(B.counts(spark, d)), ring(spark, d), B.n_cells(spark, d))
    return got.select("gene_id", r("moran_i"), r("z", digits=4), r("z_rand", digits=4))


@query()
def morans_i_permutation(spark, d):
    got = stats.morans_i_permutation(B.total_layer(B.counts(spark, d)), ring(spark, d), B.cells(spark, d), 199)
    return got.select("gene_id", r("moran_i"), r("mean_sim"), r("z_sim", digits=4), r("p_sim"))


def _two_groups(spark, d):
    """Every fourth cell against the others, from stored entries."""
    test = F.col("cell_id") % 4 == 0
    x = B.total_layer(B.counts(spark, d)).select("gene_id", "value", test.alias("test"))
    totals = B.cells(spark, d).agg(F.count_if(test).alias("n_test"), F.count_if(~test).alias("n_control"))
    return stats.two_group_de(x, totals)


@query(
    """, t AS (SELECT gene_id, total AS value, cell_id % 4 = 0 AS test FROM dx),
    rk AS (SELECT *, rank() OVER (PARTITION BY gene_id ORDER BY value) + (count(*) OVER (PARTITION BY gene_id, value) - 1) / 2.0 AS r FROM t),
    g2 AS (SELECT gene_id, count(*) FILTER (WHERE test) AS n1, count(*) FILTER (WHERE NOT test) AS n2, sum(r) FILTER (WHERE test) AS r1,
      avg(value) FILTER (WHERE test) AS m1, avg(value) FILTER (WHERE NOT test) AS m2,
      avg((value > 0)::INTEGER) FILTER (WHERE test) AS fraction FROM rk GROUP BY gene_id)
    SELECT gene_id, n1, n2, round(fraction, 6) AS fraction, round(log2(m1 / m2), 6) + 0.0 AS log2fc, r1 - n1 * (n1 + 1) / 2 AS u,
    round(1 - 2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2), 6) + 0.0 AS rbc FROM g2 WHERE fraction >= 0.1"""
)
def two_group_de(spark, d):
    g = _two_groups(spark, d)
    return g.select("gene_id", "n1", "n2", r("fraction"), r("log2fc"), "u", r("rbc"))


@query()
def two_group_de_tests(spark, d):
    g = _two_groups(spark, d).withColumn("family", F.lit(1))
    return rank.bh_monotone(g).select("gene_id", r("p"), r("q"))


@query()
def glm_de(spark, d):
    x = us(spark, d).select("gene_id", (F.col("s") + F.col("u")).alias("value"), (F.col("cell_id") % 5).cast("double").alias("t"))
    return stats.glm_de(x).select("gene_id", r("coefficient", digits=4), r("lrt", digits=3), r("p", digits=4))


@query(
    """, z AS (SELECT s_suppkey AS cell_id, s_acctbal AS z FROM supplier),
    b AS (SELECT gene_id, avg(total) AS my, avg(z) AS mz, covar_pop(total, z) / var_pop(z) AS slope FROM dx JOIN z USING (cell_id) GROUP BY gene_id)
    SELECT cell_id, gene_id, round(total - (my + slope * (z - mz)), 4) + 0.0 AS value FROM dx JOIN z USING (cell_id) JOIN b USING (gene_id)"""
)
def regress_out(spark, d):
    z = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id"), F.col("s_acctbal").alias("z"))
    return stats.regress_out(dense(spark, d, "s + u"), z).select("cell_id", "gene_id", r("value", digits=4))


@query(
    """, z AS (SELECT s_suppkey AS cell_id, s_acctbal AS z, (s_nationkey % 5)::DOUBLE AS y FROM supplier),
    m AS (SELECT gene_id, avg(total) AS mt, avg(z) AS mz, avg(y) AS my, covar_pop(z, total) AS zt, covar_pop(y, total) AS yt,
      var_pop(z) AS zz, var_pop(y) AS yy, covar_pop(z, y) AS zy FROM dx JOIN z USING (cell_id) GROUP BY gene_id),
    b AS (SELECT *, (zt * yy - yt * zy) / (zz * yy - zy * zy) AS bz, (yt * zz - zt * zy) / (zz * yy - zy * zy) AS byy FROM m)
    SELECT cell_id, gene_id, round(total - mt - bz * (z - mz) - byy * (y - my), 4) + 0.0 AS value FROM dx JOIN z USING (cell_id) JOIN b USING (gene_id)"""
)
def regress_out_covariates(spark, d):
    s = B.table(spark, d, "supplier")
    z = s.select(F.col("s_suppkey").alias("cell_id"), F.col("s_acctbal").alias("z"), (F.col("s_nationkey") % 5).cast("double").alias("y"))
    return stats.regress_out(dense(spark, d, "s + u"), z, ("z", "y")).select("cell_id", "gene_id", r("value", digits=4))


_CYCLE = """, s AS (SELECT cell_id, (gene_id[7:]::INTEGER % 5) AS phase, sum(total) AS s FROM dx GROUP BY ALL),
    z1 AS (SELECT cell_id, phase, (s - avg(s) OVER (PARTITION BY phase)) / stddev_samp(s) OVER (PARTITION BY phase) AS z FROM s),
    z2 AS (SELECT cell_id, phase, (z - avg(z) OVER (PARTITION BY cell_id)) / stddev_samp(z) OVER (PARTITION BY cell_id) AS z FROM z1),
    b AS (SELECT cell_id, arg_max(phase, z) AS phase FROM z2 GROUP BY cell_id),
    cc AS (SELECT b.cell_id, b.phase, p.z - q.z AS progress FROM b
    JOIN z2 p ON p.cell_id = b.cell_id AND p.phase = (b.phase + 4) % 5 JOIN z2 q ON q.cell_id = b.cell_id AND q.phase = (b.phase + 1) % 5)"""


def _cycle(spark, d):
    genes = us(spark, d).select("gene_id").distinct()
    phases = genes.select("gene_id", (F.substring("gene_id", 7, 9).cast("int") % 5).alias("phase"))
    return stats.cell_cycle(dense(spark, d, "s + u"), phases)


@query(_CYCLE + " SELECT cell_id, phase, round(progress, 6) + 0.0 AS progress FROM cc")
def cell_cycle_phase(spark, d):
    return _cycle(spark, d).select("cell_id", "phase", r("progress"))


@query(
    _CYCLE
    + """ SELECT cell_id, round((row_number() OVER (ORDER BY phase, progress DESC, cell_id) - 1) / ((SELECT count(*) FROM cc) - 1), 6) AS place FROM cc"""
)
def cell_cycle_order(spark, d):
    return stats.order_in_phase(_cycle(spark, d)).select("cell_id", r("place"))


VEL = KNN + """, mx AS (SELECT i AS cell_id, generate_subscripts(x, 1) AS k, unnest(x) AS x FROM knn JOIN v ON v.cell_id = j),
ma AS (SELECT cell_id, k, avg(x) AS m FROM mx GROUP BY ALL),
vv AS (SELECT v.cell_id, v.x, list(ma.m - v.x[ma.k] ORDER BY ma.k) AS v FROM v JOIN ma USING (cell_id) GROUP BY v.cell_id, v.x)"""


def vel(spark, d, near=None):
    """Vectors with v = mean of the neighbours less x."""
    p = B.vectors(spark, d)
    e = (knn(spark, d) if near is None else near).select(F.col("i").alias("cell_id"), "j").join(p.select(F.col("cell_id").alias("j"), F.col("x").alias("y")), "j")
    m = e.groupBy("cell_id").agg(F.collect_list("y").alias("ys"))  # a cell has few neighbours, whose vectors travel whole
    total = F.aggregate("ys", F.transform("x", lambda z: F.lit(0.0)), lambda s, y: F.zip_with(s, y, lambda a, b: a + b))
    return p.join(m, "cell_id").select("cell_id", "x", F.zip_with(total, "x", lambda a, b: a / F.size("ys") - b).alias("v"), "label")


def _confidence(method):
    def run(spark, d):
        near = knn(spark, d)
        return stats.neighbour_confidence(cut(vel(spark, d, near)), near, method).select("i", r("confidence"))

    return run


QUERIES["confidence_cosine"] = _confidence("cosine")
SQL["confidence_cosine"] = f"""WITH {VEL} SELECT i, round(avg(list_cosine_similarity(a.v, b.v)), 6) + 0.0 AS confidence
FROM knn JOIN vv a ON a.cell_id = i JOIN vv b ON b.cell_id = j GROUP BY i"""
QUERIES["confidence_consensus"] = _confidence("consensus")
SQL["confidence_consensus"] = f"""WITH {VEL}, n2 AS (SELECT cell_id, v, sqrt(list_sum([z * z FOR z IN v])) AS n FROM vv)
SELECT i, round(avg(list_cosine_similarity(a.v, b.v) * least(a.n, b.n) / greatest(a.n, b.n)), 6) + 0.0 AS confidence
FROM knn JOIN n2 a ON a.cell_id = i JOIN n2 b ON b.cell_id = j GROUP BY i"""
QUERIES["confidence_correlation"] = _confidence("correlation")
SQL["confidence_correlation"] = f"""WITH {VEL}, n2 AS (SELECT cell_id, [z - list_avg(v) FOR z IN v] AS v FROM vv)
SELECT i, round(avg(list_cosine_similarity(a.v, b.v)), 6) + 0.0 AS confidence
FROM knn JOIN n2 a ON a.cell_id = i JOIN n2 b ON b.cell_id = j GROUP BY i"""


@query(
    """, a AS (SELECT i, j FROM knn WHERE rank <= 8), b AS (SELECT i, j FROM knn WHERE rank > 3),
    u AS (SELECT i, j, max(x) AS x, max(y) AS y FROM (SELECT i, j, 1 AS x, 0 AS y FROM a UNION ALL SELECT i, j, 0, 1 FROM b) GROUP BY i, j)
    SELECT i, round(sum(x * y) / count(*), 6) AS jaccard FROM u GROUP BY i""", KNN
)
def confidence_jaccard(spark, d):
    e = knn(spark, d)
    return stats.neighbour_jaccard(e.where("rank <= 8"), e.where("rank > 3")).select("i", r("jaccard"))


@query(
    """, tau AS (SELECT gene_id, quantile_cont(abs(value), 0.01) AS tau FROM dx GROUP BY gene_id),
    med AS (SELECT gene_id, grp, median(total) AS m FROM dx JOIN c USING (cell_id) GROUP BY ALL),
    l AS (SELECT '1' AS p, '3' AS q UNION ALL SELECT '2', '7'),
    j AS (SELECT dx.gene_id, p, q, value, tau, a.m AS m0, b.m AS m1 FROM l JOIN med a ON a.grp = p JOIN med b ON b.grp = q AND b.gene_id = a.gene_id
      JOIN dx ON dx.gene_id = a.gene_id JOIN c ON c.cell_id = dx.cell_id AND c.grp IN (p, q) JOIN tau ON tau.gene_id = dx.gene_id)
    SELECT gene_id, p AS progenitor, q AS mature,
    round(avg((CASE WHEN m0 > m1 THEN value <= -tau ELSE value >= tau END)::INTEGER), 6) AS confidence FROM j GROUP BY ALL"""
)
def gene_confidence(spark, d):
    g = stats.gene_confidence(dense(spark, d, "s + u"), dense(spark, d), B.cells(spark, d), [("1", "3"), ("2", "7")])
    return g.select("gene_id", "progenitor", "mature", r("confidence"))


_SCORES = """, s0 AS (SELECT cell_id, sum(total) FILTER (WHERE gene_id < 'Brand#2') / (SELECT count(DISTINCT gene_id) FROM dx WHERE gene_id < 'Brand#2') AS s FROM dx GROUP BY cell_id)""" + "".join(
    f""",
    s{k + 1} AS (SELECT o.cell_id, 0.1 * o.s + 0.9 * avg(b.s) AS s FROM s{k} o JOIN ring ON i = o.cell_id AND j <> i JOIN s{k} b ON b.cell_id = j GROUP BY o.cell_id, o.s)"""
    for k in range(5)
)


@query(_SCORES + " SELECT cell_id, round(s, 6) AS score FROM s5", DENSE + RING.replace(B.COUNTS_SQL, ""))
def score_cells(spark, d):
    x = dense(spark, d, "s + u")
    genes = x.where("gene_id < 'Brand#2'").select("gene_id").distinct()
    return stats.score_cells(x, genes, ring(spark, d).where("i <> j").select("i", "j")).select("cell_id", r("score"))


@query(
    """SELECT user_id AS clone, round((count(*) FILTER (WHERE event_type = 'purchase') + 1) / (count(*) FILTER (WHERE event_type = 'signup') + 1), 6) AS growth
    FROM events GROUP BY user_id"""
)
def clone_growth(spark, d):
    e = B.table(spark, d, "events").select(F.col("user_id").alias("clone"), F.col("event_type").alias("time"))
    return stats.clone_growth(e, "signup", "purchase").select("clone", r("growth"))


@query()
def spike_in_counts(spark, d):
    x = us(spark, d).select("cell_id", F.col("s").alias("expression"), (F.col("s") * 1.3 + F.col("u") * 0.1).alias("molecules"))
    return stats.spike_in_counts(x).select("cell_id", r("k", digits=4), r("b", digits=4))


# Markov chains of user events

M = B.STEPS_SQL + """, mv AS (SELECT lag(state) OVER (PARTITION BY traj_id ORDER BY ts, event_id) AS i, state AS j FROM steps),
mn AS (SELECT i, j, count(*) AS n FROM mv WHERE i IS NOT NULL GROUP BY ALL),
mp AS (SELECT i, j, n, n / sum(n) OVER (PARTITION BY i) AS p FROM mn),
m2 AS (SELECT a.i, b.j, sum(a.p * b.p) AS p FROM mp a JOIN mp b ON a.j = b.i GROUP BY ALL),
st AS (SELECT DISTINCT i AS state FROM mp)"""


@query("SELECT i, j, n, round(p, 9) AS p FROM mp", M)
def transition_matrix(spark, d):
    return markov.transitions(B.steps(spark, d)).select("i", "j", "n", r("p", digits=9))


@query(", m4 AS (SELECT a.i, b.j, sum(a.p * b.p) AS p FROM m2 a JOIN m2 b ON a.j = b.i GROUP BY ALL) SELECT i, j, round(p, 9) AS p FROM m4", M)
def k_step_matrix(spark, d):
    return markov.power(markov.transitions(B.steps(spark, d)), 4).select("i", "j", r("p", digits=9))


@query(
    """, p0 AS (SELECT state, 1.0::DOUBLE / count(*) OVER () AS p FROM st),
    p1 AS (SELECT j AS state, sum(p0.p * mp.p) AS p FROM p0 JOIN mp ON i = state GROUP BY j),
    p2 AS (SELECT j AS state, sum(p1.p * mp.p) AS p FROM p1 JOIN mp ON i = state GROUP BY j)
    SELECT state, round(p, 9) AS p FROM p2""", M
)
def evolve_distribution(spark, d):
    chain = markov.transitions(B.steps(spark, d))
    states = chain.select(F.col("i").alias("state")).distinct()
    n = states.agg(F.count("*").alias("n"))
    start = states.crossJoin(n).select("state", (1.0 / F.col("n")).alias("p"))
    return markov.evolve(start, chain, 2).select("state", r("p", digits=9))


_PI = M + """, l1 AS (SELECT i, j, p / 2 AS p FROM mp UNION ALL SELECT state, state, 0.5 FROM st), la AS (SELECT i, j, sum(p) AS p FROM l1 GROUP BY ALL),
lb AS (SELECT a.i, b.j, sum(a.p * b.p) AS p FROM la a JOIN la b ON a.j = b.i GROUP BY ALL), lc AS (SELECT a.i, b.j, sum(a.p * b.p) AS p FROM lb a JOIN lb b ON a.j = b.i GROUP BY ALL),
ld AS (SELECT a.i, b.j, sum(a.p * b.p) AS p FROM lc a JOIN lc b ON a.j = b.i GROUP BY ALL), le AS (SELECT a.i, b.j, sum(a.p * b.p) AS p FROM ld a JOIN ld b ON a.j = b.i GROUP BY ALL),
lf AS (SELECT a.i, b.j, sum(a.p * b.p) AS p FROM le a JOIN le b ON a.j = b.i GROUP BY ALL),
pi AS (SELECT j AS state, avg(p) AS p FROM lf GROUP BY j)"""


@query("SELECT state, round(p, 6) AS p FROM pi", _PI)
def stationary_distribution(spark, d):
    return markov.stationary(markov.transitions(B.steps(spark, d)), 32).select("state", r("p"))


@query("SELECT state, round(1 / p, 4) AS t FROM pi", _PI)
def return_time(spark, d):
    pi = markov.stationary(markov.transitions(B.steps(spark, d)), 32)
    return markov.return_time(pi).select("state", r("t", digits=4))


@query(
    """, g AS (SELECT state, state[1:1] < 'p' AS grp FROM st), w AS (SELECT i, sum(n) AS w FROM mp GROUP BY i),
    x AS (SELECT a.grp AS i, b.grp AS j, sum(w * p) AS x FROM mp JOIN w USING (i) JOIN g a ON a.state = i JOIN g b ON b.state = j GROUP BY ALL)
    SELECT i, j, round(x / sum(x) OVER (PARTITION BY i), 9) AS p FROM x""", M
)
def lumped_chain(spark, d):
    chain = markov.transitions(B.steps(spark, d))
    g = chain.select(F.col("i").alias("state")).distinct().withColumn("grp", F.substring("state", 1, 1) < "p")
    pi = chain.groupBy(F.col("i").alias("state")).agg(F.sum("n").cast("double").alias("p"))
    return markov.lump(chain, g, pi).select("i", "j", r("p", digits=9))


@query(
    """, h AS (SELECT 0 AS n, state, 0.0::DOUBLE AS t FROM st UNION ALL
      SELECT n, state, sum(t) FROM (
        SELECT h.n + 1 AS n, i AS state, p * (1 + t) AS t FROM h JOIN mp ON j = h.state WHERE i <> 'purchase' AND n < 600
        UNION ALL SELECT h.n + 1, state, 0.0 FROM h WHERE n < 600) GROUP BY ALL)
    SELECT state, round(t, 6) AS t FROM h WHERE n = 600""".replace("AND n < 600", "AND h.n < 600").replace("WHERE n < 600)", "WHERE h.n < 600)"),
    "RECURSIVE " + M,
)
def hitting_time(spark, d):
    return markov.hitting_time(markov.transitions(B.steps(spark, d)), ["purchase"]).select("state", r("t"))


@query("SELECT i, j, round(n / sum(n) OVER (PARTITION BY i), 9) AS p FROM mn WHERE i <> j", M)
def embedded_chain(spark, d):
    q = markov.transitions(B.steps(spark, d)).withColumn("q", F.col("n").cast("double"))
    return markov.embedded_chain(q).select("i", "j", r("p", digits=9))


@query(
    """, e0 AS (SELECT i, j, n, sum(n) OVER (PARTITION BY i) AS s FROM mn WHERE i <> j), el AS (SELECT i, j, 1 - n / s AS d FROM e0),
    eu AS (SELECT i, j, min(d) AS d FROM (SELECT i, j, d FROM el UNION ALL SELECT j, i, d FROM el) GROUP BY i, j),
    wk AS (SELECT 'signup' AS spot, ['signup'] AS way, 0.0::DOUBLE AS t UNION ALL
      SELECT j, list_append(way, j), t + d FROM wk JOIN eu ON i = wk.spot WHERE NOT list_contains(way, j)),
    bw AS (SELECT spot AS "end", way FROM wk WHERE spot IN ('purchase', 'error')
      QUALIFY row_number() OVER (PARTITION BY spot ORDER BY t, len(way), way[len(way) - 1]) = 1)
    SELECT "end", step::INTEGER AS step, way[step] AS i, way[step + 1] AS j FROM bw, LATERAL (SELECT unnest(range(1, len(way))) AS step)""",
    "RECURSIVE " + M.strip(),
)
def tree_model(spark, d):
    return markov.tree_model(markov.transitions(B.steps(spark, d)), "signup", ["purchase", "error"])


@query()
def group_paths(spark, d):
    return markov.group_paths(markov.transitions(B.steps(spark, d))).select("a", "b", r("length"))


_STEP = {  # (the step to a neighbour, the velocity) by transform, from the lists a.x, b.x and a.v
    "sqrt": ("[sign(b.x[k] - a.x[k]) * sqrt(abs(b.x[k] - a.x[k])) FOR k IN range(1, 65)]", "[sign(q) * sqrt(abs(q)) FOR q IN a.v]"),
    "log": ("[sign(b.x[k] - a.x[k]) * ln(1 + abs(b.x[k] - a.x[k])) FOR k IN range(1, 65)]", "[sign(q) * ln(1 + abs(q)) FOR q IN a.v]"),
    "linear": ("[b.x[k] - a.x[k] FOR k IN range(1, 65)]", "a.v"),
    "logratio": (
        "[ln(1 + abs(b.x[k])) - ln(1 + abs(a.x[k])) FOR k IN range(1, 65)]",
        "[ln(1 + abs(a.x[k] + a.v[k])) - ln(1 + abs(a.x[k])) FOR k IN range(1, 65)]",
    ),
}


def _kernel_sql(transform: str, method: str) -> str:
    d, u = _STEP[transform]
    center = "e1 AS (SELECT i, j, [z - list_avg(d) FOR z IN d] AS d, [z - list_avg(u) FOR z IN u] AS u FROM e)" if method == "pearson" else "e1 AS (FROM e)"
    return VEL + f""", hop AS (SELECT i, j FROM knn UNION SELECT a.i, b.j FROM knn a JOIN knn b ON a.j = b.i),
e AS (SELECT i, j, {d} AS d, {u} AS u FROM hop JOIN vv a ON a.cell_id = i JOIN vv b ON b.cell_id = j WHERE i <> j), {center},
e2 AS MATERIALIZED (SELECT i, j, coalesce(list_cosine_similarity(d, u), 0) AS c FROM e1),
g2 AS (SELECT i, j, CASE WHEN c >= 0 THEN exp(c / 0.1) - 1 ELSE -(exp(-c / 0.1) - 1) END AS g FROM e2),
bst AS (SELECT cell_id AS i, greatest(0, coalesce(max(c), 0)) AS best FROM v LEFT JOIN e2 ON i = cell_id GROUP BY cell_id),
sty AS (SELECT i, exp(least(1, greatest(0, (SELECT quantile_cont(best, 0.98) FROM bst) - best)) / 0.1) - 1 AS stay FROM bst),
tp AS (SELECT i, j, g / (sum(abs(g)) OVER (PARTITION BY i) + stay) AS p FROM g2 JOIN sty USING (i))"""


def kernel(spark, d, transform: str = "sqrt", method: str = "cosine"):
    near = cut(knn(spark, d))
    return markov.correlation_kernel(graph.two_hop(near), cut(vel(spark, d, near)), method, transform=transform)


def _transitions(transform: str, method: str):
    def run(spark, d):
        return kernel(spark, d, transform, method).select("i", "j", r("p"))

    return run


for _name, _transform, _method in (
    ("velocity_transition_matrix", "sqrt", "cosine"),
    ("velocity_transition_pearson", "sqrt", "pearson"),
    ("velocity_transition_log", "log", "pearson"),
    ("velocity_transition_linear", "linear", "cosine"),
    ("velocity_transition_logratio", "logratio", "cosine"),
):
    QUERIES[_name] = _transitions(_transform, _method)
    SQL[_name] = f"WITH {_kernel_sql(_transform, _method)} SELECT i, j, round(p, 6) + 0.0 AS p FROM tp WHERE p <> 0"


@query(
    """, un AS (SELECT i, p, generate_subscripts(a.x, 1) AS k, unnest([(b.x[k] - a.x[k]) / list_distance(a.x, b.x) FOR k IN range(1, 65)]) AS u
      FROM tp JOIN v a ON a.cell_id = i JOIN v b ON b.cell_id = j WHERE p <> 0),
    pr AS (SELECT i, k, sum(p * u) - avg(p) * sum(u) AS v FROM un GROUP BY i, k)
    SELECT i AS cell_id, k::INTEGER - 1 AS k, round(v, 5) + 0.0 AS v FROM pr""", _kernel_sql("sqrt", "cosine")
)
def project_velocity(spark, d):
    p = markov.project_velocity(kernel(spark, d), B.vectors(spark, d))
    return p.select("cell_id", F.posexplode("v").alias("k", "v")).select("cell_id", "k", r("v", digits=5))


@query(
    """, e AS (SELECT i, j, min(d) AS d FROM (SELECT i, j, d FROM knn UNION ALL SELECT j, i, d FROM knn) GROUP BY i, j),
    st(node, t) USING KEY (node) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION
      SELECT j, min(st.t + d) FROM st JOIN e ON i = st.node LEFT JOIN recurring.st o ON o.node = j WHERE o.t IS NULL OR st.t + d < o.t GROUP BY j),
    pa AS (SELECT b.node, a.node AS parent FROM st a JOIN e ON i = a.node JOIN st b ON b.node = j WHERE abs(a.t + d - b.t) < 1e-9 AND d > 0),
    wy AS (SELECT node AS "end", node, 0 AS back FROM st UNION ALL SELECT "end", parent, back + 1 FROM wy JOIN pa USING (node))
    SELECT "end", (max(back) OVER (PARTITION BY "end") - back)::INTEGER AS step, node FROM wy""",
    "RECURSIVE " + KNN,
)
def shortest_paths(spark, d):
    tree = cut(trees.shortest_tree(knn(spark, d), 0))
    return trees.paths_to(tree, tree.select(F.col("node").alias("end")))


@query(
    """, pt AS (SELECT cell_id AS c, s AS k, [x[q] + v[q] * sqrt(s) FOR q IN range(1, 65)] AS x FROM vv CROSS JOIN (SELECT unnest(range(0, 20)) AS s)),
    nd AS MATERIALIZED (SELECT c, k, v.cell_id AS j, list_distance(pt.x, v.x) AS d,
      row_number() OVER (PARTITION BY c, k ORDER BY list_distance(pt.x, v.x), v.cell_id) AS r FROM pt CROSS JOIN v QUALIFY r <= 10),
    lim AS (SELECT quantile_cont(d, 0.5) AS l FROM knn WHERE rank = 1),
    nr AS (SELECT c, count(*) FILTER (WHERE d < l AND k >= 10) AS close, max(k) FILTER (WHERE d < l AND k < 10) AS first FROM nd CROSS JOIN lim WHERE r = 1 GROUP BY c),
    wh AS (SELECT c, close, CASE WHEN close > 0 THEN 0 ELSE 10 - first END AS walked FROM nr),
    ins AS (SELECT c, j FROM nd JOIN wh USING (c) WHERE k >= 10 - walked AND k < 20 - walked AND (walked = 0 OR r = 1)),
    hop AS (SELECT i, j FROM knn WHERE rank <= 9 UNION ALL SELECT cell_id, cell_id FROM v),
    gr AS (SELECT c, label, count(*) AS n FROM ins JOIN hop ON hop.i = ins.j JOIN v ON v.cell_id = hop.j GROUP BY ALL)
    SELECT c AS cell_id, label AS grp, round(n / sum(n) OVER (PARTITION BY c), 6) AS share,
    round(1 - (10 - greatest(close, 1) + walked) / (10.0 + walked), 6) AS confidence, walked FROM gr JOIN wh USING (c)""", VEL
)
def fate_bias_of_paths(spark, d):
    p = vel(spark, d).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(19))))
    path = cut(p.select("cell_id", F.col("s").alias("step"), F.zip_with("x", "v", lambda a, b: a + b * F.sqrt("s")).alias("x")))
    cells = B.vectors(spark, d).withColumnRenamed("label", "grp")
    got = V.fate_bias(path, cells, k=10)
    return got.select("cell_id", "grp", r("share"), r("confidence"), "walked")


@query()
def ito_kernel(spark, d):
    near = cut(knn(spark, d))
    return markov.ito_kernel(graph.two_hop(near), cut(vel(spark, d, near))).select("i", "j", r("p"))


@query(
    """, fl AS (SELECT i, j, d * (b.x[1] - a.x[1]) AS v FROM knn JOIN v a ON a.cell_id = i JOIN v b ON b.cell_id = j),
    ft AS (SELECT j AS r, i AS c, (coalesce(x.v, 0) - coalesce(y.v, 0)) / 2 AS f FROM
      (SELECT i, j FROM fl UNION SELECT j, i FROM fl) LEFT JOIN fl x USING (i, j) LEFT JOIN (SELECT j AS i, i AS j, v FROM fl) y USING (i, j)),
    mu AS (SELECT r, c, greatest(f, 0) AS mu FROM ft),
    mq AS (SELECT r, c, -0.5 * -mu + 0.5 * 1.0 AS q FROM mu
      UNION ALL SELECT c, c, -0.5 * sum(mu) + 0.5 * -count(*)::DOUBLE FROM mu GROUP BY c)
    SELECT c AS i, r AS j, round(q, 6) + 0.0 AS q FROM mq""", KNN
)
def fokker_planck_rates(spark, d):
    e = knn(spark, d)
    f = B.vectors(spark, d).select(F.col("cell_id").alias("node"), F.get("x", 0).alias("f"))
    flow = graph.gradient(e.withColumnRenamed("d", "w"), f)
    w = graph.symmetric(e).select("i", "j", F.lit(1.0).alias("w"))
    return markov.fokker_planck(flow, w, 0.5).select("i", "j", r("q"))


# trajectories: a user's events as points (day, value)

T = B.STEPS_SQL + """, tr AS (SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY ts, event_id)::INTEGER AS step, [t, value] AS x FROM steps)"""


def traj(spark, d):
    from pyspark.sql import Window

    s = B.steps(spark, d)
    w = Window.partitionBy("traj_id").orderBy("ts", "event_id")
    return s.select("traj_id", F.row_number().over(w).alias("step"), F.array("t", "value").alias("x"))


@query(
    """, l AS (SELECT traj_id, step, coalesce(list_distance(x, lag(x) OVER o), 0) AS d FROM tr WINDOW o AS (PARTITION BY traj_id ORDER BY step))
    SELECT traj_id, step, round(sum(d) OVER (PARTITION BY traj_id ORDER BY step), 4) AS arc FROM l""", T
)
def arc_length(spark, d):
    return trajectory.arc_length(traj(spark, d)).select("traj_id", "step", r("arc", digits=4))


@query(
    """, a AS (SELECT traj_id, step, x, lead(x) OVER o AS y FROM tr WINDOW o AS (PARTITION BY traj_id ORDER BY step)),
    b AS (SELECT traj_id, step, y[1] - x[1] AS p, y[2] - x[2] AS q FROM a WHERE y IS NOT NULL),
    c AS (SELECT *, lag(p) OVER o AS p0, lag(q) OVER o AS q0 FROM b WINDOW o AS (PARTITION BY traj_id ORDER BY step))
    SELECT traj_id, step, round(p, 6) + 0.0 AS dt, round(q, 6) + 0.0 AS dv,
    CASE WHEN p0 IS NULL THEN -1.0::DOUBLE ELSE
    round(acos(greatest(-1, least(1, (p * p0 + q * q0) / (sqrt(p * p + q * q) * sqrt(p0 * p0 + q0 * q0))))), 4) END AS turn FROM c""", T
)
def tangents(spark, d):
    t = trajectory.tangents(traj(spark, d)).withColumns({"dt": F.get("tangent", 0), "dv": F.get("tangent", 1)})
    return t.select("traj_id", "step", r("dt"), r("dv"), F.coalesce(F.round("turn", 4), F.lit(-1.0)).alias("turn"))


@query(
    """, l AS (SELECT traj_id, unnest([1, 5]) AS lag, unnest([lead(x, 1) OVER o, lead(x, 5) OVER o]) AS y, x FROM tr
      WINDOW o AS (PARTITION BY traj_id ORDER BY step))
    SELECT traj_id, lag, round(avg(list_distance(x, y) ** 2), 3) AS msd FROM l WHERE y IS NOT NULL GROUP BY ALL""", T
)
def lagged_displacement(spark, d):
    return trajectory.lagged_displacement(traj(spark, d), [1, 5]).select("traj_id", "lag", r("msd", digits=3))


@query(
    """, rf AS (SELECT traj_id, x AS x0 FROM tr WHERE step = 3), sq AS (
      SELECT traj_id, unnest([0, 1]) AS k, unnest([(x[1] - x0[1]) ** 2, (x[2] - x0[2]) ** 2]) AS d FROM tr JOIN rf USING (traj_id))
    SELECT traj_id, k, round(sum(d) / count(*), 3) AS msd FROM sq GROUP BY ALL""", T
)
def mean_squared_displacement(spark, d):
    return trajectory.mean_squared_displacement(traj(spark, d), 2).select("traj_id", "k", r("msd", digits=3))


@query()
def resample_arc(spark, d):
    p = trajectory.resample(traj(spark, d), 10)
    return p.select("traj_id", "k", F.round(F.get("x", 0), 4).alias("t"), F.round(F.get("x", 1), 4).alias("value"))


_FP = """, h AS (SELECT traj_id, min(row(ts, event_id, t)) FILTER (WHERE state = 'purchase') AS hit,
  min(row(ts, event_id, t)) FILTER (WHERE state = 'error') AS sink FROM steps GROUP BY traj_id)"""


@query(
    _FP + """ SELECT traj_id, round(max(hit[3]) - max(t), 6) AS t FROM steps JOIN h USING (traj_id)
    WHERE hit IS NOT NULL AND (sink IS NULL OR hit < sink) AND state = 'signup' AND row(ts, event_id, t) < hit AND t > 0 GROUP BY traj_id""", B.STEPS_SQL
)
def first_passage_time(spark, d):
    return trajectory.first_passage(B.steps(spark, d), "signup", "purchase", ["error"]).select("traj_id", r("t"))


@query(
    _FP + """ SELECT traj_id, round(max(sink[3]) - max(t), 6) AS t FROM steps JOIN h USING (traj_id)
    WHERE sink IS NOT NULL AND state = 'signup' AND row(ts, event_id, t) < sink AND t > 0 GROUP BY traj_id""", B.STEPS_SQL
)
def exit_time(spark, d):
    return trajectory.exit_time(B.steps(spark, d), "signup", ["error"]).select("traj_id", r("t"))


@query(
    """, p AS (SELECT a.gene_id, a.grp, a.v / sum(a.v) OVER (PARTITION BY a.gene_id) AS p FROM
      (SELECT gene_id, grp, sum(total) AS v FROM dx JOIN c USING (cell_id) GROUP BY ALL) a)
    SELECT gene_id, round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END), 6) AS entropy FROM p GROUP BY gene_id"""
)
def expression_entropy(spark, d):
    from fluxcell.functions import scalars as S

    g = dense(spark, d, "s + u").join(B.cells(spark, d), "cell_id").groupBy("gene_id", "grp").agg(F.sum("value").alias("v"))
    g = g.groupBy("gene_id").agg(F.collect_list("v").alias("v"))
    p = F.transform("v", lambda x: F.try_divide(x, F.aggregate("v", F.lit(0.0), lambda s, y: s + y)))
    return g.select("gene_id", F.round(S.entropy_bits(p), 6).alias("entropy"))


# markers: groups are the regions of the suppliers' nations


def _regions(spark, d):
    n = B.table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("grp"))
    return B.table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("cell_id"), "grp")


@query(
    """, rg AS (SELECT s_suppkey AS cell_id, n_regionkey::VARCHAR AS grp FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    sz AS (SELECT grp, count(*) AS n FROM rg GROUP BY grp),
    vx AS (SELECT rg.grp, gene_id, cell_id, total AS value FROM dx JOIN rg USING (cell_id)),
    nz AS (SELECT gene_id, vx.grp, count(*) FILTER (WHERE value > 0) AS held, count(*) AS n FROM vx GROUP BY ALL),
    sh AS (SELECT gene_id, grp, held / sum(held) OVER (PARTITION BY gene_id) AS c, held / n AS frac FROM nz),
    pr AS (SELECT a.grp AS t, b.grp AS v, least(a.n, b.n) AS n2 FROM sz a JOIN sz b ON a.grp <> b.grp),
    ds AS (SELECT *, row_number() OVER (PARTITION BY gene_id, grp ORDER BY value DESC) AS place FROM vx),
    al AS (SELECT t, v, gene_id, value, true AS test FROM pr JOIN ds ON grp = t UNION ALL SELECT t, v, gene_id, value, false FROM pr JOIN ds ON grp = v WHERE place <= n2),
    rk AS (SELECT *, rank() OVER (PARTITION BY t, v, gene_id ORDER BY value) + (count(*) OVER (PARTITION BY t, v, gene_id, value) - 1) / 2.0 AS r FROM al),
    g2 AS (SELECT t, v, gene_id, count(*) FILTER (WHERE test) AS n1, count(*) FILTER (WHERE NOT test) AS n2, sum(r) FILTER (WHERE test) AS r1,
      avg(value) FILTER (WHERE test) AS m1, avg(value) FILTER (WHERE NOT test) AS m2,
      avg((value > 0)::INTEGER) FILTER (WHERE test) - avg((value > 0)::INTEGER) FILTER (WHERE NOT test) AS dp FROM rk GROUP BY ALL)
    SELECT g2.gene_id, t AS test_group, v AS versus_group, round(frac, 6) AS exp_frac, round(dp, 6) + 0.0 AS diff_ratio_pos,
    round(1 - sqrt(greatest(0, CASE WHEN c > 0 THEN c * log2(c) / 2 ELSE 0 END + (1 - c) / 2 - (1 + c) / 2 * log2((1 + c) / 2))), 6) AS specificity,
    round(1 - 2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2), 6) + 0.0 AS rbc, CASE WHEN m1 > 0 AND m2 > 0 THEN round(log2(m1 / m2), 6) + 0.0 END AS log2_fc
    FROM g2 JOIN (SELECT gene_id, grp AS t, frac FROM sh WHERE frac >= 0.1) USING (gene_id, t) JOIN (SELECT gene_id, grp AS v, c FROM sh) USING (gene_id, v)"""
)
def group_marker_effects(spark, d):
    got = markers.group_markers(B.total_layer(B.counts(spark, d)), _regions(spark, d), most_q=None)
    return got.select("gene_id", "test_group", "versus_group", *[r(c) for c in ("exp_frac", "diff_ratio_pos", "specificity", "rbc", "log2_fc")])


@query()
def group_markers(spark, d):
    got = markers.group_markers(B.total_layer(B.counts(spark, d)), _regions(spark, d))
    return got.select("gene_id", "test_group", "versus_group", r("specificity"), r("rbc"), r("log2_fc"), r("p", digits=4), r("q", digits=4))


# labelling recipes: all at one time with return flag N as new, shares of the quantities (by discount) that rise or fall by year, and a pulse that is largest in the fourth year

_NEW = {
    "one-shot": ("CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0.0 END", "1.0"),
    "kin": ("l_quantity * (1 - l_discount) * (1 - exp(-0.3 * (year(l_shipdate) - 1994)))", None),
    "deg": ("l_quantity * (1 - l_discount) * exp(-0.3 * (year(l_shipdate) - 1994))", None),
    "mix": ("l_quantity * (1 - abs(year(l_shipdate) - 1998) / 5.0) * (1 - l_discount)", None),
}


def _labelled(spark, d, kind):
    new, t = _NEW[kind]
    lines = B.table(spark, d, "lineitem").join(B.table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    t = F.lit(1.0) if t else (F.year("l_shipdate") - 1994).cast("double")
    return lines.groupBy(F.col("l_suppkey").alias("cell_id"), F.col("p_brand").alias("gene_id"), t.alias("t")).agg(
        F.sum(F.expr(new)).alias("new"), F.sum("l_quantity").alias("total")
    )


def _labelled_sql(kind):
    new, t = _NEW[kind]
    rise = f"""SELECT gene_id, sum(w * t * y) / sum(w * t * t) AS gamma, sum(w * t * t) AS precision,
      CASE WHEN count(*) > 1 THEN 1 - (sum(w * y * y) - sum(w * t * y) ** 2 / sum(w * t * t)) / nullif(sum(w * y * y) - sum(w * y) ** 2 / sum(w), 0) END AS r2, count(*) AS n_times
      FROM (SELECT gene_id, t, -ln(1 - k) AS y, (1 - k) ** 2 / greatest(var_k, 1e-12) AS w FROM st WHERE t > 0 AND k < 1 {"AND t <= (SELECT peak FROM pk)" if kind == "mix" else ""}) GROUP BY gene_id"""
    cov, vt, vy = "(sum(w * t * y) - sum(w * t) * sum(w * y) / sum(w))", "(sum(w * t * t) - sum(w * t) ** 2 / sum(w))", "(sum(w * y * y) - sum(w * y) ** 2 / sum(w))"
    fall = f"""SELECT gene_id, CASE WHEN count(*) > 1 THEN -{cov} / {vt} END AS gamma, CASE WHEN count(*) > 1 THEN {vt} END AS precision,
      CASE WHEN count(*) > 1 THEN {cov} ** 2 / ({vt} * {vy}) END AS r2, count(*) AS n_times
      FROM (SELECT gene_id, t, ln(k) AS y, k * k / greatest(var_k, 1e-12) AS w FROM st WHERE k > 0 {"AND t >= (SELECT peak FROM pk)" if kind == "mix" else ""}) GROUP BY gene_id"""
    gamma = {
        "one-shot": "SELECT gene_id, -ln(1 - k) / t AS gamma, r2, 1 AS n_times FROM st WHERE k < 1 AND t > 0",
        "kin": rise,
        "deg": fall,
        "mix": f"""SELECT gene_id, sum(gamma * precision) / sum(precision) AS gamma, min(r2) AS r2, sum(n_times) - count(*) + 1 AS n_times
          FROM (FROM ({rise}) UNION ALL FROM ({fall})) WHERE gamma IS NOT NULL AND precision > 0 GROUP BY gene_id""",
    }[kind]
    alpha = "any_value(gamma) * sum(new) / sum(1 - exp(-gamma * t))" if kind in ("one-shot", "kin") else "any_value(gamma) * avg(total)"
    return f"""WITH raw AS (SELECT l_suppkey AS cell_id, p_brand AS gene_id, {t or "(year(l_shipdate) - 1994)::DOUBLE"} AS t, sum({new}) AS new, sum(l_quantity) AS total
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
    pk AS (SELECT t AS peak FROM raw GROUP BY t ORDER BY sum(new) / sum(total) DESC, t DESC LIMIT 1),
    ct AS (SELECT cell_id, sum(total) AS s FROM raw GROUP BY cell_id),
    lab AS (SELECT cell_id, gene_id, t, new / f AS new, total / f AS total FROM raw JOIN (SELECT cell_id, s / avg(s) OVER () AS f FROM ct) USING (cell_id)),
    st AS (SELECT gene_id, t, k, greatest(y2 - k * xy, 0) / (n * x2) AS var_k, 1 - greatest(y2 - k * xy, 0) / nullif(y2 - y * y / n, 0) AS r2
      FROM (SELECT gene_id, t, count(*) AS n, sum(new) AS y, sum(new * new) AS y2, sum(new * total) AS xy, sum(total * total) AS x2, sum(new * total) / sum(total * total) AS k FROM lab GROUP BY gene_id, t)),
    ga AS ({gamma}), al AS (SELECT gene_id, {alpha} AS alpha FROM lab JOIN ga USING (gene_id) WHERE gamma IS NOT NULL GROUP BY gene_id)
    SELECT gene_id, round(gamma, 6) AS gamma, round(r2, 5) AS r2, round(alpha, 4) AS alpha, n_times::BIGINT AS n_times FROM ga JOIN al USING (gene_id)"""


def _labelling(kind):
    def run(spark, d):
        made = labelling.labelling_recipe(_labelled(spark, d, kind))
        if made.kind != kind:
            raise ValueError(f"{kind} data were taken for {made.kind}")
        return made.params.select("gene_id", r("gamma"), r("r2", digits=5), r("alpha", digits=4), "n_times")

    return run


for _kind in labelling.KINDS:
    QUERIES[f"recipe_{_kind.replace('-', '_')}"] = _labelling(_kind)
    SQL[f"recipe_{_kind.replace('-', '_')}"] = _labelled_sql(_kind)
