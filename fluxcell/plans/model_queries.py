"""Queries of vector fields, prediction, simulation, multi-omic data, recipes, sources."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fluxcell.functions.lineage import cut
from fluxcell.operators import decompose, intervals, matrix, multiomic, rank, select, simulate
from fluxcell.operators import vectorfield as V
from fluxcell.plans import bindings as B
from fluxcell.plans import recipes
from fluxcell.plans.graph_queries import r
from fluxcell.plans.stats_queries import vel
from fluxcell.sources import tables
from fluxcell.streaming import incremental

QUERIES, SQL = {}, {}


def query(sql: str | None = None, prefix: str = B.COUNTS_SQL):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {prefix.strip()}\n{sql}"
        return f

    return add


def low(spark, d, k: int = 3):
    """Cells in k principal components, with their projected velocities."""
    v = cut(vel(spark, d))
    x, vec, _, _ = decompose.pca(v.select("cell_id", "x"), 64, k)
    q = [list(map(float, row)) for row in vec.T]
    from fluxcell.functions.scalars import project

    return x.join(v.select("cell_id", project(F.col("v"), q).alias("v"), F.col("label").cast("string").alias("grp")), "cell_id")


def field(spark, d, k: int = 3):
    cells = cut(low(spark, d, k))
    return cells, V.fit_field(cells, beta=0.5)


@query()
def pca(spark, d):
    x, _, _, _ = decompose.pca(B.vectors(spark, d), 64, 5)
    return x.select("cell_id", F.posexplode("x").alias("component", "score")).select("cell_id", "component", r("score", digits=4))


@query(
    """, v AS (SELECT embedding::DOUBLE[] AS x FROM embeddings), u AS (SELECT generate_subscripts(x, 1)::INTEGER - 1 AS k, unnest(x) AS x FROM v)
    SELECT k, round(avg(x), 6) + 0.0 AS mean, round(var_samp(x), 6) AS variance FROM u GROUP BY k"""
)
def feature_covariance(spark, d):
    mean, cov, _ = decompose.covariance(B.vectors(spark, d), 64)
    data = [(i, float(m), float(v)) for i, (m, v) in enumerate(zip(mean, np.diag(cov), strict=True))]
    return spark.createDataFrame(data, "k int, mean double, variance double").select("k", r("mean"), r("variance"))


@query()
def kmeans_clusters(spark, d):
    return decompose.kmeans(B.vectors(spark, d), 64, 8, rounds=5)


@query()
def svr_dispersion(spark, d):
    s = select.log_mean_cv(B.total_layer(B.sparse_counts(spark, d)), B.n_cells(spark, d))
    return decompose.dispersion_score(s).select("gene_id", r("score", digits=4))


@query()
def vector_field_fit(spark, d):
    cells, f = field(spark, d)
    out = V.per_cell(cells, f, {"v": V.velocity, "cosine": V.cosine_to_data})
    return out.select("cell_id", F.round(F.get("v", 0), 4).alias("v0"), F.round("cosine", 4).alias("cosine"))


@query()
def vector_field_calculus(spark, d):
    cells, f = field(spark, d)
    names = {"divergence": V.divergence, "curl": V.curl, "curvature": V.curvature, "torsion": V.torsion, "speed": V.speed, "jacobian_norm": V.jacobian_norm}
    return V.per_cell(cells, f, names).select("cell_id", *[r(k, digits=4) for k in names])


@query()
def vector_field_acceleration(spark, d):
    cells, f = field(spark, d)
    out = V.per_cell(cells, f, {"a": V.acceleration, "l": lambda f, x, v: f.laplacian(x)})
    return out.select("cell_id", F.posexplode("a").alias("k", "a"), "l").select("cell_id", "k", r("a", digits=4), F.round(F.get("l", "k"), 4).alias("laplacian"))


@query()
def vector_field_jacobian(spark, d):
    cells, f = field(spark, d)
    return V.jacobian_table(cells, f).select("cell_id", "effector", "regulator", r("value", digits=4))


@query()
def rank_jacobian_of_field(spark, d):
    cells, f = field(spark, d)
    j = V.jacobian_table(cells, f).join(cells.select("cell_id", "grp"), "cell_id")
    return rank.rank_jacobian(j, "full eff").select("grp", "effector", "regulator", r("value", digits=4), "rank")


@query()
def vector_field_sensitivity(spark, d):
    cells, f = field(spark, d)
    out = V.per_cell(cells, f, {"s": V.sensitivity})
    return out.select("cell_id", F.posexplode("s").alias("k", "s")).select("cell_id", "k", r("s", digits=3))


@query()
def vector_field_hessian(spark, d):
    cells, f = field(spark, d)
    out = V.per_cell(cells, f, {"h": V.hessian, "turning": V.turning})
    out = out.select("cell_id", r("turning", digits=3), F.posexplode("h").alias("k", "h"))
    return out.select("cell_id", "k", r("h", digits=4), "turning")


def wells(spark, d):
    """A field with two basins, fitted to velocities x - x^3 along the first axis and -y along the second, at all cells' places scaled into it."""
    x = F.slice("x", 1, 2)
    size = B.vectors(spark, d).agg(F.max(F.greatest(F.abs(F.get("x", 0)), F.abs(F.get("x", 1)))).alias("size"))
    cells = B.vectors(spark, d).crossJoin(F.broadcast(size)).select("cell_id", F.transform(x, lambda z: 1.8 * z / F.col("size")).alias("x"))
    a, b = F.get("x", 0), F.get("x", 1)
    cells = cut(cells.select("cell_id", "x", F.array(a - a * a * a, -b).alias("v")))
    return cells, V.fit_field(cells, beta=0.5, ridge=0.01)


@query()
def field_restarts(spark, d):
    cells = cut(low(spark, d))
    _, got = V.fit_field_with_restarts(cells, 0.6, beta=0.5)
    return cells.agg(F.count("*").alias("n")).select("n", F.lit(round(got, 3)).alias("agreement"))


@query()
def fixed_points(spark, d):
    cells, f = wells(spark, d)
    return V.fixed_points(cells, f, digits=2).select(F.round(F.get("x", 0), 2).alias("x0"), F.round(F.get("x", 1), 2).alias("x1"), "n", "stable")


@query()
def nullclines(spark, d):
    cells, f = field(spark, d, 2)
    ends = [g(F.get("x", i)).alias(n) for i, p in ((0, "x"), (1, "y")) for g, n in ((F.min, f"{p}0"), (F.max, f"{p}1"))]
    return V.nullclines(cells.agg(*ends), f, 30).select("component", r("x", digits=3), r("y", digits=3))


@query()
def separatrices(spark, d):
    cells, f = wells(spark, d)
    points = V.fixed_points(cells, f, digits=2).where("not stable").select(F.pmod(F.xxhash64("x"), F.lit(1_000_000)).alias("cell_id"), "x")
    return V.separatrices(points, f, 2.0, 40, 5).select("cell_id", "step", F.round(F.get("x", 0), 2).alias("x0"), F.round(F.get("x", 1), 2).alias("x1"))


@query()
def knock_out(spark, d):
    cells, f = field(spark, d)
    out = V.per_cell(cells, f, {"v": V.knock_out(0, np.eye(3))})
    return out.select("cell_id", F.posexplode("v").alias("k", "v")).select("cell_id", "k", r("v", digits=4))


@query()
def perturbation(spark, d):
    cells, f = field(spark, d)
    modes = ["j_delta_x", "j_x_prime", "j_j_delta_x", "f_x_prime", "f_x_prime_minus_f"]
    out = V.per_cell(cells, f, {m: V.perturb(m, np.array([0.1, 0.0, -0.1])) for m in modes})
    return out.select("cell_id", *[F.round(F.get(m, 0), 4).alias(m) for m in modes])


@query()
def fate_trajectories(spark, d):
    cells, f = field(spark, d)
    t = V.integrate(cells, f, 5.0, 50, 6)
    return t.select("cell_id", "step", r("t"), F.round(F.get("x", 0), 3).alias("x0"))


@query()
def fate_shares(spark, d):
    cells, f = field(spark, d)
    t = cut(V.integrate(cells, f, 5.0, 50, 11))
    return V.fate_shares(t, cells, 10, 5).select("cell_id", "grp", r("share"))


@query()
def fate_bias(spark, d):
    cells, f = field(spark, d)
    t = cut(V.integrate(cells, f, 5.0, 50, 31))
    return V.fate_bias(t, cells).select("cell_id", "grp", r("share"), r("confidence"), "walked")


@query()
def lineage_cells(spark, d):
    cells, f = field(spark, d)
    t = cut(V.integrate(cells, f, 5.0, 50, 11))
    return V.lineage(t, cells)


@query()
def path_potential(spark, d):
    cells, f = field(spark, d)
    t = V.integrate(cells, f, 5.0, 50, 26)
    return V.path_potential(t, f).select("cell_id", r("potential", digits=3))


@query()
def least_action_paths(spark, d):
    cells, f = field(spark, d)
    g = cells.groupBy("grp").agg(F.min_by("x", "cell_id").alias("x"))
    a, b = g.select(F.col("grp").alias("ga"), F.col("x").alias("a")), g.select(F.col("grp").alias("gb"), F.col("x").alias("b"))
    pairs = a.join(b, F.col("ga") < F.col("gb")).select((F.col("ga").cast("long") * 100 + F.col("gb").cast("long")).alias("pair_id"), "a", "b")
    out = V.least_action_paths(pairs.repartition("pair_id"), f)
    return out.select("pair_id", r("action", digits=2), r("t", digits=2))


@query()
def simulate_ode(spark, d):
    cells = B.vectors(spark, d).select("cell_id", F.transform(F.slice("x", 1, 2), lambda z: F.abs(z)).alias("x"))

    def motif(x):
        h = 1 / (1 + x[:, ::-1] ** 2)
        return h - 0.5 * x

    return simulate.simulate_ode(cells, motif, 5.0, 50).select("cell_id", F.round(F.get("x", 0), 4).alias("a"), F.round(F.get("x", 1), 4).alias("b"))


# chromatin: c = spliced + unspliced of the next supplier, peaks and genes on part keys

_CUS = """, cus AS (SELECT a.cell_id, a.gene_id, b.spliced + b.unspliced AS c, a.unspliced AS u, a.spliced AS s
  FROM dense a JOIN dense b ON a.gene_id = b.gene_id AND b.cell_id = a.cell_id % (SELECT n_cells FROM n) + 1)"""


def cus(spark, d):
    from fluxcell.plans.graph_queries import us

    x = us(spark, d)
    n = B.n_cells(spark, d)
    c = x.select(F.col("cell_id").alias("next"), "gene_id", (F.col("s") + F.col("u")).alias("c"))
    a = x.crossJoin(F.broadcast(n)).withColumn("next", F.col("cell_id") % F.col("n_cells") + 1)
    return a.join(c, ["next", "gene_id"]).select("cell_id", "gene_id", "c", "u", "s")


@query(
    _CUS
    + """, lo AS (SELECT gene_id, min(c) AS c0, min(u) AS u0, min(s) AS s0 FROM cus GROUP BY ALL),
    sh AS (SELECT cell_id, gene_id, c - c0 AS c, u - u0 AS u, s - s0 AS s FROM cus JOIN lo USING (gene_id)),
    so AS (SELECT * FROM sh WHERE c > 0 OR u > 0 OR s > 0),
    tp AS (SELECT gene_id, quantile_cont(c, 0.998) AS cp, quantile_cont(u, 0.998) AS up, quantile_cont(s, 0.998) AS sp FROM so GROUP BY ALL),
    ft AS (SELECT so.* FROM so JOIN tp USING (gene_id) WHERE c <= cp AND u <= up AND s <= sp),
    mo AS (SELECT gene_id, max(c) AS cm, max(u) AS um, max(s) AS sm FROM ft GROUP BY ALL),
    hi AS (SELECT ft.* FROM ft JOIN mo USING (gene_id) WHERE c >= 0.1 * cm AND u >= 0.1 * um AND s >= 0.1 * sm),
    ed AS (SELECT gene_id, quantile_cont(u, 0.95) AS ue, quantile_cont(s, 0.95) AS se FROM hi GROUP BY ALL),
    ga AS (SELECT gene_id, sum(u * s) / sum(s * s) AS gamma FROM hi JOIN ed USING (gene_id) WHERE u >= ue OR s >= se GROUP BY ALL)
    SELECT cell_id, gene_id, round(gamma, 6) AS gamma, round(u - gamma * s, 4) + 0.0 AS velocity FROM sh JOIN ga USING (gene_id)"""
)
def chromatin_velocity(spark, d):
    return multiomic.chromatin_velocity(cus(spark, d)).select("cell_id", "gene_id", r("gamma"), r("velocity", digits=4))


@query(
    _CUS
    + """, ed AS (SELECT gene_id, quantile_cont(u, 0.95) AS ue, quantile_cont(s, 0.95) AS se FROM cus GROUP BY ALL),
    m AS (SELECT gene_id, u, s, CASE WHEN u >= ue OR s >= se THEN u ELSE 0 END AS y1, CASE WHEN u >= ue OR s >= se THEN s ELSE 0 END AS x1,
      2 * u * s + u AS y2, 2 * s * s - s AS x2 FROM cus JOIN ed USING (gene_id)),
    g1 AS (SELECT gene_id, sum(y1 * x1) / sum(x1 * x1) AS g1, sum(y2 * x2) / sum(x2 * x2) AS g2 FROM m GROUP BY ALL),
    w2 AS (SELECT gene_id, stddev_pop(y1 - g1 * x1) AS d1, sum(y1 * x1) AS a1, sum(x1 * x1) AS b1, stddev_pop(y2 - g2 * x2) AS d2,
      sum(y2 * x2) AS a2, sum(x2 * x2) AS b2 FROM m JOIN g1 USING (gene_id) GROUP BY ALL),
    ga AS (SELECT gene_id, (CASE WHEN d1 > 1e-9 THEN a1 / (d1 * d1) ELSE 0 END + CASE WHEN d2 > 1e-9 THEN a2 / (d2 * d2) ELSE 0 END) / nullif(CASE WHEN d1 > 1e-9 THEN b1 / (d1 * d1) ELSE 0 END + CASE WHEN d2 > 1e-9 THEN b2 / (d2 * d2) ELSE 0 END, 0) AS gamma FROM w2)
    SELECT gene_id, round(gamma, 6) AS gamma, round(1 - sum((u - gamma * s) ** 2) / sum(u * u), 6) AS r2 FROM cus JOIN ga USING (gene_id) GROUP BY gene_id, gamma"""
)
def chromatin_velocity_stochastic(spark, d):
    x = cus(spark, d)
    us2 = x.select("cell_id", "gene_id", (F.col("u") * F.col("s")).alias("us"), (F.col("s") * F.col("s")).alias("ss"))
    return multiomic.chromatin_velocity_stochastic(x, us2).select("gene_id", r("gamma"), r("r2"))


_PEAKS = """peaks AS (SELECT l_orderkey * 10 + l_linenumber AS peak_id, l_suppkey % 5 AS chrom, l_partkey * 3 AS s0, l_partkey * 3 + l_linenumber AS e0
  FROM lineitem),
genes AS (SELECT p_partkey AS gene_id, p_size % 5 AS chrom, p_partkey * 3 + 1 AS tss FROM part),
links AS (SELECT gene_id, peak_id, greatest(s0 - tss, tss - e0, 0) AS distance FROM genes JOIN peaks USING (chrom)
  WHERE s0 <= tss + 10 AND e0 >= tss - 10)"""


def _peaks(spark, d):
    li = B.table(spark, d, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("peak_id"),
        (F.col("l_suppkey") % 5).alias("chrom"),
        (F.col("l_partkey") * 3).alias("start"),
        (F.col("l_partkey") * 3 + F.col("l_linenumber")).alias("end"),
    )


def _links(spark, d):
    p = B.table(spark, d, "part")
    genes = p.select(F.col("p_partkey").alias("gene_id"), (F.col("p_size") % 5).cast("long").alias("chrom"), (F.col("p_partkey") * 3 + 1).alias("tss"))
    return multiomic.link_peaks(_peaks(spark, d), genes, 10)


@query("SELECT * FROM links", _PEAKS)
def link_peaks(spark, d):
    return _links(spark, d)


@query(
    """, pc AS (SELECT l_orderkey * 10 + l_linenumber AS peak_id, l_suppkey AS cell_id, l_quantity AS value FROM lineitem)
    SELECT cell_id, gene_id, sum(value) AS value FROM links JOIN pc USING (peak_id) GROUP BY ALL""", _PEAKS
)
def gene_activity(spark, d):
    li = B.table(spark, d, "lineitem")
    pc = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("peak_id"), F.col("l_suppkey").alias("cell_id"), F.col("l_quantity").alias("value"))
    return multiomic.gene_activity(_links(spark, d), pc)


@query()
def recipe_monocle(spark, d):
    p = recipes.monocle(B.sparse_counts(spark, d), B.cells(spark, d), 200)
    chosen = p.genes.where("selected").select("gene_id")
    return matrix.restrict(matrix.layer(p.expr, "X"), None, chosen).select("cell_id", "gene_id", r("value"))


@query()
def recipe_monocle_components(spark, d):
    """The whole recipe on brands: log counts less two covariates, five components (by absolute value), cell cycle and share of new."""
    e = B.counts(spark, d)
    s = B.table(spark, d, "supplier")
    z = s.select(F.col("s_suppkey").alias("cell_id"), F.col("s_acctbal").alias("z"), (F.col("s_nationkey") % 5).cast("double").alias("y"))
    phases = e.select("gene_id").distinct().select("gene_id", (F.substring("gene_id", 7, 9).cast("int") % 5).alias("phase"))
    p = recipes.monocle(e, B.cells(spark, d), 20, n_pcs=5, covariates=z, names=("z", "y"), phases=phases, new="unspliced")
    out = p.pca.join(p.cells, "cell_id")
    return out.select("cell_id", *[F.round(F.abs(F.get("x", k)), 3).alias(f"pc{k}") for k in range(2)], "phase", r("progress", digits=3), r("ntr"))


@query()
def recipe_monocle_pearson(spark, d):
    p = recipes.monocle_pearson(B.sparse_counts(spark, d), B.cells(spark, d), 200)
    return p.expr.select("cell_id", "gene_id", r("value"))


@query()
def recipe_seurat(spark, d):
    p = recipes.seurat(B.sparse_counts(spark, d), B.cells(spark, d), 200)
    return p.genes.select("gene_id", r("score"), "selected")


@query()
def recipe_pf_log_pf(spark, d):
    return recipes.pf_log_pf(B.sparse_counts(spark, d), B.cells(spark, d)).expr.select("cell_id", "gene_id", r("value", digits=4))


@query(
    """, ct AS (SELECT cell_id, sum(value) AS ct FROM x GROUP BY ALL), gt AS (SELECT gene_id, sum(value) AS gt FROM x GROUP BY ALL),
    m AS (SELECT cell_id, gene_id, value, ct * gt / (SELECT sum(value) FROM x) AS mu FROM x JOIN ct USING (cell_id) JOIN gt USING (gene_id))
    SELECT cell_id, gene_id, round(greatest(least((value - mu) / sqrt(mu + mu * mu / 100), sqrt(n_cells)), -sqrt(n_cells)), 6) + 0.0 AS value
    FROM m CROSS JOIN n""", B.SPARSE_SQL
)
def pearson_residuals(spark, d):
    x = B.total_layer(B.sparse_counts(spark, d))
    return recipes.pearson_residuals(x, B.cells(spark, d)).select("cell_id", "gene_id", r("value"))


@query(
    """, p AS (SELECT cell_id, gene_id, value, (gene_id % 10) / 10.0 AS pi FROM x)
    SELECT cell_id, gene_id, 'new' AS layer, round(value * pi, 6) AS value FROM p UNION ALL
    SELECT cell_id, gene_id, 'old', round(value * (1 - pi), 6) FROM p""", B.SPARSE_SQL
)
def split_labeled_counts(spark, d):
    x = B.total_layer(B.sparse_counts(spark, d))
    share = x.select("cell_id", "gene_id", ((F.col("gene_id") % 10) / 10.0).alias("pi"))
    return tables.split_labeled(x, share).select("cell_id", "gene_id", "layer", r("value"))


@query(
    """, d AS (SELECT strftime(ts, '%Y-%m-%d') AS start, event_type AS state, value FROM events)
    SELECT start, state, count(*) AS n, round(sum(value), 4) AS total FROM d GROUP BY ALL"""
)
def windowed_totals(spark, d):
    w = incremental.windowed_totals(B.steps(spark, d))
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "state", "n", r("total", digits=4))


@query(
    """, o AS (SELECT chrom, s0, e0, max(e0) OVER (PARTITION BY chrom ORDER BY s0, e0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM peaks),
    g AS (SELECT *, sum((reach IS NULL OR s0 > reach)::INTEGER) OVER (PARTITION BY chrom ORDER BY s0, e0 ROWS UNBOUNDED PRECEDING) AS island FROM o)
    SELECT chrom, min(s0) AS start, max(e0) AS "end", count(*) AS n FROM g GROUP BY chrom, island""", _PEAKS
)
def merged_peaks(spark, d):
    return intervals.merge_intervals(_peaks(spark, d))


@query(
    """SELECT p_partkey AS gene_id, greatest(p_partkey * 30 - CASE WHEN p_size % 2 = 0 THEN 2000 ELSE 100 END, 0) AS start,
    p_partkey * 30 + p_size + CASE WHEN p_size % 2 = 0 THEN 100 ELSE 2000 END AS "end" FROM part"""
)
def gene_regions(spark, d):
    p = B.table(spark, d, "part").select(
        F.col("p_partkey").alias("gene_id"),
        F.lit("1").alias("chrom"),
        (F.col("p_partkey") * 30).alias("start"),
        (F.col("p_partkey") * 30 + F.col("p_size")).alias("end"),
        F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand"),
    )
    return intervals.gene_regions(p, 2000, 100).select("gene_id", "start", "end")


# peaks one to three places from a gene's start are its promoters; each is linked with the next gene as well
@query(
    """, an AS (SELECT gene_id, peak_id, distance, distance BETWEEN 1 AND 3 AS promoter FROM links),
    lk AS (SELECT peak_id, gene_id + 1 AS gene_id, gene_id AS peak_gene, promoter, distance AS own, l_discount * 10 AS correlation, l_quantity * 400 AS distance
      FROM an JOIN lineitem ON peak_id = l_orderkey * 10 + l_linenumber),
    en AS (SELECT gene_id, peak_id FROM lk WHERE (peak_gene = gene_id OR distance < 10000) AND NOT promoter AND own > 0 GROUP BY ALL HAVING max(correlation) > 0.5),
    pr AS (SELECT gene_id, peak_id FROM an WHERE promoter),
    rl AS (FROM pr UNION (SELECT * FROM en SEMI JOIN pr USING (gene_id)))
    SELECT l_suppkey AS cell_id, gene_id, sum(l_quantity) AS value FROM rl JOIN lineitem ON peak_id = l_orderkey * 10 + l_linenumber GROUP BY ALL""", _PEAKS
)
def aggregate_peaks(spark, d):
    li = B.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("peak_id"), "l_suppkey", "l_quantity", "l_discount")
    kind = F.when(F.col("distance").between(1, 3), "promoter").otherwise("distal")
    annotation = cut(_links(spark, d).select("peak_id", "gene_id", kind.alias("kind"), "distance"))
    links = annotation.join(li, "peak_id").select(
        "peak_id",
        (F.col("gene_id") + 1).alias("gene_id"),
        F.col("gene_id").alias("peak_gene"),
        F.col("kind").alias("peak_kind"),
        annotation["distance"].alias("peak_distance"),  # a peak_id may stand at several places
        (F.col("l_discount") * 10).alias("correlation"),
        (F.col("l_quantity") * 400).alias("distance"),
    )
    roles = intervals.promoter_enhancer_peaks(annotation, links)
    counts = li.select("peak_id", F.col("l_suppkey").alias("cell_id"), F.col("l_quantity").alias("value"))
    return multiomic.gene_activity(roles, counts)
