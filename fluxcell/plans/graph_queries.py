"""Queries over neighbour graphs, moments and kinetics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxcell.functions import scalars as S
from fluxcell.functions.lineage import cut
from fluxcell.operators import clustering, community, flows, graph, joint, kinetics, matrix, moments, neighbours, sampling, trees
from fluxcell.plans import bindings as B

QUERIES, SQL = {}, {}
K = 10


def query(sql: str | None = None, prefix: str = B.COUNTS_SQL):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {prefix.strip()}\n{sql}"
        return f

    return add


def r(name: str, alias: str | None = None, digits: int = 6):
    return (F.round(F.col(name), digits) + F.lit(0.0)).alias(alias or name)  # no negative zeros


KNN = f"""v AS (SELECT vec_id AS cell_id, embedding::DOUBLE[] AS x, label FROM embeddings),
knn AS MATERIALIZED (SELECT a.cell_id AS i, b.cell_id AS j, list_distance(a.x, b.x) AS d,
  row_number() OVER (PARTITION BY a.cell_id ORDER BY list_distance(a.x, b.x), b.cell_id)::INTEGER AS rank
  FROM v a JOIN v b ON a.cell_id <> b.cell_id QUALIFY rank <= {K}),
one AS (SELECT i, j FROM knn UNION SELECT cell_id, cell_id FROM v),
wt AS (SELECT i, j, 1.0 / count(*) OVER (PARTITION BY i) AS w FROM one)"""


def knn(spark, d, k: int = K):
    v = B.vectors(spark, d)
    return graph.nearest(v, v, k)


@query("SELECT i, j, round(d, 6) AS d, rank FROM knn", KNN)
def nearest_neighbours(spark, d):
    return knn(spark, d).select("i", "j", r("d"), "rank")


@query()
def nearest_neighbours_approximate(spark, d):
    v = B.vectors(spark, d)
    return graph.nearest_approximate(v, v, K).select("i", "j", r("d"), "rank")


@query()
def approximate_recall(spark, d):
    v = B.vectors(spark, d)
    return neighbours.recall(graph.nearest_approximate(v, v, K, block=64), knn(spark, d)).select(r("recall"), "n")


@query()
def visited_lists(spark, d):
    v = B.vectors(spark, d)
    return neighbours.visited_lists(v, v, K, block=64).select("cell_id", r("bound"), "visited", "lists")


@query("SELECT i, j, round(w, 9) AS w FROM wt", KNN)
def smoothing_weights(spark, d):
    return graph.smoothing_weights(knn(spark, d), B.vectors(spark, d)).select("i", "j", r("w", digits=9))


@query(
    """, g AS (SELECT i, j, exp(-d * d / 200) AS w FROM knn)
    SELECT i, j, round(w / sum(w) OVER (PARTITION BY i), 6) AS w FROM g""",
    KNN,
)
def gaussian_weights(spark, d):
    return graph.gaussian_weights(knn(spark, d)).select("i", "j", r("w"))


@query(
    """SELECT i, j, round(d, 6) AS d, rank FROM knn JOIN v a ON a.cell_id = i JOIN v b ON b.cell_id = j
    WHERE a.label = b.label""",
    KNN,
)
def neighbours_within_groups(spark, d):
    cells = B.vectors(spark, d).select("cell_id", F.col("label").alias("grp"))
    return graph.within_groups(knn(spark, d), cells).select("i", "j", r("d"), "rank")


@query(
    """SELECT i, j FROM knn UNION SELECT a.i, b.j FROM knn a JOIN knn b ON a.j = b.i UNION SELECT i, i FROM knn""", KNN
)
def two_hop_neighbours(spark, d):
    return graph.two_hop(knn(spark, d))


@query("SELECT a.i, a.j, round(least(a.d, b.d), 6) AS w FROM knn a JOIN knn b ON a.i = b.j AND a.j = b.i", KNN)
def mutual_neighbours(spark, d):
    e = knn(spark, d).withColumnRenamed("d", "w")
    back = e.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")
    return graph.mutual(e, back).select("i", "j", r("w"))


@query(
    """, bo AS (SELECT i, j, d FROM knn UNION ALL SELECT j, i, d FROM knn)
    SELECT i, j, round(min(d), 6) AS d FROM bo GROUP BY i, j""",
    KNN,
)
def symmetric_graph(spark, d):
    return graph.symmetric(knn(spark, d)).select("i", "j", r("d"))


@query(
    """SELECT i, round(avg((a.label = b.label)::INTEGER), 6) AS purity FROM knn JOIN v a ON a.cell_id = i
    JOIN v b ON b.cell_id = j GROUP BY i""",
    KNN,
)
def neighbour_purity(spark, d):
    cells = B.vectors(spark, d).select("cell_id", F.col("label").alias("grp"))
    return graph.purity(knn(spark, d), cells).select("i", r("purity"))


@query(
    """SELECT a.label AS a, b.label AS b, count(*) AS n FROM knn JOIN v a ON a.cell_id = i JOIN v b ON b.cell_id = j
    GROUP BY ALL""",
    KNN,
)
def group_graph(spark, d):
    cells = B.vectors(spark, d).select("cell_id", F.col("label").alias("grp"))
    return graph.group_links(knn(spark, d), cells)


@query("SELECT round(min(d), 6) AS d FROM knn", KNN)
def min_distance(spark, d):
    return graph.min_distance(B.vectors(spark, d)).select(r("d"))


@query(
    """, f AS (SELECT i AS node, d / 2 AS v FROM knn UNION ALL SELECT j, -d / 2 FROM knn)
    SELECT node, round(sum(v), 6) + 0.0 AS divergence FROM f GROUP BY node""",
    KNN,
)
def graph_divergence(spark, d):
    return graph.divergence(knn(spark, d).withColumnRenamed("d", "v")).select("node", r("divergence"))


@query(
    """, s AS (SELECT i, j FROM knn UNION SELECT j, i FROM knn)
    SELECT i, i AS j, count(*)::DOUBLE AS v FROM s GROUP BY i UNION ALL SELECT i, j, -1.0::DOUBLE FROM s""",
    KNN,
)
def graph_laplacian(spark, d):
    return graph.laplacian(graph.symmetric(knn(spark, d)).select("i", "j", F.lit(1.0).alias("w")))


@query(
    """SELECT i, j, round(d * (b.x[1] - a.x[1]), 6) + 0.0 AS v FROM knn JOIN v a ON a.cell_id = i JOIN v b ON b.cell_id = j""", KNN
)
def graph_gradient(spark, d):
    f = B.vectors(spark, d).select(F.col("cell_id").alias("node"), F.get("x", 0).alias("f"))
    return graph.gradient(knn(spark, d).withColumnRenamed("d", "w"), f).select("i", "j", r("v"))


@query(
    """, bo AS (SELECT i, j, d AS v, 0.0 AS u FROM knn UNION ALL SELECT j, i, 0.0, d FROM knn),
    s AS (SELECT i, j, sum(v) AS v, sum(u) AS u FROM bo GROUP BY i, j)
    SELECT i, j, round((v - u) / 2, 6) + 0.0 AS anti, round((v + u) / 2, 6) AS sym FROM s""",
    KNN,
)
def split_field(spark, d):
    a, s = graph.split_field(knn(spark, d).withColumnRenamed("d", "v"))
    return a.join(s.withColumnRenamed("v", "s"), ["i", "j"]).select("i", "j", r("v", "anti"), r("s", "sym"))


@query(
    """, e AS (SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b FROM knn),
    t AS (SELECT x.a, x.b, y.b AS c FROM e x JOIN e y ON x.a = y.a AND x.b < y.b JOIN e z ON z.a = x.b AND z.b = y.b),
    c AS (SELECT unnest([a, b, c]) AS node FROM t), nodes AS (SELECT a AS node FROM e UNION SELECT b FROM e)
    SELECT node, count(c.node) AS n FROM nodes LEFT JOIN c USING (node) GROUP BY node""",
    KNN,
)
def triangles(spark, d):
    return graph.triangles(knn(spark, d))


@query()
def graph_potential(spark, d):
    e = knn(spark, d).withColumnRenamed("d", "v")
    return graph.potential(e).select("node", r("f"))


@query()
def label_communities(spark, d):
    return community.communities(knn(spark, d).select("i", "j"))


@query(
    """, fl AS (SELECT i, j, d / 2 AS v FROM knn UNION ALL SELECT j, i, -d / 2 FROM knn), ft AS (SELECT i, j, sum(v) AS v FROM fl GROUP BY ALL),
    f AS (SELECT i AS a, j AS b, v FROM ft WHERE i < j)
    SELECT x.a, x.b, y.b AS c, round(x.v + y.v - z.v, 6) + 0.0 AS curl FROM f x JOIN f y ON x.b = y.a JOIN f z ON z.a = x.a AND z.b = y.b""",
    KNN,
)
def graph_curl(spark, d):
    return graph.curl(knn(spark, d).withColumnRenamed("d", "v")).select("a", "b", "c", r("curl"))


FLOW = KNN + """, fs AS (SELECT i, j, d / 2 AS v FROM knn UNION ALL SELECT j, i, -d / 2 FROM knn),
fw AS (SELECT i AS a, j AS b, sum(v) AS v FROM fs WHERE i < j GROUP BY ALL)"""


@query(
    """, nd AS (SELECT node, sum(v) AS v FROM (SELECT b AS node, v FROM fw UNION ALL SELECT a, -v FROM fw) GROUP BY node),
    tr AS (SELECT x.a, x.b, y.b AS c, x.v + y.v - z.v AS s FROM fw x JOIN fw y ON x.b = y.a JOIN fw z ON z.a = x.a AND z.b = y.b),
    ar AS (SELECT a, b, s AS v FROM tr UNION ALL SELECT b, c, s FROM tr UNION ALL SELECT a, c, -s FROM tr
      UNION ALL SELECT fw.a, fw.b, q.v - p.v FROM fw JOIN nd p ON p.node = fw.a JOIN nd q ON q.node = fw.b)
    SELECT a, b, round(sum(v), 6) + 0.0 AS v FROM ar GROUP BY a, b""",
    FLOW,
)
def flow_laplacian(spark, d):
    flow = flows.undirected_flow(knn(spark, d).select("i", "j", F.col("d").alias("v")))
    return flows.flow_laplacian(flow).select("a", "b", r("v"))


@query()
def hodge_parts(spark, d):
    parts = flows.hodge_parts(knn(spark, d).select("i", "j", F.col("d").alias("v")))
    return parts.select("a", "b", *[r(c, digits=5) for c in ("flow", "gradient", "curl", "harmonic")])


@query()
def density_clusters(spark, d):
    return clustering.hdbscan(knn(spark, d), 5, 5).select("node", "label", r("probability"))


@query(
    """, s AS (SELECT i, j, d FROM knn UNION ALL SELECT j, i, d FROM knn), e AS (SELECT i, j, min(d) AS d FROM s GROUP BY i, j),
    t(cell_id, t) USING KEY (cell_id) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION
      SELECT j, min(t.t + d) FROM t JOIN e ON i = t.cell_id LEFT JOIN recurring.t o ON o.cell_id = j WHERE o.t IS NULL OR t.t + d < o.t GROUP BY j)
    SELECT cell_id, round(t, 6) AS t FROM t""",
    "RECURSIVE " + KNN,
)
def shortest_times(spark, d):
    return sampling.shortest_times(knn(spark, d), [0]).select("cell_id", r("pseudotime", "t"))


@query(
    """, s AS (SELECT i, j, d FROM knn UNION ALL SELECT j, i, d FROM knn),
    e AS (SELECT row_number() OVER (ORDER BY d, i, j) AS n, i, j, d FROM (SELECT i, j, round(min(d), 9) AS d FROM s WHERE i < j GROUP BY i, j)),
    k AS (SELECT 0::BIGINT AS n, list(cell_id ORDER BY cell_id) AS node, list(cell_id ORDER BY cell_id) AS tree, false AS taken FROM v
      UNION ALL
      SELECT e.n, node, CASE WHEN a = b THEN tree ELSE list_transform(tree, lambda t: CASE WHEN t = a THEN b ELSE t END) END, a <> b
      FROM (SELECT n, node, tree, tree[list_position(node, e.i)] AS a, tree[list_position(node, e.j)] AS b
            FROM (SELECT k.*, e.i, e.j FROM k JOIN e ON e.n = k.n + 1) e) k JOIN e ON e.n = k.n + 1)
    SELECT i, j, round(d, 6) AS d FROM e JOIN k USING (n) WHERE taken""",
    "RECURSIVE " + KNN,
)
def spanning_tree(spark, d):
    e = knn(spark, d).select("i", "j", F.round("d", 9).alias("d"))
    return trees.spanning_forest(e).select("i", "j", r("d"))


def _centres(spark, d):
    """A principal graph's nodes: the means of the labels' vectors."""
    parts = B.vectors(spark, d).select(F.col("label").cast("long").alias("node"), F.posexplode("x").alias("k", "x"))
    parts = parts.groupBy("node", "k").agg(F.avg("x").alias("x"))
    return parts.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("x"))


# a lightest path's longest edge is found by doubling; an edge of the graph stands in the tree if it is no longer than that
CENTRES = KNN + """, cm AS (SELECT label AS node, k, avg(x) AS x FROM (SELECT label, generate_subscripts(x, 1) AS k, unnest(x) AS x FROM v) GROUP BY ALL),
cen AS (SELECT node, list(x ORDER BY k) AS x FROM cm GROUP BY node),
ck AS (SELECT a.node AS i, b.node AS j, list_distance(a.x, b.x) AS d FROM cen a JOIN cen b ON a.node <> b.node
  QUALIFY row_number() OVER (PARTITION BY a.node ORDER BY list_distance(a.x, b.x), b.node) <= 5),
ce AS (SELECT i, j, min(d) AS d FROM (SELECT i, j, d FROM ck UNION ALL SELECT j, i, d FROM ck) GROUP BY i, j),
mm AS (SELECT 0 AS n, i, j, d FROM ce UNION ALL SELECT n, i, j, min(d) FROM (
  SELECT n + 1 AS n, i, j, d FROM mm WHERE n < 4
  UNION ALL SELECT a.n + 1, a.i, b.j, greatest(a.d, b.d) FROM mm a JOIN mm b ON a.j = b.i AND a.n = b.n AND a.i <> b.j WHERE a.n < 4) GROUP BY ALL),
st AS (SELECT ce.i, ce.j, ce.d FROM ce JOIN mm USING (i, j) WHERE n = 4 AND ce.d <= mm.d + 1e-12),
rt AS (SELECT min(i) AS root FROM (SELECT i FROM st GROUP BY i HAVING count(*) = 1)),
dn AS (SELECT root AS node, NULL::INTEGER AS parent, 0.0::DOUBLE AS d, 0.0::DOUBLE AS t FROM rt
  UNION ALL SELECT st.j, st.i, st.d, t + st.d FROM dn JOIN st ON st.i = dn.node WHERE st.j IS DISTINCT FROM dn.parent)"""


@query(
    """, nc AS (SELECT cell_id, v.x, node AS spot FROM v CROSS JOIN cen
      QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY list_distance(v.x, cen.x), node) = 1),
    sg AS (SELECT nc.cell_id, nc.x, dn.*, a.x AS xn, b.x AS xp, up.t AS tp FROM nc JOIN dn ON spot IN (dn.node, dn.parent)
      JOIN cen a ON a.node = dn.node JOIN cen b ON b.node = dn.parent JOIN dn up ON up.node = dn.parent),
    pj AS (SELECT *, greatest(0, least(1, list_sum([(x[k] - xp[k]) * (xn[k] - xp[k]) FOR k IN range(1, 65)]) / list_distance(xn, xp) ** 2)) AS f FROM sg),
    fo AS (SELECT cell_id, node, parent, tp + f * d AS t, sqrt(list_sum([(x[k] - xp[k] - f * (xn[k] - xp[k])) ** 2 FOR k IN range(1, 65)])) AS away FROM pj)
    SELECT cell_id, node::BIGINT AS node, parent::BIGINT AS parent, round(t, 5) AS pseudotime, round(away, 5) AS away FROM fo
    QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY round(away, 12), node) = 1""",
    "RECURSIVE " + CENTRES,
)
def tree_pseudotime(spark, d):
    cells, nodes = B.vectors(spark, d), _centres(spark, d)
    points = nodes.select(F.col("node").alias("cell_id"), "x")
    near = graph.nearest(cells, points, 1, skip_self=False).select(F.col("i").alias("cell_id"), F.col("j").alias("node"))
    out = trees.tree_pseudotime(cells, nodes, near, graph.nearest(points, points, 5))
    return out.select("cell_id", "node", "parent", r("pseudotime", digits=5), r("away", digits=5))


@query()
def sample_by_group(spark, d):
    cells = B.vectors(spark, d).select("cell_id", F.col("label").alias("grp"))
    return sampling.sample_by_group(cells, 5)


def _modalities(spark, d):
    v = B.vectors(spark, d)
    return v.select("cell_id", F.slice("x", 1, 32).alias("x")), v.select("cell_id", F.slice("x", 33, 32).alias("x"))


def _modality_sql(n: str, low: int, high: int) -> str:
    """Unit vectors u, the nearest nb, neighbourhoods ad and bandwidths bw of one modality, each with the suffix n."""
    return f"""u{n} AS (SELECT cell_id, [z / sqrt(list_sum([q * q FOR q IN x[{low}:{high}]])) FOR z IN x[{low}:{high}]] AS x FROM v),
nb{n} AS MATERIALIZED (SELECT a.cell_id AS i, b.cell_id AS j, list_distance(a.x, b.x) AS d,
  row_number() OVER (PARTITION BY a.cell_id ORDER BY list_distance(a.x, b.x), b.cell_id) AS r FROM u{n} a JOIN u{n} b ON a.cell_id <> b.cell_id QUALIFY r <= 50),
ad{n} AS (SELECT i, j FROM nb{n} WHERE r <= {K} UNION ALL SELECT cell_id, cell_id FROM v),
sh{n} AS MATERIALIZED (SELECT p.i, q.i AS j, count(*) AS n FROM ad{n} p JOIN ad{n} q ON p.j = q.j GROUP BY ALL),
lm{n} AS (SELECT i, coalesce(list(n ORDER BY n)[{K + 1}], max(n)) AS most FROM sh{n} GROUP BY i),
bw{n} AS (SELECT i, list_avg(list(d ORDER BY d DESC)[1:{K}]) AS bw FROM (SELECT s.i, list_distance(a.x, b.x) AS d FROM sh{n} s JOIN lm{n} USING (i)
  JOIN u{n} a ON a.cell_id = s.i JOIN u{n} b ON b.cell_id = s.j WHERE n <= most) GROUP BY i),
nn{n} AS (SELECT i, d AS near FROM nb{n} WHERE r = 1),"""


def _affinity_sql(n: str, other: str) -> str:
    """How much better a modality's own neighbours predict than the other's, as rt."""
    mean = lambda e: f"(SELECT i, list(m ORDER BY k) AS m FROM (SELECT i, k, avg(x) AS m FROM (SELECT e.i, generate_subscripts(x, 1) AS k, unnest(x) AS x FROM nb{e} e JOIN u{n} ON cell_id = j WHERE r <= {K}) GROUP BY i, k) GROUP BY i)"
    aff = lambda d: f"exp(-greatest(0, {d} - near) / (bw - near))"
    return f"""rt{n} AS (SELECT i, {aff(f"list_distance(o.m, u{n}.x)")} / ({aff(f"list_distance(c.m, u{n}.x)")} + 1e-4) AS rt
  FROM {mean(n)} o JOIN {mean(other)} c USING (i) JOIN u{n} ON cell_id = i JOIN nn{n} USING (i) JOIN bw{n} USING (i)),"""


JOINT = KNN.replace("\none AS", "\n" + _modality_sql("a", 1, 32) + _modality_sql("b", 33, 64) + _affinity_sql("a", "b") + _affinity_sql("b", "a") + """
mw AS (SELECT i, 1 / (1 + exp(b.rt - a.rt)) AS weight FROM rta a JOIN rtb b USING (i)),
one AS""")


@query("SELECT i, round(weight, 6) AS weight_a, round(a.bw, 6) AS bw_a, round(b.bw, 6) AS bw_b FROM mw JOIN bwa a USING (i) JOIN bwb b USING (i)", JOINT)
def weighted_neighbours(spark, d):
    a, b = (cut(joint.unit_vectors(v)) for v in _modalities(spark, d))
    w = joint.modality_weights(graph.nearest(a, a, K), graph.nearest(b, b, K), a, b, K)
    return w.select("i", r("weight", "weight_a"), r("bw_a"), r("bw_b"))


@query(
    f""", un AS (SELECT i, j FROM nba UNION SELECT i, j FROM nbb),
    sm AS (SELECT un.i, un.j, weight * exp(-greatest(0, list_distance(p.x, q.x) - na.near) / (a.bw - na.near))
      + (1 - weight) * exp(-greatest(0, list_distance(s.x, t.x) - nb.near) / (b.bw - nb.near)) AS similarity
      FROM un JOIN mw USING (i) JOIN bwa a USING (i) JOIN bwb b USING (i) JOIN nna na USING (i) JOIN nnb nb USING (i)
      JOIN ua p ON p.cell_id = un.i JOIN ua q ON q.cell_id = un.j JOIN ub s ON s.cell_id = un.i JOIN ub t ON t.cell_id = un.j)
    SELECT i, j, round(similarity, 6) AS similarity, round(sqrt(greatest(0, (1 - similarity) / 2)), 5) AS distance,
    row_number() OVER (PARTITION BY i ORDER BY round(similarity, 12) DESC, j)::INTEGER AS rank FROM sm QUALIFY rank <= {K}""",
    JOINT,
)
def joint_neighbours(spark, d):
    got = joint.joint_neighbours(*_modalities(spark, d), K, 50)
    return got.select("i", "j", r("similarity"), r("distance", digits=5), "rank")


@query()
def grid_velocity(spark, d):
    v = B.vectors(spark, d)
    e = knn(spark, d).join(v.select(F.col("cell_id").alias("j"), F.slice("x", 1, 2).alias("x")), "j")
    near = e.groupBy("i").agg(F.avg(F.get("x", 0)).alias("a"), F.avg(F.get("x", 1)).alias("b"))
    p = v.join(near, F.col("cell_id") == F.col("i")).select(
        "cell_id",
        F.slice("x", 1, 2).alias("x"),
        F.array(F.col("a") - F.get("x", 0), F.col("b") - F.get("x", 1)).alias("v"),
    )
    p = cut(p)
    bounds = p.agg(
        F.min(F.get("x", 0)).alias("x0"), F.max(F.get("x", 0)).alias("x1"), F.min(F.get("x", 1)).alias("y0"), F.max(F.get("x", 1)).alias("y1")
    )
    return graph.grid_velocity(p, bounds, 20, 10).select(*[r(c) for c in ("gx", "gy", "ux", "uy", "mass")])


# moments: cells are suppliers, neighbours are the suppliers with adjacent keys

RING = B.COUNTS_SQL + """, ring AS (
  SELECT a.s_suppkey AS i, b.s_suppkey AS j, 1.0 / count(*) OVER (PARTITION BY a.s_suppkey) AS w
  FROM supplier a JOIN supplier b ON abs(a.s_suppkey - b.s_suppkey) <= 2
)"""


def ring(spark, d):
    s = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"))
    near = s.select("i", F.explode(F.expr("sequence(i - 2, i + 2)")).alias("j"))
    near = near.join(s.select(F.col("i").alias("j")), "j", "left_semi")
    return graph.row_normalize(near.select("i", "j", F.lit(1.0).alias("w")))


def us(spark, d):
    """Dense u and s for each cell and brand."""
    w = matrix.wide(B.counts(spark, d), B.LAYERS)
    genes = B.table(spark, d, "part").select(F.col("p_brand").alias("gene_id")).distinct()
    dense = matrix.densify(w, B.cells(spark, d), genes)
    return dense.select("cell_id", "gene_id", F.col("unspliced").alias("u"), F.col("spliced").alias("s"))


def ols(spark, d):
    """Steady-state slopes of the brands, from stored entries and the number of cells."""
    w = matrix.wide(B.counts(spark, d), B.LAYERS).withColumnsRenamed({"unspliced": "u", "spliced": "s"})
    return kinetics.gamma_ols(w, n_cells=B.n_cells(spark, d))


@query("SELECT i AS cell_id, gene_id, round(sum(w * value), 6) AS m FROM ring JOIN x ON x.cell_id = j GROUP BY ALL", RING)
def first_moment(spark, d):
    return moments.first_moment(ring(spark, d), B.total_layer(B.counts(spark, d))).select("cell_id", "gene_id", r("m"))


@query(
    """SELECT i AS cell_id, gene_id, round(sum(w * spliced * unspliced), 4) AS m,
    round(sum(w * spliced * unspliced) - sum(w * spliced) * sum(w * unspliced), 4) AS c
    FROM ring JOIN w ON w.cell_id = j GROUP BY ALL""".replace("FROM ring JOIN w ON w.cell_id", "FROM ring JOIN w AS x2 ON x2.cell_id"),
    RING,
)
def second_moment(spark, d):
    xy = matrix.wide(B.counts(spark, d), B.LAYERS).withColumnsRenamed({"spliced": "x", "unspliced": "y"})
    a = moments.second_moment(ring(spark, d), xy)
    b = moments.second_moment(ring(spark, d), xy, centered=True).withColumnRenamed("m", "c")
    return a.join(b, ["cell_id", "gene_id"]).select("cell_id", "gene_id", r("m", digits=4), r("c", digits=4))


@query(
    "SELECT gene_id, t, round(avg(total), 6) AS m, round(var_pop(total), 4) AS v FROM lab GROUP BY ALL", B.LABELED_SQL
)
def strata_moments(spark, d):
    x = B.labeled(spark, d).withColumnRenamed("total", "value")
    return moments.strata_moments(x).select("gene_id", "t", r("m"), r("v", digits=4))


OLS = B.COUNTS_SQL + """, us AS (SELECT cell_id, gene_id, unspliced AS u, spliced AS s FROM dense),
top AS (SELECT gene_id, greatest(max(s), 1e-3) AS ms, greatest(max(u), 1e-3) AS mu FROM us GROUP BY gene_id),
ev AS (SELECT us.*, s / ms + u / mu AS ev FROM us JOIN top USING (gene_id)),
edge AS (SELECT gene_id, quantile_cont(ev, 0.95) AS edge FROM ev GROUP BY gene_id),
m AS (SELECT ev.*, ev >= edge AS ok FROM ev JOIN edge USING (gene_id)),
gam AS (SELECT gene_id, avg(s * u) FILTER (WHERE ok) / avg(s * s) FILTER (WHERE ok) AS gamma FROM m GROUP BY gene_id),
fit AS (SELECT gene_id, gamma, count(*) FILTER (WHERE ok) AS n,
  1 - avg((u - gamma * s) ** 2) FILTER (WHERE ok) / nullif(var_pop(u) FILTER (WHERE ok), 0) AS r2,
  1 - avg((u - gamma * s) ** 2) / nullif(var_pop(u), 0) AS r2_all, avg((u - gamma * s) ** 2) FILTER (WHERE ok) AS e_in
  FROM m JOIN gam USING (gene_id) GROUP BY ALL)"""


@query(
    """SELECT gene_id, round(gamma, 6) AS gamma, n, round(r2, 6) AS r2, round(r2_all, 6) AS r2_all,
    CASE WHEN e_in > 1e-18 THEN round(-n / 2.0 * (ln(2 * pi() * e_in) + 1), 4) END AS loglik FROM fit""",
    OLS,
)
def gamma_ols(spark, d):
    g = ols(spark, d)
    return g.select("gene_id", r("gamma"), "n", r("r2"), r("r2_all"), r("loglik", digits=4))


@query("SELECT gene_id, round(gamma, 6) AS gamma, round(r2, 6) AS r2, n FROM fit ORDER BY gamma DESC, gene_id LIMIT 20", OLS)
def steepest_genes(spark, d):
    g = ols(spark, d)
    return g.orderBy(F.desc("gamma"), "gene_id").limit(20).select("gene_id", r("gamma"), r("r2"), "n")


@query(
    """SELECT cell_id, gene_id, round(0.5 - u, 6) AS v_u, round(u - gamma * s, 6) AS v_s FROM us JOIN gam USING (gene_id)""",
    OLS,
)
def velocity(spark, d):
    x = us(spark, d)
    p = ols(spark, d).select("gene_id", "gamma", F.lit(0.5).alias("alpha"))
    return kinetics.velocity(x, p).select("cell_id", "gene_id", r("v_u"), r("v_s"))


@query(
    """, k AS (SELECT count(*) FILTER (WHERE gamma > 0.01 AND r2 > 0.3) AS k FROM fit),
    best AS (SELECT gene_id FROM fit ORDER BY r2 DESC NULLS LAST, gene_id LIMIT 7)
    SELECT gene_id FROM fit CROSS JOIN k WHERE CASE WHEN k >= 5 THEN gamma > 0.01 AND r2 > 0.3
    ELSE gene_id IN (FROM best) END""",
    OLS,
)
def transition_genes(spark, d):
    return kinetics.transition_genes(ols(spark, d), min_r2=0.3, fallback=7)


@query(
    """, us AS (SELECT cell_id, gene_id, unspliced AS u, spliced AS s, unspliced + 2 * unspliced * spliced AS y2,
      2 * spliced * spliced - spliced AS x2 FROM dense),
    f AS (SELECT gene_id, sum(u * s) / sum(s * s) AS g1, sum(y2 * x2) / sum(x2 * x2) AS g2 FROM us GROUP BY gene_id),
    w2 AS (SELECT gene_id, var_pop(u - g1 * s) AS v1, var_pop(y2 - g2 * x2) AS v2, sum(u * s) AS a1, sum(s * s) AS b1,
      sum(y2 * x2) AS a2, sum(x2 * x2) AS b2 FROM us JOIN f USING (gene_id) GROUP BY gene_id)
    SELECT gene_id, round((a1 / v1 + a2 / v2) / (b1 / v1 + b2 / v2), 6) AS gamma FROM w2"""
)
def gamma_gmm(spark, d):
    x = us(spark, d).withColumns({"us": F.col("u") * F.col("s"), "ss": F.col("s") * F.col("s")})
    return kinetics.gamma_gmm(x).select("gene_id", r("gamma"))


@query(
    """, us AS (SELECT cell_id, gene_id, unspliced AS u, spliced AS s, s_nationkey AS grp FROM dense JOIN supplier ON cell_id = s_suppkey),
    mv AS (SELECT gene_id, grp, avg(s) AS m, var_pop(s) AS v FROM us GROUP BY ALL),
    phi AS (SELECT gene_id, greatest(sum((v - m) * m * m) / sum(m * m * m * m), 0) AS phi FROM mv GROUP BY gene_id),
    q AS (SELECT gene_id, u, s, 1 / (s + phi * s * s) AS wq FROM us JOIN phi USING (gene_id) WHERE s > 0)
    SELECT gene_id, round(sum(wq * s * u) / sum(wq * s * s), 6) AS gamma FROM q GROUP BY gene_id"""
)
def gamma_negbin(spark, d):
    x = us(spark, d)
    mv = x.join(B.cells(spark, d), "cell_id").groupBy("gene_id", "grp").agg(F.avg("s").alias("mean"), F.var_pop("s").alias("variance"))
    return kinetics.gamma_negbin(x, kinetics.dispersion_nb(mv)).select("gene_id", r("gamma"))


@query(
    """, k AS (SELECT gene_id, t, sum(new * total) / sum(total * total) AS k FROM lab GROUP BY ALL)
    SELECT gene_id, round(sum(t * -ln(1 - k)) / sum(t * t), 6) AS gamma, count(*) AS n_times FROM k
    WHERE k < 1 AND t > 0 GROUP BY gene_id""",
    B.LABELED_SQL,
)
def gamma_two_step(spark, d):
    return kinetics.gamma_two_step(B.labeled(spark, d)).select("gene_id", r("gamma"), "n_times")


@query(
    "SELECT gene_id, round(0.7 * avg(new) / avg(1 - exp(-0.7 * t)), 6) AS alpha FROM lab GROUP BY gene_id", B.LABELED_SQL
)
def alpha_synthesis(spark, d):
    return kinetics.alpha_synthesis(B.labeled(spark, d), 0.7).select("gene_id", r("alpha"))


@query(
    """, s AS (SELECT gene_id, t, avg(total) AS m FROM lab GROUP BY ALL),
    z AS (SELECT *, first(t) OVER (PARTITION BY gene_id ORDER BY t) AS t0, first(m) OVER (PARTITION BY gene_id ORDER BY t) AS m0 FROM s)
    SELECT gene_id, round(avg(-ln(m / m0) / (t - t0)), 6) AS gamma FROM z WHERE t > t0 GROUP BY gene_id""",
    B.LABELED_SQL,
)
def degradation_rate(spark, d):
    s = moments.strata_moments(B.labeled(spark, d).withColumnRenamed("total", "value"))
    return kinetics.degradation(s).select("gene_id", r("gamma"))


@query(
    """, s AS (SELECT t, sum(new) / sum(total) AS y FROM lab GROUP BY t)
    SELECT CASE WHEN count(*) <= 1 THEN 'one-shot' WHEN avg(t * y) - avg(t) * avg(y) > 0 THEN 'kin' ELSE 'deg' END
    AS experiment_type FROM s""",
    B.LABELED_SQL,
)
def experiment_type(spark, d):
    return kinetics.experiment_type(B.labeled(spark, d))


@query(
    """, s AS (SELECT gene_id, sum(new) AS l, sum(total) AS r FROM lab GROUP BY gene_id),
    k AS (SELECT gene_id, l, r, l / r AS k, -ln(1 - l / r) / 2.0 AS g FROM s WHERE l < r)
    SELECT gene_id, round(g, 6) AS gamma, round(CASE WHEN g = 0 THEN NULL ELSE l * g / (1 - exp(-g * 2.0)) END, 4) AS alpha,
    round((r - l) / (1 - k), 4) AS r0, round(l / exp(-g * 2.0), 4) AS l0 FROM k""",
    B.LABELED_SQL,
)
def one_shot(spark, d):
    s = B.labeled(spark, d).groupBy("gene_id").agg(F.sum("new").alias("l"), F.sum("total").alias("r"))
    s = s.where("l < r").withColumn("k", S.ratio(F.col("l"), F.col("r")))
    s = s.withColumn("g", S.gamma_one_shot(F.col("k"), 2.0))
    return s.select(
        "gene_id",
        r("g", "gamma"),
        F.round(S.alpha_one_shot(F.col("l"), F.col("g"), 2.0), 4).alias("alpha"),
        F.round(S.total_before_labeling(F.col("r"), F.col("l"), F.col("k")), 4).alias("r0"),
        F.round(S.labeled_before_decay(F.col("l"), F.col("g"), 2.0), 4).alias("l0"),
    )


@query(
    """SELECT p_partkey AS gene_id, round(3 * exp(-0.5 * p_size / 10) + 4 / 0.5 * (1 - exp(-0.5 * p_size / 10)), 6) AS u,
    round(p_size ** 2 / (20.0 ** 2 + p_size ** 2), 6) AS act, round(20.0 ** 2 / (20.0 ** 2 + p_size ** 2), 6) AS inh,
    round(2 * 20.0 ** 2 * p_size / (20.0 ** 2 + p_size ** 2) ** 2, 6) AS slope FROM part"""
)
def closed_form_kinetics(spark, d):
    p = B.table(spark, d, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_size").cast("double").alias("x"))
    return p.select(
        "gene_id",
        F.round(S.unspliced_at(F.col("x") / 10, 3.0, 4.0, 0.5), 6).alias("u"),
        F.round(S.hill_activating(F.col("x"), 20.0, 2.0), 6).alias("act"),
        F.round(S.hill_inhibiting(F.col("x"), 20.0, 2.0), 6).alias("inh"),
        F.round(S.hill_activating_slope(F.col("x"), 20.0, 2.0), 6).alias("slope"),
    )


@query()
def fit_kinetics(spark, d):
    s = moments.strata_moments(B.labeled(spark, d).withColumnRenamed("new", "value"))
    return kinetics.fit_kinetics(s).select("gene_id", r("alpha", digits=3), r("gamma", digits=3), r("cost", digits=1))


@query(
    """SELECT cell_id, round(sqrt(list_sum([z * z FOR z IN x])), 6) AS norm, round(list_distance(x, x[2:] || x[:1]), 6) AS d,
    round(list_cosine_similarity(x, x[2:] || x[:1]), 6) AS cosine,
    round(exp(-0.1 * list_distance(x, x[2:] || x[:1]) ** 2), 6) AS kernel FROM v""",
    KNN,
)
def vector_algebra(spark, d):
    v = B.vectors(spark, d)
    y = F.concat(F.slice("x", 2, F.size("x") - 1), F.slice("x", 1, 1))
    v = v.withColumn("y", y)
    a, b = F.col("x"), F.col("y")
    return v.select(
        "cell_id",
        F.round(S.norm(a), 6).alias("norm"),
        F.round(S.distance(a, b), 6).alias("d"),
        F.round(S.cosine(a, b), 6).alias("cosine"),
        F.round(S.gaussian_kernel(a, b, 0.1), 6).alias("kernel"),
    )
