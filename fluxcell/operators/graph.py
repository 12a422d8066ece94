"""Neighbour graphs: edge tables ``(i, j, ...)`` and what is computed on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxcell.functions.lineage import cut
from fluxcell.functions.scalars import ratio
from fluxcell.operators.neighbours import nearest, nearest_approximate

__all__ = ["nearest", "nearest_approximate"]  # the graphs that most of this module starts from

def symmetric(edges: DataFrame) -> DataFrame:
    """Union of (i, j) and (j, i) with the least distance."""
    both = edges.select("i", "j", "d").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    return both.groupBy("i", "j").agg(F.min("d").alias("d"))


def smoothing_weights(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(i, j, w)``: connected pairs and the diagonal count 1, each row divided by its sum."""
    one = edges.select("i", "j").where("i <> j").unionByName(nodes.select(F.col("cell_id").alias("i"), F.col("cell_id").alias("j")))
    return row_normalize(one.distinct().withColumn("w", F.lit(1.0)))


def gaussian_weights(edges: DataFrame, sigma: float = 10.0) -> DataFrame:
    return row_normalize(edges.select("i", "j", F.exp(-F.col("d") * F.col("d") / (2 * sigma * sigma)).alias("w")))


def row_normalize(edges: DataFrame) -> DataFrame:
    s = edges.groupBy("i").agg(F.sum("w").alias("s"))
    return edges.join(s, "i").select("i", "j", ratio(F.col("w"), F.col("s")).alias("w"))


def within_groups(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Edges whose ends have the same group in ``cells(cell_id, grp)``."""
    a = cells.select(F.col("cell_id").alias("i"), F.col("grp").alias("ga"))
    b = cells.select(F.col("cell_id").alias("j"), F.col("grp").alias("gb"))
    return edges.join(a, "i").join(b, "j").where("ga = gb").drop("ga", "gb")


def two_hop(edges: DataFrame) -> DataFrame:
    """Each node's neighbours, theirs, and itself: distinct (i, j)."""
    e = edges.select("i", "j")
    second = e.select("i", F.col("j").alias("m")).join(e.select(F.col("i").alias("m"), "j"), "m").select("i", "j")
    self_ = e.select("i").distinct().select("i", F.col("i").alias("j"))
    return e.unionByName(second).unionByName(self_).distinct()


def mutual(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges of both graphs, with the smaller weight."""
    return a.select("i", "j", "w").join(b.select("i", "j", F.col("w").alias("v")), ["i", "j"]).select(
        "i", "j", F.least("w", "v").alias("w")
    )


# calculus on graphs with edge values (i, j, v), i -> j


def divergence(edges: DataFrame) -> DataFrame:
    """Half of (row sum - column sum) at each node."""
    out = edges.select(F.col("i").alias("node"), (F.col("v") / 2).alias("v"))
    into = edges.select(F.col("j").alias("node"), (-F.col("v") / 2).alias("v"))
    return out.unionByName(into).groupBy("node").agg(F.sum("v").alias("divergence"))


def laplacian(edges: DataFrame) -> DataFrame:
    """``(i, j, v)`` of D - A for symmetric edges (i, j, w); with a length column e, weights are w / e^2."""
    w = ratio(F.col("w"), F.col("e") * F.col("e")) if "e" in edges.columns else F.col("w")
    a = edges.select("i", "j", w.alias("w"))
    diagonal = a.groupBy("i").agg(F.sum("w").alias("v")).select("i", F.col("i").alias("j"), "v")
    return diagonal.unionByName(a.select("i", "j", (-F.col("w")).alias("v")))


def gradient(edges: DataFrame, potential: DataFrame) -> DataFrame:
    """``(i, j, v)``: w (f_j - f_i) along edges (i, j, w) of ``potential(node, f)``."""
    a = potential.select(F.col("node").alias("i"), F.col("f").alias("fi"))
    b = potential.select(F.col("node").alias("j"), F.col("f").alias("fj"))
    return edges.join(a, "i").join(b, "j").select("i", "j", (F.col("w") * (F.col("fj") - F.col("fi"))).alias("v"))


def split_field(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Antisymmetric and symmetric parts, (v_ij - v_ji) / 2 and (v_ij + v_ji) / 2, where either exists."""
    both = edges.select("i", "j", "v", F.lit(0.0).alias("u")).unionByName(
        edges.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(0.0).alias("v"), F.col("v").alias("u"))
    )
    both = both.groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("u").alias("u"))
    part = lambda c: both.select("i", "j", (c / 2).alias("v"))
    return part(F.col("v") - F.col("u")), part(F.col("v") + F.col("u"))


def oriented(edges: DataFrame) -> DataFrame:
    """Undirected edges (i, j) once each as (x, y), from the end of smaller degree: no node then has many out-edges, hubs included."""
    e = edges.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).where("a <> b").distinct()
    e = cut(e)
    deg = e.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    at = lambda side: deg.select(F.col("node").alias(side), F.struct("n", "node").alias(f"d{side}"))
    e = e.join(at("a"), "a").join(at("b"), "b")
    up = F.col("da") < F.col("db")
    return cut(e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y")))


def triangle_rows(e: DataFrame) -> DataFrame:
    """``(x, y, z)``: the triangles of ``oriented`` edges, each once, from its node of least degree."""
    wedge = e.join(e.select("x", F.col("y").alias("z")), "x").where("y < z")
    closing = e.select(F.least("x", "y").alias("y"), F.greatest("x", "y").alias("z"))
    return wedge.join(closing, ["y", "z"])


def triangles(edges: DataFrame) -> DataFrame:
    """``(node, n)``: 3-cliques at each node; each is found once, from its node of least degree."""
    e = oriented(edges)
    corner = triangle_rows(e).select(F.explode(F.array("x", "y", "z")).alias("node"))
    nodes = e.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    counts = corner.groupBy("node").agg(F.count("*").alias("n"))
    return nodes.join(counts, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n"))


def potential(edges: DataFrame, tolerance: float = 1e-9, rounds: int = 500) -> DataFrame:
    """``(node, f)`` whose graph gradient is close to the antisymmetric flow (i, j, v): the Poisson equation
    L f = -div, mean 0 in each connected graph of a connected table.

    Conjugate gradients, preconditioned by degree: a round is one join of the edges with the
    direction, one aggregate and two sums, written before the next. They end when the residual has fallen
    to ``tolerance`` of the right-hand side, and raise if that takes more than ``rounds``.
    """
    adj = edges.select("i", "j").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j")))
    adj = cut(adj.where("i <> j").distinct())
    deg = adj.groupBy("i").agg(F.count("*").cast("double").alias("deg")).withColumnRenamed("i", "node")
    b = divergence(edges).join(deg, "node").select("node", "deg", (-F.col("divergence")).alias("r"))
    state = cut(b.select("node", "deg", F.lit(0.0).alias("f"), "r", (F.col("r") / F.col("deg")).alias("d")))
    total = lambda df, *x: df.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in x]).first()
    rz, start = total(state, F.col("r") * F.col("r") / F.col("deg"), F.col("r") * F.col("r"))
    left = start
    for _ in range(rounds):
        if left <= tolerance * tolerance * start:
            middle = state.agg(F.avg("f").alias("m"))
            return state.crossJoin(F.broadcast(middle)).select("node", (F.col("f") - F.col("m")).alias("f"))
        near = adj.join(state.select(F.col("node").alias("j"), "d"), "j").groupBy(F.col("i").alias("node")).agg(F.sum("d").alias("s"))
        state = cut(state.join(near, "node").withColumn("ld", F.col("deg") * F.col("d") - F.col("s")))
        step = rz / total(state, F.col("d") * F.col("ld"))[0]
        state = state.select("node", "deg", (F.col("f") + step * F.col("d")).alias("f"), (F.col("r") - step * F.col("ld")).alias("r"), "d")
        new, left = total(state, F.col("r") * F.col("r") / F.col("deg"), F.col("r") * F.col("r"))
        state = state.withColumn("d", F.col("r") / F.col("deg") + new / rz * F.col("d"))
        rz = new
    raise ArithmeticError(f"the potential did not converge in {rounds} rounds")


def group_links(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """``(a, b, n)``: pairs of groups that some edge connects, with the number of such edges."""
    ga = cells.select(F.col("cell_id").alias("i"), F.col("grp").alias("a"))
    gb = cells.select(F.col("cell_id").alias("j"), F.col("grp").alias("b"))
    return edges.join(ga, "i").join(gb, "j").groupBy("a", "b").agg(F.count("*").alias("n"))


def purity(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """``(i, purity)``: share of a node's neighbours that are in its own group."""
    ga = cells.select(F.col("cell_id").alias("i"), F.col("grp").alias("a"))
    gb = cells.select(F.col("cell_id").alias("j"), F.col("grp").alias("b"))
    both = edges.join(ga, "i").join(gb, "j")
    return both.groupBy("i").agg(ratio(F.count_if(F.col("a") == F.col("b")), F.count("*")).alias("purity"))


def curl(edges: DataFrame) -> DataFrame:
    """``(a, b, c, curl)``: circulation v_ab + v_bc + v_ca of the antisymmetric flow (i, j, v) around every triangle a < b < c."""
    flow, _ = split_field(edges)
    e = cut(flow.where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"), "v"))
    for_wedge = oriented(e.select(F.col("a").alias("i"), F.col("b").alias("j")))
    found = triangle_rows(for_wedge).select(F.array_sort(F.array("x", "y", "z")).alias("t"))
    found = found.select(*[F.get("t", k).alias(n) for k, n in enumerate("abc")])
    side = lambda p, q, name: e.select(F.col("a").alias(p), F.col("b").alias(q), F.col("v").alias(name))
    found = found.join(side("a", "b", "ab"), ["a", "b"]).join(side("b", "c", "bc"), ["b", "c"]).join(side("a", "c", "ac"), ["a", "c"])
    return found.select("a", "b", "c", (F.col("ab") + F.col("bc") - F.col("ac")).alias("curl"))


def min_distance(points: DataFrame) -> DataFrame:
    """The least distance between two points of ``points(cell_id, x)``; 0 where two are equal."""
    return nearest(points, points, 1).agg(F.min("d").alias("d"))


def grid_velocity(points: DataFrame, bounds: DataFrame, n_grid: int, k: int) -> DataFrame:
    """``(gx, gy, ux, uy, mass)``: Gaussian-weighted mean velocity of the k nearest of
    ``points(cell_id, x, v)`` (2-d) at each node of an n_grid x n_grid grid over ``bounds``."""
    ax = lambda n: F.explode(F.expr(f"sequence(0, {n_grid - 1})")).alias(n)
    step = lambda lo, hi, n: F.col(lo) + (F.col(hi) - F.col(lo)) * F.col(n) / (n_grid - 1)
    grid = bounds.select("*", ax("a")).select("*", ax("b"))
    grid = grid.select(
        (F.col("a") * n_grid + F.col("b")).cast("long").alias("cell_id"),
        F.array(step("x0", "x1", "a"), step("y0", "y1", "b")).alias("x"),
        ((F.col("x1") - F.col("x0")) / (n_grid - 1)).alias("sx"),
        ((F.col("y1") - F.col("y0")) / (n_grid - 1)).alias("sy"),
    )
    near = nearest(grid.select("cell_id", "x"), points.select("cell_id", "x"), k, skip_self=False)
    scale = (F.col("sx") + F.col("sy")) / 2 * 0.5
    w = F.exp(-F.col("d") * F.col("d") / (2 * scale * scale))
    e = near.join(grid.withColumnRenamed("cell_id", "i"), "i").join(points.select(F.col("cell_id").alias("j"), "v"), "j")
    g = e.withColumn("w", w).groupBy("i", "x").agg(
        F.sum("w").alias("mass"),
        F.sum(F.col("w") * F.get("v", 0)).alias("sx"),
        F.sum(F.col("w") * F.get("v", 1)).alias("sy"),
    )
    total = F.greatest(F.lit(1.0), F.col("mass"))
    return g.select(
        F.get("x", 0).alias("gx"), F.get("x", 1).alias("gy"), (F.col("sx") / total).alias("ux"), (F.col("sy") / total).alias("uy"), "mass"
    )
