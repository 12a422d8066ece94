"""Flows on the edges of a graph: incidence of edges and triangles, the Laplacian of flows, gradient, curl and harmonic parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxcell.functions.lineage import cut
from fluxcell.operators import graph


def undirected_flow(edges: DataFrame) -> DataFrame:
    """``(a, b, v)``, a < b: the antisymmetric part of the flow (i, j, v), once for each edge."""
    flow, _ = graph.split_field(edges.where("i <> j"))
    return cut(flow.where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"), "v"))


def incidence(flow: DataFrame) -> DataFrame:
    """``(t, a, b, sign)``: the three edges of every triangle t = (a < b < c) of ``flow(a, b)``; going round, the longest edge is met backwards."""
    edges = graph.oriented(flow.select(F.col("a").alias("i"), F.col("b").alias("j")))
    t = graph.triangle_rows(edges).select(F.array_sort(F.array("x", "y", "z")).alias("n"))
    t = t.select(F.struct(*[F.get("n", k).alias(c) for k, c in enumerate("abc")]).alias("t"))
    side = lambda a, b, sign: F.struct(F.col(f"t.{a}").alias("a"), F.col(f"t.{b}").alias("b"), F.lit(sign).alias("sign"))
    sides = F.explode(F.array(side("a", "b", 1.0), side("b", "c", 1.0), side("a", "c", -1.0)))
    return cut(t.select("t", sides.alias("s")).select("t", "s.*"))


def circulation(flow: DataFrame, sides: DataFrame) -> DataFrame:
    """``(t, v)``: the flow around each triangle of ``sides``."""
    return sides.join(flow.select("a", "b", "v"), ["a", "b"]).groupBy("t").agg(F.sum(F.col("sign") * F.col("v")).alias("v"))


def around(turns: DataFrame, sides: DataFrame) -> DataFrame:
    """``(a, b, v)``: the flow that ``turns(t, v)`` around triangles make along edges."""
    return sides.join(turns.select("t", "v"), "t").groupBy("a", "b").agg(F.sum(F.col("sign") * F.col("v")).alias("v"))


def node_inflow(flow: DataFrame) -> DataFrame:
    """``(node, v)``: what flows into each node less what flows out."""
    into = flow.select(F.col("b").alias("node"), "v").unionByName(flow.select(F.col("a").alias("node"), (-F.col("v")).alias("v")))
    return into.groupBy("node").agg(F.sum("v").alias("v"))


def slope(flow: DataFrame, at: DataFrame) -> DataFrame:
    """``(a, b, v)``: the difference of ``at(node, v)`` along the edges of ``flow(a, b)``."""
    end = lambda side: at.select(F.col("node").alias(side), F.col("v").alias(f"v{side}"))
    return flow.select("a", "b").join(end("a"), "a").join(end("b"), "b").select("a", "b", (F.col("vb") - F.col("va")).alias("v"))


def flow_laplacian(flow: DataFrame) -> DataFrame:
    """``(a, b, v)`` of the Laplacian of flows applied to ``flow(a, b, v)``: gradient of the inflow and curl of the circulation."""
    sides = incidence(flow)
    turning = around(circulation(flow, sides), sides)
    both = slope(flow, node_inflow(flow)).unionByName(turning)
    return both.groupBy("a", "b").agg(F.sum("v").alias("v"))


def curl_part(flow: DataFrame, sides: DataFrame, tolerance: float = 1e-8, rounds: int = 500) -> DataFrame:
    """``(a, b, v)``: the closest flow to ``flow`` that turns around triangles make, by least squares over the triangles.

    Conjugate gradients on the normal equations: a round is a join of the incidences with the triangles' direction, one with the
    edges' rest, and three sums; each is written. They end when no circulation is left in the rest but ``tolerance``
    of that at the start, and raise if that takes more than ``rounds``.
    """
    total = lambda df: df.agg(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0))).first()[0]
    rest = flow.select("a", "b", "v")
    way = cut(circulation(rest, sides))
    left = start = total(way)
    for _ in range(rounds):
        if left <= tolerance * tolerance * start or left == 0:
            both = flow.select("a", "b", "v").unionByName(rest.select("a", "b", (-F.col("v")).alias("v")))
            return cut(both.groupBy("a", "b").agg(F.sum("v").alias("v")))
        made = cut(around(way, sides))
        step = left / total(made)
        rest = cut(rest.unionByName(made.select("a", "b", (-step * F.col("v")).alias("v"))).groupBy("a", "b").agg(F.sum("v").alias("v")))
        turn = cut(circulation(rest, sides))
        new = total(turn)
        both = turn.unionByName(way.select("t", (new / left * F.col("v")).alias("v")))
        way, left = cut(both.groupBy("t").agg(F.sum("v").alias("v"))), new
    raise ArithmeticError(f"the curl did not converge in {rounds} rounds")


def hodge_parts(edges: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """``(a, b, flow, gradient, curl, harmonic)``: the parts of the antisymmetric flow (i, j, v) along each edge a < b.

    The gradient is of the potential that fits the flow best, the curl of the triangles' turns that fit it best, and the
    harmonic part is the rest: no node is a source of it and no triangle turns it. The parts are orthogonal and sum to the flow.
    """
    flow = undirected_flow(edges)
    both = flow.select(F.col("a").alias("i"), F.col("b").alias("j"), "v")
    both = both.unionByName(flow.select(F.col("b").alias("i"), F.col("a").alias("j"), (-F.col("v")).alias("v")))
    f = graph.potential(both, tolerance).select("node", F.col("f").alias("v"))
    gradient = slope(flow, f).withColumnRenamed("v", "gradient")
    curl = curl_part(flow, incidence(flow), tolerance).withColumnRenamed("v", "curl")
    out = flow.withColumnRenamed("v", "flow").join(gradient, ["a", "b"]).join(curl, ["a", "b"])
    return out.withColumn("harmonic", F.col("flow") - F.col("gradient") - F.col("curl"))
