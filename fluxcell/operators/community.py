"""Communities of high modularity: local moves, refinement into connected parts, and contraction of these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxcell.functions.lineage import cut
from fluxcell.operators.trees import components

GAIN = 1e-4  # of modularity: less is no gain
STRIDE = 4  # rounds between two looks at what they have brought


def _both_ways(edges: DataFrame) -> DataFrame:
    """Undirected edges (i, j, w) from either end, each once; weights are 1 where there are none."""
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    e = edges.where("i <> j").select("i", "j", w.alias("w"))
    e = e.unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    return e.groupBy("i", "j").agg(F.max("w").alias("w"))


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Modularity of ``labels(node, label)`` on the undirected graph (i, j[, w]): edges within less what degrees let expect."""
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    e = edges.where("i <> j").select("i", "j", w.alias("w"))
    at = lambda side, name: labels.select(F.col("node").alias(side), F.col("label").alias(name))
    e = e.join(at("i", "a"), "i").join(at("j", "b"), "j")
    m, inside = e.agg(F.sum("w"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")))).first()
    half = e.select("a", "w").unionByName(e.select(F.col("b").alias("a"), "w")).groupBy("a").agg(F.sum("w").alias("k"))
    return (inside or 0.0) / m - half.agg(F.sum(F.col("k") * F.col("k"))).first()[0] / (4 * m * m)


def _quality(e: DataFrame, here: DataFrame, total: float) -> float:
    """Modularity of ``here(node, k, label)`` on edges from either end, loops included."""
    at = lambda side, name: here.select(F.col("node").alias(side), F.col("label").alias(name))
    inside = e.join(at("i", "a"), "i").join(at("j", "b"), "j").where("a = b").agg(F.sum("w")).first()[0] or 0.0
    expected = here.groupBy("label").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0.0
    return inside / total - expected / (total * total)


def _best_label(e: DataFrame, movers: DataFrame, targets: DataFrame, weight: DataFrame, total: float, inside: bool = False) -> DataFrame:
    """``(node, to)``: of ``movers(node, k, label)`` that gain by it, the community of ``targets(node, label)`` with the largest gain of modularity, ties to the smaller.

    ``weight(label, all)`` is a community's degree. With ``inside`` both have a column ``whole``, and only communities in the mover's own whole count;
    without, a mover may also leave for a community of its own, named by a negative number.
    """
    whole = ["whole"] if inside else []
    near = e.where("i <> j").join(movers.select(F.col("node").alias("i"), "k", F.col("label").alias("own"), *[F.col(c).alias("mine") for c in whole]), "i")
    near = near.join(targets.select(F.col("node").alias("j"), "label", *whole), "j")
    if inside:
        near = near.where("mine = whole")
    near = near.groupBy("i", "label").agg(F.sum("w").alias("w"), F.first("k").alias("k"), F.first("own").alias("own"))
    stay = movers.select(F.col("node").alias("i"), "label", F.lit(0.0).alias("w"), "k", F.col("label").alias("own"))
    if not inside:
        stay = stay.unionByName(stay.withColumn("label", -F.col("i") - 1))
    near = near.unionByName(stay).groupBy("i", "label").agg(F.sum("w").alias("w"), F.first("k").alias("k"), F.first("own").alias("own"))
    others = F.coalesce("all", F.lit(0.0)) - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(F.lit(0.0))
    gain = F.round(F.col("w") - F.col("k") * others / total, 9)
    choice = F.struct(gain.alias("g"), (F.col("label") == F.col("own")).alias("stays"), (-F.col("label")).alias("l"))
    best = near.join(weight, "label", "left").groupBy("i").agg(F.max(choice).alias("best"))
    return best.where("not best.stays").select(F.col("i").alias("node"), (-F.col("best.l")).alias("to"))


def local_moves(e: DataFrame, here: DataFrame, total: float, seed: int, level: int) -> tuple[DataFrame, float]:
    """``here(node, k, label)`` after rounds in which nodes move to the neighbouring community of largest gain, and its modularity.

    In a round only half of the nodes (by a hash of node and round) may move, so that neighbours don't swap for ever. Rounds end when
    ``STRIDE`` of them have brought no gain; the best communities are kept.
    """
    best, top, n = here, _quality(e, here, total), 0
    while True:
        for _ in range(STRIDE):
            may = here.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.lit(n), "node"), F.lit(2)) == 0)
            weight = here.groupBy("label").agg(F.sum("k").alias("all"))
            moved = _best_label(e, may, here, weight, total)
            here, n = cut(here.join(moved, "node", "left").select("node", "k", F.coalesce("to", "label").alias("label"))), n + 1
        q = _quality(e, here, total)
        if q <= top + GAIN:
            return (here, q) if q > top else (best, top)
        best, top = here, q


def refine(e: DataFrame, here: DataFrame, total: float, seed: int, level: int) -> DataFrame:
    """``(node, k, label, whole)``: each community of ``here(node, k, label)``, now whole, in connected parts, now label.

    All nodes start alone. In a round, those still alone that a hash lets move join a neighbouring part of their community, of those that don't move, if
    modularity gains by it. Parts only grow, each time along an edge from a node that stays, so every part is connected.
    """
    parts, n = cut(here.select("node", "k", F.col("node").alias("label"), F.col("label").alias("whole"), F.lit(True).alias("moved"))), 0
    while not parts.where("moved").isEmpty():
        parts = parts.withColumn("moved", F.lit(False))
        for _ in range(STRIDE):
            size = parts.groupBy("label").agg(F.count("*").alias("size"), F.sum("k").alias("all"))
            marked = parts.join(size, "label")
            free = (F.col("size") == 1) & (F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(level), F.lit(n), "node"), F.lit(2)) == 0)
            to = _best_label(e, marked.where(free), marked.where(~free), size.select("label", "all"), total, inside=True)
            new = parts.join(to, "node", "left").select("node", "k", F.coalesce("to", "label").alias("label"), "whole", (F.col("moved") | F.col("to").isNotNull()).alias("moved"))
            parts, n = cut(new), n + 1
    return parts.drop("moved")


def communities(edges: DataFrame, membership: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """``(node, label)``: connected communities of high modularity on the undirected graph (i, j[, w]).

    A level moves nodes (``local_moves``), refines the communities into connected parts (``refine``), and makes the parts the nodes
    of the next level's weighted graph, which starts from the communities. Levels end when one brings no gain. Then a community that
    moves have left in pieces is divided into them. ``membership(node, label)`` is where to start from (else every node alone; nodes without one start alone). A label is the
    community's smallest node. Ties go to the smaller label.
    """
    e = first = cut(_both_ways(edges))
    of = cut(e.select(F.col("i").alias("node")).distinct().withColumn("at", F.col("node")))
    total = e.agg(F.sum("w")).first()[0]
    degree = e.groupBy("i").agg(F.sum("w").alias("k")).select(F.col("i").alias("node"), "k")
    here = degree.withColumn("label", F.col("node"))
    if membership is not None:
        # a starting community is named by its smallest node
        known = membership.join(degree.select("node"), "node", "left_semi")
        low = known.join(known.groupBy("label").agg(F.min("node").alias("low")), "label").select("node", "low")
        here = degree.join(low, "node", "left").select("node", "k", F.coalesce("low", "node").alias("label"))
    here, level, last = cut(here), 0, None
    while total:
        here, q = local_moves(e, here, total, seed, level)
        if last is not None and q <= last + GAIN:
            break
        last = q
        parts = refine(e, here, total, seed, level)
        if parts.where("label <> node").isEmpty():  # nothing joins within the communities
            break
        level += 1
        name = parts.groupBy("label").agg(F.min("node").alias("low"))
        parts = cut(parts.join(name, "label").select("node", "k", F.col("low").alias("part"), "whole"))
        of = cut(of.join(parts.select(F.col("node").alias("at"), "part"), "at").select("node", F.col("part").alias("at")))
        ends = lambda side: parts.select(F.col("node").alias(side), F.col("part").alias(f"{side}2"))  # noqa: B023,E731
        e = e.join(ends("i"), "i").join(ends("j"), "j").groupBy(F.col("i2").alias("i"), F.col("j2").alias("j")).agg(F.sum("w").alias("w"))
        e = cut(e)
        here = cut(parts.groupBy(F.col("part").alias("node"), F.col("whole").alias("label")).agg(F.sum("k").alias("k")).select("node", "k", "label"))
    found = cut(of.join(here.select(F.col("node").alias("at"), "label"), "at").select("node", "label"))
    end = lambda side: found.select(F.col("node").alias(side), F.col("label").alias(f"{side}2"))
    inner = first.join(end("i"), "i").join(end("j"), "j").where("i2 = j2").select("i", "j")
    alone = found.select(F.col("node").alias("i"), F.col("node").alias("j"))
    return components(inner.unionByName(alone)).withColumnRenamed("component", "label")
