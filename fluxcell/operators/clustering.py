"""Density clustering: the single-linkage dendrogram of a spanning tree as a table, its condensed clusters and their stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxcell.functions.lineage import cut
from fluxcell.operators.trees import last_of, spanning_forest

LEAST = 1e-12  # of a distance, so that its inverse is finite


def core_distances(neighbours: DataFrame, k: int) -> DataFrame:
    """``(cell_id, core)``: the distance to the k-th nearest of ``neighbours(i, j, d, rank)``."""
    return neighbours.where(F.col("rank") == k).select(F.col("i").alias("cell_id"), F.col("d").alias("core"))


def mutual_reachability(edges: DataFrame, core: DataFrame) -> DataFrame:
    """``(i, j, d)``: each edge's length, or the core distance of either end where that is larger."""
    at = lambda side: core.select(F.col("cell_id").alias(side), F.col("core").alias(f"c{side}"))
    e = edges.select("i", "j", "d").join(at("i"), "i").join(at("j"), "j")
    return e.select("i", "j", F.greatest("d", "ci", "cj").alias("d"))


def _below(pointers: DataFrame, start: DataFrame) -> DataFrame:
    """``(e, at)``: for each ``start(e, at)`` the last of at, its parent, its parent's parent, ... that is before e.

    ``pointers(node, up)`` lead to later nodes only. Jumps of doubling length are made as tables, then taken from the longest down.
    """
    jumps = [cut(pointers.select("node", "up"))]
    while True:
        last = jumps[-1]
        step = last.join(last.select(F.col("node").alias("up"), F.col("up").alias("up2")), "up").select("node", F.col("up2").alias("up"))
        step = cut(step.where("up is not null"))
        if step.isEmpty():
            break
        jumps.append(step)
    for jump in reversed(jumps):
        start = start.join(jump.select(F.col("node").alias("at"), "up"), "at", "left")
        start = cut(start.select("e", F.when(F.col("up") < F.col("e"), F.col("up")).otherwise(F.col("at")).alias("at")))
    return start


def dendrogram(forest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(e, w, up)`` and ``(node, up)``: the merges of single linkage over a spanning forest (i, j, d), and each node's first.

    Every edge merges two clusters; e numbers the edges by (d, i, j), and up is the edge by which the merged cluster is
    merged next, null at the last. Merging edge by edge would be one long chain of steps. Instead the forest is contracted in
    rounds: each component picks its first edge, and picked edges are contracted. The edges left over are at most half
    as many, and among themselves merge in the same order in the contracted forest, so the last round's
    merges are known first. Back through the rounds, a round's picked edges of one component lie between the merges above
    that component: each is placed by a search up the merges (jumps of doubling length) for the last before it; the
    edges of one place are a chain in order of e.
    """
    numbered = cut(forest.select("i", "j", "d")).repartitionByRange("d", "i", "j").sortWithinPartitions("d", "i", "j")
    numbered = cut(numbered.select(F.monotonically_increasing_id().alias("e"), F.col("d").alias("w"), F.col("i").alias("a"), F.col("j").alias("b")))
    left, rounds = numbered.select("e", "a", "b"), []
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("node"), "e", F.col("b").alias("to")).unionByName(left.select(F.col("b").alias("node"), "e", F.col("a").alias("to")))
        pick = cut(ends.groupBy("node").agg(F.min("e").alias("e"), F.min_by("to", "e").alias("to")))
        back = pick.select(F.col("node").alias("to"), F.col("to").alias("back"))
        ends_here = (F.col("back") == F.col("node")) & (F.col("node") < F.col("to"))
        top = last_of(pick.join(back, "to").select("node", F.when(ends_here, F.col("node")).otherwise(F.col("to")).alias("to")))
        top = cut(top)
        taken = pick.join(top, "node").select("e", F.col("last").alias("comp")).distinct()  # each picked edge with its new component
        rounds.append((pick.select("node", "e"), cut(taken)))
        at = lambda side: top.select(F.col("node").alias(side), F.col("last").alias(f"{side}2"))  # noqa: B023,E731
        left = left.join(pick.select("e").distinct(), "e", "left_anti").join(at("a"), "a").join(at("b"), "b")
        left = cut(left.select("e", F.col("a2").alias("a"), F.col("b2").alias("b")))
    merges, first = None, None  # (e, up) of the rounds done; (comp, e) by which a component of this round is merged next
    for pick, taken in reversed(rounds):
        if merges is None:
            placed = taken.select("e", "comp", F.lit(None).cast("long").alias("under"))
        else:
            above = taken.join(first.select(F.col("node").alias("comp"), F.col("e").alias("next")), "comp", "left")
            # those before the component's next merge stand directly on it, the others on the last merge before them
            climb = above.where(F.col("next") < F.col("e")).select("e", F.col("next").alias("at"))
            found = _below(merges.select(F.col("e").alias("node"), "up"), climb)
            placed = above.join(found, "e", "left").select("e", "comp", F.col("at").alias("under"))
        placed = cut(placed)
        # a place is above a merge, or above a component that is not merged before
        place = Window.partitionBy("under", F.when(F.col("under").isNull(), F.col("comp"))).orderBy("e")
        chain = placed.select("e", "comp", "under", F.lead("e").over(place).alias("next"), (F.row_number().over(place) == 1).alias("lowest"))
        chain = cut(chain)
        if merges is None:
            merges = chain.select("e", F.col("next").alias("up"))
        else:
            over = merges.select(F.col("e").alias("under"), F.col("up").alias("over"))
            meets = first.select(F.col("node").alias("comp"), F.col("e").alias("meets"))
            ends_at = F.when(F.col("under").isNull(), F.col("meets")).otherwise(F.col("over"))
            new = chain.join(over, "under", "left").join(meets, "comp", "left").select("e", F.coalesce("next", ends_at).alias("up"))
            lifted = chain.where("lowest and under is not null").select(F.col("under").alias("e"), F.col("e").alias("through"))
            old = merges.join(lifted, "e", "left").select("e", F.coalesce("through", "up").alias("up"))
            merges = new.unionByName(old)
        merges, first = cut(merges), pick
    if merges is None:
        return numbered.select("e", "w", F.lit(None).cast("long").alias("up")), numbered.select(F.col("a").alias("node"), F.col("e").alias("up"))
    return cut(merges.join(numbered.select("e", "w"), "e").select("e", "w", "up")), first.select("node", F.col("e").alias("up"))


def sizes(merges: DataFrame, leaves: DataFrame) -> DataFrame:
    """``(e, n)``: nodes under each merge, by sums over ever longer jumps up ``merges(e, up)`` from the counts of ``leaves(node, up)``."""
    own = leaves.groupBy(F.col("up").alias("e")).agg(F.count("*").alias("n"))
    here = cut(merges.select("e", "up").join(own, "e", "left").select("e", "up", F.coalesce("n", F.lit(0)).alias("n")))
    while True:
        got = here.where("up is not null").groupBy(F.col("up").alias("e")).agg(F.sum("n").alias("more"))
        jump = here.select(F.col("e").alias("up"), F.col("up").alias("up2"))
        new = here.join(got, "e", "left").join(jump, "up", "left")
        here = cut(new.select("e", F.col("up2").alias("up"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
        if here.where("up is not null").isEmpty():
            return here.select("e", "n")


def condensed(merges: DataFrame, leaves: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``(cluster, parent, birth, stability)`` and ``(node, cluster, left)`` of clusters of at least ``least`` nodes.

    Going down from a tree's last merge, a merge of two clusters that are both large enough ends its cluster and begins two;
    otherwise nodes of a smaller side fall out of the cluster there. Densities are 1 / distance. A cluster is named by
    its topmost merge and born at the density of the merge that began it (0 for a whole tree); its stability is the sum over its nodes of the
    density ``left`` at which they fall out, less its birth. A tree with fewer nodes has no cluster.
    """
    size = sizes(merges, leaves)
    m = cut(merges.join(size, "e").where(F.col("n") >= least).withColumn("density", 1 / F.greatest("w", F.lit(LEAST))))
    large = m.where("up is not null").groupBy(F.col("up").alias("e")).agg(F.count("*").alias("large"), F.sum("n").alias("inside"))
    m = m.join(large, "e", "left").fillna(0, ["large", "inside"])
    above = m.select(F.col("e").alias("up"), F.col("large").alias("above"), F.col("density").alias("birth"))
    m = m.join(above, "up", "left").withColumn("begins", F.coalesce(F.col("above") == 2, F.lit(True)))
    m = cut(m)
    of = last_of(m.select(F.col("e").alias("node"), F.when(F.col("begins"), F.col("e")).otherwise(F.col("up")).alias("to")))
    m = m.join(of.select(F.col("node").alias("e"), F.col("last").alias("cluster")), "e")
    born = m.where("begins").select("cluster", F.col("up").alias("from"), F.when(F.col("up").isNull(), 0.0).otherwise(F.col("birth")).alias("birth"))
    # all that isn't in a large side falls out, and at the end of a cluster everything
    out = F.when(F.col("large") == 2, F.col("n")).otherwise(F.col("n") - F.col("inside"))
    spread = m.select("e", "cluster", "density", out.alias("out"))
    spread = cut(spread)
    total = spread.join(born.select("cluster", "birth"), "cluster").groupBy("cluster").agg(F.sum(F.col("out") * (F.col("density") - F.col("birth"))).alias("stability"))
    parent = spread.select(F.col("e").alias("from"), F.col("cluster").alias("parent"))
    clusters = cut(born.join(total, "cluster").join(parent, "from", "left").select("cluster", "parent", "birth", "stability"))
    # a node leaves at its first merge of a large enough cluster
    small = merges.join(m.select("e"), "e", "left_anti").select("e", "up")
    up = small.select(F.col("e").alias("node"), "up").unionByName(m.select(F.col("e").alias("node"), F.col("e").alias("up")))
    first = last_of(up.select("node", F.coalesce("up", "node").alias("to")))
    nodes = leaves.join(first.select(F.col("node").alias("up"), F.col("last").alias("e")), "up").join(spread.select("e", "cluster", "density"), "e", "left")
    return clusters, cut(nodes.select("node", "cluster", F.col("density").alias("left")))


def select_stable(clusters: DataFrame, allow_single: bool = False) -> DataFrame:
    """``(cluster, chosen)``: the clusters of greatest total stability, none inside another; chosen is each cluster's, or null.

    A cluster is worth its stability or what its parts are worth, if that is more; rounds go up the levels of clusters.
    """
    c = cut(clusters.withColumns({"worth": F.lit(None).cast("double"), "own": F.lit(None).cast("boolean")}))
    while not c.where("worth is null").isEmpty():
        parts = c.where("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(
            F.sum("worth").alias("parts"), F.count_if(F.col("worth").isNull()).alias("open")
        )
        c = c.join(parts, "cluster", "left")
        ready = F.col("worth").isNull() & (F.coalesce("open", F.lit(0)) == 0)
        alone = F.col("parent").isNull() & F.lit(not allow_single)
        own = ~alone & (F.col("stability") >= F.coalesce("parts", F.lit(0.0)))
        value = F.when(own, F.col("stability")).otherwise(F.coalesce("parts", F.lit(0.0)))
        c = cut(c.select(*[x for x in clusters.columns], F.when(ready, value).otherwise(F.col("worth")).alias("worth"), F.when(ready, own).otherwise(F.col("own")).alias("own")))
    # the topmost of a chain of clusters that are worth more than their parts: rounds go down
    c = c.select("cluster", "parent", F.when(F.col("own") & F.col("parent").isNull(), F.col("cluster")).alias("chosen"), F.col("parent").isNull().alias("done"), "own")
    c = cut(c)
    while not c.where("not done").isEmpty():
        up = c.select(F.col("cluster").alias("parent"), F.col("chosen").alias("above"), F.col("done").alias("ready"))
        c = c.join(up, "parent", "left")
        value = F.coalesce("chosen", "above", F.when(F.col("own"), F.col("cluster")))
        now = ~F.col("done") & F.col("ready")
        c = cut(c.select("cluster", "parent", F.when(now, value).otherwise(F.col("chosen")).alias("chosen"), (F.col("done") | now).alias("done"), "own"))
    return c.select("cluster", "chosen")


def hdbscan(neighbours: DataFrame, min_samples: int = 5, min_size: int = 5, allow_single: bool = False) -> DataFrame:
    """``(node, label, probability)`` by hierarchical density clustering of the graph ``neighbours(i, j, d, rank)``.

    The spanning forest of the mutual reachability distances is merged, condensed and cut into the most stable clusters.
    ``label`` is a cluster's smallest node and null for noise; ``probability`` is the density at which the node falls out
    of its cluster over the cluster's highest. The graph should join every cell with ``min_samples`` neighbours at least.
    """
    near = cut(neighbours.select("i", "j", "d", "rank"))
    forest = spanning_forest(mutual_reachability(near, core_distances(near, min_samples)))
    merges, leaves = dendrogram(forest)
    clusters, nodes = condensed(merges, cut(leaves), min_size)
    chosen = select_stable(clusters, allow_single)
    got = cut(nodes.join(chosen, "cluster", "left").select("node", "chosen", "left"))
    top = got.where("chosen is not null").groupBy("chosen").agg(F.min("node").alias("label"), F.max("left").alias("most"))
    all_nodes = near.select(F.explode(F.array("i", "j")).alias("node")).distinct()
    out = all_nodes.join(got.join(top, "chosen"), "node", "left")
    return out.select("node", "label", F.coalesce(F.col("left") / F.col("most"), F.lit(0.0)).alias("probability"))
