"""Spanning trees of edge tables: Boruvka rounds, rooting by Euler tours, distances, projection of cells, pseudotime."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxcell.functions.lineage import cut


def last_of(links: DataFrame) -> DataFrame:
    """``(node, last)``: where pointers ``links(node, to)`` end, by pointer doubling; a node that points to itself ends there."""
    links = cut(links.select("node", "to"))
    while True:
        further = links.select(F.col("node").alias("to"), F.col("to").alias("further"))
        far = links.join(further, "to", "left").select("node", F.coalesce("further", "to").alias("next"), "to")
        far = cut(far.select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        if far.where("moved").isEmpty():
            return far.select("node", F.col("to").alias("last"))
        links = far.select("node", "to")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """``(i, j, d)``, i < j: the minimum spanning forest of the undirected graph (i, j, d), by Boruvka rounds.

    In a round every component takes its lightest edge (ties: smallest ends, so that no cycle arises), the
    components that these edges join become one by pointer doubling, and between two components only
    the lightest edge stays. At least half of the components go in a round; each round is written
    as a table. Loops and edges without a length are left out.
    """
    e = edges.where("i <> j and d is not null").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d")
    e = e.groupBy("i", "j").agg(F.min("d").alias("d")).select(F.col("i").alias("a"), F.col("j").alias("b"), F.struct("d", "i", "j").alias("e"))
    taken = []
    while True:
        e = cut(e)
        if e.isEmpty():
            break
        ends = e.select(F.col("a").alias("node"), F.struct("e", F.col("b").alias("to")).alias("p")).unionByName(
            e.select(F.col("b").alias("node"), F.struct("e", F.col("a").alias("to")).alias("p"))
        )
        pick = cut(ends.groupBy("node").agg(F.min("p").alias("p")).select("node", "p.to", "p.e"))
        taken.append(pick.select("e").distinct())
        back = pick.select(F.col("node").alias("to"), F.col("to").alias("back"))
        # two components may pick each other: the smaller is then the end of the pointers
        ends_here = (F.col("back") == F.col("node")) & (F.col("node") < F.col("to"))
        up = pick.join(back, "to").select("node", F.when(ends_here, F.col("node")).otherwise(F.col("to")).alias("to"))
        top = last_of(up)
        at = lambda side: top.select(F.col("node").alias(side), F.col("last").alias(f"{side}2"))  # noqa: B023,E731
        e = e.join(at("a"), "a").join(at("b"), "b").where("a2 <> b2")
        e = e.groupBy(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).agg(F.min("e").alias("e"))
    if not taken:
        return edges.select("i", "j", "d").limit(0)
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return cut(out.select("e.i", "e.j", "e.d"))


def rooted(forest: DataFrame, root: DataFrame) -> DataFrame:
    """``(node, parent, d)`` of the trees (i, j, d) that hold a node of ``root(node)`` (one in each tree); the root has none.

    Each tree's Euler tour, from the root along every edge there and back, is a linked list of directed
    edges: after (u, v) comes (v, w), w being v's neighbour after u. Pointer doubling counts how far each is from the
    list's end, and of an edge's two directions the one that comes first leads down. Rounds grow with the logarithm of the
    tree's size, whatever its depth. A node's neighbours are put in order in one task, so it should not have millions.
    """
    arcs = forest.select(F.col("i").alias("u"), F.col("j").alias("v"), "d").unionByName(
        forest.select(F.col("j").alias("u"), F.col("i").alias("v"), "d")
    )
    arcs = cut(arcs)
    around = Window.partitionBy("u").orderBy("v")
    first = F.first("v").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    order = arcs.select("u", "v", F.coalesce(F.lead("v").over(around), first).alias("w"), (F.row_number().over(around) == 1).alias("one"))
    # the arc (x, u) is followed by (u, w) where w follows x around u
    follows = order.select(F.col("v").alias("pu"), F.col("u").alias("pv"), F.col("u").alias("nu"), F.col("w").alias("nv"))
    starts = order.where("one").join(root.select(F.col("node").alias("u")), "u", "left_semi").select(F.col("u").alias("su"), F.col("v").alias("sv"))
    begins = (F.col("nu") == F.col("su")) & (F.col("nv") == F.col("sv"))
    tour = follows.join(starts, begins, "left").select(
        F.col("pu").alias("u"),
        F.col("pv").alias("v"),
        F.when(F.col("su").isNull(), F.col("nu")).alias("nu"),
        F.when(F.col("su").isNull(), F.col("nv")).alias("nv"),
        F.lit(1).cast("long").alias("n"),
    )
    tour = cut(tour)
    size = 2 * forest.count()
    hop = 1
    while hop < size:
        ahead = tour.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("nnu"), F.col("nv").alias("nnv"), F.col("n").alias("more"))
        tour = tour.join(ahead, ["nu", "nv"], "left").select(
            "u", "v", F.col("nnu").alias("nu"), F.col("nnv").alias("nv"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")
        )
        tour = cut(tour)
        hop *= 2
    ended = tour.where("nu is null").select("u", "v", "n")  # tours without a root go round for ever
    down = ended.join(ended.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("n").alias("back")), ["u", "v"]).where("n > back")
    found = down.join(arcs, ["u", "v"]).select(F.col("v").alias("node"), F.col("u").alias("parent"), "d")
    roots = root.select("node", F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("d"))
    return cut(found.unionByName(roots))


def depths(tree: DataFrame) -> DataFrame:
    """``(node, t, hops)``: distance and steps to the root along ``tree(node, parent, d)``, by pointer doubling."""
    here = cut(tree.select("node", F.col("parent").alias("up"), F.col("d").alias("t"), F.col("parent").isNotNull().cast("int").alias("hops")))
    while not here.where("up is not null").isEmpty():
        above = here.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("t").alias("t2"), F.col("hops").alias("h2"))
        here = cut(
            here.join(above, "up", "left").select(
                "node",
                F.col("up2").alias("up"),
                (F.col("t") + F.coalesce("t2", F.lit(0.0))).alias("t"),
                (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops"),
            )
        )
    return here.select("node", "t", "hops")


def branches(forest: DataFrame) -> DataFrame:
    """``(node, degree, kind)`` of the trees (i, j): ``tip`` with one edge, ``branch`` with over two, else ``path``."""
    n = forest.select(F.explode(F.array("i", "j")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    kind = F.when(F.col("degree") == 1, "tip").when(F.col("degree") > 2, "branch").otherwise("path")
    return n.withColumn("kind", kind)


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of the undirected graph (i, j), component being its smallest node; nodes without an edge are absent.

    In a round each node points to its smallest neighbour or itself, and what points to one end becomes one node; no edge is left at the end.
    """
    both = edges.select("i", "j").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    both = cut(both)
    low = cut(both.select(F.col("i").alias("node")).distinct().withColumn("component", F.col("node")))
    both = both.where("i <> j")
    while not both.isEmpty():
        up = both.groupBy(F.col("i").alias("node")).agg(F.min("j").alias("m")).select("node", F.least("node", "m").alias("to"))
        top = cut(last_of(up))
        low = low.join(top.select(F.col("node").alias("component"), "last"), "component", "left")
        low = cut(low.select("node", F.coalesce("last", "component").alias("component")))
        move = lambda side: top.select(F.col("node").alias(side), F.col("last").alias(f"{side}2"))  # noqa: B023,E731
        both = both.join(move("i"), "i").join(move("j"), "j").where("i2 <> j2")
        both = cut(both.select(F.col("i2").alias("i"), F.col("j2").alias("j")).distinct())
    return low


def segments(forest: DataFrame) -> DataFrame:
    """``(node, segment)``: nodes of one unbranched stretch share a segment, the smallest of them; branch nodes are their own."""
    kinds = cut(branches(forest))
    at = lambda side: kinds.select(F.col("node").alias(side), F.col("kind").alias(f"k{side}"))
    inner = forest.select("i", "j").join(at("i"), "i").join(at("j"), "j").where("ki <> 'branch' and kj <> 'branch'")
    alone = kinds.select(F.col("node").alias("i"), F.col("node").alias("j"))
    return components(inner.select("i", "j").unionByName(alone)).withColumnRenamed("component", "segment")


def project_to_tree(cells: DataFrame, nearest_node: DataFrame, tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(cell_id, node, parent, f, away, t)``: the closest point of the tree to each of ``cells(cell_id, x)``.

    Looked for on the segments of ``tree(node, parent, d)`` that end at the cell's node in ``nearest_node(cell_id, node)``;
    ``nodes(node, x, t)`` have places and distances from the root. f is the share of the way from parent to node, t the
    distance from the root there, and away the distance to the tree. Ties go to the smaller node. A node without a segment is its own closest point.
    """
    a = nodes.select(F.col("node"), F.col("x").alias("xn"))
    b = nodes.select(F.col("node").alias("parent"), F.col("x").alias("xp"), F.col("t").alias("tp"))
    sides = tree.join(a, "node").join(b, "parent", "left")
    # a segment is met from both of its ends
    ends = sides.withColumn("at", F.explode(F.when(F.col("parent").isNull(), F.array("node")).otherwise(F.array("node", "parent"))))
    e = cells.select("cell_id", "x").join(nearest_node.select("cell_id", F.col("node").alias("at")), "cell_id").join(ends, "at")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    e = e.withColumns({"way": F.zip_with("xn", "xp", lambda x, y: x - y), "step": F.zip_with("x", "xp", lambda x, y: x - y)})
    f = F.coalesce(F.try_divide(dot("step", "way"), dot("way", "way")), F.lit(1.0))
    e = e.withColumn("f", F.when(F.col("parent").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), f))))
    foot = F.when(F.col("parent").isNull(), F.col("xn")).otherwise(F.zip_with("xp", "way", lambda p, w: p + F.col("f") * w))
    away = F.sqrt(F.aggregate(F.zip_with("x", foot, lambda x, y: x - y), F.lit(0.0), lambda s, x: s + x * x))
    t = F.coalesce(F.col("tp") + F.col("f") * F.col("d"), F.lit(0.0))
    e = e.select("cell_id", "node", "parent", "f", away.alias("away"), t.alias("t"))
    # a root is only looked at by itself where it has no segment
    best = e.groupBy("cell_id").agg(F.min(F.struct(F.round("away", 12).alias("r"), F.col("parent").isNull().alias("alone"), "node", "parent", "f", "away", "t")).alias("b"))
    return best.select("cell_id", "b.node", "b.parent", "b.f", "b.away", "b.t")


def tree_pseudotime(cells: DataFrame, nodes: DataFrame, nearest_node: DataFrame, edges: DataFrame, root: int | None = None) -> DataFrame:
    """``(cell_id, pseudotime, node, parent, f, segment, away)`` along the minimum spanning tree of a principal graph.

    ``nodes(node, x)`` are its centres, ``edges(i, j, d)`` its candidate edges, ``nearest_node(cell_id, node)`` each cell's
    centre. The tree is rooted at ``root``, or else at the smallest tip; a cell is projected to the closest segment of its
    centre, and its pseudotime is the distance from the root to that point along the tree. Cells of a tree without the
    root have none. ``segment`` is the unbranched stretch of the projection's outer end.
    """
    forest = spanning_forest(edges)
    if root is None:
        root = branches(forest).where("kind = 'tip'").agg(F.min("node")).first()[0]
    start = nodes.where(F.col("node") == root).select("node")
    tree = rooted(forest, start)
    placed = nodes.select("node", "x").join(depths(tree), "node")
    got = project_to_tree(cells, nearest_node, tree, placed)
    got = got.join(segments(forest), "node", "left")
    out = cells.select("cell_id").join(got, "cell_id", "left")
    return out.select("cell_id", F.col("t").alias("pseudotime"), "node", "parent", "f", F.coalesce("segment", "node").alias("segment"), "away")


def shortest_tree(edges: DataFrame, root: int | str) -> DataFrame:
    """``(node, parent, t, hops)``: least path lengths t from ``root`` over the undirected graph (i, j, d >= 0), and the step before each node.

    Of equal lengths the path with fewer steps counts, then the one over the smaller node. A round relaxes the edges of the nodes that the round
    before improved, until none is; nodes out of reach are absent.
    """
    both = edges.select("i", "j", "d").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    both = cut(both.where("i <> j").groupBy("i", "j").agg(F.min("d").alias("d")))
    kind = dict(both.dtypes)["i"]
    none = F.lit(None).cast(kind)
    start = both.where(F.col("i") == root).select(F.col("i").alias("node")).distinct()
    here = cut(start.select("node", F.struct(F.lit(0.0).alias("t"), F.lit(0).alias("hops"), none.alias("parent")).alias("p"), F.lit(True).alias("new")))
    while not here.where("new").isEmpty():
        from_ = here.where("new").select(F.col("node").alias("i"), F.col("p.t").alias("t"), F.col("p.hops").alias("hops"))
        step = both.join(from_, "i").select(
            F.col("j").alias("node"), F.struct((F.col("t") + F.col("d")).alias("t"), (F.col("hops") + 1).alias("hops"), F.col("i").alias("parent")).alias("p")
        )
        known = here.select("node", "p", F.col("p").alias("old"))
        best = known.unionByName(step.withColumn("old", F.lit(None).cast(dict(known.dtypes)["old"])))
        best = best.groupBy("node").agg(F.min("p").alias("p"), F.min("old").alias("old"))
        here = cut(best.select("node", "p", F.coalesce(F.col("p") < F.col("old"), F.lit(True)).alias("new")))
    return here.select("node", "p.parent", "p.t", "p.hops")


def paths_to(tree: DataFrame, ends: DataFrame) -> DataFrame:
    """``(end, step, node)``: the way from the root to each of ``ends(end)`` in ``tree(node, parent, hops)``; step 0 is the root.

    Pointer doubling: with jumps of 1, 2, 4, ... parents each path's known part doubles.
    """
    jump = cut(tree.select("node", F.col("parent").alias("up")))
    path = ends.join(tree.select(F.col("node").alias("end")), "end", "left_semi").distinct().select("end", F.col("end").alias("node"))
    while not jump.where("up is not null").isEmpty():
        more = path.join(jump.where("up is not null"), "node").select("end", F.col("up").alias("node"))
        path = cut(path.unionByName(more).distinct())
        further = jump.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        jump = cut(jump.join(further, "up", "left").select("node", F.col("up2").alias("up")))
    return path.join(tree.select("node", F.col("hops").alias("step")), "node").select("end", "step", "node")
