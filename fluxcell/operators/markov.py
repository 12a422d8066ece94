"""Markov chains as edge tables ``(i, j, p)``: estimation, steps, passage times, lumping, projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxcell.functions.lineage import column_quantile, cut
from fluxcell.functions.scalars import ratio
from fluxcell.operators.trees import paths_to, shortest_tree


def transitions(steps: DataFrame) -> DataFrame:
    """``(i, j, n, p)``: counts and shares of moves between successive states of ``steps(traj_id, ts, event_id, state)``."""
    w = Window.partitionBy("traj_id").orderBy("ts", "event_id")
    moves = steps.withColumn("i", F.lag("state").over(w)).where("i is not null").groupBy("i", F.col("state").alias("j"))
    n = moves.agg(F.count("*").alias("n"))
    s = n.groupBy("i").agg(F.sum("n").alias("s"))
    return n.join(s, "i").select("i", "j", "n", ratio(F.col("n"), F.col("s")).alias("p"))


def power(chain: DataFrame, k: int) -> DataFrame:
    """The k-step chain, by repeated edge joins (squaring where possible)."""

    def times(a: DataFrame, b: DataFrame) -> DataFrame:
        right = b.select(F.col("i").alias("m"), "j", F.col("p").alias("q"))
        prod = a.select("i", F.col("j").alias("m"), "p").join(right, "m")
        return prod.groupBy("i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("p"))

    out, base = None, chain.select("i", "j", "p")
    while k:
        if k & 1:
            out = base if out is None else times(out, base)
        k >>= 1
        if k:
            base = times(base, base)
    return out


def evolve(start: DataFrame, chain: DataFrame, k: int) -> DataFrame:
    """``(state, p)``: the distribution ``start(state, p)`` after k steps."""
    p = start
    for n in range(k):
        m = p.select(F.col("state").alias("i"), F.col("p").alias("a")).join(chain.select("i", "j", "p"), "i")
        p = m.groupBy(F.col("j").alias("state")).agg(F.sum(F.col("a") * F.col("p")).alias("p"))
        if n % 10 == 9:
            p = cut(p)
    return p


def stationary(chain: DataFrame, rounds: int = 40, lazy: float = 0.5) -> DataFrame:
    """``(state, p)`` by power iteration of the lazy chain from the uniform distribution."""
    states = chain.select(F.explode(F.array("i", "j")).alias("state")).distinct()
    n = states.agg(F.count("*").alias("n"))
    start = states.crossJoin(F.broadcast(n)).select("state", (1.0 / F.col("n")).alias("p"))
    stay = states.select(F.col("state").alias("i"), F.col("state").alias("j"), F.lit(lazy).alias("p"))
    slow = cut(chain.select("i", "j", (F.col("p") * (1 - lazy)).alias("p")).unionByName(stay))
    return evolve(start, slow, rounds)


def return_time(pi: DataFrame) -> DataFrame:
    return pi.select("state", ratio(F.lit(1.0), F.col("p")).alias("t"))


def lump(chain: DataFrame, groups: DataFrame, pi: DataFrame) -> DataFrame:
    """The chain between groups ``(state, grp)``, states weighted by their stationary share ``pi(state, p)``."""
    a = groups.select(F.col("state").alias("i"), F.col("grp").alias("ga"))
    b = groups.select(F.col("state").alias("j"), F.col("grp").alias("gb"))
    w = pi.select(F.col("state").alias("i"), F.col("p").alias("w"))
    e = chain.join(a, "i").join(b, "j").join(w, "i")
    num = e.groupBy("ga", "gb").agg(F.sum(F.col("w") * F.col("p")).alias("x"))
    den = num.groupBy("ga").agg(F.sum("x").alias("s"))
    return num.join(den, "ga").select(F.col("ga").alias("i"), F.col("gb").alias("j"), ratio(F.col("x"), F.col("s")).alias("p"))


def hitting_time(chain: DataFrame, targets: list, tolerance: float = 1e-10, rounds: int = 60) -> DataFrame:
    """``(state, t)``: expected steps to a target, 0 at the targets; null where a target may never be reached.

    Over the moves Q among states that aren't targets, t is the sum of Q^k 1 over all k. A round
    doubles the terms summed, t := t + R t and R := R R from t = 1 and R = Q, and the rounds end when
    R's rows sum to less than ``tolerance``. States from which some chain of moves leads to no
    target are set aside first. Meant for chains of states (lumped, or of event types), whose powers stay small.
    """
    moves = chain.where((F.col("p") > 0) & ~F.col("i").isin(targets)).select("i", "j", "p")
    states = cut(chain.select(F.explode(F.array("i", "j")).alias("state")).distinct())
    # states that can reach a target, then those that can't avoid it for good
    able = cut(states.where(F.col("state").isin(targets)))
    while True:
        more = moves.join(able.withColumnRenamed("state", "j"), "j", "left_semi").select(F.col("i").alias("state"))
        more = cut(more.distinct().join(able, "state", "left_anti"))
        if more.isEmpty():
            break
        able = cut(able.unionByName(more))
    lost = cut(states.join(able, "state", "left_anti"))
    while True:
        more = moves.join(lost.withColumnRenamed("state", "j"), "j", "left_semi").select(F.col("i").alias("state"))
        more = cut(more.distinct().join(lost, "state", "left_anti"))
        if more.isEmpty():
            break
        lost = cut(lost.unionByName(more))
    inner = moves.where(~F.col("j").isin(targets)).join(lost.withColumnRenamed("state", "i"), "i", "left_anti")
    r = cut(inner)
    t = cut(states.where(~F.col("state").isin(targets)).join(lost, "state", "left_anti").withColumn("t", F.lit(1.0)))
    for _ in range(rounds):
        left = r.groupBy("i").agg(F.sum("p").alias("s")).agg(F.max("s")).first()[0] or 0.0
        if left < tolerance:
            break
        step = r.join(t.withColumnRenamed("state", "j"), "j").groupBy(F.col("i").alias("state")).agg(F.sum(F.col("p") * F.col("t")).alias("more"))
        t = cut(t.join(step, "state", "left").select("state", (F.col("t") + F.coalesce("more", F.lit(0.0))).alias("t")))
        r = cut(power(r, 2))
    else:
        raise ArithmeticError(f"hitting times did not converge in {rounds} doublings")
    done = states.where(F.col("state").isin(targets)).withColumn("t", F.lit(0.0))
    return t.unionByName(done).unionByName(lost.withColumn("t", F.lit(None).cast("double")))


def embedded_chain(rates: DataFrame) -> DataFrame:
    """Jump chain of a rate matrix ``(i, j, q)``, i <> j: q_ij over the row's sum."""
    e = rates.where("i <> j")
    s = e.groupBy("i").agg(F.sum("q").alias("s"))
    return e.join(s, "i").select("i", "j", ratio(F.col("q"), F.col("s")).alias("p"))


def fokker_planck(flow: DataFrame, weights: DataFrame, diffusion: float) -> DataFrame:
    """Rates ``(i, j, q)`` from i to j of drift and diffusion on a graph: max(F_ij, 0) / 2 + D w_ij for i <> j.

    F is the antisymmetric part of ``flow(i, j, v)``: of an edge's two directions only the one that the flow goes along
    has drift, so no rate is negative. ``weights(i, j, w)`` should be symmetric. The diagonal is less what leaves, so a
    state's rates sum to 0; as a matrix with columns for the states that are left, q stands in row j and column i.
    """
    both = flow.where("i <> j").select("i", "j", "v").unionByName(
        flow.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("v")).alias("v"))
    )
    drift = both.groupBy("i", "j").agg((F.greatest(F.sum("v") / 2, F.lit(0.0)) / 2).alias("q"))
    spread = weights.where("i <> j").select("i", "j", (diffusion * F.col("w")).alias("q"))
    off = drift.unionByName(spread).groupBy("i", "j").agg(F.sum("q").alias("q"))
    return off.unionByName(off.groupBy("i").agg((-F.sum("q")).alias("q")).select("i", F.col("i").alias("j"), "q"))


# velocity-driven transition matrix

EDGE = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("p", pa.float64())])


def correlation_kernel(
    edges: DataFrame, vectors: DataFrame, method: str = "pearson", sigma: float = 0.1, transform: str = "sqrt"
) -> DataFrame:
    """``(i, j, p)``: how well the step to a neighbour agrees with a cell's velocity.

    x_j - x_i and v_i are compared (Pearson or cosine, undefined = 0) after a transform: ``sqrt`` or
    ``log`` (log1p) of the absolute value with its sign, ``linear``, or ``logratio`` (differences of
    log1p of absolute values, for x_j and for x_i + v_i). Positive and negative parts c give
    expm1(c / sigma) and -expm1(-c / sigma). Each row is divided by the sum of absolute values,
    in which staying takes part by expm1(d / sigma): d is what the cell's best match (0 at
    least) lacks to the 98th percentile of all cells' best, at most 1. Self edges and zeros are then left out.
    ``edges`` is usually the graph with its second neighbours. Work is a
    join of edges and vectors; the arithmetic runs in batches of edges.
    """
    a = vectors.select(F.col("cell_id").alias("i"), F.col("x").alias("xi"), F.col("v").alias("vi"))
    b = vectors.select(F.col("cell_id").alias("j"), F.col("x").alias("xj"))
    e = edges.where("i <> j").select("i", "j").join(a, "i").join(b, "j")
    signed = {
        "sqrt": lambda d: np.sign(d) * np.sqrt(np.abs(d)),
        "log": lambda d: np.sign(d) * np.log1p(np.abs(d)),
        "linear": lambda d: d,
    }
    if transform not in (*signed, "logratio"):
        raise ValueError(transform)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            n = t.num_rows
            if not n:
                continue
            get = lambda c: t.column(c).flatten().to_numpy().reshape(n, -1)  # noqa: B023,E731
            x, y, v = get("xi"), get("xj"), get("vi")
            if transform == "logratio":
                here = np.log1p(np.abs(x))
                d, v = np.log1p(np.abs(y)) - here, np.log1p(np.abs(x + v)) - here
            else:
                d, v = signed[transform](y - x), signed[transform](v)
            if method == "pearson":
                d, v = d - d.mean(1, keepdims=True), v - v.mean(1, keepdims=True)
            low = np.sqrt((d * d).sum(1) * (v * v).sum(1))
            c = np.where(low > 0, (d * v).sum(1) / np.where(low > 0, low, 1), 0.0)
            yield pa.RecordBatch.from_arrays([t.column("i"), t.column("j"), pa.array(c)], schema=EDGE)

    c = cut(e.select("i", "j", "xi", "vi", "xj").mapInArrow(run, "i long, j long, p double"))
    g = F.when(F.col("p") >= 0, F.expm1(F.col("p") / sigma)).otherwise(-F.expm1(-F.col("p") / sigma))
    per = c.groupBy("i").agg(F.greatest(F.max("p"), F.lit(0.0)).alias("best"), F.sum(F.abs(g)).alias("s"))
    per = cut(vectors.select(F.col("cell_id").alias("i")).join(per, "i", "left").fillna(0.0, ["best", "s"]))
    top = column_quantile(per, "best", 0.98)
    stay = F.expm1(F.greatest(F.least(F.lit(top) - F.col("best"), F.lit(1.0)), F.lit(0.0)) / sigma)
    p = F.coalesce(ratio(g, F.col("s") + stay), F.lit(0.0))
    return c.join(per, "i").select("i", "j", p.alias("p")).where("p <> 0")


def project_velocity(chain: DataFrame, positions: DataFrame) -> DataFrame:
    """``(cell_id, v)``: sum of p_ij u_ij less mean p_i times the sum of u_ij, u unit steps in ``positions(cell_id, x)``."""
    a = positions.select(F.col("cell_id").alias("i"), F.col("x").alias("xi"))
    b = positions.select(F.col("cell_id").alias("j"), F.col("x").alias("xj"))
    e = chain.select("i", "j", "p").join(b, "j").join(a, "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            n = t.num_rows
            if not n:
                continue
            x, y = (t.column(c).flatten().to_numpy().reshape(n, -1) for c in ("xi", "xj"))
            p, cell = t.column("p").to_numpy(), t.column("i").to_numpy()
            d = y - x
            length = np.sqrt((d * d).sum(1, keepdims=True))
            u = np.divide(d, length, out=np.zeros_like(d), where=length > 0)
            ids, at = np.unique(cell, return_inverse=True)
            sums = np.zeros((len(ids), 2 * u.shape[1] + 2))
            np.add.at(sums, at, np.concatenate([p[:, None] * u, u, p[:, None], np.ones((n, 1))], 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["i", "s"])

    # the join has brought a cell's edges together, so a batch holds most cells whole and few rows are left
    some = e.select("i", "p", "xi", "xj").mapInArrow(run, "i long, s array<double>")
    total = some.select("i", F.posexplode("s").alias("k", "s")).groupBy("i", "k").agg(F.sum("s").alias("s"))
    total = total.groupBy(F.col("i").alias("cell_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("s"))
    d = ((F.size("s") - 2) / 2).cast("int")
    weighted, plain = F.slice("s", F.lit(1), d), F.slice("s", d + 1, d)
    mean = F.get("s", 2 * d) / F.get("s", 2 * d + 1)
    return total.select("cell_id", F.zip_with(weighted, plain, lambda w, u: w - mean * u).alias("v"))


def ito_kernel(edges: DataFrame, vectors: DataFrame, n_best: int = 30, least: float = 1e-7) -> DataFrame:
    """``(i, j, p)`` of the local Ito kernel: p_ij ~ exp(-|x_j - x_i - tau v_i|^2 / (4 tau D)), tau from the
    neighbours best aligned with v_i, D from the neighbours' mean squared distance; p <= least dropped."""
    a = vectors.select(F.col("cell_id").alias("i"), F.col("x").alias("xi"), F.col("v").alias("vi"))
    b = vectors.select(F.col("cell_id").alias("j"), F.col("x").alias("xj"))
    d = F.zip_with("xj", "xi", lambda x, y: x - y)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    e = edges.where("i <> j").select("i", "j").join(a, "i").join(b, "j").withColumn("d", d)
    e = e.select("i", "j", dot("d", "d").alias("dd"), dot("d", "vi").alias("dv"), dot("vi", "vi").alias("vv"))
    cos = ratio(F.col("dv"), F.sqrt(F.col("dd") * F.col("vv")))
    best = Window.partitionBy("i").orderBy(F.desc_nulls_last(cos), "j")
    e = e.withColumn("r", F.row_number().over(best))
    per = e.groupBy("i").agg(
        F.avg(F.when((F.col("r") <= n_best) & (F.col("dv") > 0), ratio(F.col("dv"), F.col("vv")))).alias("tau"),
        F.avg("dd").alias("ms"),
    )
    e = e.join(per.withColumn("tau", F.coalesce("tau", F.lit(1.0))), "i")
    away = F.col("dd") - 2 * F.col("tau") * F.col("dv") + F.col("tau") * F.col("tau") * F.col("vv")
    e = e.withColumn("g", F.exp(-ratio(away, 2 * F.col("ms"))))
    s = e.groupBy("i").agg(F.sum("g").alias("s"))
    p = e.join(s, "i").select("i", "j", ratio(F.col("g"), F.col("s")).alias("p")).where(F.col("p") > least)
    s2 = p.groupBy("i").agg(F.sum("p").alias("s"))
    return p.join(s2, "i").select("i", "j", ratio(F.col("p"), F.col("s")).alias("p"))


def group_paths(chain: DataFrame) -> DataFrame:
    """``(a, b, length)``: shortest undirected paths on lengths 1 - p between the (few) groups of a lumped
    chain, by repeated min-plus joins until twice the logarithm of the group count."""
    e = chain.where("i <> j").select(F.col("i").alias("a"), F.col("j").alias("b"), (1 - F.col("p")).alias("length"))
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "length")).groupBy("a", "b").agg(F.min("length").alias("length"))
    n = e.select("a").distinct().count()
    d = e
    for _ in range(max(1, math.ceil(math.log2(max(2, n))))):
        right = d.select(F.col("a").alias("m"), F.col("b").alias("c"), F.col("length").alias("l2"))
        via = d.join(right, d["b"] == right["m"]).where("a <> c").select("a", F.col("c").alias("b"), (F.col("length") + F.col("l2")).alias("length"))
        d = cut(d.unionByName(via).groupBy("a", "b").agg(F.min("length").alias("length")))
    return d


def tree_model(chain: DataFrame, progenitor: str, terminators: list[str], allowed: DataFrame | None = None) -> DataFrame:
    """``(end, step, i, j)``: the steps of the shortest path from the progenitor to each terminal group; together they are the lineage tree.

    ``chain(i, j, p)`` are transitions between groups; those without an edge in ``allowed(i, j)`` are pruned and negative ones left out, rows are divided
    by their sums, and a transition, in either direction, is 1 - p long.
    """
    e = chain.where("i <> j and p > 0").select("i", "j", "p")
    if allowed is not None:
        e = e.join(allowed.select("i", "j").distinct(), ["i", "j"], "left_semi")
    s = e.groupBy("i").agg(F.sum("p").alias("s"))
    e = e.join(s, "i").select("i", "j", (1 - ratio(F.col("p"), F.col("s"))).alias("d"))
    tree = cut(shortest_tree(e, progenitor))
    ends = tree.where(F.col("node").isin(terminators)).select(F.col("node").alias("end"))
    way = paths_to(tree, ends).where("step > 0")
    return way.join(tree.select("node", "parent"), "node").select("end", "step", F.col("parent").alias("i"), F.col("node").alias("j"))
