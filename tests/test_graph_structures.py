"""Neighbour searches, spanning trees and what rests on them, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxcell.operators import graph, markov, neighbours, trajectory, trees


def vectors(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, x array<double>")


def clustered(n=900, groups=30, seed=0):
    rng = np.random.default_rng(seed)
    return 4 * rng.normal(size=(groups, 8))[rng.integers(0, groups, n)] + 0.3 * rng.normal(size=(n, 8))


def exact(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, 1, kind="stable")[:, :k]


@pytest.mark.parametrize("x", [clustered(), np.random.default_rng(1).normal(size=(500, 12)), np.repeat(np.arange(40.0), 12)[:, None]])
def test_nearest_over_lists_matches_brute_force(spark, x):
    df = vectors(spark, x)
    want = exact(x, 6)
    got = {(r["i"], r["rank"]): r["j"] for r in neighbours.nearest(df, df, 6, block=40).collect()}
    assert got == {(i, k + 1): want[i, k] for i in range(len(x)) for k in range(6)}


def test_nearest_with_few_points_and_other_queries(spark):
    points = vectors(spark, clustered(130))
    asked = points.where("cell_id < 20").withColumn("cell_id", F.col("cell_id") + 1000)
    got = neighbours.nearest(asked, points, 200, block=10).groupBy("i").count().collect()
    assert len(got) == 20 and {r["count"] for r in got} == {130}
    own = neighbours.nearest(asked, points, 1, block=10).collect()
    assert all(r["j"] == r["i"] - 1000 and r["d"] == 0 for r in own)
    assert neighbours.nearest(points.limit(0), points, 3).count() == 0
    assert neighbours.nearest(points, points.limit(0), 3).count() == 0


def test_lists_are_left_out_and_recall_is_reached(spark):
    df = vectors(spark, clustered())
    seen = neighbours.visited_lists(df, df, 6, block=40).agg(F.avg("visited"), F.max("lists")).first()
    assert seen[1] == 30 and seen[0] < 10
    full = neighbours.nearest(df, df, 6).select("i", "j")
    for target in (0.9, 0.99):
        found = neighbours.nearest_approximate(df, df, 6, target=target, block=40)
        assert neighbours.recall(found, full).first()["recall"] >= target - 0.03


def find(up, x):
    while up.setdefault(x, x) != x:
        x = up[x]
    return x


def kruskal(edges):
    least = {}
    for i, j, d in edges:
        if i != j and d is not None:
            key = min(i, j), max(i, j)
            least[key] = min(d, least.get(key, np.inf))
    up, out = {}, set()
    for (i, j), d in sorted(least.items(), key=lambda e: (e[1], e[0])):
        a, b = find(up, i), find(up, j)
        if a != b:
            up[a] = b
            out.add((i, j, d))
    return out


@pytest.fixture(scope="module")
def tree(spark):
    rng = np.random.default_rng(2)
    e = [(int(a), int(b), float(d)) for a, b, d in zip(*rng.integers(0, 90, (2, 400)), rng.integers(1, 30, 400), strict=True)]  # ties
    e += [(500, 501, 1.0), (501, 502, 2.0), (7, 7, 0.0), (3, 9, None), (800, 801, 4.0)]
    return e, trees.spanning_forest(spark.createDataFrame(e, "i long, j long, d double"))


def test_spanning_forest_matches_kruskal(spark, tree):
    edges, forest = tree
    assert {tuple(r) for r in forest.collect()} == kruskal(edges)
    assert trees.spanning_forest(spark.createDataFrame([], "i long, j long, d double")).count() == 0


def test_depths_and_segments_match_a_walk(spark, tree):
    edges, forest = tree
    near, degree = {}, {}
    for i, j, d in kruskal(edges):
        near.setdefault(i, []).append((j, d))
        near.setdefault(j, []).append((i, d))
    roots = spark.createDataFrame([(3,), (502,)], "node long")
    want, todo = {3: (None, 0.0, 0), 502: (None, 0.0, 0)}, [3, 502]
    while todo:
        x = todo.pop()
        for y, d in near[x]:
            if y not in want:
                want[y] = x, want[x][1] + d, want[x][2] + 1
                todo.append(y)
    made = trees.rooted(forest, roots)
    assert {r["node"]: r["parent"] for r in made.collect()} == {n: p for n, (p, _, _) in want.items()}
    assert {r["node"]: (r["t"], r["hops"]) for r in trees.depths(made).collect()} == {n: w[1:] for n, w in want.items()}
    degree = {n: len(v) for n, v in near.items()}
    assert {r["node"]: r["degree"] for r in trees.branches(forest).collect()} == degree
    up = {}
    for i, j, _ in kruskal(edges):
        if degree[i] <= 2 and degree[j] <= 2:
            a, b = find(up, i), find(up, j)
            up[max(a, b)] = min(a, b)
    assert {r["node"]: r["segment"] for r in trees.segments(forest).collect()} == {n: find(up, n) for n in near}


def test_a_long_path_takes_few_rounds(spark):
    path = spark.range(300).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), F.lit(0.5).alias("d"))
    made = trees.rooted(trees.spanning_forest(path), spark.createDataFrame([(0,)], "node long"))
    far = trees.depths(made).where("node = 300").first()
    assert (far["t"], far["hops"]) == (150.0, 300)


def test_pseudotime_on_a_fork(spark):
    nodes = {0: (0.0, 0.0), 1: (1.0, 0.0), 2: (2.0, 0.0), 3: (3.0, 1.0), 4: (3.0, -1.0), 9: (50.0, 50.0)}
    edges = [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 2**0.5), (2, 4, 2**0.5), (0, 2, 2.0), (3, 4, 2.0)]
    cells = {10: ((0.25, 0.3), 0), 11: ((2.0, 0.1), 2), 12: ((3.0, 1.0), 3), 13: ((2.5, -0.5), 4), 14: ((-5.0, 0.0), 0), 15: ((50.0, 50.0), 9)}
    got = trees.tree_pseudotime(
        spark.createDataFrame([(c, list(x)) for c, (x, _) in cells.items()], "cell_id long, x array<double>"),
        spark.createDataFrame([(n, list(x)) for n, x in nodes.items()], "node long, x array<double>"),
        spark.createDataFrame([(c, n) for c, (_, n) in cells.items()], "cell_id long, node long"),
        spark.createDataFrame(edges, "i long, j long, d double"),
    )
    t = {r["cell_id"]: r for r in got.collect()}
    assert [t[c]["pseudotime"] for c in range(10, 15)] == pytest.approx([0.25, 2 + 0.05 * 2**0.5, 2 + 2**0.5, 2 + 2**0.5 / 2, 0.0])
    assert [t[c]["node"] for c in (10, 12, 13, 14)] == [1, 3, 4, 1] and t[15]["pseudotime"] is None
    assert t[10]["away"] == pytest.approx(0.3) and t[14]["away"] == pytest.approx(5)
    assert t[10]["segment"] == 0 and t[12]["segment"] == 3


def test_fokker_planck_is_the_matrix_formula(spark):
    rng = np.random.default_rng(3)
    f = rng.normal(size=(7, 7)) * (rng.random((7, 7)) < 0.6)
    np.fill_diagonal(f, 0)
    w = np.triu(rng.random((7, 7)), 1)
    w = w + w.T
    rows = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(7) for j in range(7) if m[i, j]], "i long, j long, v double")
    got = markov.fokker_planck(rows(f), rows(w).withColumnRenamed("v", "w"), 1.5).collect()
    anti = (f - f.T) / 2
    mu = np.maximum(anti.T, 0)
    mu = np.diag(mu.sum(0)) - mu
    q = -0.5 * mu + 1.5 * (w - np.diag(w.sum(0))).T
    made = np.zeros((7, 7))
    for r in got:
        made[r["j"], r["i"]] = r["q"]  # columns are the states that are left
    assert made == pytest.approx(q) and (made - np.diag(np.diag(made)) >= 0).all() and made.sum(0) == pytest.approx(np.zeros(7))


def test_mean_squared_displacement_from_a_point(spark):
    x = np.random.default_rng(4).normal(size=(6, 2))
    df = spark.createDataFrame([(1, 10 + i, v.tolist()) for i, v in enumerate(x)] + [(2, 0, [1.0, 1.0])], "traj_id long, step int, x array<double>")
    for ref in (0, 4):
        got = {(r["traj_id"], r["k"]): r["msd"] for r in trajectory.mean_squared_displacement(df, ref).collect()}
        want = ((x - x[ref]) ** 2).mean(0)
        assert [got[1, 0], got[1, 1]] == pytest.approx(want.tolist())
        assert ((2, 0) in got) == (ref == 0)
