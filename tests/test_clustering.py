"""Density clustering against a recursion over the same spanning forest."""

import numpy as np
import pytest
from test_graph_structures import find, kruskal

from fluxcell.operators import clustering, graph, trees


def parts(nodes, edges):
    up = {}
    for i, j, _ in edges:
        up[find(up, i)] = find(up, j)
    out = {}
    for n in nodes:
        out.setdefault(find(up, n), set()).add(n)
    return list(out.values())


def descend(nodes, edges, least, birth=0.0):
    """(nodes with the density they leave at, stability, parts) of the cluster that starts with all nodes."""
    left, current = {}, sorted(edges, key=lambda e: (e[2], e[0], e[1]))
    while True:
        *rest, (_, _, w) = current
        density = 1 / max(w, 1e-12)
        sides = parts(nodes, rest)
        large = [s for s in sides if len(s) >= least]
        inside = lambda s: [e for e in rest if e[0] in s]  # noqa: B023,E731
        if len(large) == 1:
            left |= {n: density for n in nodes - large[0]}
            nodes, current = large[0], inside(large[0])
            continue
        left |= {n: density for n in nodes}
        below = [descend(s, inside(s), least, density) for s in large]
        return left, sum(d - birth for d in left.values()), below


def chosen(cluster, allowed):
    """(worth, clusters of greatest total stability)."""
    left, stability, below = cluster
    got = [chosen(c, True) for c in below]
    worth = sum(w for w, _ in got)
    if allowed and stability >= worth:
        return stability, [left_below(cluster)]
    return worth, [c for _, cs in got for c in cs]


def left_below(cluster):
    """Nodes with the density at which they leave the last part they are in."""
    left, _, below = cluster
    out = dict(left)
    for c in below:
        out |= left_below(c)
    return out


def brute_hdbscan(edges, least, allow_single):
    forest = kruskal(edges)
    nodes = {n for i, j, _ in edges for n in (i, j)}
    labels = {n: None for n in nodes}
    for tree in parts(nodes, forest):
        if len(tree) >= least:
            for c in chosen(descend(tree, [e for e in forest if e[0] in tree], least), allow_single)[1]:
                most = max(c.values())
                labels |= {n: (min(c), d / most) for n, d in c.items()}
    return labels


@pytest.mark.parametrize("allow_single", [False, True])
def test_hdbscan_matches_recursion(spark, allow_single):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, s, (n, 2)) for c, s, n in ((0, 0.3, 50), (4, 0.2, 30), (5, 0.2, 25), (-6, 1.0, 40))] + [rng.uniform(-9, 9, (25, 2))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, x array<double>")
    near = graph.nearest(df, df, 8).collect()
    core = {r["i"]: r["d"] for r in near if r["rank"] == 4}
    edges = [(r["i"], r["j"], max(r["d"], core[r["i"]], core[r["j"]])) for r in near]
    got = clustering.hdbscan(spark.createDataFrame(near), 4, 7, allow_single).collect()
    want = brute_hdbscan(edges, 7, allow_single)
    assert {r["node"]: r["label"] for r in got} == {n: c and c[0] for n, c in want.items()}
    assert all(r["probability"] == pytest.approx(want[r["node"]][1] if r["label"] is not None else 0.0) for r in got)
    assert len({r["label"] for r in got}) >= 4


def merges_of(forest):
    """Single linkage edge by edge: weights in order, each merge's next, each node's first."""
    up, last, after, first = {}, {}, {}, {}
    order = sorted(forest, key=lambda e: (e[2], e[0], e[1]))
    for k, (i, j, _) in enumerate(order):
        a, b = find(up, i), find(up, j)
        for c, n in ((a, i), (b, j)):
            if c in last:
                after[last[c]] = k
            else:
                first[n] = k
        up[a] = b
        last[b] = k
    return [w for _, _, w in order], after, first


@pytest.mark.parametrize("n,weights", [(2, 9), (60, 4), (150, 10_000)])
def test_dendrogram_matches_single_linkage(spark, n, weights):
    rng = np.random.default_rng(n)
    forest = [(int(rng.integers(0, i)), i, float(rng.integers(1, weights))) for i in range(1, n)] + [(1000, 1001, 2.0)]
    merges, leaves = clustering.dendrogram(spark.createDataFrame(forest, "i long, j long, d double"))
    rows = sorted(merges.collect(), key=lambda r: r["e"])
    place = {r["e"]: k for k, r in enumerate(rows)}
    weight, after, first = merges_of(forest)
    assert [r["w"] for r in rows] == weight
    assert {k: place[r["up"]] for k, r in enumerate(rows) if r["up"] is not None} == after
    assert {r["node"]: place[r["up"]] for r in leaves.collect()} == first
    count = {}
    for k in first.values():
        while k is not None:
            count[k] = count.get(k, 0) + 1
            k = after.get(k)
    assert {place[r["e"]]: r["n"] for r in clustering.sizes(merges, leaves).collect()} == count


def test_dendrogram_of_a_chain(spark):
    rows = [(i, i + 1, float(i)) for i in range(200)]  # each merge adds one node to the last
    merges, leaves = clustering.dendrogram(spark.createDataFrame(rows, "i long, j long, d double"))
    got = sorted(merges.collect(), key=lambda r: r["e"])
    assert [r["up"] for r in got[:-1]] == [r["e"] for r in got[1:]] and got[-1]["up"] is None
    assert {r["n"] for r in clustering.sizes(merges, leaves).collect()} == set(range(2, 202))


def test_nothing_to_cluster(spark):
    none = spark.createDataFrame([], "i long, j long, d double, rank int")
    assert clustering.hdbscan(none).count() == 0
    assert trees.last_of(spark.createDataFrame([], "node long, to long")).count() == 0
