"""Spatial statistics and edge flows against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxcell.functions import lineage
from fluxcell.operators import flows, markers, stats


def test_permuted_is_a_bijection():
    for n in (1, 2, 3, 7, 100, 1009):
        seen = {tuple(stats.permuted(np.arange(n), n, k).tolist()) for k in range(6)}
        assert all(sorted(s) == list(range(n)) for s in seen)
        assert len(seen) > (n > 6) * 4
    assert stats.permuted(np.array([5, 2]), 50, 3).tolist() == stats.permuted(np.arange(50), 50, 3)[[5, 2]].tolist()


def test_numbered_counts_in_order(spark):
    ids = np.random.default_rng(0).permutation(500) * 3
    df = spark.createDataFrame([(int(i), "x") for i in ids], "cell_id long, y string").repartition(7)
    assert {r["cell_id"]: r["index"] for r in lineage.numbered(df, "cell_id").collect()} == {int(i): int(i) // 3 for i in ids}
    assert lineage.numbered(df.limit(0), "cell_id").count() == 0


@pytest.fixture(scope="module")
def field():
    """Sparse values of five genes on 40 cells, and edges with some weights in one direction only."""
    rng = np.random.default_rng(1)
    x = rng.poisson(1.0, (40, 5)).astype(float)
    x[:, 0] = np.maximum(0, 10 - np.abs(np.arange(40) - 20))  # smooth along the path
    x[:, 4] = 0
    x[3, 4] = 2
    w = np.zeros((40, 40))
    for i in range(39):
        w[i, i + 1] = 1 + i % 3
        if i % 4:
            w[i + 1, i] = 2
    return x, w


def tables(spark, x, w):
    stored = [(i * 10, f"g{g}", float(x[i, g])) for i in range(len(x)) for g in range(x.shape[1]) if x[i, g]]
    edges = [(i * 10, j * 10, float(w[i, j])) for i in range(len(w)) for j in range(len(w)) if w[i, j]]
    return spark.createDataFrame(stored, "cell_id long, gene_id string, value double"), spark.createDataFrame(edges, "i long, j long, w double")


def moran(x, w):
    z = x - x.mean(0)
    return np.einsum("ij,ig,jg->g", w, z, z) / (w.sum() * x.var(0))


def test_morans_i_from_stored_values(spark, field):
    x, w = field
    stored, edges = tables(spark, x, w)
    got = {r["gene_id"]: r for r in stats.morans_i(stored, edges, spark.createDataFrame([(40,)], "n_cells long")).collect()}
    n, s0, expect = 40.0, w.sum(), -1 / 39
    s1, s2 = ((w + w.T) ** 2).sum() / 2, ((w.sum(0) + w.sum(1)) ** 2).sum()
    z = x - x.mean(0)
    k = (z**4).mean(0) / (z**2).mean(0) ** 2
    normal = (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - expect**2
    free = n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0**2) - k * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0**2)
    random = free / ((n - 1) * (n - 2) * (n - 3) * s0**2) - expect**2
    for g, i in enumerate(moran(x, w)):
        r = got[f"g{g}"]
        assert r["moran_i"] == pytest.approx(i) and r["z"] == pytest.approx((i - expect) / normal**0.5)
        assert r["z_rand"] == pytest.approx((i - expect) / random[g] ** 0.5)


def test_permutation_p_matches_brute_force(spark, field):
    x, w = field
    stored, edges = tables(spark, x, w)
    cells = spark.range(40).select((F.col("id") * 10).alias("cell_id"))
    got = {r["gene_id"]: r for r in stats.morans_i_permutation(stored, edges, cells, 60, seed=2).collect()}
    own, sims = moran(x, w), []
    for p in range(1, 61):
        to = stats.permuted(np.arange(40), 40, 2 * 1_000_003 + p)
        sims.append(moran(x[to], w))
    sims = np.round(np.array(sims), 12)
    for g in range(5):
        larger = int((sims[:, g] >= round(own[g], 12)).sum())
        r = got[f"g{g}"]
        assert r["moran_i"] == pytest.approx(own[g]) and r["mean_sim"] == pytest.approx(sims[:, g].mean())
        assert r["z_sim"] == pytest.approx((own[g] - sims[:, g].mean()) / sims[:, g].std())
        if g < 4:  # the last gene's placements tie with its own
            assert r["p_sim"] == pytest.approx((min(larger, 60 - larger) + 1) / 61)
    assert got["g0"]["p_sim"] == pytest.approx(1 / 61)


@pytest.fixture(scope="module")
def flow():
    """A random flow on a graph with triangles, a square without a diagonal (a harmonic loop), and a tail."""
    rng = np.random.default_rng(2)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 14, (26, 2)) if a != b}
    pairs |= {(0, 20), (20, 21), (21, 22), (0, 22), (22, 30)} | {(i, i + 1) for i in range(13)}
    return {p: float(rng.normal()) for p in sorted(pairs)}


def operators(flow):
    """Gradient (edges x nodes) and curl (triangles x edges) as matrices."""
    edges = sorted(flow)
    nodes = sorted({n for e in edges for n in e})
    gradient = np.array([[(n == b) - (n == a) for n in nodes] for a, b in edges], float)
    rows = [(a, b, c) for a in nodes for b in nodes for c in nodes if (a, b) in flow and (b, c) in flow and (a, c) in flow]
    at = {e: k for k, e in enumerate(edges)}
    curl = np.zeros((len(rows), len(edges)))
    for t, (a, b, c) in enumerate(rows):
        curl[t, [at[a, b], at[b, c]]], curl[t, at[a, c]] = 1, -1
    return edges, gradient, curl, rows


def test_hodge_parts_match_least_squares(spark, flow):
    edges, gradient, curl, rows = operators(flow)
    f = np.array([flow[e] for e in edges])
    df = spark.createDataFrame([(a, b, v) for (a, b), v in flow.items()], "i long, j long, v double")
    half = df.withColumn("v", F.col("v") * 2)  # antisymmetric parts of edges given once are half of them
    got = {(r["a"], r["b"]): r for r in flows.hodge_parts(half).collect()}
    parts = {k: np.array([got[e][k] for e in edges]) for k in ("flow", "gradient", "curl", "harmonic")}
    assert parts["flow"] == pytest.approx(f)
    assert parts["gradient"] == pytest.approx(gradient @ np.linalg.lstsq(gradient, f, rcond=None)[0], abs=1e-6)
    assert parts["curl"] == pytest.approx(curl.T @ np.linalg.lstsq(curl.T, f, rcond=None)[0], abs=1e-6)
    for a, b in (("gradient", "curl"), ("gradient", "harmonic"), ("curl", "harmonic")):
        assert parts[a] @ parts[b] == pytest.approx(0, abs=1e-5)
    assert np.abs(gradient.T @ parts["harmonic"]).max() < 1e-5 and np.abs(curl @ parts["harmonic"]).max() < 1e-5
    assert np.abs(parts["harmonic"]).max() > 0.05


def test_flow_laplacian_and_circulation(spark, flow):
    edges, gradient, curl, rows = operators(flow)
    f = np.array([flow[e] for e in edges])
    df = spark.createDataFrame([(a, b, v) for (a, b), v in flow.items()], "a long, b long, v double")
    want = (gradient @ gradient.T + curl.T @ curl) @ f
    got = {(r["a"], r["b"]): r["v"] for r in flows.flow_laplacian(df).collect()}
    assert [got[e] for e in edges] == pytest.approx(want.tolist())
    turns = {tuple(r["t"]): r["v"] for r in flows.circulation(df, flows.incidence(df)).collect()}
    assert [turns[t] for t in rows] == pytest.approx((curl @ f).tolist())


def test_flow_without_triangles(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (1, 2, 2.0), (2, 3, 2.0), (3, 0, 2.0)], "i long, j long, v double")
    rows = flows.hodge_parts(df).collect()
    assert all(r["gradient"] == pytest.approx(0, abs=1e-8) and r["curl"] == 0 for r in rows)
    assert all(abs(r["harmonic"]) == pytest.approx(1) for r in rows)


def brute_markers(x, groups, least):
    """Every pair of groups on the dense matrix, cell by cell."""
    import math
    from collections import Counter

    out = {}
    for g in range(x.shape[1]):
        held = {a: (x[groups == a, g] != 0).sum() for a in set(groups)}
        for t in set(groups):
            test = x[groups == t, g]
            if (test != 0).mean() < least:
                continue
            for v in set(groups) - {t}:
                control = np.sort(x[groups == v, g])[-min(len(test), (groups == v).sum()) :]
                u = sum((a > b) + 0.5 * (a == b) for a in test for b in control)
                n1, n2 = len(test), len(control)
                n, tie = n1 + n2, sum(k**3 - k for k in Counter([*test, *control]).values())
                sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - tie / (n * (n - 1))))
                p = math.erfc(max(abs(u - n1 * n2 / 2) - 0.5, 0) / sd / math.sqrt(2)) if sd else 1.0
                q = np.array([held[a] for a in sorted(held)], float)
                q /= q.sum()
                one = np.array([float(a == v) for a in sorted(held)])
                bits = lambda d: -sum(z * math.log2(z) for z in d if z > 0)
                special = 1 - math.sqrt(max(0.0, bits((q + one) / 2) - bits(q) / 2))
                out[f"g{g}", t, v] = (special, (test != 0).mean(), (test > 0).mean() - (control > 0).mean(), 1 - 2 * u / (n1 * n2), u, p)
    return out


def test_group_markers_match_brute_force(spark):
    rng = np.random.default_rng(5)
    groups = np.repeat(["a", "b", "c"], [30, 18, 25])
    x = rng.poisson(0.7, (73, 6)).astype(float)
    x[:30, 0] += rng.poisson(3, 30)
    x[30:, 1] = 0
    x[:, 5] = 0
    x[3, 5] = 1
    stored = [(i, f"g{g}", float(x[i, g])) for i in range(73) for g in range(6) if x[i, g]]
    df = spark.createDataFrame(stored, "cell_id long, gene_id string, value double")
    cells = spark.createDataFrame([(i, str(g)) for i, g in enumerate(groups)], "cell_id long, grp string")
    got = {(r["gene_id"], r["test_group"], r["versus_group"]): r for r in markers.group_markers(df, cells, most_q=None).collect()}
    want = brute_markers(x, groups, 0.1)
    assert set(got) == set(want)
    for key, values in want.items():
        r = got[key]
        assert [r[c] for c in ("specificity", "exp_frac", "diff_ratio_pos", "rbc", "u")] == pytest.approx(list(values[:5]))
        assert r["p"] == pytest.approx(values[5], abs=1e-6)
    for t in "abc":  # Benjamini-Hochberg within a test group
        rows = sorted((r["p"], r["q"]) for k, r in got.items() if k[1] == t)
        raw = [p * len(rows) / (i + 1) for i, (p, _) in enumerate(rows)]
        assert [q for _, q in rows] == pytest.approx([min(1.0, *raw[i:]) for i in range(len(rows))])
    few = markers.group_markers(df, cells).collect()
    assert few and all(r["q"] < 0.05 for r in few) and any(r["gene_id"] == "g0" and r["test_group"] == "a" for r in few)
