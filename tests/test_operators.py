import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxcell.functions import lineage
from fluxcell.functions import scalars as S
from fluxcell.operators import community, decompose, graph, kinetics, markov, matrix, moments, multiomic, normalize, qc, rank, sampling, select, simulate, stats, trajectory
from fluxcell.operators import vectorfield as V
from fluxcell.plans import recipes
from fluxcell.sources import tables
from fluxcell.streaming import incremental


def expr(spark, m, layer="X"):
    data = [(i, f"g{j}", layer, float(v)) for i, row in enumerate(m) for j, v in enumerate(row) if v]
    return spark.createDataFrame(data, "cell_id long, gene_id string, layer string, value double")


def ncells(spark, n):
    return spark.createDataFrame([(n,)], "n_cells long")


def edges(spark, m, name="w"):
    data = [(i, j, float(v)) for i, row in enumerate(m) for j, v in enumerate(row) if v]
    return spark.createDataFrame(data, f"i long, j long, {name} double")


PATH = [[0, 1, 0], [1, 0, 1], [0, 1, 0]]
X3 = [[1, 2], [3, 4], [5, 6]]


def test_gene_filter(spark):
    m = [[1, 0, 3, 0], [0, 1, 1, 0], [0, 1, 2, 1], [0, 0, 0, 0], [0, 1, 1, 1], [1, 0, 0, 1]]
    limits = {"X": {"min_cell": 2, "min_avg": 0.5, "max_avg": 2.5, "min_count": 2}}
    got = qc.filter_genes_by_outliers(expr(spark, m), ncells(spark, 6), limits).collect()
    assert {r["gene_id"]: r["kept"] for r in got} == {"g0": False, "g1": True, "g2": True, "g3": True}


def test_cell_filter(spark):
    m = [[1, 0, 3], [4, 0, 0], [7, 8, 9], [10, 11, 12]]
    got = qc.filter_cells_by_outliers(expr(spark, m), {"X": (2, 6)}).where("kept").collect()
    assert {r["cell_id"] for r in got} == {0, 2, 3}


def test_pattern_filter(spark):
    g = spark.createDataFrame([("MT-1",), ("RPS",), ("GATA1",)], "gene_id string")
    got = {r["gene_id"]: not r["kept"] for r in qc.filter_genes_by_pattern(g).collect()}
    assert got == {"MT-1": True, "RPS": True, "GATA1": False}


def test_mean_variance_matches_numpy(spark):
    m = np.array([[1, 2, 0, 1, 5], [0, 0, 3, 1, 299], [4, 0, 5, 1, 399]], float)
    got = {r["gene_id"]: r for r in select.mean_variance(expr(spark, m), ncells(spark, 3)).collect()}
    for j in range(5):
        assert got[f"g{j}"]["mean"] == pytest.approx(m[:, j].mean())
        assert got[f"g{j}"]["variance"] == pytest.approx(m[:, j].var(ddof=1))


def test_moments(spark):
    x = expr(spark, X3).select("cell_id", "gene_id", "value")
    w = edges(spark, PATH)
    got = {(r["cell_id"], r["gene_id"]): r["m"] for r in moments.first_moment(w, x).collect()}
    assert [[got[i, f"g{j}"] for j in range(2)] for i in range(3)] == [[3, 4], [6, 8], [3, 4]]
    got = {(r["cell_id"], r["gene_id"]): r["m"] for r in moments.first_moment(graph.row_normalize(w), x).collect()}
    assert [[got[i, f"g{j}"] for j in range(2)] for i in range(3)] == [[3, 4]] * 3
    xy = x.select("cell_id", "gene_id", F.col("value").alias("x"), (F.col("value") + 1).alias("y"))
    got = {(r["cell_id"], r["gene_id"]): r["m"] for r in moments.second_moment(w, xy).collect()}
    assert [[got[i, f"g{j}"] for j in range(2)] for i in range(3)] == [[12, 20], [32, 48], [12, 20]]


def test_laplacian(spark):
    got = {(r["i"], r["j"]): r["v"] for r in graph.laplacian(edges(spark, PATH)).collect()}
    assert got == {(0, 0): 1, (0, 1): -1, (1, 0): -1, (1, 1): 2, (1, 2): -1, (2, 1): -1, (2, 2): 1}
    e = edges(spark, [[0, 2, 0], [2, 0, 1], [0, 1, 0]], "e")
    got = {(r["i"], r["j"]): r["v"] for r in graph.laplacian(edges(spark, PATH).join(e, ["i", "j"])).collect()}
    assert got == {(0, 0): 0.25, (0, 1): -0.25, (1, 0): -0.25, (1, 1): 1.25, (1, 2): -1, (2, 1): -1, (2, 2): 1}


def test_divergence(spark):
    for m, want in (([[0, 0, 0], [1, 0, 1], [0, 0, 0]], [-0.5, 1, -0.5]), ([[0, 0, 0], [3, 0, 2], [0, 0, 0]], [-1.5, 2.5, -1])):
        got = {r["node"]: r["divergence"] for r in graph.divergence(edges(spark, m, "v")).collect()}
        assert [got[i] for i in range(3)] == want


def test_triangles(spark):
    m = [[0, 1, 1, 1], [1, 0, 1, 0], [1, 1, 0, 1], [1, 0, 1, 0]]
    got = {r["node"]: r["n"] for r in graph.triangles(edges(spark, m)).collect()}
    assert [got[i] for i in range(4)] == [2, 1, 2, 1]


def test_min_distance(spark):
    for pts, want in (([[1, 2], [3, 4], [5, 6], [0, 0]], 2.23606797749979), ([[0, 0], [3, 4], [5, 6], [0, 0]], 0)):
        df = spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(pts)], "cell_id long, x array<double>")
        assert graph.min_distance(df).first()["d"] == pytest.approx(want)


def test_nearest_matches_brute_force_over_blocks(spark):
    x = np.random.default_rng(0).normal(size=(300, 5))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "cell_id long, x array<double>")
    got = {(r["i"], r["rank"]): r["j"] for r in graph.nearest(df, df, 4, block=50).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, 1, kind="stable")[:, :4]
    assert all(got[i, k + 1] == want[i, k] for i in range(300) for k in range(4))


def test_normalise_and_proportional_fitting(spark):
    m = [[1, 2], [3, 3], [0, 0]]
    x = expr(spark, m)
    cells = spark.createDataFrame([(i,) for i in range(3)], "cell_id long")
    f = {r["cell_id"]: r["size_factor"] for r in normalize.size_factors(x, cells).collect()}
    assert f == {0: 1.0, 1: 2.0, 2: pytest.approx(1 / 3)}
    pf = normalize.proportional_fit(x, ncells(spark, 3)).groupBy("cell_id").agg(F.sum("value").alias("s")).collect()
    assert {r["cell_id"]: r["s"] for r in pf} == {0: pytest.approx(3), 1: pytest.approx(3)}


def test_closed_forms(spark):
    row = spark.range(1).select(
        S.unspliced_at(F.lit(2.0), 1.0, 3.0, 0.5).alias("u"),
        S.spliced_at(F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(0.5), F.lit(0.5)).alias("s_eq"),
        S.spliced_at(F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(0.5), F.lit(0.500001)).alias("s_near"),
        S.gamma_from_old(F.lit(1.0), F.lit(math.e), 1.0).alias("g"),
        S.freeman_tukey_inverse(S.freeman_tukey(F.lit(7.0))).alias("seven"),
    ).first()
    assert row["u"] == pytest.approx(math.exp(-1) + 6 * (1 - math.exp(-1)))
    assert row["s_eq"] == pytest.approx(row["s_near"], abs=1e-4)
    assert row["g"] == pytest.approx(1) and row["seven"] == pytest.approx(7)


def test_information(spark):
    p, q = F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(1.0), F.lit(0.0))
    r = spark.range(1).select(S.entropy_bits(p).alias("h"), S.jensen_shannon(p, q).alias("j"), S.jensen_shannon(p, p).alias("z")).first()
    assert r["h"] == pytest.approx(1) and r["z"] == pytest.approx(0) and r["j"] == pytest.approx(0.311278, abs=1e-5)


def test_fit_kinetics_recovers_rates(spark):
    data = [("a", float(t), 4 / 0.8 * (1 - math.exp(-0.8 * t))) for t in range(1, 8)]
    r = kinetics.fit_kinetics(spark.createDataFrame(data, "gene_id string, t double, m double")).first()
    assert r["alpha"] == pytest.approx(4, rel=1e-3) and r["gamma"] == pytest.approx(0.8, rel=1e-3)


def test_bh_known_values(spark):
    t = spark.createDataFrame([("f", 0.01), ("f", 0.04), ("f", 0.03), ("f", 0.5)], "family string, p double")
    q = {r["p"]: round(r["q"], 6) for r in rank.bh_monotone(t).collect()}
    assert q == {0.01: 0.04, 0.03: 0.053333, 0.04: 0.053333, 0.5: 0.5}


def test_normal_tail(spark):
    r = spark.range(1).select(stats.normal_tail(F.lit(1.959964)).alias("p")).first()
    assert r["p"] == pytest.approx(0.05, abs=1e-5)


def test_stationary_of_two_state_chain(spark):
    c = spark.createDataFrame([("a", "a", 0.9), ("a", "b", 0.1), ("b", "a", 0.5), ("b", "b", 0.5)], "i string, j string, p double")
    pi = {r["state"]: r["p"] for r in markov.stationary(c, 60).collect()}
    assert pi["a"] == pytest.approx(5 / 6, abs=1e-6)
    t = {r["state"]: r["t"] for r in markov.hitting_time(c, ["b"]).collect()}
    assert t["a"] == pytest.approx(10, abs=1e-3)


def test_trajectory_geometry(spark):
    tr = spark.createDataFrame([(0, i, [float(i), 0.0]) for i in range(5)], "traj_id long, step int, x array<double>")
    arc = [r["arc"] for r in trajectory.arc_length(tr).orderBy("step").collect()]
    assert arc == [0, 1, 2, 3, 4]
    msd = {r["lag"]: r["msd"] for r in trajectory.lagged_displacement(tr, [1, 2]).collect()}
    assert msd == {1: 1.0, 2: 4.0}
    x = [r["x"][0] for r in trajectory.resample(tr, 9).orderBy("k").collect()]
    assert x == pytest.approx([i / 2 for i in range(9)])


def test_field_calculus_matches_differences(spark):
    rng = np.random.default_rng(1)
    f = V.Field(rng.normal(size=(6, 3)), 0.4, rng.normal(size=(6, 3)))
    x, h = rng.normal(size=(4, 3)), 1e-5
    j = f.jacobian(x)
    for k in range(3):
        d = np.zeros(3)
        d[k] = h
        assert np.allclose(j[:, :, k], (f(x + d) - f(x - d)) / (2 * h), atol=1e-6)
    lap = sum((f(x + h * 100 * e) - 2 * f(x) + f(x - h * 100 * e)) / (h * 100) ** 2 for e in np.eye(3))
    assert np.allclose(f.laplacian(x), lap, atol=1e-4)
    assert np.allclose(V.divergence(f, x, x), np.trace(j, axis1=1, axis2=2))


def test_field_fit_recovers_linear_flow(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, size=(400, 2))
    v = x @ np.array([[-1.0, 0.5], [-0.5, -1.0]]).T
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, v, strict=True))], "cell_id long, x array<double>, v array<double>")
    f = V.fit_field(df, 60, beta=0.5, ridge=0.01)
    assert np.abs(f(x) - v).mean() < 0.1
    fp = [r for r in V.fixed_points(df, f, digits=1).collect() if abs(r["x"][0]) < 0.2 and abs(r["x"][1]) < 0.2]
    assert fp and all(r["stable"] for r in fp)


def test_pca_matches_numpy(spark):
    x = np.random.default_rng(3).normal(size=(200, 6)) * np.arange(1, 7)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "cell_id long, x array<double>")
    _, vec, share, _ = decompose.pca(df, 6, 3)
    u = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(vec), np.abs(u[2][:3].T), atol=1e-6)
    assert np.allclose(share, (u[1] ** 2 / (u[1] ** 2).sum())[:3])


def test_gillespie_reaches_poisson_mean(spark):
    s = simulate.gillespie(spark, 300, [0, 0], simulate.EXPRESSION, simulate.expression_rates(8.0, 2.0, 1.0), 12.0, 3)
    m = s.where("t = 12").select(F.avg(F.get("counts", 0)).alias("u"), F.avg(F.get("counts", 1)).alias("s")).first()
    assert m["u"] == pytest.approx(4, abs=0.6) and m["s"] == pytest.approx(8, abs=0.9)


def test_link_peaks_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    p = [(i, int(c), int(s), int(s + w)) for i, (c, s, w) in enumerate(zip(rng.integers(0, 3, 80), rng.integers(0, 500, 80), rng.integers(0, 90, 80), strict=True))]
    g = [(i, int(c), int(t)) for i, (c, t) in enumerate(zip(rng.integers(0, 3, 40), rng.integers(0, 500, 40), strict=True))]
    got = multiomic.link_peaks(
        spark.createDataFrame(p, "peak_id long, chrom long, start long, end long"), spark.createDataFrame(g, "gene_id long, chrom long, tss long"), 20
    ).collect()
    want = {(a, b) for a, c, t in g for b, c2, s, e in p if c == c2 and s <= t + 20 and e >= t - 20}
    assert sorted((r["gene_id"], r["peak_id"]) for r in got) == sorted(want)


def test_sources_round_trip(spark, tmp_path):
    x = expr(spark, X3)
    tables.write_parquet(x, str(tmp_path / "x"), ["layer"])
    assert tables.read_parquet(spark, str(tmp_path / "x")).count() == 6
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% c\n3 2 2\n1 1 5\n3 2 7\n")
    got = tables.read_matrix_market(spark, str(tmp_path / "m.mtx"), "X").collect()
    assert sorted((r["cell_id"], r["gene_id"], r["value"]) for r in got) == [(0, "0", 5.0), (2, "1", 7.0)]
    (tmp_path / "w.csv").write_text("id,a,b\n1,0,2\n2,3,0\n")
    got = tables.read_wide_csv(spark, str(tmp_path / "w.csv"), "X", "id").collect()
    assert sorted((r["cell_id"], r["gene_id"], r["value"]) for r in got) == [(1, "b", 2.0), (2, "a", 3.0)]


def test_stream_matches_batch(spark, tmp_path):
    src = spark.createDataFrame([(f"2024-01-0{d} 10:00:00", "a", float(d)) for d in (1, 1, 2, 3)], "ts string, state string, value double")
    src = src.withColumn("ts", F.to_timestamp("ts"))
    src.write.parquet(str(tmp_path / "in"))
    batch = incremental.windowed_totals(src).collect()
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = incremental.windowed_totals(stream).writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("totals").collect()) == sorted(batch)


def test_aggregate_datasets_keeps_common(spark):
    a, b = expr(spark, [[1, 2], [3, 4]]), expr(spark, [[1, 0]])
    got = matrix.aggregate_datasets([a, b]).collect()
    assert [(r["cell_id"], r["gene_id"], r["value"]) for r in got] == [(0, "g0", 2.0)]


def test_lineage_starts_from_every_cell(spark):
    from fluxcell.plans import bindings as B
    from fluxcell.plans.model_queries import QUERIES

    d = "/root/testdata/sf0.001"
    origins = {r["origin"] for r in QUERIES["lineage_cells"](spark, d).select("origin").distinct().collect()}
    assert origins == {r["cell_id"] for r in B.vectors(spark, d).select("cell_id").collect()}


def test_two_groups_from_stored_entries_match_dense(spark):
    rng = np.random.default_rng(3)
    m = rng.poisson(1.0, (40, 6)) * rng.integers(0, 2, (40, 6))
    dense = [(f"g{j}", float(m[i, j]), i % 4 == 0) for i in range(40) for j in range(6)]
    kind = "gene_id string, value double, test boolean"
    a = stats.two_group_de(spark.createDataFrame(dense, kind)).orderBy("gene_id").collect()
    totals = spark.createDataFrame([(10, 30)], "n_test long, n_control long")
    b = stats.two_group_de(spark.createDataFrame([r for r in dense if r[1]], kind), totals).orderBy("gene_id").collect()
    assert a == b and len(a) >= 4
    for r in a:
        x = m[:, int(r["gene_id"][1:])]
        t, c = x[::4], np.delete(x, np.arange(0, 40, 4))
        u = sum((v > c).sum() + (v == c).sum() / 2 for v in t)
        assert r["u"] == u and (r["n1"], r["n2"]) == (10, 30)
        n, k = 40, np.unique(x, return_counts=True)[1]
        sd = math.sqrt(10 * 30 / 12 * (n + 1 - (k**3 - k).sum() / (n * (n - 1))))
        assert r["p"] == pytest.approx(math.erfc(max(abs(u - 150) - 0.5, 0) / sd / math.sqrt(2)), abs=1e-6)


def test_slopes_from_stored_entries_match_dense(spark):
    rng = np.random.default_rng(4)
    m = rng.poisson(2.0, (50, 3, 2)).astype(float) * rng.integers(0, 2, (50, 3, 1))
    rows = [(i, f"g{j}", *map(float, m[i, j])) for i in range(50) for j in range(3)]
    kind = "cell_id long, gene_id string, u double, s double"
    dense = kinetics.gamma_ols(spark.createDataFrame(rows, kind)).orderBy("gene_id").collect()
    some = spark.createDataFrame([r for r in rows if r[2] or r[3]], kind)
    sparse = kinetics.gamma_ols(some, n_cells=ncells(spark, 50)).orderBy("gene_id").collect()
    for a, b in zip(dense, sparse, strict=True):
        assert a["gene_id"] == b["gene_id"] and list(a)[1:] == pytest.approx(list(b)[1:])


def test_column_quantile(spark):
    rng = np.random.default_rng(5)
    for x in (rng.normal(size=3000), np.repeat([1.0, 5.0], 1500), np.array([2.0])):
        df = spark.createDataFrame([(float(v),) for v in x], "v double")
        for q in (0.0, 0.31, 0.98, 1.0):
            assert lineage.column_quantile(df, "v", q) == pytest.approx(np.quantile(x, q))
        for k in (0, len(x) // 2, len(x) - 1):
            want = np.sort(x)[[k, min(k + 1, len(x) - 1)]]
            assert lineage.order_statistics(df, "v", k, most=5) == tuple(want)
    assert lineage.column_quantile(df.limit(0), "v", 0.5) is None


def test_kernel_row_sums_leave_room_to_stay(spark):
    rng = np.random.default_rng(6)
    x, v = rng.normal(size=(30, 4)), rng.normal(size=(30, 4))
    cells = spark.createDataFrame([(i, x[i].tolist(), v[i].tolist()) for i in range(30)], "cell_id long, x array<double>, v array<double>")
    e = [(i, (i + k) % 30) for i in range(30) for k in (1, 2, 5)]
    got = {(r["i"], r["j"]): r["p"] for r in markov.correlation_kernel(spark.createDataFrame(e, "i long, j long"), cells, "cosine", transform="log").collect()}
    f = lambda z: np.sign(z) * np.log1p(np.abs(z))
    c = {(i, j): f(x[j] - x[i]) @ f(v[i]) / np.linalg.norm(f(x[j] - x[i])) / np.linalg.norm(f(v[i])) for i, j in e}
    best = np.array([max(0, *(c[i, (i + k) % 30] for k in (1, 2, 5))) for i in range(30)])
    stay = np.expm1(np.clip(np.percentile(best, 98) - best, 0, 1) / 0.1)
    g = {k: math.copysign(math.expm1(abs(z) / 0.1), z) for k, z in c.items()}
    for i, j in e:
        assert got[i, j] == pytest.approx(g[i, j] / (sum(abs(g[i, (i + k) % 30]) for k in (1, 2, 5)) + stay[i]))


def test_hitting_times_solve_the_linear_system(spark):
    rng = np.random.default_rng(7)
    p = rng.random((7, 7)) * (rng.random((7, 7)) < 0.5) + np.eye(7) * 0.3
    p[5] = p[6] = 0
    p[5, 5] = 1.0  # never leaves
    p[:5, 5] = 0
    p[3, 5] = 0.5
    p[:4, 6] += 0.2
    p[4] = 0
    p[4, [4, 6]] = 0.9, 0.1
    p[6, 6] = 1
    p /= p.sum(1, keepdims=True)
    chain = edges(spark, p, "p")
    got = {r["state"]: r["t"] for r in markov.hitting_time(chain, [6]).collect()}
    reach = {3}
    while True:  # states from which some moves lead to state 5
        more = {i for i in range(6) if any(p[i, j] for j in reach | {5})} | reach
        if more == reach:
            break
        reach = more
    sound = [i for i in range(6) if i not in reach and i != 5]
    t = np.linalg.solve(np.eye(len(sound)) - p[np.ix_(sound, sound)], np.ones(len(sound)))
    assert got[6] == 0 and got[5] is None and all(got[i] is None for i in reach)
    assert [got[i] for i in sound] == pytest.approx(t.tolist())


def test_potential_solves_the_poisson_equation(spark):
    rng = np.random.default_rng(8)
    e = {(i, (i + k) % 40): rng.normal() for i in range(40) for k in (1, 3, 11)}
    got = {r["node"]: r["f"] for r in graph.potential(spark.createDataFrame([(i, j, float(v)) for (i, j), v in e.items()], "i long, j long, v double")).collect()}
    lap, b = np.zeros((40, 40)), np.zeros(40)
    for (i, j), v in e.items():
        lap[i, j] = lap[j, i] = -1
        b[i] -= v / 2
        b[j] += v / 2
    np.fill_diagonal(lap, -lap.sum(1))
    f = np.linalg.lstsq(lap, b, rcond=None)[0]
    assert [got[i] for i in range(40)] == pytest.approx((f - f.mean()).tolist(), abs=1e-7)


def test_communities_find_planted_groups(spark):
    rng = np.random.default_rng(9)
    e = [(i, j) for i in range(90) for j in range(i) if rng.random() < (0.5 if i // 30 == j // 30 else 0.02)]
    df = spark.createDataFrame(e, "i long, j long")
    got = community.communities(df)
    label = {r["node"]: r["label"] for r in got.collect()}
    assert label == {i: i // 30 * 30 for i in range(90)}
    assert community.modularity(df, got) > 0.5


def test_shortest_times_and_triangles(spark):
    import heapq

    rng = np.random.default_rng(10)
    e = {(int(a), int(b)): float(d) for a, b, d in zip(rng.integers(0, 60, 150), rng.integers(0, 60, 150), rng.random(150), strict=True) if a != b}
    df = spark.createDataFrame([(a, b, d) for (a, b), d in e.items()], "i long, j long, d double")
    near = {}
    for (a, b), d in e.items():
        near.setdefault(a, []).append((b, d))
        near.setdefault(b, []).append((a, d))
    root = min(near)
    want, todo = {}, [(0.0, root)]
    while todo:
        d, a = heapq.heappop(todo)
        if a not in want:
            want[a] = d
            for b, x in near[a]:
                heapq.heappush(todo, (d + x, b))
    got = {r["cell_id"]: r["pseudotime"] for r in sampling.shortest_times(df, [root]).collect()}
    assert got == pytest.approx(want)
    pairs = {tuple(sorted(p)) for p in e}
    three = {(a, b, c) for a, b in pairs for c in range(b + 1, 60) if (a, c) in pairs and (b, c) in pairs}
    n = {r["node"]: r["n"] for r in graph.triangles(df).collect()}
    assert all(n[i] == sum(i in t for t in three) for i in n)
    assert {(r["a"], r["b"], r["c"]) for r in graph.curl(df.withColumnRenamed("d", "v")).collect()} == three


def test_regress_out_leaves_least_squares_residuals(spark):
    rng = np.random.default_rng(11)
    z, y = rng.normal(size=(25, 2)), rng.normal(size=(25, 3))
    x = spark.createDataFrame([(i, f"g{j}", float(y[i, j])) for i in range(25) for j in range(3)], "cell_id long, gene_id string, value double")
    c = spark.createDataFrame([(i, float(z[i, 0]), float(z[i, 1]), 1.0) for i in range(25)], "cell_id long, a double, b double, same double")
    got = {(r["cell_id"], r["gene_id"]): r["value"] for r in stats.regress_out(x, c, ("a", "b", "same")).collect()}
    a = np.hstack([np.ones((25, 1)), z])
    want = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
    assert [got[i, f"g{j}"] for i in range(25) for j in range(3)] == pytest.approx(want.ravel().tolist(), abs=1e-8)


def test_gene_components_match_numpy(spark):
    rng = np.random.default_rng(12)
    m = rng.poisson(1.0, (60, 70)) + 5 * rng.poisson(0.5, (60, 3)) @ rng.integers(0, 2, (3, 70))
    m[7] = 0
    x = expr(spark, m).select("cell_id", "gene_id", "value")
    scores, loadings, share = decompose.gene_pca(x, spark.range(60).withColumnRenamed("id", "cell_id"), x.select("gene_id"), 3)
    got = np.array([r["x"] for r in scores.orderBy("cell_id").collect()])
    u, s, _ = np.linalg.svd(m - m.mean(0), full_matrices=False)
    assert np.abs(got) == pytest.approx(np.abs(u[:, :3] * s[:3]), abs=1e-3)
    assert share == pytest.approx(s[:3] ** 2 / (s**2).sum(), rel=1e-4) and loadings.count() == 70


def test_recipe_lists_and_components(spark):
    rng = np.random.default_rng(13)
    m = rng.poisson(3.0, (40, 30)) * rng.integers(0, 2, (40, 30))
    e = expr(spark, m, "spliced").unionByName(expr(spark, m // 2, "unspliced"))
    cells = spark.range(40).withColumnRenamed("id", "cell_id")
    p = recipes.monocle(e, cells, 10, append=["g29"], exclude=["g0"], n_pcs=2, new="unspliced")
    chosen = {r["gene_id"] for r in p.genes.where("selected").collect()}
    assert "g29" in chosen and "g0" not in chosen
    assert p.pca.count() == p.cells.count() and len(p.pca.first()["x"]) == 2
    part = {r["cell_id"]: r["ntr"] for r in p.cells.collect()}
    new, total = (m // 2).sum(1), (m + m // 2).sum(1)
    kept = [g for g in range(30) if (m[:, g] > 0).sum() >= 5]
    assert all(part[i] == pytest.approx((m[i, kept] // 2).sum() / (m[i, kept] + m[i, kept] // 2).sum()) for i in part)
    assert new.sum() < total.sum()
    forced = recipes.monocle(e, cells, 10, force=["g1", "g2"])
    assert {r["gene_id"] for r in forced.genes.where("selected").collect()} == {"g1", "g2"}


def test_approximate_neighbours_recall(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(30, 16))[rng.integers(0, 30, 1200)] + 0.6 * rng.normal(size=(1200, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, x array<double>")
    exact = {(r["i"], r["j"]) for r in graph.nearest(df, df, 10).select("i", "j").collect()}
    got = {(r["i"], r["j"]): r["d"] for r in graph.nearest_approximate(df, df, 10, block=300).collect()}
    assert len(exact & set(got)) >= 0.9 * len(exact)
    assert all(d == pytest.approx(float(np.linalg.norm(x[i] - x[j]))) for (i, j), d in list(got.items())[:200])


def test_simulation_stops_at_too_many_events(spark):
    with pytest.raises(Exception, match="more than 20 events"):
        simulate.gillespie(spark, 1, [0, 0], simulate.EXPRESSION, simulate.expression_rates(50.0, 1.0, 0.5), 10.0, 5, max_events=20).count()


def test_hessian_and_turning_match_differences():
    rng = np.random.default_rng(15)
    f = V.Field(rng.normal(size=(6, 3)), 0.4, rng.normal(size=(6, 3)))
    x, h = rng.normal(size=(4, 3)), 1e-5
    got = f.hessian(x)
    for k in range(3):
        step = np.eye(3)[k] * h
        assert got[..., k] == pytest.approx((f.jacobian(x + step) - f.jacobian(x - step)) / (2 * h), abs=1e-6)
    assert np.einsum("nijj->ni", got) == pytest.approx(f.laplacian(x))
    w, a = f(x), V.acceleration(f, x, None)
    want = np.linalg.norm(np.cross(w, a), axis=1) / np.linalg.norm(w, axis=1) ** 3
    assert V.turning(f, x, None) == pytest.approx(want)


def test_separatrices_leave_from_saddles(spark):
    rng = np.random.default_rng(16)
    x = rng.uniform(-1.8, 1.8, (400, 2))
    v = np.stack([x[:, 0] - x[:, 0] ** 3, -x[:, 1]], 1)
    cells = spark.createDataFrame([(i, x[i].tolist(), v[i].tolist()) for i in range(400)], "cell_id long, x array<double>, v array<double>")
    f = V.fit_field(cells, 80, beta=0.5, ridge=0.01)
    found = [r for r in V.fixed_points(cells, f, digits=1).collect() if r["n"] > 20]
    at = {(round(r["x"][0]), round(r["x"][1])): r["stable"] for r in found}
    assert at == {(-1, 0): True, (1, 0): True, (0, 0): False}
    saddle = spark.createDataFrame([(1, [0.0, 0.0])], "cell_id long, x array<double>")
    path = V.separatrices(saddle, f, 3.0, 60, 4).collect()
    ends = [r["x"] for r in path if r["step"] == max(q["step"] for q in path)]
    assert len(ends) == 2 and all(abs(e[0]) < 0.3 and abs(e[1]) > 0.1 for e in ends)  # along x = 0, one on each side
