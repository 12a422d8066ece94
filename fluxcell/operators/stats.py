"""Statistics over genes and cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxcell.functions.lineage import cut, numbered
from fluxcell.functions.scalars import cosine, norm, pearson, ratio


def normal_tail(z: Column) -> Column:
    """P(|Z| >= |z|), by a rational approximation with absolute error below 1.5e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def _moran_numerators(x: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``(gene_id, *keys, cross, linear)``: sums of w x_i x_j, and of w (x_i + x_j), over ``edges(i, j, w, *keys)`` from stored values."""
    a = x.select(F.col("cell_id").alias("i"), "gene_id", F.col("value").alias("xi"))
    b = x.select(F.col("cell_id").alias("j"), "gene_id", F.col("value").alias("xj"))
    e = edges.groupBy("i", "j", *keys).agg(F.sum("w").alias("w"))
    ends = e.select("i", "w", *keys).unionByName(e.select(F.col("j").alias("i"), "w", *keys)).groupBy("i", *keys).agg(F.sum("w").alias("w"))
    cross = e.join(a, "i").join(b, ["j", "gene_id"]).groupBy("gene_id", *keys).agg(F.sum(F.col("w") * F.col("xi") * F.col("xj")).alias("cross"))
    linear = ends.join(a, "i").groupBy("gene_id", *keys).agg(F.sum(F.col("w") * F.col("xi")).alias("linear"))
    return linear.join(cross, ["gene_id", *keys], "left").fillna(0.0, ["cross"])


def _moran_moments(x: DataFrame, n_cells: DataFrame) -> DataFrame:
    """``(gene_id, n_cells, mu, var, kurtosis)`` with all cells without a stored value at 0."""
    power = [F.sum(F.pow("value", F.lit(k))).alias(f"p{k}") for k in (1, 2, 3, 4)]
    m = x.groupBy("gene_id").agg(*power).crossJoin(F.broadcast(n_cells)).withColumn("mu", F.col("p1") / F.col("n_cells"))
    n, mu = F.col("n_cells"), F.col("mu")
    m = m.withColumn("var", F.col("p2") / n - mu * mu)
    fourth = F.col("p4") / n - 4 * mu * F.col("p3") / n + 6 * mu * mu * F.col("p2") / n - 3 * mu * mu * mu * mu
    return m.select("gene_id", "n_cells", "mu", "var", ratio(fourth, F.col("var") * F.col("var")).alias("kurtosis"))


def _moran(numerators: DataFrame, moments: DataFrame, weights: DataFrame) -> DataFrame:
    """``numerators`` with all of ``moments``, s0 and ``moran_i``: the centred products, multiplied out."""
    s0 = weights.agg(F.sum("w").alias("s0"))
    one = numerators.join(moments, "gene_id").crossJoin(F.broadcast(s0))
    num = F.col("cross") - F.col("mu") * F.col("linear") + F.col("mu") * F.col("mu") * F.col("s0")
    return one.withColumn("moran_i", ratio(num, F.col("s0") * F.col("var")))


def morans_i(x: DataFrame, weights: DataFrame, n_cells: DataFrame) -> DataFrame:
    """``(gene_id, moran_i, z, p, z_rand, p_rand)`` of stored ``x(cell_id, gene_id, value)`` on edges (i, j, w).

    z under the assumption of normal values, z_rand under randomisation (every value equally likely at any cell). Cells
    without a stored value are 0 and take part by their number; only pairs of stored values are joined.
    """
    out = _moran(_moran_numerators(x, weights, []), _moran_moments(x, n_cells), weights)
    both = weights.select("i", "j", "w").unionByName(weights.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    sym = both.groupBy("i", "j").agg(F.sum("w").alias("w"))
    s1 = sym.agg((F.sum(F.col("w") * F.col("w")) / 2).alias("s1"))
    ends = both.groupBy("i").agg(F.sum("w").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("s2"))
    out = out.crossJoin(F.broadcast(s1)).crossJoin(F.broadcast(ends))
    n, s0, s1, s2 = F.col("n_cells").cast("double"), F.col("s0"), F.col("s1"), F.col("s2")
    expect = -ratio(F.lit(1.0), n - 1)
    normal = ratio(n * n * s1 - n * s2 + 3 * s0 * s0, (n * n - 1) * s0 * s0) - expect * expect
    free = n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - F.col("kurtosis") * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)
    random = ratio(free, (n - 1) * (n - 2) * (n - 3) * s0 * s0) - expect * expect
    for name, var in (("z", normal), ("z_rand", random)):
        out = out.withColumn(name, ratio(F.col("moran_i") - expect, F.sqrt(var)))
    p = lambda c: normal_tail(F.col(c))
    return out.select("gene_id", "moran_i", "z", p("z").alias("p"), "z_rand", p("z_rand").alias("p_rand"))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a pseudorandom permutation of 0 ... n - 1 takes each index: four Feistel rounds on a grid of about sqrt(n) x sqrt(n), walked
    until inside. Each row is computed by itself; different keys give different permutations."""
    side = int(np.ceil(np.sqrt(n)))
    high = -(-n // side)

    def mixed(x: np.ndarray, seed: int) -> np.ndarray:
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)

    out, open_ = np.array(index, np.int64), np.ones(len(index), bool)
    while open_.any():
        a, b = out[open_] // side, out[open_] % side
        for r in range(4):
            if r % 2:
                a = (a + mixed(b, key * 8 + r)) % high
            else:
                b = (b + mixed(a, key * 8 + r)) % side
        out[open_] = a * side + b
        open_ = out >= n
    return out


def morans_i_permutation(x: DataFrame, weights: DataFrame, cells: DataFrame, permutations: int = 999, seed: int = 0) -> DataFrame:
    """``(gene_id, moran_i, mean_sim, z_sim, p_sim)``: Moran's I against ``permutations`` random placements of the values.

    Cells of ``cells(cell_id)`` are numbered; a placement moves the ends of every edge by a keyed bijection of the numbers, computed
    row by row, so all placements are scored by one join of the moved edges with the stored values. p_sim = (m + 1) / (permutations + 1), m being
    how many placements reach the statistic, or stay below it if those are fewer.
    """
    spark = x.sparkSession
    number = cut(numbered(cells.select("cell_id"), "cell_id", "at"))
    n = number.count()
    x = cut(x.join(number, "cell_id").select(F.col("at").alias("cell_id"), "gene_id", "value"))
    at = lambda side: number.select(F.col("cell_id").alias(side), F.col("at").alias(f"{side}2"))
    e = weights.join(at("i"), "i").join(at("j"), "j").select(F.col("i2").alias("i"), F.col("j2").alias("j"), F.col("w").cast("double").alias("w"))
    e = cut(e)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, j = (b.column(c).to_numpy() for c in "ij")
            for p in range(1, permutations + 1):
                ends = [pa.array(permuted(c, n, seed * 1_000_003 + p)) for c in (i, j)]
                yield pa.RecordBatch.from_arrays([*ends, b.column("w"), pa.array(np.full(len(i), p, np.int32))], names=["i", "j", "w", "p"])

    moved = e.mapInArrow(place, "i long, j long, w double, p int")
    count = spark.createDataFrame([(n,)], "n_cells long")
    m = cut(_moran_moments(x, count))
    own = _moran(_moran_numerators(x, e, []), m, e).select("gene_id", "moran_i")
    sim = _moran(_moran_numerators(x, moved, ["p"]), m, e).select("gene_id", F.col("moran_i").alias("s"))
    got = sim.join(own, "gene_id").groupBy("gene_id", "moran_i").agg(
        F.count_if(F.col("s") >= F.col("moran_i")).alias("larger"), F.avg("s").alias("mean_sim"), F.stddev_pop("s").alias("sd"), F.count("s").alias("found")
    )
    # a placement in which no edge ends at a stored value has no row: its products are those of the mean alone
    s0 = e.agg(F.sum("w").alias("s0"))
    m = m.crossJoin(F.broadcast(s0)).select("gene_id", ratio(F.col("mu") * F.col("mu"), F.col("var")).alias("bare"))
    got = got.join(m, "gene_id").withColumn("lost", F.lit(permutations) - F.col("found"))
    mean = (F.col("mean_sim") * F.col("found") + F.col("bare") * F.col("lost")) / permutations
    square = (F.col("found") * (F.col("sd") * F.col("sd") + F.col("mean_sim") * F.col("mean_sim")) + F.col("lost") * F.col("bare") * F.col("bare")) / permutations
    larger = F.col("larger") + F.when(F.col("bare") >= F.col("moran_i"), F.col("lost")).otherwise(0)
    got = got.withColumns({"mean_sim": mean, "sd": F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), "larger": larger})
    tail = F.least(F.col("larger"), F.lit(permutations) - F.col("larger"))
    return got.select("gene_id", "moran_i", "mean_sim", ratio(F.col("moran_i") - F.col("mean_sim"), F.col("sd")).alias("z_sim"), ((tail + 1) / (permutations + 1)).alias("p_sim"))


def two_group_de(x: DataFrame, totals: DataFrame | None = None, least_fraction: float = 0.1) -> DataFrame:
    """Test against control for each gene of ``x(gene_id, value, test boolean)``.

    With ``totals(n_test, n_control)``, x holds stored entries only and every other cell of a gene
    counts as 0; without, x is dense. Entries are counted by gene, value and side first, so that a
    gene's order statistics run over its distinct values, and its zeros are one row.

    Genes detected in at least ``least_fraction`` of the test cells. log2 fold change of means,
    Mann-Whitney U with average ranks and a tie-corrected normal p-value, rank-biserial
    correlation 1 - 2 U / (n1 n2).
    """
    by = x.groupBy("gene_id", "value").agg(F.count_if("test").alias("k1"), F.count_if(~F.col("test")).alias("k2"))
    if totals is not None:
        held = by.groupBy("gene_id").agg(F.sum("k1").alias("k1"), F.sum("k2").alias("k2")).crossJoin(F.broadcast(totals))
        absent = held.select("gene_id", F.lit(0.0).alias("value"), (F.col("n_test") - F.col("k1")).alias("k1"), (F.col("n_control") - F.col("k2")).alias("k2"))
        by = by.unionByName(absent).groupBy("gene_id", "value").agg(F.sum("k1").alias("k1"), F.sum("k2").alias("k2"))
    upto = Window.partitionBy("gene_id").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    k, k1, k2 = F.col("k"), F.col("k1"), F.col("k2")
    by = by.withColumn("k", k1 + k2).withColumn("before", F.coalesce(F.sum("k").over(upto), F.lit(0)))
    g = by.groupBy("gene_id").agg(
        F.sum("k1").alias("n1"),
        F.sum("k2").alias("n2"),
        F.sum(k1 * (F.col("before") + (k + 1) / 2.0)).alias("r1"),
        ratio(F.sum(k1 * F.col("value")), F.sum("k1")).alias("m1"),
        ratio(F.sum(k2 * F.col("value")), F.sum("k2")).alias("m2"),
        ratio(F.sum(F.when(F.col("value") > 0, k1).otherwise(0)), F.sum("k1")).alias("fraction"),
        F.sum(k.cast("double") * (k.cast("double") * k - 1)).alias("tie"),
    )
    g = g.where((F.col("fraction") >= least_fraction) & (F.col("n1") > 0) & (F.col("n2") > 0))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - ratio(F.col("tie"), n * (n - 1))))
    z = ratio(F.greatest(F.abs(F.col("u") - n1 * n2 / 2) - 0.5, F.lit(0.0)), sd)
    lfc = F.when((F.col("m1") > 0) & (F.col("m2") > 0), F.log2(ratio(F.col("m1"), F.col("m2"))))
    g = g.withColumn("u", u)
    return g.select(
        "gene_id", "n1", "n2", "fraction", lfc.alias("log2fc"), "u", (1 - 2 * ratio(F.col("u"), n1 * n2)).alias("rbc"), normal_tail(z).alias("p")
    )


def glm_de(x: DataFrame, rounds: int = 25) -> DataFrame:
    """``(gene_id, coefficient, lrt, p)``: NB2 log-link regression of ``x(gene_id, value, t)`` on t against the
    intercept alone. Gradients are summed over the t-distinct rows of a gene, given as counts by value."""

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y, t, k = (pdf[c].to_numpy(float) for c in ("value", "t", "k"))
        mean = (y * k).sum() / k.sum()
        var = (k * (y - mean) ** 2).sum() / k.sum()
        a = max((var - mean) / max(mean * mean, 1e-12), 1e-6)
        lg = np.array([math.lgamma(v + 1 / a) - math.lgamma(1 / a) - math.lgamma(v + 1) for v in y])

        def ll(eta):
            mu = np.exp(np.clip(eta, -30, 30))
            return (k * (lg + y * np.log(a * mu / (1 + a * mu)) - np.log1p(a * mu) / a)).sum()

        def run(design):
            b = np.zeros(design.shape[1])
            b[0] = np.log(max(mean, 1e-9))
            for _ in range(rounds):
                mu = np.exp(np.clip(design @ b, -30, 30))
                w = k * mu / (1 + a * mu)
                z = design @ b + (y - mu) / mu
                b = np.linalg.lstsq(design.T @ (w[:, None] * design), design.T @ (w * z), rcond=None)[0]
            return b, ll(design @ b)

        one = np.ones((len(y), 1))
        _, l0 = run(one)
        b, l1 = run(np.hstack([one, t[:, None]]))
        lrt = max(2 * (l1 - l0), 0.0)
        return pd.DataFrame({"gene_id": [key[0]], "coefficient": [b[1]], "lrt": [lrt], "p": [math.erfc(math.sqrt(lrt / 2))]})

    kind = dict(x.dtypes)["gene_id"]
    counted = x.groupBy("gene_id", "value", "t").agg(F.count("*").alias("k"))
    return counted.groupBy("gene_id").applyInPandas(fit, f"gene_id {kind}, coefficient double, lrt double, p double")


def regress_out(x: DataFrame, covariates: DataFrame, names: tuple[str, ...] = ("z",)) -> DataFrame:
    """Residuals of dense ``x(cell_id, gene_id, value)`` on the named columns of ``covariates(cell_id, ...)`` and an intercept.

    A gene's normal equations are sums over its cells, one small row a gene; they are solved in
    batches of genes (least squares of least norm, so that constant or dependent covariates do no harm).
    """
    z = [F.lit(1.0), *[F.col(n).cast("double") for n in names]]
    m = len(z)
    j = x.join(covariates.select("cell_id", *names), "cell_id")
    pairs = [(a, b) for a in range(m) for b in range(a, m)]
    sums = j.groupBy("gene_id").agg(
        F.array(*[F.sum(z[a] * z[b]) for a, b in pairs]).alias("zz"), F.array(*[F.sum(c * F.col("value")) for c in z]).alias("zy")
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            beta = []
            for zz, zy in zip(t["zz"], t["zy"], strict=True):
                a = np.zeros((m, m))
                for (p, q), v in zip(pairs, zz, strict=True):
                    a[p, q] = a[q, p] = v
                beta.append(np.linalg.lstsq(a, np.array(zy, float), rcond=1e-12)[0].tolist())
            yield pd.DataFrame({"gene_id": t["gene_id"], "beta": beta})

    kind = dict(x.dtypes)["gene_id"]
    beta = sums.mapInPandas(solve, f"gene_id {kind}, beta array<double>")
    fit = sum((F.get("beta", k) * c for k, c in enumerate(z)), F.lit(0.0))
    return j.join(beta, "gene_id").select("cell_id", "gene_id", (F.col("value") - fit).alias("value"))


def cell_cycle(x: DataFrame, phases: DataFrame) -> DataFrame:
    """``(cell_id, phase, progress)`` from ``x(cell_id, gene_id, value)`` and ordered gene sets ``phases(gene_id, phase int)``.

    A phase's score is its summed expression, z-scored over cells and then over the cell's phases;
    the phase correlates best with its one-hot vector, which for z-scores is the largest; progress
    is the score of the phase before less that of the phase after, around the circle.
    """
    s = x.join(phases, "gene_id").groupBy("cell_id", "phase").agg(F.sum("value").alias("s"))
    # a row for each phase: a window by phase would hold all cells in one task
    of_phase = s.groupBy("phase").agg(F.avg("s").alias("mean"), F.stddev_samp("s").alias("sd"))
    over_phases = Window.partitionBy("cell_id")
    s = s.join(F.broadcast(of_phase), "phase").withColumn("z", ratio(F.col("s") - F.col("mean"), F.col("sd")))
    s = s.withColumn("z", ratio(F.col("z") - F.avg("z").over(over_phases), F.stddev_samp("z").over(over_phases)))
    k = s.select("phase").distinct().agg(F.count("*").alias("k"))
    per = s.groupBy("cell_id").agg(
        F.max_by("phase", F.struct("z", -F.col("phase"))).alias("phase"),
        F.map_from_entries(F.collect_list(F.struct("phase", "z"))).alias("by"),
    )
    at = lambda d: F.try_element_at("by", F.pmod(F.col("phase") + d, F.col("k")).cast("int"))
    return per.crossJoin(F.broadcast(k)).select("cell_id", "phase", (at(F.lit(-1)) - at(F.lit(1))).alias("progress"))


def order_in_phase(cc: DataFrame) -> DataFrame:
    """Place of each cell, 0 to 1, in order of phase and falling progress.

    Rows are dealt to ranges of that order and written; a row's place is the count of the ranges
    before its own plus its place in it, so no task holds all cells.
    """
    order = [F.col("phase"), F.desc("progress"), F.col("cell_id")]
    at = cut(cc.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    n = at.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = n.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    total = n.agg(F.sum("_n").alias("_all"))
    row = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = at.join(F.broadcast(carry), "_part").crossJoin(F.broadcast(total))
    return out.select(*cc.columns, ratio(F.col("_before") + row - 1, F.col("_all") - 1).alias("place"))


def neighbour_confidence(vectors: DataFrame, edges: DataFrame, method: str = "cosine") -> DataFrame:
    """``(i, confidence)``: mean over neighbours of the similarity of velocities ``vectors(cell_id, v)``:
    cosine, correlation, or consensus (cosine times smaller over larger length)."""
    a = vectors.select(F.col("cell_id").alias("i"), F.col("v").alias("vi"))
    b = vectors.select(F.col("cell_id").alias("j"), F.col("v").alias("vj"))
    x, y = F.col("vi"), F.col("vj")
    sim = {
        "cosine": cosine(x, y),
        "correlation": pearson(x, y),
        "consensus": cosine(x, y) * ratio(F.least(norm(x), norm(y)), F.greatest(norm(x), norm(y))),
    }[method]
    return edges.join(a, "i").join(b, "j").groupBy("i").agg(F.avg(sim).alias("confidence"))


def neighbour_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(i, jaccard)`` of each node's neighbour sets in two edge tables."""
    both = a.select("i", "j", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select("i", "j", F.lit(0).alias("x"), F.lit(1).alias("y")))
    pair = both.groupBy("i", "j").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return pair.groupBy("i").agg(ratio(F.sum(F.col("x") * F.col("y")), F.count("*")).alias("jaccard"))


def gene_confidence(x: DataFrame, v: DataFrame, cells: DataFrame, lineage: list[tuple[str, str]], q: float = 0.01) -> DataFrame:
    """``(gene_id, progenitor, mature, confidence)``: share of the pair's cells whose velocity agrees with the
    change of the median from progenitor to mature group; the threshold is a quantile of |v| over all cells."""
    tau = v.groupBy("gene_id").agg(F.percentile(F.abs("value"), F.lit(q)).alias("tau"))
    med = x.join(cells, "cell_id").groupBy("gene_id", "grp").agg(F.percentile("value", F.lit(0.5)).alias("m"))
    pairs = x.sparkSession.createDataFrame(lineage, "progenitor string, mature string")
    pairs = pairs.join(med.select("gene_id", F.col("grp").alias("progenitor"), F.col("m").alias("m0")), "progenitor").join(
        med.select(F.col("gene_id"), F.col("grp").alias("mature"), F.col("m").alias("m1")), ["mature", "gene_id"]
    )
    vel = v.join(cells, "cell_id").join(tau, "gene_id")
    j = pairs.join(vel, "gene_id").where((F.col("grp") == F.col("progenitor")) | (F.col("grp") == F.col("mature")))
    ok = F.when(F.col("m0") > F.col("m1"), F.col("value") <= -F.col("tau")).otherwise(F.col("value") >= F.col("tau"))
    return j.groupBy("gene_id", "progenitor", "mature").agg(ratio(F.count_if(ok), F.count("*")).alias("confidence"))


def score_cells(x: DataFrame, genes: DataFrame, edges: DataFrame, beta: float = 0.1, rounds: int = 5) -> DataFrame:
    """``(cell_id, score)``: mean over a gene set (absent = 0), then rounds of beta own + (1 - beta) neighbours' mean."""
    n = genes.agg(F.count("*").alias("n"))
    s = x.join(F.broadcast(genes.select("gene_id")), "gene_id", "left_semi").groupBy("cell_id").agg(F.sum("value").alias("s"))
    s = s.crossJoin(F.broadcast(n)).select("cell_id", ratio(F.col("s"), F.col("n")).alias("score"))
    deg = edges.groupBy("i").agg(F.count("*").alias("deg"))
    w = edges.join(deg, "i").select("i", "j", ((1 - beta) / F.col("deg")).alias("w"))
    w = cut(w.unionByName(deg.select("i", F.col("i").alias("j"), F.lit(beta).alias("w"))))
    for _ in range(rounds):
        s = w.join(s.withColumnRenamed("cell_id", "j"), "j").groupBy(F.col("i").alias("cell_id")).agg(F.sum(F.col("w") * F.col("score")).alias("score"))
    return s


def clone_growth(cells: DataFrame, source: str, target: str) -> DataFrame:
    """``(clone, growth)``: (cells at the target time + 1) / (cells at the source time + 1) of ``cells(clone, time)``."""
    g = cells.groupBy("clone").agg(F.count_if(F.col("time") == target).alias("t"), F.count_if(F.col("time") == source).alias("s"))
    return g.select("clone", ratio(F.col("t") + 1, F.col("s") + 1).alias("growth"))


def spike_in_counts(cells: DataFrame, rounds: int = 20) -> DataFrame:
    """``(cell_id, k, b)``: robust line of log1p molecules on log1p expression of each cell's spike-ins
    ``cells(cell_id, expression, molecules)``, Huber weights; a cell's rows are its spike-ins."""

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = np.log1p(pdf["expression"].to_numpy(float)), np.log1p(pdf["molecules"].to_numpy(float))
        a, w = np.stack([x, np.ones_like(x)], 1), np.ones_like(x)
        for _ in range(rounds):
            b = np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
            r = np.abs(y - a @ b)
            scale = max(np.median(r) / 0.6745, 1e-12)
            w = np.minimum(1.0, 1.345 * scale / np.maximum(r, 1e-12))
        return pd.DataFrame({"cell_id": [key[0]], "k": [b[0]], "b": [b[1]]})

    return cells.groupBy("cell_id").applyInPandas(fit, "cell_id long, k double, b double")
