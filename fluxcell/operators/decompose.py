"""PCA by a covariance aggregate, projections, k-means, dispersion regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxcell.functions.lineage import cut


def covariance(cells: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance (n - 1) and count of ``cells(x)``; every task sums its rows' outer products once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1))
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1).astype(float)
                x = np.hstack([x, np.ones((len(x), 1))])
                total += x.T @ x
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["k", "v"])

    got = cells.select("x").where("x is not null").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    m = np.zeros((d + 1) ** 2)
    for r in got:
        m[r["k"]] = r["v"]
    m = m.reshape(d + 1, d + 1)
    n = int(round(m[d, d]))
    mean = m[:d, d] / max(n, 1)
    return mean, (m[:d, :d] - n * np.outer(mean, mean)) / max(n - 1, 1), n


def pca(cells: DataFrame, d: int, k: int) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """``(cell_id, x)`` projected on k components, with components (d x k), explained ratios and the mean.
    A component's largest entry is positive."""
    mean, cov, _ = covariance(cells, d)
    val, vec = np.linalg.eigh(cov)
    order = np.argsort(-val)[:k]
    vec = vec[:, order] * np.sign(vec[np.abs(vec[:, order]).argmax(0), order])
    share = val[order] / max(val.sum(), 1e-300)
    schema = pa.schema([("cell_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1).astype(float)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(((x - mean) @ vec).tolist(), schema.field("x").type)], schema=schema)

    out = cells.where("x is not null").select("cell_id", "x").mapInArrow(run, "cell_id long, x array<double>")
    return out, vec, share, mean


PART = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])
BLOCK_ROWS = 64


def _summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of matrices of one shape that tasks gave in blocks of rows (``PART``)."""

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in t.column("data").to_pylist())
        return pa.table({"block": t.column("block")[:1], "part": pa.array([0], pa.int32()), "data": [total.tobytes()]}, schema=PART)

    kind = "block int, part int, data binary"
    got = parts.groupBy("block", "part").applyInArrow(add, kind).groupBy("block").applyInArrow(add, kind).collect()
    out = np.zeros(shape)
    for r in got:
        out[r["block"] * BLOCK_ROWS : (r["block"] + 1) * BLOCK_ROWS] = np.frombuffer(r["data"]).reshape(-1, shape[1])
    return out


def gene_pca(
    x: DataFrame, cells: DataFrame, genes: DataFrame, k: int, extra: int = 10, passes: int = 6, seed: int = 0
) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """PCA of cells on a panel of genes: ``(cell_id, x)``, ``(gene_id, loadings)`` and explained shares.

    ``x(cell_id, gene_id, value)`` holds stored entries; absent ones are 0 and take part through the
    means alone, so nothing is made dense. The leading subspace comes from ``passes`` rounds of
    orthogonal iteration from a random start: a round multiplies the covariance by genes x
    (k + extra) numbers, in one pass over the cells' sparse rows. Driver and tasks hold such matrices,
    never genes x genes; the panel should have some thousands of genes. A component's largest loading is positive.
    """
    spark = x.sparkSession
    names = [r[0] for r in genes.select("gene_id").distinct().orderBy("gene_id").collect()]  # the panel
    g, kind = len(names), dict(genes.dtypes)["gene_id"]
    index = spark.createDataFrame(list(zip(names, range(g), strict=True)), f"gene_id {kind}, ix int")
    rows = cut(
        x.where("value <> 0").join(F.broadcast(index), "gene_id").groupBy("cell_id").agg(F.collect_list(F.struct("ix", "value")).alias("row"))
        .select("cell_id", F.col("row.ix").alias("ix"), F.col("row.value").cast("array<double>").alias("value"))
    )  # a cell's entries within the panel
    n = cells.count()
    sums = rows.select(F.explode(F.arrays_zip("ix", "value")).alias("e")).groupBy("e.ix").agg(
        F.sum("e.value").alias("s"), F.sum(F.col("e.value") * F.col("e.value")).alias("q")
    )
    mean, square = np.zeros(g), 0.0
    for r in sums.collect():  # one row for each gene of the panel
        mean[r["ix"]], square = r["s"] / n, square + r["q"]
    variance = (square - n * (mean @ mean)) / max(n - 1, 1)
    wide = min(g, k + extra)

    def times(q: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((g, wide))
            for b in batches:
                ix, value = b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy()
                if not len(ix):
                    continue
                length = np.diff(b.column(0).offsets.to_numpy())
                part = value[:, None] * q[ix]
                own = np.add.reduceat(part, np.cumsum(length) - length, 0)  # no cell here is empty
                order = np.argsort(ix, kind="stable")
                back = (value[:, None] * np.repeat(own, length, 0))[order]
                gene, first = np.unique(ix[order], return_index=True)
                total[gene] += np.add.reduceat(back, first, 0)
            blocks = range(0, g, BLOCK_ROWS)
            part_id = [TaskContext.get().partitionId() % 64] * len(blocks)
            data = [np.ascontiguousarray(total[i : i + BLOCK_ROWS]).tobytes() for i in blocks]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(blocks)), pa.int32()), pa.array(part_id, pa.int32()), pa.array(data, pa.binary())], schema=PART
            )

        parts = rows.select("ix", "value").mapInArrow(run, "block int, part int, data binary")
        return (_summed(parts, (g, wide)) - n * np.outer(mean, mean @ q)) / max(n - 1, 1)

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(g, wide)))[0]
    for _ in range(passes):
        q = np.linalg.qr(times(q))[0]
    value, turn = np.linalg.eigh(q.T @ times(q))
    order = np.argsort(-value)[:k]
    vec = q @ turn[:, order]
    vec *= np.where(vec[np.abs(vec).argmax(0), range(vec.shape[1])] < 0, -1.0, 1.0)
    middle = mean @ vec
    schema = pa.schema([("cell_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = []
            for ix, v in zip(b.column(1), b.column(2), strict=True):
                score.append((np.array(v.values) @ vec[np.array(ix.values)] - middle).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, schema.field("x").type)], schema=schema)

    some = rows.mapInArrow(project, "cell_id long, x array<double>")
    rest = cells.select("cell_id").join(rows.select("cell_id"), "cell_id", "left_anti")
    scores = some.join(cells.select("cell_id"), "cell_id", "left_semi").unionByName(
        rest.select("cell_id", F.array(*[F.lit(float(-m)) for m in middle]).alias("x"))
    )
    loadings = spark.createDataFrame([(a, v.tolist()) for a, v in zip(names, vec, strict=True)], f"gene_id {kind}, loadings array<double>")
    return scores, loadings, value[order] / max(variance, 1e-300)


def kmeans(cells: DataFrame, d: int, k: int, rounds: int = 10, seed: int = 0) -> DataFrame:
    """``(cell_id, cluster)``: Lloyd's rounds from a hash sample; a round is one pass that sums by nearest centre."""
    first = cells.orderBy(F.xxhash64(F.lit(seed), "cell_id"), "cell_id").limit(k).collect()
    centre = np.array([r["x"] for r in first], float)

    def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)

    def sums(c: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, d + 1))
            for b in batches:
                if b.num_rows:
                    x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1).astype(float)
                    np.add.at(total, assign(x, c), np.hstack([x, np.ones((len(x), 1))]))
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["k", "v"])

        return run

    for _ in range(rounds):
        got = cells.select("x").mapInArrow(sums(centre), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        m = np.zeros(k * (d + 1))
        for r in got:
            m[r["k"]] = r["v"]
        m = m.reshape(k, d + 1)
        full = m[:, d] > 0
        centre[full] = m[full, :d] / m[full, d:]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1).astype(float)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(assign(x, centre), pa.int32())], names=["cell_id", "cluster"])

    return cells.select("cell_id", "x").mapInArrow(label, "cell_id long, cluster int")


def dispersion_score(stats: DataFrame, n_knots: int = 200) -> DataFrame:
    """``(gene_id, score)``: log CV less its kernel regression on log mean, ``stats(gene_id, log_m, log_cv)``.

    The curve is fitted to medians in equal-width bins of log mean (at most ``n_knots`` rows), by kernel ridge
    regression with a Gaussian kernel of width proportional to the number of genes' bins.
    """
    edge = stats.agg(F.min("log_m").alias("lo"), F.max("log_m").alias("hi"))
    at = F.floor((F.col("log_m") - F.col("lo")) / F.greatest((F.col("hi") - F.col("lo")) / n_knots, F.lit(1e-12)))
    knots = stats.crossJoin(F.broadcast(edge)).groupBy(F.least(at, F.lit(n_knots - 1)).alias("b")).agg(
        F.avg("log_m").alias("m"), F.percentile("log_cv", F.lit(0.5)).alias("c"), F.count("*").alias("w")
    )
    got = knots.orderBy("b").collect()
    x, y, w = (np.array([r[c] for r in got], float) for c in ("m", "c", "w"))
    width = max((x.max() - x.min()) / 10, 1e-6) if len(x) else 1.0
    gram = np.exp(-((x[:, None] - x[None]) ** 2) / (2 * width**2))
    coef = np.linalg.solve(gram + np.diag(0.1 * w.max() / np.maximum(w, 1)), y - y.mean()) if len(x) else np.zeros(0)
    curve = F.lit(float(y.mean()) if len(y) else 0.0)
    pairs = F.array(*[F.struct(F.lit(float(a)).alias("m"), F.lit(float(c)).alias("c")) for a, c in zip(x, coef, strict=True)])
    value = F.aggregate(pairs, curve, lambda s, p: s + p["c"] * F.exp(-F.pow(F.col("log_m") - p["m"], 2) / (2 * width**2)))
    return stats.select("gene_id", (F.col("log_cv") - value).alias("score"))
