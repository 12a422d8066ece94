"""Kernel vector fields f(x) = sum_m exp(-beta |x - c_m|^2) C_m: fitting, calculus, fixed points, perturbation.

A field is a small model (control points and coefficients, ``n_control`` x d) that travels to the
tasks; cells stay in Spark, one Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxcell.functions.lineage import column_quantile, cut
from fluxcell.functions.scalars import ratio
from fluxcell.operators.neighbours import nearest


@dataclass
class Field:
    control: np.ndarray
    beta: float
    coef: np.ndarray

    def kernel(self, x: np.ndarray) -> np.ndarray:
        d = (x * x).sum(1)[:, None] - 2 * x @ self.control.T + (self.control * self.control).sum(1)[None]
        return np.exp(-self.beta * np.maximum(d, 0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.coef

    def jacobian(self, x: np.ndarray) -> np.ndarray:
        """J[n, i, j] = d f_i / d x_j at each row."""
        k = self.kernel(x)
        diff = x[:, None, :] - self.control[None]
        return -2 * self.beta * np.einsum("nm,mi,nmj->nij", k, self.coef, diff)

    def hessian(self, x: np.ndarray) -> np.ndarray:
        """H[n, i, j, l] = d2 f_i / d x_j d x_l at each row."""
        k, diff = self.kernel(x), x[:, None, :] - self.control[None]
        outer = 4 * self.beta**2 * np.einsum("nm,mi,nmj,nml->nijl", k, self.coef, diff, diff, optimize=True)
        return outer - 2 * self.beta * np.einsum("ni,jl->nijl", k @ self.coef, np.eye(x.shape[1]))

    def laplacian(self, x: np.ndarray) -> np.ndarray:
        k, diff = self.kernel(x), x[:, None, :] - self.control[None]
        w = k * (4 * self.beta**2 * (diff * diff).sum(2) - 2 * self.beta * x.shape[1])
        return w @ self.coef


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)


def fit_field(
    cells: DataFrame,
    n_control: int = 100,
    beta: float = 0.1,
    ridge: float = 3.0,
    gamma: float = 0.9,
    seed: int = 0,
    tolerance: float = 1e-5,
    rounds: int = 500,
) -> Field:
    """Robust kernel regression of v on x over ``cells(cell_id, x, v)`` by expectation-maximisation.

    Control points are a hash sample of at most ``n_control`` cells weighted towards large |v|.
    Each round every batch computes its cells' posteriors of being inliers and adds its part of
    U'PU, U'PV and the residual sums; one row a task is added up, so cells never leave Spark.
    The inlier share stays within 0.05 and 0.95. Rounds end when the energy (expected residuals and the ridge) changes by less than the share
    ``tolerance``, or the residuals' variance vanishes; it is an error if that takes more than ``rounds``.
    """
    cells = cut(cells.select("cell_id", "x", "v").where("x is not null and v is not null"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, z: s + z * z))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "cell_id"), 11) + 0.5) / float(1 << 53)
    picked = cells.orderBy((-F.log(u) / F.greatest(size, F.lit(1e-12))).asc(), "cell_id").limit(n_control).collect()
    control = np.array([r["x"] for r in picked], float)
    if not len(control):
        return Field(np.zeros((0, 1)), beta, np.zeros((0, 1)))
    d, m = control.shape[1], len(control)
    field = Field(control, beta, np.zeros((m, d)))
    gram = field.kernel(control)
    first = cells.select(F.avg(F.pow(size, 2)).alias("s"), F.count("*").alias("n"), F.max(size).alias("a")).first()
    sigma2, n, spread = first["s"] / d + 1e-12, first["n"], max(first["a"], 1e-9) * 2

    def sums(field: Field, sigma2: float, gamma: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b, t = np.zeros((m, m)), np.zeros((m, d)), np.zeros(2)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, v = matrix(batch, "x"), matrix(batch, "v")
                k = field.kernel(x)
                r2 = ((v - k @ field.coef) ** 2).sum(1)
                inlier = gamma * np.exp(-r2 / (2 * sigma2)) * (2 * np.pi * sigma2) ** (-d / 2)
                p = inlier / (inlier + (1 - gamma) / spread**d + 1e-300)
                a += k.T @ (p[:, None] * k)
                b += k.T @ (p[:, None] * v)
                t += [p.sum(), (p * r2).sum()]
            flat = np.concatenate([a.ravel(), b.ravel(), t])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["k", "v"])

        return run

    energy = np.inf
    for _ in range(rounds):
        got = cells.mapInArrow(sums(field, sigma2, gamma), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(m * m + m * d + 2)
        for r in got:
            flat[r["k"]] = r["v"]
        a, b, (sp, sr) = flat[: m * m].reshape(m, m), flat[m * m : m * m + m * d].reshape(m, d), flat[-2:]
        before, energy = energy, sr / (2 * sigma2) + sp * np.log(sigma2) * d / 2 + ridge / 2 * float(np.sum(field.coef * (gram @ field.coef)))
        if abs(energy - before) <= tolerance * abs(energy) or sigma2 <= 1e-8:
            return field
        gamma = float(np.clip(sp / n, 0.05, 0.95))
        coef = np.linalg.lstsq(a + ridge * sigma2 * gram, b, rcond=None)[0]
        field = Field(control, beta, coef)
        sigma2 = max(sr / max(sp * d, 1e-12), 1e-8)
    raise ArithmeticError(f"the field did not converge in {rounds} rounds")


def agreement(cells: DataFrame, field: Field) -> float:
    """The mean cosine of v and f(x) over ``cells(x, v)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for batch in batches:
            if batch.num_rows:
                v, f = matrix(batch, "v"), field(matrix(batch, "x"))
                total += float(((v * f).sum(1) / (np.linalg.norm(v, axis=1) * np.linalg.norm(f, axis=1) + 1e-20)).sum())
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n])], names=["s", "n"])

    both = cells.select("x", "v").where("x is not null and v is not null").mapInArrow(run, "s double, n long")
    return both.agg(F.sum("s") / F.sum("n")).first()[0] or 0.0


def fit_field_with_restarts(cells: DataFrame, least: float = 0.6, seeds: tuple[int, ...] = (0, 100, 200, 300, 400), **options) -> tuple[Field, float]:
    """The first field, over ``seeds`` for its control points, that agrees with the velocities by ``least`` at least, or the best of all; and its agreement."""
    best: tuple[Field, float] | None = None
    for seed in seeds:
        field = fit_field(cells, seed=seed, **options)
        got = agreement(cells, field)
        if best is None or got > best[1]:
            best = field, got
        if got >= least:
            break
    return best


def per_cell(cells: DataFrame, field: Field, outputs: dict[str, Callable], columns: str = "x") -> DataFrame:
    """``(cell_id, ...)``: functions of (field, x[, v]) evaluated a batch at a time; scalars or vectors."""
    names = list(outputs)
    probe = np.zeros((1, field.control.shape[1]))
    shapes = {k: np.asarray(f(field, probe, probe)).ndim for k, f in outputs.items()}
    kind = ", ".join(f"{k} {'double' if shapes[k] == 1 else 'array<double>'}" for k in names)
    schema = pa.schema([("cell_id", pa.int64())] + [(k, pa.float64() if shapes[k] == 1 else pa.list_(pa.float64())) for k in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch, "x")
            v = matrix(batch, "v")
            out = [batch.column("cell_id")]
            for k in names:
                y = np.asarray(outputs[k](field, x, v), float)
                out.append(pa.array(y if y.ndim == 1 else y.reshape(len(y), -1).tolist(), schema.field(k).type))
            yield pa.RecordBatch.from_arrays(out, schema=schema)

    cells = cells.select("cell_id", "x", "v" if "v" in cells.columns else F.col("x").alias("v"))
    return cells.mapInArrow(run, f"cell_id long, {kind}")


def velocity(f: Field, x, v):
    return f(x)


def divergence(f: Field, x, v):
    return np.trace(f.jacobian(x), axis1=1, axis2=2)


def curl(f: Field, x, v):
    """Of the first two dimensions: dv2/dx1 - dv1/dx2."""
    j = f.jacobian(x)
    return j[:, 1, 0] - j[:, 0, 1] if x.shape[1] > 1 else np.zeros(len(x))


def acceleration(f: Field, x, v):
    return np.einsum("nij,nj->ni", f.jacobian(x), f(x))


def curvature(f: Field, x, v):
    """Norm of (a (v.v) - v (v.a)) / |v|^4."""
    w, a = f(x), acceleration(f, x, v)
    vv, va = (w * w).sum(1, keepdims=True), (w * a).sum(1, keepdims=True)
    return np.sqrt((((a * vv - w * va) / np.maximum(vv**2, 1e-300)) ** 2).sum(1))


def turning(f: Field, x, v):
    """The other curvature: |v x a| / |v|^3, from lengths and the angle between them."""
    w, a = f(x), acceleration(f, x, v)
    vv, aa, va = (w * w).sum(1), (a * a).sum(1), (w * a).sum(1)
    return np.sqrt(np.maximum(vv * aa - va * va, 0)) / np.maximum(vv**1.5, 1e-300)


def hessian(f: Field, x, v):
    """All second derivatives of a cell, flattened in order of component, then the two variables."""
    return f.hessian(x).reshape(len(x), -1)


def torsion(f: Field, x, v):
    """Of 3-d fields: (v x a) . (J a) / |v x a|^2; zero otherwise."""
    if x.shape[1] != 3:
        return np.zeros(len(x))
    w, a = f(x), acceleration(f, x, v)
    jerk = np.einsum("nij,nj->ni", f.jacobian(x), a)
    c = np.cross(w, a)
    return (c * jerk).sum(1) / np.maximum((c * c).sum(1), 1e-300)


def jacobian_norm(f: Field, x, v):
    return np.sqrt((f.jacobian(x) ** 2).sum((1, 2)))


def sensitivity(f: Field, x, v):
    """inv(I - J) with every column divided by its diagonal entry."""
    d = x.shape[1]
    s = np.linalg.pinv(np.eye(d)[None] - f.jacobian(x))
    diag = np.einsum("nii->ni", s)
    return (s / np.where(diag == 0, 1, diag)[:, None, :]).reshape(len(x), -1)


def speed(f: Field, x, v):
    return np.sqrt((f(x) ** 2).sum(1))


def cosine_to_data(f: Field, x, v):
    w = f(x)
    return (w * v).sum(1) / np.maximum(np.sqrt((w * w).sum(1) * (v * v).sum(1)), 1e-300)


def jacobian_table(cells: DataFrame, field: Field, loadings: np.ndarray | None = None, genes: list[str] | None = None) -> DataFrame:
    """``(cell_id, effector, regulator, value)``: J, or q_i J q_j for gene loadings q (genes x d)."""
    q = np.eye(field.control.shape[1]) if loadings is None else np.asarray(loadings, float)
    genes = genes or [str(i) for i in range(len(q))]
    schema = pa.schema([("cell_id", pa.int64()), ("effector", pa.string()), ("regulator", pa.string()), ("value", pa.float64())])
    e, r = np.repeat(genes, len(genes)), np.tile(genes, len(genes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                j = np.einsum("ai,nij,bj->nab", q, field.jacobian(matrix(some, "x")), q)
                ids = np.repeat(some.column("cell_id").to_numpy(), len(e))
                columns = [pa.array(ids), pa.array(np.tile(e, some.num_rows)), pa.array(np.tile(r, some.num_rows)), pa.array(j.ravel())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return cells.select("cell_id", "x").mapInArrow(run, "cell_id long, effector string, regulator string, value double")


def perturb(mode: str, delta: np.ndarray) -> Callable:
    """Response to moving every cell by ``delta``: j_delta_x, j_x_prime, j_j_delta_x, f_x_prime, f_x_prime_minus_f."""

    def run(f: Field, x, v):
        moved = x + delta
        j = f.jacobian(x)
        return {
            "j_delta_x": lambda: np.einsum("nij,j->ni", j, delta),
            "j_x_prime": lambda: np.einsum("nij,nj->ni", j, moved),
            "j_j_delta_x": lambda: np.einsum("nij,njk,k->ni", j, j, delta),
            "f_x_prime": lambda: f(moved),
            "f_x_prime_minus_f": lambda: f(moved) - f(x),
        }[mode]()

    return run


def knock_out(gene: int, loadings: np.ndarray, strength: float = 1.0) -> Callable:
    """Velocity in gene space less strength times the gene's expression, projected back."""
    q = np.asarray(loadings, float)

    def run(f: Field, x, v):
        vg = f(x) @ q.T
        vg[:, gene] -= strength * np.abs(x @ q.T)[:, gene]
        return vg @ np.linalg.pinv(q).T

    return run


def fixed_points(cells: DataFrame, field: Field, rounds: int = 50, digits: int = 3) -> DataFrame:
    """``(x, n, stable)``: zeros that Newton's method reaches from the cells, rounded, with how many cells
    reach each and whether all eigenvalues of J there have negative real parts."""
    schema = pa.schema([("x", pa.list_(pa.float64())), ("stable", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch, "x")
            reach = 3 * np.abs(field.control).max()
            for _ in range(rounds):
                j = field.jacobian(x) + 1e-9 * np.eye(x.shape[1])
                x = x - np.clip(np.einsum("nij,nj->ni", np.linalg.pinv(j), field(x)), -1, 1)
            f = field(x)
            scale = max(np.abs(field.coef).max(), 1e-12)
            ok = (np.abs(f).max(1) < 1e-6 * scale) & (np.abs(x).max(1) < reach) & (field.kernel(x).max(1) > 1e-3)
            x = x[ok]
            stable = (np.linalg.eigvals(field.jacobian(x)).real < 0).all(1) if len(x) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(x, digits).tolist(), schema.field("x").type), pa.array(stable)], schema=schema)

    found = cells.select("cell_id", "x").mapInArrow(run, "x array<double>, stable boolean")
    return found.groupBy("x").agg(F.count("*").alias("n"), F.min("stable").alias("stable"))


def integrate(cells: DataFrame, field: Field, t_end: float, n_steps: int, n_keep: int, direction: int = 1, stop: float = 1e-5) -> DataFrame:
    """``(cell_id, step, t, x)``: trajectories from every cell by classical Runge-Kutta steps, all cells of a
    batch together; a cell rests where all |f| < stop. ``n_keep`` evenly spaced points are kept."""
    h = direction * t_end / n_steps
    keep = np.unique(np.linspace(0, n_steps, n_keep).round().astype(int))
    schema = pa.schema([("cell_id", pa.int64()), ("step", pa.int32()), ("t", pa.float64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = matrix(batch, "x"), batch.column("cell_id")
            for n in range(n_steps + 1):
                if n in keep:
                    m = batch.num_rows
                    cols = [ids, pa.array(np.full(m, n), pa.int32()), pa.array(np.full(m, n * h)), pa.array(x.tolist(), schema.field("x").type)]
                    yield pa.RecordBatch.from_arrays(cols, schema=schema)
                k1 = field(x)
                moving = (np.abs(k1) >= stop).any(1, keepdims=True)
                k2 = field(x + h / 2 * k1)
                k3 = field(x + h / 2 * k2)
                k4 = field(x + h * k3)
                x = x + moving * h / 6 * (k1 + 2 * k2 + 2 * k3 + k4)

    return cells.select("cell_id", "x").mapInArrow(run, "cell_id long, step int, t double, x array<double>")


def least_action_paths(pairs: DataFrame, field: Field, n_points: int = 20, rounds: int = 200, diffusion: float = 1.0) -> DataFrame:
    """``(pair_id, action, t, path)`` for ``pairs(pair_id, a, b)``: the path between two states that least opposes
    the field, S = 1/(2D) sum |dx/dt - f|^2 dt, by turns: the best uniform time step, then gradient steps on inner points."""

    def action(path, dt):
        mid = (path[1:] + path[:-1]) / 2
        r = (path[1:] - path[:-1]) / dt - field(mid)
        return 0.5 * (r * r).sum() * dt / diffusion, r, mid

    def best_dt(path):
        d, f = path[1:] - path[:-1], field((path[1:] + path[:-1]) / 2)
        return float(np.clip(np.sqrt((d * d).sum() / max((f * f).sum(), 1e-12)), 1e-3, 1e3))

    def solve(a, b):
        path = np.linspace(a, b, n_points)
        dt = best_dt(path)
        s, r, mid = action(path, dt)
        rate = 0.1
        for _ in range(rounds):
            j = field.jacobian(mid)
            jr = np.einsum("nij,ni->nj", j, r) * dt / 2
            g = np.zeros_like(path)
            g[1:] += r - jr
            g[:-1] += -r - jr
            g = g[1:-1] / diffusion
            trial = path.copy()
            trial[1:-1] -= rate * dt * g
            t2 = best_dt(trial)
            s2, r2, mid2 = action(trial, t2)
            if s2 < s:
                path, dt, s, r, mid, rate = trial, t2, s2, r2, mid2, rate * 1.2
            else:
                rate /= 2
        return s, dt * (n_points - 1), path

    schema = pa.schema([("pair_id", pa.int64()), ("action", pa.float64()), ("t", pa.float64()), ("path", pa.list_(pa.list_(pa.float64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [solve(np.array(a), np.array(b)) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            cols = [batch.column("pair_id"), [o[0] for o in out], [o[1] for o in out], [o[2].tolist() for o in out]]
            cols = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return pairs.select("pair_id", "a", "b").mapInArrow(run, "pair_id long, action double, t double, path array<array<double>>")


def path_potential(traj: DataFrame, field: Field) -> DataFrame:
    """``(cell_id, potential)``: minus the path integral of f along a cell's trajectory ``traj(cell_id, step, x)``,
    relative to the trajectory's end."""
    from pyspark.sql import Window

    w = Window.partitionBy("cell_id").orderBy("step")
    piece = traj.withColumn("to", F.lead("x").over(w)).where("to is not null")
    schema = pa.schema([("cell_id", pa.int64()), ("work", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = matrix(batch, "x"), matrix(batch, "to")
                work = (field((a + b) / 2) * (b - a)).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("cell_id"), pa.array(work)], schema=schema)

    pieces = piece.select("cell_id", "x", "to").mapInArrow(run, "cell_id long, work double")
    return pieces.groupBy("cell_id").agg(F.sum("work").alias("potential"))


def fate_shares(traj: DataFrame, cells: DataFrame, k: int = 30, tail: int = 10) -> DataFrame:
    """``(cell_id, grp, share)``: groups of the k nearest cells of each trajectory's last ``tail`` points."""
    from pyspark.sql import Window

    last = Window.partitionBy("cell_id").orderBy(F.desc("step"))
    end = traj.withColumn("r", F.row_number().over(last)).where(F.col("r") <= tail)
    end = end.withColumn("point", F.xxhash64("cell_id", "step"))
    near = nearest(end.select(F.col("point").alias("cell_id"), "x"), cells.select("cell_id", "x"), k, skip_self=False)
    owner = end.select(F.col("point").alias("i"), F.col("cell_id").alias("owner"))
    g = near.join(owner, "i").join(cells.select(F.col("cell_id").alias("j"), "grp"), "j")
    n = g.groupBy("owner", "grp").agg(F.count("*").alias("n"))
    s = n.groupBy("owner").agg(F.sum("n").alias("s"))
    return n.join(s, "owner").select(F.col("owner").alias("cell_id"), "grp", (F.col("n") / F.col("s")).alias("share"))


def slow_tail(traj: DataFrame, share: float = 0.05, least: int = 10) -> DataFrame:
    """``traj(cell_id, step, x[, t])`` plus its points' numbers ``k`` from 0, their count ``n``, and the size ``m`` of the tail where it moves slowly.

    The tail begins after the last step that is faster than the quantile ``share`` of the trajectory's speeds; it has ``least`` points at least.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("cell_id").orderBy("step")
    span = (F.lead("t").over(w) - F.col("t")) if "t" in traj.columns else F.lit(1.0)
    speed = ratio(F.sqrt(F.aggregate(F.zip_with(F.lead("x").over(w), "x", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, z: s + z)), span)
    p = traj.select("cell_id", "step", "x", (F.row_number().over(w) - 1).alias("k"), speed.alias("speed"))
    per = p.groupBy("cell_id").agg(F.count("*").cast("int").alias("n"), F.percentile("speed", F.lit(share)).alias("limit"))
    p = p.join(per, "cell_id")
    fast = p.where(F.col("speed") > F.col("limit")).groupBy("cell_id").agg(F.max("k").alias("last"))
    slow = F.coalesce(F.col("n") - 2 - F.col("last"), F.col("n") - 1)
    return p.join(fast, "cell_id", "left").select("cell_id", "step", "k", "x", "n", F.least("n", F.greatest(slow, F.lit(least))).alias("m"))


def fate_bias(
    traj: DataFrame, cells: DataFrame, k: int = 30, threshold: float = 1.0, share: float = 0.05, least: int = 10, sources: list[str] | None = None
) -> DataFrame:
    """``(cell_id, grp, share, confidence, walked)``: the groups of the observed cells where each trajectory of ``traj(cell_id, step, x)`` ends.

    A point is near the data if its nearest of ``cells(cell_id, x, grp)`` is closer than ``threshold`` times the median distance from a cell to its nearest
    other. If no point of the slow tail is near, the tail is walked back, step by step, to the first place where one is (the
    last near point then is its first); a trajectory that is never near has null group and share. The ``k`` nearest cells of the
    tail's points (after walking back the nearest only), and from there the cells' own neighbours, are counted by group; shares of ``sources`` go to the
    likeliest other group, if there is one. Confidence is 1 - (far points + steps walked) / (points + steps walked).

    Points before the tail are looked up for trajectories only whose tail is far.
    """
    from pyspark.sql import Window

    points = cells.select("cell_id", "x")
    own = cut(nearest(points, points, k - 1).select("i", "j", "d", "rank"))
    limit = threshold * (column_quantile(own.where("rank = 1"), "d", 0.5) or 0.0)
    p = cut(slow_tail(traj, share, least).withColumn("point", F.xxhash64("cell_id", "k")))

    def found(some: DataFrame, k: int) -> DataFrame:
        near = nearest(some.select(F.col("point").alias("cell_id"), "x"), points, k, skip_self=False)
        return some.select("cell_id", "k", "n", "m", "point").join(near.select(F.col("i").alias("point"), "j", "d", "rank"), "point")

    tail = cut(found(p.where("k >= n - m"), k))
    near = tail.where("rank = 1").groupBy("cell_id", "n", "m").agg(F.count_if(F.col("d") < limit).alias("close"))
    lost = near.where("close = 0").select("cell_id")
    before = cut(found(p.where("k < n - m").join(lost, "cell_id", "left_semi"), 1))
    back = before.where(F.col("d") < limit).groupBy("cell_id").agg(F.max("k").alias("first"))
    where = near.join(back, "cell_id", "left").withColumn("walked", F.when(F.col("close") > 0, 0).otherwise(F.col("n") - F.col("m") - F.col("first")))
    close = F.when(F.col("close") > 0, F.col("close")).otherwise(F.lit(1))
    sure = 1 - (F.col("m") - close + F.col("walked")) / (F.col("m") + F.col("walked"))
    where = cut(where.select("cell_id", "n", "m", "walked", F.when(F.col("walked").isNull(), 0.0).otherwise(sure).alias("confidence")))
    inside = tail.unionByName(before).join(where.select("cell_id", "walked"), "cell_id").where("k >= n - m - walked and k < n - walked and (walked = 0 or rank = 1)")
    spread = own.select(F.col("i").alias("j"), F.col("j").alias("at")).unionByName(points.select(F.col("cell_id").alias("j"), F.col("cell_id").alias("at")))
    # a cell that many points are near to is counted before its neighbours are looked up
    some = inside.groupBy("cell_id", "j").agg(F.count("*").alias("n")).join(spread, "j").groupBy("cell_id", "at").agg(F.sum("n").alias("n"))
    g = some.join(cells.select(F.col("cell_id").alias("at"), "grp"), "at").groupBy("cell_id", "grp").agg(F.sum("n").alias("n"))
    g = g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("cell_id")))
    if sources:
        each = Window.partitionBy("cell_id")
        is_source = F.col("grp").isin(sources)
        given = F.sum(F.when(is_source, F.col("share")).otherwise(0.0)).over(each)
        best = F.max(F.when(~is_source, F.col("share"))).over(each)
        first = F.min(F.when(~is_source & (F.col("share") == best), F.col("grp"))).over(each)
        moved = F.when(first.isNull(), F.col("share")).when(is_source, 0.0).otherwise(F.col("share") + F.when(F.col("grp") == first, given).otherwise(0.0))
        g = g.withColumn("share", moved)
    return where.join(g.select("cell_id", "grp", "share"), "cell_id", "left").select("cell_id", "grp", "share", "confidence", "walked")


def lineage(traj: DataFrame, cells: DataFrame, k: int = 5) -> DataFrame:
    """``(origin, cell_id)``: cells within the k nearest of any point of a cell's trajectory, but for itself."""
    p = traj.withColumn("point", F.xxhash64("cell_id", "step"))
    near = nearest(p.select(F.col("point").alias("cell_id"), "x"), cells.select("cell_id", "x"), k, skip_self=False)
    owner = p.select(F.col("point").alias("i"), F.col("cell_id").alias("origin"))
    return near.join(owner, "i").select("origin", F.col("j").alias("cell_id")).where("origin <> cell_id").distinct()


def nullclines(bounds: DataFrame, field: Field, n_grid: int = 50) -> DataFrame:
    """``(component, x, y)``: where a component of a 2-d field changes sign along the lines of a grid over
    ``bounds(x0, x1, y0, y1)`` (one row), by linear interpolation. A task takes some of the grid's columns."""
    schema = pa.schema([("component", pa.int32()), ("x", pa.float64()), ("y", pa.float64())])
    lines = bounds.select("*", F.explode(F.expr(f"sequence(0, {n_grid - 1})")).alias("k")).repartition("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                xs, ys = np.linspace(b["x0"], b["x1"], n_grid), np.linspace(b["y0"], b["y1"], n_grid)
                for line in (np.stack([np.full(n_grid, xs[b["k"]]), ys], 1), np.stack([xs, np.full(n_grid, ys[b["k"]])], 1)):
                    f = field(line)
                    for c in (0, 1):
                        at = np.flatnonzero(f[:-1, c] * f[1:, c] < 0)
                        w = f[at, c] / (f[at, c] - f[at + 1, c])
                        p = line[at] + w[:, None] * (line[at + 1] - line[at])
                        out += [(c, float(x), float(y)) for x, y in p]
            if out:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return lines.mapInArrow(run, "component int, x double, y double")


def separatrices(saddles: DataFrame, field: Field, t_end: float, n_steps: int, n_keep: int, nudge: float = 1e-2) -> DataFrame:
    """``(cell_id, step, t, x)``: from both sides of each saddle ``(cell_id, x)``, back in time along its stable
    directions (eigenvector columns of negative eigenvalues); the curves that part basins."""
    schema = pa.schema([("cell_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, out = [], []
            x = matrix(batch, "x")
            val, vec = np.linalg.eig(field.jacobian(x))
            for i, k in np.argwhere(val.real < 0):
                d = vec[i, :, k].real
                for side in (-1, 1):
                    ids.append(int(batch.column("cell_id")[i].as_py()) * 64 + 2 * int(k) + (side > 0))
                    out.append((x[i] + side * nudge * d).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, schema.field("x").type)], schema=schema)

    seeds = saddles.select("cell_id", "x").mapInArrow(starts, "cell_id long, x array<double>")
    return integrate(seeds, field, t_end, n_steps, n_keep, direction=-1)
