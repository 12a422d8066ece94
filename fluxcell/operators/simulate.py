"""Stochastic simulation: trajectories are rows of a range, seeded by trajectory, run in batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def gillespie(
    spark: SparkSession,
    n_traj: int,
    start: list[int],
    stoichiometry: list[list[int]],
    rates,
    t_end: float,
    n_times: int,
    seed: int = 0,
    max_events: int = 1_000_000,
) -> DataFrame:
    """``(traj_id, t, counts)``: the direct method for reactions with propensities ``rates(counts) -> array``,
    observed at evenly spaced times. Trajectory k uses seed (seed, k), so reruns agree. One with more than
    ``max_events`` events stops the job."""
    times = np.linspace(0, t_end, n_times)
    change = np.array(stoichiometry, np.int64)
    schema = pa.schema([("traj_id", pa.int64()), ("t", pa.float64()), ("counts", pa.list_(pa.int64()))])

    def one(k: int) -> np.ndarray:
        rng, t, x, i = np.random.default_rng([seed, k]), 0.0, np.array(start, np.int64), 0
        out = np.zeros((n_times, len(x)), np.int64)
        for _ in range(max_events):
            a = np.maximum(np.asarray(rates(x), float), 0)
            total = a.sum()
            t = t + rng.exponential(1 / total) if total > 0 else np.inf
            while i < n_times and times[i] < t:
                out[i] = x
                i += 1
            if i >= n_times:
                break
            x = x + change[np.searchsorted(np.cumsum(a), rng.random() * total, "right")]
        if i < n_times:
            raise ArithmeticError(f"trajectory {k} has more than {max_events} events before {times[-1]}")
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                x = one(k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * n_times, pa.int64()), pa.array(times), pa.array(x.tolist(), schema.field("counts").type)], schema=schema
                )

    return spark.range(n_traj).mapInArrow(run, "traj_id long, t double, counts array<long>")


def expression_rates(alpha: float, beta: float, gamma: float):
    """Transcription, splicing and degradation of one gene: counts (u, s), with changes ``EXPRESSION``."""
    return lambda x: [alpha, beta * x[0], gamma * x[1]]


EXPRESSION = [[1, 0], [-1, 1], [0, -1]]


def toggle_rates(a: float, k: float, n: float, gamma: float):
    """Two genes that inhibit each other, with changes ``TOGGLE``."""
    return lambda x: [a / (1 + (x[1] / k) ** n), a / (1 + (x[0] / k) ** n), gamma * x[0], gamma * x[1]]


TOGGLE = [[1, 0], [0, 1], [-1, 0], [0, -1]]


def simulate_ode(cells: DataFrame, field, t_end: float, n_steps: int) -> DataFrame:
    """``(cell_id, x)``: end points after t_end under ``field(x)`` (rows in, rows out), by Runge-Kutta in batches."""
    h = t_end / n_steps
    schema = pa.schema([("cell_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
            for _ in range(n_steps):
                k1 = field(x)
                k2 = field(x + h / 2 * k1)
                k3 = field(x + h / 2 * k2)
                x = x + h / 6 * (k1 + 2 * k2 + 2 * k3 + field(x + h * k3))
            yield pa.RecordBatch.from_arrays([batch.column("cell_id"), pa.array(x.tolist(), schema.field("x").type)], schema=schema)

    return cells.select("cell_id", "x").mapInArrow(run, "cell_id long, x array<double>")
