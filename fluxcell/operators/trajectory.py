"""Trajectories as rows ordered by time: window expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxcell.functions.scalars import angle, distance, norm, ratio


def _order(*more: str):
    return Window.partitionBy("traj_id").orderBy("step", *more)


def arc_length(traj: DataFrame) -> DataFrame:
    """``traj(traj_id, step, x)`` plus the length travelled so far."""
    w = _order()
    piece = F.coalesce(distance(F.col("x"), F.lag("x").over(w)), F.lit(0.0))
    return traj.withColumn("_d", piece).withColumn("arc", F.sum("_d").over(w)).drop("_d")


def tangents(traj: DataFrame) -> DataFrame:
    """Steps to the next point and their turning angle from the step before; the last point has none."""
    w = _order()
    t = traj.withColumn("tangent", F.zip_with(F.lead("x").over(w), "x", lambda a, b: a - b)).where("tangent is not null")
    before = F.lag("tangent").over(w)
    moved = (norm(before) > 0) & (norm(F.col("tangent")) > 0)
    return t.withColumn("turn", F.when(moved, angle(F.col("tangent"), before)))


def mean_squared_displacement(traj: DataFrame, ref: int = 0) -> DataFrame:
    """``(traj_id, k, msd)``: the mean of (x_k - x_k of the ref-th point) squared over all points, by dimension k from 0.

    Their sum is the total. A trajectory without such a point has none.
    """
    at = traj.select("traj_id", "step", "x").withColumn("n", F.row_number().over(_order()) - 1) if ref else None
    first = traj.groupBy("traj_id").agg(F.min_by("x", "step").alias("x0")) if ref == 0 else at.where(F.col("n") == ref).select("traj_id", F.col("x").alias("x0"))
    d = traj.join(first, "traj_id").select("traj_id", F.posexplode(F.zip_with("x", "x0", lambda a, b: (a - b) * (a - b))).alias("k", "d"))
    return d.groupBy("traj_id", "k").agg(F.avg("d").alias("msd"))


def lagged_displacement(traj: DataFrame, lags: list[int]) -> DataFrame:
    """``(traj_id, lag, msd)`` over steps a fixed number apart."""
    w = _order()
    ahead = traj.select("traj_id", "x", *[F.lead("x", k).over(w).alias(f"x{k}") for k in lags])
    parts = [F.struct(F.lit(k).alias("lag"), F.pow(distance(F.col(f"x{k}"), F.col("x")), 2).alias("d")) for k in lags]
    d = ahead.select("traj_id", F.explode(F.array(*parts)).alias("p")).select("traj_id", "p.*")
    return d.where("d is not null").groupBy("traj_id", "lag").agg(F.avg("d").alias("msd"))


def resample(traj: DataFrame, n: int) -> DataFrame:
    """``(traj_id, k, x)``: n points evenly spaced by arc length, linear between the trajectory's points."""
    w = _order()
    a = arc_length(traj).withColumns({"next": F.lead("x").over(w), "to": F.lead("arc").over(w)})
    a = a.withColumn("total", F.max("arc").over(Window.partitionBy("traj_id")))
    place = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: k * F.col("total") / (n - 1))
    p = a.select("*", F.posexplode(place).alias("k", "s"))
    last = F.col("next").isNull()
    p = p.where(F.when(last, F.col("k") == n - 1).otherwise((F.col("s") >= F.col("arc")) & (F.col("s") < F.col("to")) & (F.col("k") < n - 1)))
    f = F.coalesce(ratio(F.col("s") - F.col("arc"), F.col("to") - F.col("arc")), F.lit(0.0))
    x = F.when(last, F.col("x")).otherwise(F.zip_with("x", "next", lambda u, v: u + f * (v - u)))
    return p.select("traj_id", "k", x.alias("x"))


def first_passage(steps: DataFrame, init: str, target: str, sinks: list[str]) -> DataFrame:
    """``(traj_id, t)``: time from the last initial state before the first target to it, for trajectories
    that meet the target before any sink; an initial state at time 0 or earlier does not count."""
    w = Window.partitionBy("traj_id")
    hit = F.min(F.when(F.col("state") == target, F.struct("ts", "event_id", "t"))).over(w)
    sink = F.min(F.when(F.col("state").isin(sinks), F.struct("ts", "event_id", "t"))).over(w)
    s = steps.withColumns({"hit": hit, "sink": sink})
    s = s.where("hit is not null and (sink is null or hit < sink)")
    before = (F.col("state") == init) & (F.struct("ts", "event_id", "t") < F.col("hit")) & (F.col("t") > 0)
    return s.where(before).groupBy("traj_id").agg((F.first("hit")["t"] - F.max("t")).alias("t"))


def exit_time(steps: DataFrame, init: str, sinks: list[str]) -> DataFrame:
    """``(traj_id, t)``: time from the last initial state before the first sink to that sink."""
    w = Window.partitionBy("traj_id")
    sink = F.min(F.when(F.col("state").isin(sinks), F.struct("ts", "event_id", "t"))).over(w)
    s = steps.withColumn("sink", sink).where("sink is not null")
    before = (F.col("state") == init) & (F.struct("ts", "event_id", "t") < F.col("sink")) & (F.col("t") > 0)
    return s.where(before).groupBy("traj_id").agg((F.first("sink")["t"] - F.max("t")).alias("t"))
