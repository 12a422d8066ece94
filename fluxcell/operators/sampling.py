"""Samples of cells: by hash, by velocity, by cluster; and distances from roots as pseudotime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxcell.functions.lineage import cut
from fluxcell.functions.scalars import norm


def uniform(seed: int, *columns: str) -> Column:
    """A uniform number in (0, 1) for each row, from a hash, so that reruns agree."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) + 0.5) / float(1 << 53)


def sample_random(cells: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return cells.orderBy(uniform(seed, "cell_id"), "cell_id").limit(n)


def sample_by_velocity(cells: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n cells without replacement, likelier the larger |v| is (exponential keys)."""
    key = -F.log(uniform(seed, "cell_id")) / F.greatest(norm(F.col("v")), F.lit(1e-300))
    return cells.orderBy(key, "cell_id").limit(n)


def sample_by_group(cells: DataFrame, n_each: int, seed: int = 0) -> DataFrame:
    """Up to n_each cells of every group."""
    w = Window.partitionBy("grp").orderBy(uniform(seed, "cell_id"), "cell_id")
    return cells.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_each).drop("_r")


def shortest_times(edges: DataFrame, roots: list) -> DataFrame:
    """``(cell_id, pseudotime)``: least path length from a root over undirected edges (i, j, d >= 0); unreached
    cells are absent. A round relaxes the edges of the cells that the round before improved, until none is."""
    both = edges.select("i", "j", "d").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    both = cut(both.groupBy("i", "j").agg(F.min("d").alias("d")))
    t = both.select(F.col("i").alias("cell_id")).distinct().where(F.col("cell_id").isin(roots))
    t = cut(t.select("cell_id", F.lit(0.0).alias("t"), F.lit(True).alias("new")))
    while not t.where("new").isEmpty():
        step = both.join(t.where("new").select(F.col("cell_id").alias("i"), "t"), "i")
        step = step.select(F.col("j").alias("cell_id"), (F.col("t") + F.col("d")).alias("t"), F.lit(None).cast("double").alias("old"))
        all_ = t.select("cell_id", "t", F.col("t").alias("old")).unionByName(step)
        best = all_.groupBy("cell_id").agg(F.min("t").alias("t"), F.min("old").alias("old"))
        t = cut(best.select("cell_id", "t", F.coalesce(F.col("t") < F.col("old"), F.lit(True)).alias("new")))
    return t.select("cell_id", F.col("t").alias("pseudotime"))
