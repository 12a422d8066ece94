"""Normalisation and transforms. Statistics over all cells are one-row aggregates sent to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxcell.functions.scalars import ratio


def size_factors(x: DataFrame, cells: DataFrame, method: str = "median", scale_to: float | None = None) -> DataFrame:
    """``(cell_id, size_factor)``: a cell's total (0 counts as 1) over the median, mean or geometric
    mean of totals, or over ``scale_to``; null results become 1. ``cells`` lists every cell."""
    totals = cells.select("cell_id").join(x.groupBy("cell_id").agg(F.sum("value").alias("t")), "cell_id", "left")
    totals = totals.select("cell_id", F.when(F.coalesce("t", F.lit(0.0)) == 0, 1.0).otherwise(F.col("t")).alias("t"))
    middle = {
        "median": F.percentile("t", F.lit(0.5)),
        "mean": F.avg("t"),
        "geometric": F.exp(F.avg(F.log("t"))),
    }[method]
    by = totals.agg((F.lit(scale_to) if scale_to else middle).alias("m"))
    return totals.crossJoin(F.broadcast(by)).select(
        "cell_id", F.coalesce(ratio(F.col("t"), F.col("m")), F.lit(1.0)).alias("size_factor")
    )


def normalize(expr: DataFrame, factors: DataFrame) -> DataFrame:
    return expr.join(factors, "cell_id").withColumn("value", ratio(F.col("value"), F.col("size_factor"))).drop("size_factor")


def proportional_fit(x: DataFrame, n_cells: DataFrame) -> DataFrame:
    """Every non-empty cell gets the mean total over all cells, the empty ones counted."""
    totals = x.groupBy("cell_id").agg(F.sum("value").alias("t"))
    goal = totals.agg(F.sum("t").alias("s")).crossJoin(n_cells).select(ratio(F.col("s"), F.col("n_cells")).alias("goal"))
    return (
        x.join(totals, "cell_id")
        .crossJoin(F.broadcast(goal))
        .withColumn("value", F.coalesce(F.col("value") * ratio(F.col("goal"), F.col("t")), F.lit(0.0)))
        .select(x.columns)
    )


def pf_log_pf(x: DataFrame, n_cells: DataFrame) -> DataFrame:
    """Proportional fitting, log1p, proportional fitting."""
    first = proportional_fit(x, n_cells).withColumn("value", F.log1p("value"))
    return proportional_fit(first, n_cells)


def centered_log_ratio(x: DataFrame, n_cells: DataFrame) -> DataFrame:
    """Per feature: log1p(x / exp(sum of log1p of positive values / number of cells))."""
    level = x.where("value > 0").groupBy("gene_id").agg(F.sum(F.log1p("value")).alias("l"))
    return (
        x.join(level, "gene_id")
        .crossJoin(F.broadcast(n_cells))
        .withColumn("value", F.log1p(F.col("value") / F.exp(F.col("l") / F.col("n_cells"))))
        .select(x.columns)
    )


def tf_idf(x: DataFrame, n_cells: DataFrame, scale: float = 1e4) -> DataFrame:
    """log1p(x / cell total * log1p(cells / feature total) * scale)."""
    cell = x.groupBy("cell_id").agg(F.sum("value").alias("ct"))
    feature = x.groupBy("gene_id").agg(F.sum("value").alias("ft"))
    weight = F.log1p(ratio(F.col("n_cells"), F.col("ft"))) * scale
    return (
        x.join(cell, "cell_id")
        .join(feature, "gene_id")
        .crossJoin(F.broadcast(n_cells))
        .withColumn("value", F.log1p(ratio(F.col("value"), F.col("ct")) * weight))
        .select(x.columns)
    )
