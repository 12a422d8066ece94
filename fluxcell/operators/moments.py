"""Smoothed moments over a weight graph, and moments by time point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_moment(weights: DataFrame, x: DataFrame) -> DataFrame:
    """``(cell_id, gene_id, m)``: W X for edges (i, j, w) and stored values; absent ones are 0."""
    v = x.select(F.col("cell_id").alias("j"), "gene_id", "value")
    return (
        weights.join(v, "j")
        .groupBy(F.col("i").alias("cell_id"), "gene_id")
        .agg(F.sum(F.col("w") * F.col("value")).alias("m"))
    )


def second_moment(weights: DataFrame, xy: DataFrame, centered: bool = False) -> DataFrame:
    """``(cell_id, gene_id, m)``: W (X * Y) for ``xy(cell_id, gene_id, x, y)``, less W X * W Y if centred."""
    v = xy.select(F.col("cell_id").alias("j"), "gene_id", "x", "y")
    g = (
        weights.join(v, "j")
        .groupBy(F.col("i").alias("cell_id"), "gene_id")
        .agg(
            F.sum(F.col("w") * F.col("x") * F.col("y")).alias("xy"),
            F.sum(F.col("w") * F.col("x")).alias("mx"),
            F.sum(F.col("w") * F.col("y")).alias("my"),
        )
    )
    m = F.col("xy") - F.col("mx") * F.col("my") if centered else F.col("xy")
    return g.select("cell_id", "gene_id", m.alias("m"))


def strata_moments(x: DataFrame) -> DataFrame:
    """``(gene_id, t, m, v)``: mean and population variance of the values at each time, NaN left out."""
    ok = x.where(~F.isnan("value"))
    return ok.groupBy("gene_id", "t").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
