"""Layer tables ``expr(cell_id, gene_id, layer, value)``: non-zero entries of count matrices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def layer(expr: DataFrame, name: str) -> DataFrame:
    return expr.where(F.col("layer") == name)


def with_total(expr: DataFrame, name: str = "X", parts: list[str] | None = None) -> DataFrame:
    """``expr`` plus a layer that sums ``parts`` (all layers if none are named)."""
    some = expr.where(F.col("layer").isin(parts)) if parts else expr
    total = some.groupBy("cell_id", "gene_id").agg(F.sum("value").alias("value"))
    return expr.unionByName(total.select("cell_id", "gene_id", F.lit(name).alias("layer"), "value"))


def wide(expr: DataFrame, layers: list[str]) -> DataFrame:
    """One row for each (cell, gene) that has an entry, one column for each layer, absent = 0."""
    sums = [F.sum(F.when(F.col("layer") == x, F.col("value")).otherwise(0.0)).alias(x) for x in layers]
    return expr.where(F.col("layer").isin(layers)).groupBy("cell_id", "gene_id").agg(*sums)


def densify(wide_expr: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """Every (cell, gene) with zeros where there is no entry. For statistics in which zeros take
    part and gene panels of a few thousand; the genes are the side that is sent to every task."""
    grid = cells.select("cell_id").join(F.broadcast(genes.select("gene_id")))
    out = grid.join(wide_expr, ["cell_id", "gene_id"], "left")
    return out.na.fill(0.0, [c for c in wide_expr.columns if c not in ("cell_id", "gene_id")])


def restrict(expr: DataFrame, cells: DataFrame | None = None, genes: DataFrame | None = None) -> DataFrame:
    if cells is not None:
        expr = expr.join(cells.select("cell_id"), "cell_id", "left_semi")
    if genes is not None:
        expr = expr.join(genes.select("gene_id"), "gene_id", "left_semi")
    return expr


def aggregate_datasets(datasets: list[DataFrame]) -> DataFrame:
    """Sum of several layer tables over the cells and genes that all of them have."""
    n = len(datasets)
    tagged = [d.withColumn("part", F.lit(i)) for i, d in enumerate(datasets)]
    every = reduce(DataFrame.unionByName, tagged)
    cells = every.groupBy("cell_id").agg(F.countDistinct("part").alias("n")).where(F.col("n") == n)
    genes = every.groupBy("gene_id").agg(F.countDistinct("part").alias("n")).where(F.col("n") == n)
    return restrict(every, cells, genes).groupBy("cell_id", "gene_id", "layer").agg(F.sum("value").alias("value"))


# predicates over annotation tables: plain Columns combine with &, | and ~


def compare(key: str, op: str, value) -> Column:
    c = F.col(key)
    return {
        "==": c == value, "!=": c != value, ">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value,
    }[op]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def select_cells(cells: DataFrame, groups: dict[str, list], how: str = "union") -> DataFrame:
    """Cells whose group columns hold one of the listed values, in any (union) or every (intersection) column."""
    conditions = [F.col(k).isin(v) for k, v in groups.items()]
    return cells.where(any_of(conditions) if how == "union" else all_of(conditions))
