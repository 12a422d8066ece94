"""Quality control of cells and genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxcell.functions.scalars import has_prefix, ratio

# Name prefixes of uninformative genes.
UNINFORMATIVE = ["MT-", "RPS", "RPL", "MRPS", "MRPL", "ERCC-"]


def cell_stats(x: DataFrame, mito_prefix: str = "MT-") -> DataFrame:
    """n_genes, n_counts and mitochondrial share of each cell of one layer."""
    mito = F.upper(F.col("gene_id").cast("string")).startswith(mito_prefix)
    return x.groupBy("cell_id").agg(
        F.count_if(F.col("value") > 0).alias("n_genes"),
        F.sum("value").alias("n_counts"),
        ratio(F.sum(F.when(mito, F.col("value")).otherwise(0.0)), F.sum("value")).alias("p_mito"),
    )


def gene_stats(x: DataFrame) -> DataFrame:
    return x.groupBy("gene_id").agg(F.count_if(F.col("value") > 0).alias("n_cells"), F.sum("value").alias("n_counts"))


def filter_cells_by_outliers(expr: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """``(cell_id, kept)``: in every layer named, the genes detected (value > 0) lie within its limits."""
    seen = [F.count_if((F.col("layer") == k) & (F.col("value") > 0)).alias(f"n_{k}") for k in limits]
    counts = expr.groupBy("cell_id").agg(*seen)
    kept: Column = F.lit(True)
    for k, (low, high) in limits.items():
        kept = kept & F.col(f"n_{k}").between(low, high)
    return counts.select("cell_id", kept.alias("kept"))


def filter_genes_by_outliers(
    expr: DataFrame, n_cells: DataFrame, limits: dict[str, dict[str, float]], shared: tuple[list[str], float] | None = None
) -> DataFrame:
    """``(gene_id, kept)``. In every layer named: cells detected >= min_cell, mean over all cells
    (zeros included) within min_avg..max_avg, sum >= min_count. ``shared``: over the given layers,
    the sum of entries that are non-zero in all of them reaches the count. ``n_cells``: one row."""
    aggs = []
    for k in limits:
        here = F.when(F.col("layer") == k, F.col("value"))
        aggs += [F.count_if(here > 0).alias(f"c_{k}"), F.coalesce(F.sum(here), F.lit(0.0)).alias(f"s_{k}")]
    out = expr.groupBy("gene_id").agg(*aggs).crossJoin(F.broadcast(n_cells))  # one row
    kept: Column = F.lit(True)
    for k, x in limits.items():
        mean = ratio(F.col(f"s_{k}"), F.col("n_cells"))
        kept = (
            kept
            & (F.col(f"c_{k}") >= x.get("min_cell", 0))
            & (mean >= x.get("min_avg", 0.0))
            & (mean <= x.get("max_avg", float("inf")))
            & (F.col(f"s_{k}") >= x.get("min_count", 0.0))
        )
    out = out.select("gene_id", kept.alias("kept"))
    if shared:
        layers, least = shared
        both = (
            expr.where(F.col("layer").isin(layers) & (F.col("value") > 0))
            .groupBy("cell_id", "gene_id")
            .agg(F.count_distinct("layer").alias("n"), F.sum("value").alias("v"))
            .where(F.col("n") == len(layers))
        )
        total = both.groupBy("gene_id").agg(F.sum("v").alias("shared"))
        enough = F.coalesce(F.col("shared"), F.lit(0.0)) >= least
        out = out.join(total, "gene_id", "left").select("gene_id", (F.col("kept") & enough).alias("kept"))
    return out


def filter_genes_by_clusters(
    expr: DataFrame, cells: DataFrame, least: dict[str, float], small: int = 40
) -> DataFrame:
    """``(gene_id, kept)``: for every layer the largest cluster mean exceeds its bound. A cluster of
    at most ``small`` cells uses the mean over all cells. ``cells(cell_id, grp)`` lists every cell."""
    sizes = cells.groupBy("grp").agg(F.count("*").alias("n"))
    all_cells = cells.agg(F.count("*").alias("n_all"))
    by = (
        expr.where(F.col("layer").isin(list(least)))
        .join(cells, "cell_id")
        .groupBy("gene_id", "layer", "grp")
        .agg(F.sum("value").alias("s"))
    )
    per = by.groupBy("gene_id", "layer").agg(F.sum("s").alias("s_all"))
    large = by.join(F.broadcast(sizes), "grp").where(F.col("n") > small)  # one row for each cluster
    top = large.groupBy("gene_id", "layer").agg(F.max(ratio(F.col("s"), F.col("n"))).alias("top"))
    any_small = sizes.agg(F.max((F.col("n") <= small).cast("int")).alias("any_small"))
    both = per.join(top, ["gene_id", "layer"], "left").crossJoin(F.broadcast(all_cells)).crossJoin(F.broadcast(any_small))
    overall = F.when(F.col("any_small") == 1, ratio(F.col("s_all"), F.col("n_all")))
    best = F.coalesce(F.greatest("top", overall), F.lit(0.0))
    bound = F.lit(0.0)
    for k, v in least.items():
        bound = F.when(F.col("layer") == k, F.lit(v)).otherwise(bound)
    passed = both.groupBy("gene_id").agg(F.count_if(best > bound).alias("n"))
    return passed.select("gene_id", (F.col("n") == len(least)).alias("kept"))


def filter_genes_by_pattern(genes: DataFrame, prefixes: list[str] | None = None, name: str = "gene_id") -> DataFrame:
    """``(gene_id, kept)``: names that start with none of the prefixes (case-sensitive)."""
    return genes.select("gene_id", (~has_prefix(F.col(name), prefixes or UNINFORMATIVE)).alias("kept"))


def filter_cells_by_variable_genes(x: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """Cells with a non-zero sum over the given genes."""
    on = x.join(genes.select("gene_id"), "gene_id", "left_semi").groupBy("cell_id").agg(F.sum("value").alias("s"))
    return cells.join(on.where("s <> 0"), "cell_id", "left_semi")


def filter_cells_by_quantile(cells: DataFrame, column: str, low: float = 0.01, high: float | None = 0.99) -> DataFrame:
    """Cells whose value lies within the exact quantiles; without ``high`` only the lower bound holds."""
    q = cells.agg(
        F.percentile(column, F.lit(low)).alias("q_low"),
        F.percentile(column, F.lit(1.0 if high is None else high)).alias("q_high"),
    )
    return cells.crossJoin(F.broadcast(q)).where(F.col(column).between(F.col("q_low"), F.col("q_high"))).select(cells.columns)
