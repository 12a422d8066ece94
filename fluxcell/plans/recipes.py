"""Preprocessing recipes: chains of operators with data-dependent defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxcell.functions.lineage import cut
from fluxcell.functions.scalars import ratio
from fluxcell.operators import decompose, matrix, normalize, qc, select, stats


@dataclass
class Prepared:
    cells: DataFrame
    genes: DataFrame
    expr: DataFrame
    pca: DataFrame | None = None
    loadings: DataFrame | None = None


def _n(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count("*").alias("n_cells"))


def filtered(expr: DataFrame, cells: DataFrame, min_genes: float, min_cells: float) -> tuple[DataFrame, DataFrame]:
    """Cells with at least min_genes genes and genes found in at least min_cells cells, and their entries."""
    x = cut(matrix.with_total(expr))
    kept_cells = cut(qc.filter_cells_by_outliers(x, {"X": (min_genes, float("inf"))}).where("kept").select("cell_id"))
    x = matrix.restrict(x, kept_cells)
    kept_genes = qc.filter_genes_by_outliers(x, _n(kept_cells), {"X": {"min_cell": min_cells}}).where("kept").select("gene_id")
    return cut(cells.join(kept_cells, "cell_id", "left_semi")), cut(matrix.restrict(x, None, kept_genes))


def choose(genes: DataFrame, append: list | None = None, exclude: list | None = None, force: list | None = None) -> DataFrame:
    """``genes(gene_id, selected, ...)`` with genes added, left out, or (``force``) no others but those named."""
    chosen = F.col("selected")
    if force is not None:
        chosen = F.col("gene_id").isin(force)
    elif append:
        chosen = chosen | F.col("gene_id").isin(append)
    if exclude:
        chosen = chosen & ~F.col("gene_id").isin(exclude)
    return genes.withColumn("selected", chosen)


def finish(
    p: Prepared, n_pcs: int, covariates: DataFrame | None = None, names: tuple[str, ...] = (), phases: DataFrame | None = None,
    new: str | None = None,
) -> Prepared:
    """What recipes end with, on the selected genes of layer X: the covariates are regressed out, cells are put
    on ``n_pcs`` components, the cell cycle is scored by ``phases(gene_id, phase)``, and the share of layer ``new`` in X is noted."""
    chosen = p.genes.where("selected").select("gene_id")
    x = matrix.restrict(matrix.layer(p.expr, "X"), None, chosen).select("cell_id", "gene_id", "value")
    if names:
        wide = matrix.densify(x, p.cells, chosen)  # residuals of absent entries are not 0
        x = stats.regress_out(wide, covariates, names)
    cells = p.cells
    if phases is not None:
        cells = cells.join(stats.cell_cycle(matrix.layer(p.expr, "X"), phases), "cell_id", "left")
    if new is not None:
        sums = [F.sum(F.when(F.col("layer") == c, F.expm1("value"))).alias(n) for c, n in ((new, "new"), ("X", "all"))]
        share = p.expr.groupBy("cell_id").agg(*sums).select("cell_id", ratio(F.coalesce("new", F.lit(0.0)), F.col("all")).alias("ntr"))
        cells = cells.join(share, "cell_id", "left")
    scores, loadings, _ = decompose.gene_pca(x, p.cells, chosen, n_pcs)
    return Prepared(cells, p.genes, p.expr, scores, loadings)


def monocle(
    expr: DataFrame, cells: DataFrame, n_top: int = 2000, append: list | None = None, exclude: list | None = None,
    force: list | None = None, n_pcs: int | None = None, **more,
) -> Prepared:
    """Filter cells and genes, size factors, normalise, select by dispersion, log1p, and (``n_pcs``) what
    ``finish`` does. Thresholds follow the data: at least min(50, 1 % of genes) genes a cell and max(5, 1 % of cells) cells a gene."""
    size = expr.agg(F.count_distinct("gene_id").alias("g"), F.count_distinct("cell_id").alias("c")).first()
    cells, x = filtered(expr, cells, min(50, 0.01 * size["g"]), max(5, 0.01 * size["c"]))
    factors = normalize.size_factors(matrix.layer(x, "X"), cells)
    x = cut(normalize.normalize(x, factors))
    spread = select.mean_variance(matrix.layer(x, "X"), _n(cells))
    genes = cut(choose(select.seurat_dispersion(spread, n_top=n_top), append, exclude, force))
    p = Prepared(cells.join(factors, "cell_id"), genes, x.withColumn("value", F.log1p("value")))
    return finish(p, n_pcs, **more) if n_pcs else p


def monocle_pearson(expr: DataFrame, cells: DataFrame, n_top: int = 2000, n_pcs: int | None = None) -> Prepared:
    """As ``monocle``, with Pearson residuals of the selected genes' filtered counts (stored entries) as layer X."""
    size = expr.agg(F.count_distinct("gene_id").alias("g"), F.count_distinct("cell_id").alias("c")).first()
    cells, x = filtered(expr, cells, min(50, 0.01 * size["g"]), max(5, 0.01 * size["c"]))
    factors = normalize.size_factors(matrix.layer(x, "X"), cells)
    even = normalize.normalize(matrix.layer(x, "X"), factors)
    genes = select.seurat_dispersion(select.mean_variance(even, _n(cells)), n_top=n_top)
    total = matrix.layer(x, "X").select("cell_id", "gene_id", "value")
    residuals = matrix.restrict(pearson_residuals(total, cells), None, genes.where("selected"))
    p = Prepared(cells.join(factors, "cell_id"), genes, residuals.withColumn("layer", F.lit("X")))
    return finish(p, n_pcs) if n_pcs else p


def seurat(expr: DataFrame, cells: DataFrame, n_top: int = 2000, scale_to: float = 1e4, n_pcs: int | None = None, **more) -> Prepared:
    """Filter, scale every cell to one total, log1p, select by dispersion of normalised counts, and (``n_pcs``) ``finish``."""
    cells, x = filtered(expr, cells, 1, 5)
    factors = normalize.size_factors(matrix.layer(x, "X"), cells, scale_to=scale_to)
    x = cut(normalize.normalize(x, factors))
    genes = select.seurat_dispersion(select.mean_variance(matrix.layer(x, "X"), _n(cells)), n_top=n_top)
    p = Prepared(cells, genes, x.withColumn("value", F.log1p("value")))
    return finish(p, n_pcs, **more) if n_pcs else p


def pf_log_pf(expr: DataFrame, cells: DataFrame, n_pcs: int | None = None) -> Prepared:
    """Filter, then proportional fitting, log1p, proportional fitting of the summed layer, and (``n_pcs``) components of all genes kept."""
    cells, x = filtered(expr, cells, 1, 5)
    total = matrix.layer(x, "X")
    genes = total.select("gene_id").distinct().withColumn("selected", F.lit(True))
    p = Prepared(cells, genes, normalize.pf_log_pf(total, _n(cells)))
    return finish(p, n_pcs) if n_pcs else p


def pearson_residuals(x: DataFrame, cells: DataFrame, theta: float = 100.0) -> DataFrame:
    """Analytic residuals (x - mu) / sqrt(mu + mu^2 / theta), mu = cell total * gene share, clipped to the square
    root of the cell count, for the stored entries; formula of Lause, Berens and Kobak (2021)."""
    ct = x.groupBy("cell_id").agg(F.sum("value").alias("ct"))
    gt = x.groupBy("gene_id").agg(F.sum("value").alias("gt"))
    one = x.agg(F.sum("value").alias("all")).crossJoin(_n(cells))
    mu = F.col("ct") * F.col("gt") / F.col("all")
    r = (F.col("value") - mu) / F.sqrt(mu + mu * mu / theta)
    top = F.sqrt(F.col("n_cells").cast("double"))
    j = x.join(ct, "cell_id").join(gt, "gene_id").crossJoin(F.broadcast(one))
    return j.select("cell_id", "gene_id", F.greatest(F.least(r, top), -top).alias("value"))
