"""Gene statistics and feature selection. Tables hold non-zero values; n_cells brings in the zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxcell.functions.scalars import ratio


def mean_variance(x: DataFrame, n_cells: DataFrame) -> DataFrame:
    """``(gene_id, mean, variance)`` over all cells; variance with n - 1, 0 where undefined."""
    s = x.groupBy("gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    s = s.crossJoin(F.broadcast(n_cells))
    mean = ratio(F.col("s"), F.col("n_cells"))
    var = (ratio(F.col("q"), F.col("n_cells")) - mean * mean) * ratio(F.col("n_cells"), F.col("n_cells") - 1)
    return s.select("gene_id", mean.alias("mean"), F.coalesce(var, F.lit(0.0)).alias("variance"))


def log_mean_cv(x: DataFrame, n_cells: DataFrame) -> DataFrame:
    """``(gene_id, log_m, log_cv)``: log2 of mean and of population CV, 0 where undefined."""
    s = x.groupBy("gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    s = s.crossJoin(F.broadcast(n_cells))
    mean = ratio(F.col("s"), F.col("n_cells"))
    sd = F.sqrt(F.greatest(ratio(F.col("q"), F.col("n_cells")) - mean * mean, F.lit(0.0)))
    cv = ratio(sd, mean)
    log = lambda c: F.when(c > 0, F.log2(c)).otherwise(F.lit(0.0))
    return s.select("gene_id", log(mean).alias("log_m"), log(cv).alias("log_cv"))


def seurat_dispersion(stats: DataFrame, n_bins: int = 20, n_top: int = 2000) -> DataFrame:
    """``(gene_id, mean, dispersion, score, selected)`` of ``stats(gene_id, mean, variance)``.

    ln(variance / mean) is z-scored within equal-width, right-closed bins of log1p(mean); a bin
    with one gene uses its mean as deviation and 0 as mean. The n_top-th largest score is the
    threshold, ties included. Gene means are reported, not bin means.
    """
    disp = ratio(F.col("variance"), F.col("mean"))
    g = stats.select(
        "gene_id",
        F.log1p("mean").alias("m"),
        F.when(disp > 0, F.log(F.when(disp > 0, disp))).alias("d"),
    )
    edge = g.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / n_bins
    at = F.when(F.col("hi") > F.col("lo"), F.ceil((F.col("m") - F.col("lo")) / width)).otherwise(F.lit(1))
    g = g.crossJoin(F.broadcast(edge)).withColumn("bin", F.greatest(at, F.lit(1)))
    bins = g.groupBy("bin").agg(F.avg("d").alias("bm"), F.stddev_samp("d").alias("bs"))
    one = F.col("bs").isNull()
    score = ratio(F.col("d") - F.when(one, 0.0).otherwise(F.col("bm")), F.when(one, F.col("bm")).otherwise(F.col("bs")))
    g = g.join(F.broadcast(bins), "bin").select("gene_id", "m", "d", score.alias("score"))  # at most n_bins rows
    top = g.orderBy(F.desc_nulls_last("score")).limit(n_top).agg(F.min("score").alias("cut"))
    return g.crossJoin(F.broadcast(top)).select(
        "gene_id",
        F.col("m").alias("mean"),
        F.col("d").alias("dispersion"),
        "score",
        F.coalesce(F.col("score") >= F.col("cut"), F.lit(False)).alias("selected"),
    )


def fano_selection(stats: DataFrame) -> DataFrame:
    """``(gene_id, fano, expected, selected)`` of ``stats(gene_id, mean, variance)`` (population variance).

    A = least CV among the 20 genes of largest mean, B = sqrt of the median Fano factor in the
    10-90 % box of both means and Fano factors; expected = A^2 mean + B^2; a gene is selected if
    its ratio to the expected factor exceeds 1 + the standard deviation of Fano factors in the box.
    """
    g = stats.where("mean > 0").withColumn("fano", ratio(F.col("variance"), F.col("mean")))
    a = (
        g.orderBy(F.desc("mean"), "gene_id").limit(20).agg(F.min(ratio(F.sqrt("variance"), F.col("mean"))).alias("a"))
    )
    box = g.agg(
        *[F.percentile(c, F.lit(p)).alias(f"{c}_{n}") for c in ("mean", "fano") for p, n in ((0.1, "lo"), (0.9, "hi"))]
    )
    boxed = g.crossJoin(F.broadcast(box)).where(
        F.col("mean").between(F.col("mean_lo"), F.col("mean_hi")) & F.col("fano").between(F.col("fano_lo"), F.col("fano_hi"))
    )
    b = boxed.agg(F.sqrt(F.percentile("fano", F.lit(0.5))).alias("b"), (1 + F.stddev_pop("fano")).alias("t"))
    expected = F.col("a") * F.col("a") * F.col("mean") + F.col("b") * F.col("b")
    return (
        g.crossJoin(F.broadcast(a))
        .crossJoin(F.broadcast(b))
        .select(
            "gene_id",
            "fano",
            expected.alias("expected"),
            F.coalesce(ratio(F.col("fano"), expected) > F.col("t"), F.lit(False)).alias("selected"),
        )
    )


def gini(x: DataFrame, n_cells: DataFrame) -> DataFrame:
    """Gini coefficient of each gene over all cells, of values less the global minimum (0 where any
    entry is absent) plus 1e-7: sum((2 i - n - 1) x_i) / (n sum x_i). Zeros take ranks 1..n - k, and
    stored values are counted by gene and value first, so that only distinct ones are ranked."""
    low = x.agg(F.count("*").alias("entries"), F.count_distinct("gene_id").alias("g"), F.min("value").alias("mn"))
    low = low.crossJoin(n_cells).select(
        "n_cells", F.when(F.col("entries") < F.col("g") * F.col("n_cells"), F.least("mn", F.lit(0.0))).otherwise(F.col("mn")).alias("low")
    )
    by = x.groupBy("gene_id", "value").agg(F.count("*").alias("c"))
    w = Window.partitionBy("gene_id").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    v = F.col("value") - F.col("low") + 1e-7
    k = by.groupBy("gene_id").agg(F.sum("c").alias("k"))
    ranked = by.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0))).join(k, "gene_id").crossJoin(F.broadcast(low))
    n, c = F.col("n_cells"), F.col("c")
    zeros = n - F.col("k")
    zero = F.lit(1e-7) - F.col("low")
    ranks = c * (2 * (F.col("before") + zeros) + c + 1)  # twice the sum of the ranks of the equal values
    out = ranked.groupBy("gene_id", "k", "n_cells", "low").agg(
        F.sum((ranks - c * (n + 1)) * v).alias("top"), F.sum(c * v).alias("sum")
    )
    # ranks 1..zeros of the absent entries: sum(2 i - n - 1) = zeros (zeros - n)
    top = F.col("top") + zeros * (zeros - n) * zero
    return out.select("gene_id", ratio(top, n * (F.col("sum") + zeros * zero)).alias("gini"))


def new_to_total(wide_expr: DataFrame, by: str, new: str, total: str) -> DataFrame:
    """Share of new in total counts, by cell or by gene."""
    return wide_expr.groupBy(by).agg(ratio(F.sum(new), F.sum(total)).alias("ntr"))


def gene_fraction(x: DataFrame) -> DataFrame:
    total = x.agg(F.sum("value").alias("all"))
    per = x.groupBy("gene_id").agg(F.sum("value").alias("s"))
    return per.crossJoin(F.broadcast(total)).select("gene_id", ratio(F.col("s"), F.col("all")).alias("frac"))


def highest_fraction_genes(x: DataFrame, n_top: int = 30) -> DataFrame:
    """``(cell_id, gene_id, rank, fraction)``: of the genes with the largest sums, their share in each cell."""
    top = x.groupBy("gene_id").agg(F.sum("value").alias("s")).orderBy(F.desc("s"), "gene_id").limit(n_top)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("s"), "gene_id")))  # n_top rows
    cell = x.groupBy("cell_id").agg(F.sum("value").alias("t"))
    return x.join(F.broadcast(top), "gene_id").join(cell, "cell_id").select(
        "cell_id", "gene_id", "rank", ratio(F.col("value"), F.col("t")).alias("fraction")
    )
