"""Chromatin and RNA: chromatin velocity, peak to gene links, gene activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxcell.functions.scalars import ratio


def chromatin_velocity(cus: DataFrame, outlier: float = 99.8, extreme: float = 0.95) -> DataFrame:
    """``(cell_id, gene_id, gamma, velocity)`` of dense ``cus(cell_id, gene_id, c, u, s)``.

    Each value is shifted by the gene's minimum. All-zero cells and cells above the outlier
    percentile (80..100) of any value are left out of the fit. High cells have c, u and s of at
    least a tenth of the gene's maximum; those with u or s at or above their extreme quantile give
    gamma = sum(u s) / sum(s s). The velocity is u - gamma s of every cell.
    """
    low = cus.groupBy("gene_id").agg(*[F.min(k).alias(f"{k}0") for k in "cus"])
    x = cus.join(low, "gene_id").select("cell_id", "gene_id", *[(F.col(k) - F.col(f"{k}0")).alias(k) for k in "cus"])
    p = min(max(outlier, 80.0), 100.0) / 100
    some = x.where("c > 0 or u > 0 or s > 0")
    top = some.groupBy("gene_id").agg(*[F.percentile(k, F.lit(p)).alias(f"{k}p") for k in "cus"])
    fit = some.join(top, "gene_id").where("c <= cp and u <= up and s <= sp")
    most = fit.groupBy("gene_id").agg(*[F.max(k).alias(f"{k}m") for k in "cus"])
    high = fit.join(most, "gene_id").where("c >= 0.1 * cm and u >= 0.1 * um and s >= 0.1 * sm")
    edge = high.groupBy("gene_id").agg(*[F.percentile(k, F.lit(extreme)).alias(f"{k}e") for k in "us"])
    used = high.join(edge, "gene_id").where("u >= ue or s >= se")
    g = used.groupBy("gene_id").agg(ratio(F.sum(F.col("u") * F.col("s")), F.sum(F.col("s") * F.col("s"))).alias("gamma"))
    return x.join(g, "gene_id").select("cell_id", "gene_id", "gamma", (F.col("u") - F.col("gamma") * F.col("s")).alias("velocity"))


def link_peaks(peaks: DataFrame, genes: DataFrame, distance: int, bin_size: int | None = None) -> DataFrame:
    """``(gene_id, peak_id, distance)``: peaks(peak_id, chrom, start, end) that overlap the gene's start
    extended by ``distance`` on both sides; genes(gene_id, chrom, tss).

    An interval join by bins: both sides list the bins that they touch, meet on (chromosome, bin),
    and each pair is kept in its first shared bin, so no side is broadcast and no pair repeats.
    """
    b = bin_size or max(1, 2 * distance)
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / b), F.floor(hi / b)))
    g = genes.select("gene_id", "chrom", "tss", bins(F.col("tss") - distance, F.col("tss") + distance).alias("bin"))
    p = peaks.select("peak_id", F.col("chrom"), "start", "end", bins(F.col("start"), F.col("end")).alias("bin"))
    lo, hi = F.col("tss") - distance, F.col("tss") + distance
    j = g.join(p, ["chrom", "bin"]).where((F.col("start") <= hi) & (F.col("end") >= lo))
    j = j.where(F.col("bin") == F.floor(F.greatest("start", lo) / b))
    away = F.greatest(F.col("start") - F.col("tss"), F.col("tss") - F.col("end"), F.lit(0))
    return j.select("gene_id", "peak_id", away.alias("distance"))


def gene_activity(links: DataFrame, peak_counts: DataFrame) -> DataFrame:
    """``(cell_id, gene_id, value)``: counts of the linked peaks added up by gene."""
    j = links.select("gene_id", "peak_id").join(peak_counts, "peak_id")
    return j.groupBy("cell_id", "gene_id").agg(F.sum("value").alias("value"))


def chromatin_velocity_stochastic(cus: DataFrame, us2: DataFrame, extreme: float = 0.95) -> DataFrame:
    """``(gene_id, gamma, r2)`` from first and second moments ``us2(cell_id, gene_id, us, ss)`` as well: first
    moments count in cells whose u or s reaches its extreme quantile, second moments (2 ss - s, 2 us + u) in all;
    the two parts are weighted by 1 / the deviation of their residuals; r2 is against sum(u^2)."""
    edge = cus.groupBy("gene_id").agg(*[F.percentile(k, F.lit(extreme)).alias(f"{k}e") for k in "us"])
    x = cus.join(edge, "gene_id").join(us2, ["cell_id", "gene_id"])
    used = (F.col("u") >= F.col("ue")) | (F.col("s") >= F.col("se"))
    first = lambda c: F.when(used, F.col(c)).otherwise(0.0)
    x = x.withColumns(
        {"y1": first("u"), "x1": first("s"), "y2": 2 * F.col("us") + F.col("u"), "x2": 2 * F.col("ss") - F.col("s")}
    )
    slope = lambda i: ratio(F.sum(F.col(f"y{i}") * F.col(f"x{i}")), F.sum(F.col(f"x{i}") * F.col(f"x{i}")))
    g = x.groupBy("gene_id").agg(slope(1).alias("g1"), slope(2).alias("g2"))
    x = x.join(g, "gene_id")
    sums = {}
    for i in (1, 2):
        sums[f"d{i}"] = F.stddev_pop(F.col(f"y{i}") - F.col(f"g{i}") * F.col(f"x{i}"))
        sums[f"a{i}"] = F.sum(F.col(f"y{i}") * F.col(f"x{i}"))
        sums[f"b{i}"] = F.sum(F.col(f"x{i}") * F.col(f"x{i}"))
    w = x.groupBy("gene_id").agg(*[v.alias(k) for k, v in sums.items()])
    # a part that its slope fits exactly has no finite weight and is left out
    part = lambda c, i: F.when(F.col(f"d{i}") > 1e-9, F.col(f"{c}{i}") / (F.col(f"d{i}") * F.col(f"d{i}"))).otherwise(0.0)
    w = w.select("gene_id", ratio(part("a", 1) + part("a", 2), part("b", 1) + part("b", 2)).alias("gamma"))
    r = cus.join(w, "gene_id")
    res = F.col("u") - F.col("gamma") * F.col("s")
    return r.groupBy("gene_id", "gamma").agg((1 - ratio(F.sum(res * res), F.sum(F.col("u") * F.col("u")))).alias("r2"))
