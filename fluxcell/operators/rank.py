"""Rankings of genes and cells, multiple-test correction, regulator rankings, ROC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxcell.functions.scalars import ratio


def rank_genes(x: DataFrame, cells: DataFrame, absolute: bool = False, by: str = "mean") -> DataFrame:
    """``(grp, gene_id, value, rank)``: mean (or max) over a group's cells of the (absolute) value, descending.
    ``x`` is dense; ties go to the smaller gene id."""
    v = F.abs("value") if absolute else F.col("value")
    stat = (F.avg if by == "mean" else F.max)(v)
    g = x.join(cells, "cell_id").groupBy("grp", "gene_id").agg(stat.alias("value"))
    w = Window.partitionBy("grp").orderBy(F.desc("value"), "gene_id")
    return g.withColumn("rank", F.row_number().over(w))


def rank_cell_groups(x: DataFrame, cells: DataFrame, absolute: bool = False) -> DataFrame:
    """For each gene, the groups in order of their mean value."""
    v = F.abs("value") if absolute else F.col("value")
    g = x.join(cells, "cell_id").groupBy("gene_id", "grp").agg(F.avg(v).alias("value"))
    w = Window.partitionBy("gene_id").orderBy(F.desc("value"), "grp")
    return g.withColumn("rank", F.row_number().over(w))


def top_n(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def bh_simple(tests: DataFrame, p: str = "p") -> DataFrame:
    """q = p n / average rank, at most 1, not made monotone. Groups by column ``family``."""
    fam = Window.partitionBy("family")
    rank = F.rank().over(fam.orderBy(p)) + (F.count("*").over(Window.partitionBy("family", p)) - 1) / 2
    return tests.withColumn("q", F.least(F.lit(1.0), F.col(p) * F.count("*").over(fam) / rank))


def bh_monotone(tests: DataFrame, p: str = "p") -> DataFrame:
    """Benjamini-Hochberg: least of p n / rank over this and larger p-values, at most 1."""
    fam = Window.partitionBy("family")
    rank = F.rank().over(fam.orderBy(p)) + F.count("*").over(Window.partitionBy("family", p)) - 1
    raw = tests.withColumn("_raw", F.col(p) * F.count("*").over(fam) / rank)
    tail = fam.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return raw.withColumn("q", F.least(F.lit(1.0), F.min("_raw").over(tail))).drop("_raw")


def rank_jacobian(jac: DataFrame, mode: str = "full reg", absolute: bool = False, normalize: bool = False) -> DataFrame:
    """Rank ``jac(grp, cell_id, effector, regulator, value)`` averaged over each group's cells.

    full reg / full eff: regulators of each effector / effectors of each regulator; reg / eff: mean
    over the other side; int: pairs; switch: product of two mutually negative entries. Normalised
    values are divided by the pair's largest absolute value over groups (null where that is 0).
    Values that differ by rounding alone (the ninth digit) are ranked by name.
    """
    v = F.abs("value") if absolute else F.col("value")
    m = jac.groupBy("grp", "effector", "regulator").agg(F.avg(v).alias("value"))
    if normalize:
        top = F.max(F.abs("value")).over(Window.partitionBy("effector", "regulator"))
        m = m.withColumn("value", ratio(F.col("value"), top))
    if mode in ("full reg", "full eff"):
        part, other = ("effector", "regulator") if mode == "full reg" else ("regulator", "effector")
        w = Window.partitionBy("grp", part).orderBy(F.desc(F.round("value", 9)), other)
        return m.withColumn("rank", F.row_number().over(w))
    if mode in ("reg", "eff"):
        name = "regulator" if mode == "reg" else "effector"
        m = m.groupBy("grp", name).agg(F.avg("value").alias("value"))
        return m.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc(F.round("value", 9)), name)))
    if mode == "switch":
        back = m.select("grp", F.col("effector").alias("regulator"), F.col("regulator").alias("effector"), F.col("value").alias("back"))
        m = m.join(back, ["grp", "effector", "regulator"]).where("effector < regulator and value < 0 and back < 0")
        m = m.select("grp", "effector", "regulator", (F.col("value") * F.col("back")).alias("value"))
    w = Window.partitionBy("grp").orderBy(F.desc(F.round("value", 9)), "effector", "regulator")
    return m.withColumn("rank", F.row_number().over(w))


def aggregate_effects(jac: DataFrame, regulators: DataFrame, effectors: DataFrame) -> DataFrame:
    """Sums of ``jac(cell_id, effector, regulator, value)`` over gene sets ``(set, gene)`` on each side."""
    r = regulators.select(F.col("set").alias("regulator_set"), F.col("gene").alias("regulator"))
    e = effectors.select(F.col("set").alias("effector_set"), F.col("gene").alias("effector"))
    return jac.join(r, "regulator").join(e, "effector").groupBy("cell_id", "effector_set", "regulator_set").agg(F.sum("value").alias("value"))


def tf_priority(lists: DataFrame) -> DataFrame:
    """``lists(source, gene, position)``: priority 1 - position / list length, averaged over sources where absent counts 0."""
    n = lists.groupBy("source").agg(F.count("*").alias("n"))
    k = n.agg(F.count("*").alias("k"))
    p = lists.join(F.broadcast(n), "source").withColumn("p", 1 - ratio(F.col("position"), F.col("n")))
    return p.groupBy("gene").agg(F.sum("p").alias("s")).crossJoin(F.broadcast(k)).select("gene", ratio(F.col("s"), F.col("k")).alias("priority"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the curve of ``scored(family, score, truth)``, by rank sums with average ranks for ties."""
    fam = Window.partitionBy("family")
    rank = F.rank().over(fam.orderBy("score")) + (F.count("*").over(Window.partitionBy("family", "score")) - 1) / 2
    g = scored.withColumn("r", rank).groupBy("family").agg(
        F.sum(F.when(F.col("truth"), F.col("r")).otherwise(0.0)).alias("s"),
        F.count_if("truth").alias("p"),
        F.count_if(~F.col("truth")).alias("n"),
    )
    return g.select("family", ratio(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("n")).alias("auc"))


def regulatory_network(m: DataFrame, n_top: int) -> DataFrame:
    """The n_top edges of largest absolute value in each group of ``m(grp, regulator, effector, value)``."""
    return top_n(m, "grp", [F.desc(F.abs("value")), F.col("regulator"), F.col("effector")], n_top)


def clr_scores(m: DataFrame) -> DataFrame:
    """Context likelihood of ``m(regulator, effector, value)``: sqrt of the summed squares of positive z-scores,
    along the row (population deviation) and along the column (sample deviation)."""
    row, col = Window.partitionBy("regulator"), Window.partitionBy("effector")
    zr = ratio(F.col("value") - F.avg("value").over(row), F.stddev_pop("value").over(row))
    zc = ratio(F.col("value") - F.avg("value").over(col), F.stddev_samp("value").over(col))
    pos = lambda z: F.pow(F.greatest(F.coalesce(z, F.lit(0.0)), F.lit(0.0)), 2)
    return m.select("regulator", "effector", F.sqrt(pos(zr) + pos(zc)).alias("z"))
