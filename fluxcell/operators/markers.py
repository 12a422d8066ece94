"""Marker genes of groups: every group against every other, from stored entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxcell.functions.lineage import cut
from fluxcell.functions.scalars import ratio
from fluxcell.operators.rank import bh_monotone
from fluxcell.operators.stats import normal_tail


def group_markers(
    x: DataFrame, cells: DataFrame, least_fraction: float = 0.1, least_fold: float | None = None, truncate: bool = True, most_q: float | None = 0.05
) -> DataFrame:
    """``(gene_id, test_group, versus_group, specificity, exp_frac, diff_ratio_pos, rbc, log2_fc, u, p, q)`` for each ordered pair of groups.

    ``x(cell_id, gene_id, value)`` are stored entries, every other cell of ``cells(cell_id, grp)`` is 0. Genes found in at least ``least_fraction`` of the
    test cells are tested by Mann-Whitney U (average ranks, tie-corrected normal p), rank-biserial correlation 1 - 2 U / (n1 n2), and the log2 fold change of means
    (at least ``least_fold`` in size, if given; null where either mean is 0). With ``truncate`` only as many control cells as test cells count, those with the largest values.
    ``specificity`` is 1 - sqrt of the Jensen-Shannon divergence between the shares of the groups among the cells that express the gene and the control
    group alone; ``diff_ratio_pos`` is the difference of the shares with a positive value. q is Benjamini-Hochberg's over a test group's rows; only
    q < ``most_q`` stay, if given.

    Entries are counted by gene, group and value first: a pair's order statistics run over distinct values, and zeros are one row. Work
    is groups x distinct values, as groups are few.
    """
    size = cut(cells.groupBy("grp").agg(F.count("*").alias("n")))
    by = x.where("value <> 0").join(cells, "cell_id").groupBy("gene_id", "grp", "value").agg(F.count("*").alias("k"))
    by = cut(by)
    held = by.groupBy("gene_id", "grp").agg(F.sum("k").alias("held"))
    every = by.select("gene_id").distinct().crossJoin(F.broadcast(size))
    held = cut(every.join(held, ["gene_id", "grp"], "left").fillna(0, ["held"]))
    zeros = held.select("gene_id", "grp", F.lit(0.0).alias("value"), (F.col("n") - F.col("held")).alias("k")).where("k > 0")
    by = by.select("gene_id", "grp", "value", "k").unionByName(zeros)
    above = Window.partitionBy("gene_id", "grp").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    by = cut(by.withColumn("above", F.coalesce(F.sum("k").over(above), F.lit(0))))
    share = held.withColumn("all", F.sum("held").over(Window.partitionBy("gene_id")))
    share = share.select("gene_id", "grp", ratio(F.col("held"), F.col("all")).alias("share"), ratio(F.col("held"), F.col("n")).alias("exp_frac"))
    share = cut(share)
    a = size.select(F.col("grp").alias("test_group"), F.col("n").alias("n1"))
    b = size.select(F.col("grp").alias("versus_group"), F.col("n").alias("nc"))
    pairs = a.join(b, F.col("test_group") != F.col("versus_group"))  # groups are few
    most = F.least("n1", "nc") if truncate else F.col("nc")
    pairs = cut(pairs.select("test_group", "versus_group", "n1", most.alias("n2")))
    tested = share.where(F.col("exp_frac") >= least_fraction).select("gene_id", F.col("grp").alias("test_group"), "exp_frac")
    ask = cut(tested.join(F.broadcast(pairs), "test_group"))
    test = ask.join(by.withColumnRenamed("grp", "test_group"), ["gene_id", "test_group"])
    test = test.select("gene_id", "test_group", "versus_group", "value", F.col("k").alias("k1"), F.lit(0).cast("long").alias("k2"))
    control = ask.join(by.withColumnRenamed("grp", "versus_group"), ["gene_id", "versus_group"])
    kept = F.least("k", F.col("n2") - F.col("above"))
    control = control.where(kept > 0).select("gene_id", "test_group", "versus_group", "value", F.lit(0).cast("long").alias("k1"), kept.alias("k2"))
    key = ["gene_id", "test_group", "versus_group"]
    both = test.unionByName(control).groupBy(*key, "value").agg(F.sum("k1").alias("k1"), F.sum("k2").alias("k2"))
    k1, k2, k = F.col("k1"), F.col("k2"), F.col("k1") + F.col("k2")
    upto = Window.partitionBy(*key).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("before", F.coalesce(F.sum(k).over(upto), F.lit(0)))
    kd = k.cast("double")
    g = both.groupBy(*key).agg(
        F.sum("k1").alias("n1"),
        F.sum("k2").alias("n2"),
        F.sum(k1 * (F.col("before") + (k + 1) / 2.0)).alias("r1"),
        ratio(F.sum(k1 * F.col("value")), F.sum("k1")).alias("m1"),
        ratio(F.sum(k2 * F.col("value")), F.sum("k2")).alias("m2"),
        (ratio(F.sum(F.when(F.col("value") > 0, k1).otherwise(0)), F.sum("k1")) - ratio(F.sum(F.when(F.col("value") > 0, k2).otherwise(0)), F.sum("k2"))).alias("diff_ratio_pos"),
        F.sum(kd * (kd * kd - 1)).alias("tie"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    g = g.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - ratio(F.col("tie"), n * (n - 1))))
    z = ratio(F.greatest(F.abs(F.col("u") - n1 * n2 / 2) - 0.5, F.lit(0.0)), sd)
    fold = F.when((F.col("m1") > 0) & (F.col("m2") > 0), F.log2(ratio(F.col("m1"), F.col("m2"))))
    g = g.join(share.select("gene_id", F.col("grp").alias("versus_group"), F.col("share").alias("c")), ["gene_id", "versus_group"]).join(tested, ["gene_id", "test_group"])
    # with the control group alone as the other distribution, all shares but its own drop out of the divergence
    c = F.col("c")
    divergence = F.when(c > 0, c * F.log2(c) / 2).otherwise(0.0) + (1 - c) / 2 - (1 + c) / 2 * F.log2((1 + c) / 2)
    g = g.select(
        *key,
        (1 - F.sqrt(F.greatest(divergence, F.lit(0.0)))).alias("specificity"),
        "exp_frac",
        "diff_ratio_pos",
        (1 - 2 * ratio(F.col("u"), n1 * n2)).alias("rbc"),
        fold.alias("log2_fc"),
        "u",
        F.coalesce(normal_tail(z), F.lit(1.0)).alias("p"),
    )
    if least_fold is not None:
        g = g.where(F.coalesce(F.abs("log2_fc") >= least_fold, F.lit(True)))
    g = bh_monotone(cut(g).withColumn("family", F.col("test_group"))).drop("family")
    return g.where(F.col("q") < most_q) if most_q is not None else g
