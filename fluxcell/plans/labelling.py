"""Labelling recipes: from counts of new and of all molecules by time to degradation rates, synthesis and velocities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxcell.functions.lineage import cut
from fluxcell.functions.scalars import ratio
from fluxcell.operators import kinetics

LEAST = 1e-12  # of a variance, so that its weight is finite
KINDS = ("one-shot", "kin", "deg", "mix")


@dataclass
class Labelled:
    kind: str
    params: DataFrame  # gene_id, gamma, r2, alpha, n_times
    velocity: DataFrame  # cell_id, gene_id, v
    transition: DataFrame  # gene_id


def labelling_kind(lab: DataFrame) -> tuple[str, float | None]:
    """(kind, time of the largest labelled share) of ``lab(t, new, total)``: ``one-shot`` with one time, ``kin`` if the share is largest at the
    last time, ``deg`` at the first, else ``mix``: labelling, then a chase."""
    share = lab.groupBy("t").agg(ratio(F.sum("new"), F.sum("total")).alias("y")).where("y is not null")
    one = share.agg(F.count("*"), F.min("t"), F.max("t"), F.max_by("t", F.struct("y", "t"))).first()
    if one[0] <= 1:
        return "one-shot", one[3]
    return ("kin" if one[3] == one[2] else "deg" if one[3] == one[1] else "mix"), one[3]


def normalized(lab: DataFrame) -> DataFrame:
    """``lab(cell_id, gene_id, t, new, total)`` with both counts divided by the cell's total over the mean cell's."""
    per = lab.groupBy("cell_id").agg(F.sum("total").alias("s"))
    mean = per.agg(F.avg("s").alias("mean"))
    f = per.crossJoin(F.broadcast(mean)).select("cell_id", (F.col("s") / F.col("mean")).alias("f"))
    return lab.join(f, "cell_id").select("cell_id", "gene_id", "t", ratio(F.col("new"), F.col("f")).alias("new"), ratio(F.col("total"), F.col("f")).alias("total"))


def strata(lab: DataFrame) -> DataFrame:
    """``(gene_id, t, k, var_k, r2)``: slopes of new on total through 0 at each time, their variances from second moments, and their fit.

    Cells without a stored value add nothing to any of the sums but r2, which is over the stored ones.
    """
    n, y2, xy, x2 = F.count("*"), F.sum(F.col("new") * F.col("new")), F.sum(F.col("new") * F.col("total")), F.sum(F.col("total") * F.col("total"))
    s = lab.groupBy("gene_id", "t").agg(n.alias("n"), y2.alias("y2"), xy.alias("xy"), x2.alias("x2"), F.sum("new").alias("y"))
    s = s.withColumn("k", ratio(F.col("xy"), F.col("x2")))
    rest = F.greatest(F.col("y2") - F.col("k") * F.col("xy"), F.lit(0.0))
    spread = F.col("y2") - F.col("y") * F.col("y") / F.col("n")
    return s.select("gene_id", "t", "k", ratio(rest, F.col("n") * F.col("x2")).alias("var_k"), (1 - ratio(rest, spread)).alias("r2"))


def _rise(s: DataFrame) -> DataFrame:
    """``(gene_id, gamma, precision, r2, n_times)`` from shares that rise as 1 - exp(-gamma t): a weighted line of -ln(1 - k) through 0."""
    s = s.where("t > 0 and k < 1").select("gene_id", "t", (-F.log(1 - F.col("k"))).alias("y"), (F.pow(1 - F.col("k"), 2) / F.greatest("var_k", F.lit(LEAST))).alias("w"))
    t, y, w = F.col("t"), F.col("y"), F.col("w")
    g = s.groupBy("gene_id").agg(
        F.sum(w * t * t).alias("precision"), F.sum(w * t * y).alias("ty"), F.sum(w * y * y).alias("yy"), F.sum(w * y).alias("sy"), F.sum(w).alias("sw"), F.count("*").alias("n_times")
    )
    gamma = ratio(F.col("ty"), F.col("precision"))
    spread = F.col("yy") - F.col("sy") * F.col("sy") / F.col("sw")
    rest = F.col("yy") - gamma * F.col("ty")
    r2 = F.when(F.col("n_times") > 1, 1 - ratio(rest, spread))
    return g.select("gene_id", gamma.alias("gamma"), "precision", r2.alias("r2"), "n_times")


def _fall(s: DataFrame) -> DataFrame:
    """``(gene_id, gamma, precision, r2, n_times)`` from shares that fall as exp(-gamma t): a weighted line of ln(k)."""
    s = s.where("k > 0").select("gene_id", "t", F.log("k").alias("y"), (F.col("k") * F.col("k") / F.greatest("var_k", F.lit(LEAST))).alias("w"))
    t, y, w = F.col("t"), F.col("y"), F.col("w")
    g = s.groupBy("gene_id").agg(
        F.sum(w).alias("sw"), F.sum(w * t).alias("st"), F.sum(w * y).alias("sy"), F.sum(w * t * t).alias("tt"), F.sum(w * t * y).alias("ty"), F.sum(w * y * y).alias("yy"), F.count("*").alias("n_times")
    )
    vt, vy = (F.col(a * 2) - F.col(f"s{a}") * F.col(f"s{a}") / F.col("sw") for a in "ty")
    cov = F.col("ty") - F.col("st") * F.col("sy") / F.col("sw")
    two = F.col("n_times") > 1
    return g.select("gene_id", F.when(two, -ratio(cov, vt)).alias("gamma"), F.when(two, vt).alias("precision"), F.when(two, ratio(cov * cov, vt * vy)).alias("r2"), "n_times")


def labelling_recipe(lab: DataFrame, kind: str | None = None, min_r2: float | None = None) -> Labelled:
    """Rates and velocities of ``lab(cell_id, gene_id, t, new, total)``, stored entries; the kind of experiment is read from the data unless given.

    Counts are scaled by the cells' totals. At each time the slope of new on total estimates the labelled share, weighted in later fits by one over
    its variance. gamma follows from the shares: ``one-shot`` from the one time, ``kin`` from their rise, ``deg`` from their fall, ``mix`` from the rise up to the
    time of the largest share and the fall from there, by the precision of each. alpha is gamma times new over 1 - exp(-gamma t) (of ``deg`` and ``mix``:
    times the mean total); velocities are synthesis (of the cell for ``one-shot`` and ``kin``) less gamma total. Transition genes have gamma and r2 over
    their bounds: 0.9 for ``kin``, else 0.01. A gene without a rate has none and no velocity.
    """
    found, peak = labelling_kind(lab)
    kind = kind or found
    if kind not in KINDS:
        raise ValueError(kind)
    lab = cut(normalized(lab))
    s = cut(strata(lab))
    if kind == "one-shot":
        gamma = -F.log(1 - F.col("k")) / F.col("t")
        params = s.where("k < 1 and t > 0").select("gene_id", gamma.alias("gamma"), "r2", F.lit(1).cast("long").alias("n_times"))
    elif kind == "mix":
        both = _rise(s.where(F.col("t") <= peak)).unionByName(_fall(s.where(F.col("t") >= peak))).where("gamma is not null and precision > 0")
        params = both.groupBy("gene_id").agg(
            ratio(F.sum(F.col("gamma") * F.col("precision")), F.sum("precision")).alias("gamma"),
            F.min("r2").alias("r2"),
            (F.sum("n_times") - F.count("*") + 1).alias("n_times"),
        )
    else:
        params = (_rise(s) if kind == "kin" else _fall(s)).select("gene_id", "gamma", "r2", "n_times")
    params = cut(params.where("gamma is not null"))
    j = lab.join(params.select("gene_id", "gamma"), "gene_id")
    made = F.coalesce(ratio(F.col("gamma"), 1 - F.exp(-F.col("gamma") * F.col("t"))), ratio(F.lit(1.0), F.col("t")))
    if kind in ("one-shot", "kin"):
        alpha = j.groupBy("gene_id").agg(ratio(F.first("gamma") * F.sum("new"), F.sum(1 - F.exp(-F.col("gamma") * F.col("t")))).alias("alpha"))
        v = made * F.col("new") - F.col("gamma") * F.col("total")
        velocity = j.select("cell_id", "gene_id", v.alias("v"))
    else:
        alpha = j.groupBy("gene_id").agg((F.first("gamma") * F.avg("total")).alias("alpha"))
        velocity = j.join(alpha, "gene_id").select("cell_id", "gene_id", (F.col("alpha") - F.col("gamma") * F.col("total")).alias("v"))
    params = cut(params.join(alpha, "gene_id").select("gene_id", "gamma", "r2", "alpha", "n_times"))
    least = min_r2 if min_r2 is not None else 0.9 if kind == "kin" else 0.01
    return Labelled(kind, params, velocity, kinetics.transition_genes(params, least))
