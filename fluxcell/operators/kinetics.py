"""Kinetic rates of each gene and the velocities that follow. One or two grouped passes each."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxcell.functions.scalars import gamma_from_old, ratio


def gamma_ols(us: DataFrame, percent_left: float = 5.0, n_cells: DataFrame | None = None) -> DataFrame:
    """Steady-state slope of u on s for each gene of ``us(cell_id, gene_id, u, s)``.

    Cells with s / max s + u / max u at or above the (100 - percent_left)th percentile (maxima at
    least 1e-3) give the slope through the origin, mean(s u) / mean(s^2). Returns gamma, the
    number of such cells, r2 on them and on all cells, and the Gaussian log-likelihood on them.

    With ``n_cells`` (one row), us holds stored entries only and all other cells of a gene are one
    row of zeros with their number; without, us is dense.
    """
    us = us.select("gene_id", "u", "s", F.lit(1).cast("long").alias("k"))
    top = us.groupBy("gene_id").agg(
        F.greatest(F.max("s"), F.lit(1e-3)).alias("ms"), F.greatest(F.max("u"), F.lit(1e-3)).alias("mu"), F.sum("k").alias("held")
    )
    if n_cells is not None:
        rest = top.crossJoin(F.broadcast(n_cells)).select(
            "gene_id", F.lit(0.0).alias("u"), F.lit(0.0).alias("s"), (F.col("n_cells") - F.col("held")).alias("k")
        )
        us = us.unionByName(rest.where("k > 0"))
    both = us.join(top, "gene_id").withColumn("e", F.col("s") / F.col("ms") + F.col("u") / F.col("mu"))
    edge = both.groupBy("gene_id").agg(F.percentile("e", F.lit(1 - percent_left / 100), F.col("k")).alias("edge"))
    both = both.join(edge, "gene_id").withColumn("in", F.col("e") >= F.col("edge"))
    here = lambda c: F.when(F.col("in"), c)
    k = F.col("k")
    g = both.groupBy("gene_id").agg(
        ratio(F.sum(here(k * F.col("s") * F.col("u"))), F.sum(here(k * F.col("s") * F.col("s")))).alias("gamma"),
        ratio(F.sum(here(k * F.col("u"))), F.sum(here(k))).alias("m_in"),
        ratio(F.sum(k * F.col("u")), F.sum(k)).alias("m_all"),
    )
    res = F.col("u") - F.col("gamma") * F.col("s")
    off = lambda m: k * (F.col("u") - F.col(m)) * (F.col("u") - F.col(m))
    fit = both.join(g, "gene_id").groupBy("gene_id", "gamma").agg(
        F.sum(F.when(F.col("in"), k).otherwise(0)).alias("n"),
        ratio(F.sum(here(k * res * res)), F.sum(here(k))).alias("e_in"),
        ratio(F.sum(here(off("m_in"))), F.sum(here(k))).alias("v_in"),
        ratio(F.sum(k * res * res), F.sum(k)).alias("e_all"),
        ratio(F.sum(off("m_all")), F.sum(k)).alias("v_all"),
    )
    sound = F.when(F.col("e_in") > 1e-18, F.col("e_in"))  # no likelihood of an exact fit
    ll = -F.col("n") / 2 * (F.log(2 * math.pi * sound) + 1)
    return fit.select(
        "gene_id",
        "gamma",
        "n",
        (1 - ratio(F.col("e_in"), F.col("v_in"))).alias("r2"),
        (1 - ratio(F.col("e_all"), F.col("v_all"))).alias("r2_all"),
        ll.alias("loglik"),
    )


def gamma_gmm(us: DataFrame) -> DataFrame:
    """Stochastic steady-state slope from first and second moments of ``us(gene_id, u, s, us, ss)``.

    y = [u, u + 2 us], x = [s, 2 ss - s]; residual variances about each part's own slope weight
    the two parts: gamma = sum y' W x / sum x' W x.
    """
    y2, x2 = F.col("u") + 2 * F.col("us"), 2 * F.col("ss") - F.col("s")
    m = us.withColumns({"y2": y2, "x2": x2})
    first = m.groupBy("gene_id").agg(
        ratio(F.sum(F.col("u") * F.col("s")), F.sum(F.col("s") * F.col("s"))).alias("g1"),
        ratio(F.sum(F.col("y2") * F.col("x2")), F.sum(F.col("x2") * F.col("x2"))).alias("g2"),
    )
    m = m.join(first, "gene_id")
    w = m.groupBy("gene_id").agg(
        F.var_pop(F.col("u") - F.col("g1") * F.col("s")).alias("v1"),
        F.var_pop(F.col("y2") - F.col("g2") * F.col("x2")).alias("v2"),
        F.sum(F.col("u") * F.col("s")).alias("a1"),
        F.sum(F.col("s") * F.col("s")).alias("b1"),
        F.sum(F.col("y2") * F.col("x2")).alias("a2"),
        F.sum(F.col("x2") * F.col("x2")).alias("b2"),
    )
    top = ratio(F.col("a1"), F.col("v1")) + ratio(F.col("a2"), F.col("v2"))
    low = ratio(F.col("b1"), F.col("v1")) + ratio(F.col("b2"), F.col("v2"))
    return w.select("gene_id", ratio(top, low).alias("gamma"))


def dispersion_nb(moments: DataFrame) -> DataFrame:
    """phi of var = mean + phi mean^2 over ``moments(gene_id, mean, variance)`` rows, by least squares through 0."""
    m2 = F.col("mean") * F.col("mean")
    return moments.groupBy("gene_id").agg(
        F.greatest(ratio(F.sum((F.col("variance") - F.col("mean")) * m2), F.sum(m2 * m2)), F.lit(0.0)).alias("phi")
    )


def gamma_negbin(us: DataFrame, phi: DataFrame) -> DataFrame:
    """Slope of u on s weighted by the negative-binomial variance s + phi s^2 of each cell (s > 0)."""
    w = ratio(F.lit(1.0), F.col("s") + F.col("phi") * F.col("s") * F.col("s"))
    j = us.where("s > 0").join(phi, "gene_id").withColumn("w", w)
    return j.groupBy("gene_id").agg(
        ratio(F.sum(F.col("w") * F.col("s") * F.col("u")), F.sum(F.col("w") * F.col("s") * F.col("s"))).alias("gamma")
    )


def gamma_two_step(lab: DataFrame) -> DataFrame:
    """Slope k_t of new on total at each time, then gamma = sum(t * -ln(1 - k_t)) / sum(t^2), times with k < 1."""
    k = lab.groupBy("gene_id", "t").agg(
        ratio(F.sum(F.col("new") * F.col("total")), F.sum(F.col("total") * F.col("total"))).alias("k")
    )
    ok = k.where("k < 1 and t > 0")
    return ok.groupBy("gene_id").agg(
        ratio(F.sum(F.col("t") * -F.log(1 - F.col("k"))), F.sum(F.col("t") * F.col("t"))).alias("gamma"),
        F.count("*").alias("n_times"),
    )


def alpha_synthesis(lab: DataFrame, beta: float) -> DataFrame:
    """beta mean(u) / mean(1 - exp(-beta t)) of ``lab(gene_id, t, new)``."""
    return lab.groupBy("gene_id").agg(
        ratio(beta * F.avg("new"), F.avg(1 - F.exp(-beta * F.col("t")))).alias("alpha")
    )


def degradation(strata: DataFrame) -> DataFrame:
    """Mean of -ln(m_t / m_0) / t over later times of ``strata(gene_id, t, m)``; t counts from the first time."""
    w = Window.partitionBy("gene_id").orderBy("t")
    s = strata.withColumns({"t0": F.first("t").over(w), "m0": F.first("m").over(w)}).where("t > t0 and m > 0 and m0 > 0")
    return s.groupBy("gene_id").agg(F.avg(gamma_from_old(F.col("m"), F.col("m0"), F.col("t") - F.col("t0"))).alias("gamma"))


def velocity(us: DataFrame, params: DataFrame, beta: Column | float = 1.0) -> DataFrame:
    """``(cell_id, gene_id, v_u, v_s)``: alpha - beta u (alpha = gamma mean s where none is given) and beta u - gamma s."""
    b = beta if isinstance(beta, Column) else F.lit(beta)
    j = us.join(params, "gene_id")
    alpha = F.col("alpha") if "alpha" in params.columns else F.lit(None).cast("double")
    return j.select("cell_id", "gene_id", (alpha - b * F.col("u")).alias("v_u"), (b * F.col("u") - F.col("gamma") * F.col("s")).alias("v_s"))


def protein_velocity(sp: DataFrame, eta: float, delta: float) -> DataFrame:
    return sp.withColumn("v_p", eta * F.col("s") - delta * F.col("p"))


def transition_genes(params: DataFrame, min_r2: float = 0.01, min_gamma: float = 0.01, least: int = 5, fallback: int = 50) -> DataFrame:
    """Genes with gamma and r2 over their bounds; if fewer than ``least``, the ``fallback`` of largest r2."""
    ok = (F.col("gamma") > min_gamma) & (F.col("r2") > min_r2)
    n = params.agg(F.count_if(ok).alias("n_ok"))
    top = params.orderBy(F.desc_nulls_last("r2"), "gene_id").limit(fallback).select("gene_id").withColumn("top", F.lit(True))
    j = params.join(F.broadcast(top), "gene_id", "left").crossJoin(F.broadcast(n))
    return j.where(F.when(F.col("n_ok") >= least, ok).otherwise(F.coalesce("top", F.lit(False)))).select("gene_id")


def experiment_type(lab: DataFrame) -> DataFrame:
    """One row: one-shot (one time), kin (labeled share rises with time) or deg."""
    share = lab.groupBy("t").agg(ratio(F.sum("new"), F.sum("total")).alias("y"))
    s = share.agg(
        F.count("*").alias("n"),
        (F.avg(F.col("t") * F.col("y")) - F.avg("t") * F.avg("y")).alias("cov"),
    )
    kind = F.when(F.col("n") <= 1, "one-shot").when(F.col("cov") > 0, "kin").otherwise("deg")
    return s.select(kind.alias("experiment_type"))


def fit_kinetics(strata: DataFrame, rounds: int = 60) -> DataFrame:
    """``(gene_id, alpha, gamma, cost)``: m(t) = alpha / gamma (1 - exp(-gamma t)) fitted by damped
    Gauss-Newton to ``strata(gene_id, t, m)``. A gene's rows are one for each time point."""

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t, m = pdf["t"].to_numpy(float), pdf["m"].to_numpy(float)
        g = 1.0 / max(t.mean(), 1e-9)
        a = max(m.max(), 1e-9) * g
        p, damp = np.log([a, g]), 1e-2

        def model(p):
            a, g = np.exp(p)
            return a / g * (1 - np.exp(-g * t))

        cost = ((model(p) - m) ** 2).sum()
        for _ in range(rounds):
            a, g = np.exp(p)
            e = np.exp(-g * t)
            jac = np.stack([model(p), a * t * e - model(p)], 1)
            r = m - model(p)
            h = jac.T @ jac
            step = np.linalg.lstsq(h + damp * np.diag(np.diag(h) + 1e-12), jac.T @ r, rcond=None)[0]
            new = p + np.clip(step, -2, 2)
            c = ((model(new) - m) ** 2).sum()
            if c < cost:
                p, cost, damp = new, c, damp / 3
            else:
                damp = min(damp * 4, 1e8)
        a, g = np.exp(p)
        return pd.DataFrame({"gene_id": [key[0]], "alpha": [a], "gamma": [g], "cost": [cost]})

    kind = dict(strata.dtypes)["gene_id"]
    return strata.groupBy("gene_id").applyInPandas(fit, f"gene_id {kind}, alpha double, gamma double, cost double")
