"""Labelling recipes on shares that follow known rates."""

import numpy as np
import pytest

from fluxcell.plans import labelling

RATES = {"g0": 0.2, "g1": 0.5, "g2": 1.1}


def lab(spark, share, times, noise=0.0, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(60):
        t = float(times[c % len(times)])
        for g, rate in RATES.items():
            total = float(rng.uniform(5, 50))
            rows.append((c, g, t, float(total * share(rate, t) * np.exp(noise * rng.normal())), total))
    return spark.createDataFrame(rows, "cell_id long, gene_id string, t double, new double, total double")


CASES = {
    "one-shot": (lambda g, t: 1 - np.exp(-g * t), [2]),
    "kin": (lambda g, t: 1 - np.exp(-g * t), [0.5, 1, 2, 3]),
    "deg": (lambda g, t: 0.8 * np.exp(-g * t), [0, 1, 2, 4]),
    "mix": (lambda g, t: (1 - np.exp(-g * t)) if t <= 2 else (1 - np.exp(-g * 2)) * np.exp(-g * (t - 2)), [1, 2, 3, 4]),
}


@pytest.mark.parametrize("kind", CASES)
def test_recipes_recover_rates(spark, kind):
    share, times = CASES[kind]
    made = labelling.labelling_recipe(lab(spark, share, times))
    assert made.kind == kind
    got = {r["gene_id"]: r for r in made.params.collect()}
    for g, rate in RATES.items():
        assert got[g]["gamma"] == pytest.approx(rate, rel=1e-6) and got[g]["n_times"] == len(times)
    assert made.velocity.count() == 180
    rough = labelling.labelling_recipe(lab(spark, share, times, 0.05, 1), kind)
    assert all(r["gamma"] == pytest.approx(RATES[r["gene_id"]], rel=0.25) for r in rough.params.collect())


def test_weights_follow_the_variance(spark):
    """A time whose shares scatter widely hardly moves the rate."""
    rng = np.random.default_rng(3)
    rows = []
    for c in range(400):
        t = float(c % 2 + 1)
        total = float(rng.uniform(20, 30))
        share = 1 - np.exp(-0.3 * t) if t == 1 else float(rng.uniform(0.0, 0.95))
        rows += [(c, "g", t, float(total * share * (1 + 0.001 * rng.normal())), total), (c, "h", t, 0.5 * total * (t / 2), total)]
    made = labelling.labelling_recipe(spark.createDataFrame(rows, "cell_id long, gene_id string, t double, new double, total double"), "kin")
    assert {r["gene_id"]: r["gamma"] for r in made.params.collect()}["g"] == pytest.approx(0.3, abs=0.01)


def test_kinds_and_odd_genes(spark):
    df = spark.createDataFrame([(0, "a", 1.0, 5.0, 5.0), (1, "a", 1.0, 2.0, 2.0), (0, "b", 1.0, 0.0, 3.0)], "cell_id long, gene_id string, t double, new double, total double")
    made = labelling.labelling_recipe(df)
    assert made.kind == "one-shot" and {r["gene_id"]: r["gamma"] for r in made.params.collect()} == {"b": 0.0}  # a is labelled whole: no rate
    with pytest.raises(ValueError):
        labelling.labelling_recipe(df, "other")
