"""Scalar functions: Column in, Column out, all inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def ratio(a, b) -> Column:
    """a / b in doubles, null where b is 0."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


# variance-stabilising


def log_pseudo(x: Column, pseudo: float = 1.0, base: float = math.e) -> Column:
    """log(x + pseudo) in the given base, null where the argument is not positive."""
    shifted = x + F.lit(pseudo)
    return F.when(shifted > 0, F.log(shifted) / math.log(base))


def freeman_tukey(x: Column) -> Column:
    return F.sqrt(x) + F.sqrt(x + 1)


def freeman_tukey_inverse(y: Column) -> Column:
    """x such that sqrt(x) + sqrt(x + 1) = y."""
    return F.pow((y * y - 1) / (2 * y), 2)


def nb_stabilised(x: Column, dispersion: Column | float) -> Column:
    """asinh(sqrt(d x)) / sqrt(d): variance of a negative binomial count of dispersion d becomes constant."""
    d = _c(dispersion)
    return F.asinh(F.sqrt(d * x)) / F.sqrt(d)


# kinetics in closed form


def unspliced_at(t, u0, alpha, beta) -> Column:
    decay = F.exp(-_c(beta) * t)
    return u0 * decay + ratio(alpha, beta) * (1 - decay)


def spliced_at(t, s0, u0, alpha, beta, gamma) -> Column:
    """Spliced counts after time t; the limit form is used where beta equals gamma."""
    eb, eg = F.exp(-_c(beta) * t), F.exp(-_c(gamma) * t)
    steady = ratio(alpha, gamma)
    distinct = s0 * eg + steady * (1 - eg) + ratio(alpha - u0 * beta, _c(gamma) - beta) * (eg - eb)
    equal = s0 * eb + ratio(alpha, beta) * (1 - eb) - (alpha - u0 * beta) * t * eb
    return F.when(_c(beta) == _c(gamma), equal).otherwise(distinct)


def protein_at(t, p0, s, eta, delta) -> Column:
    """Protein after time t under a constant spliced level."""
    e = F.exp(-_c(delta) * t)
    return p0 * e + ratio(_c(eta) * s, delta) * (1 - e)


def gamma_from_old(old: Column, total: Column, t) -> Column:
    """-ln(old / total) / t, null where the share isn't positive."""
    share = ratio(old, total)
    return F.when(share > 0, -F.log(share) / t)


def gamma_one_shot(new_share: Column, t) -> Column:
    """-ln(1 - k) / t, null where k >= 1."""
    return F.when(new_share < 1, -F.log(1 - new_share) / t)


def alpha_one_shot(labeled: Column, gamma: Column, t) -> Column:
    """l gamma / (1 - exp(-gamma t)), null where gamma is 0."""
    return F.try_divide(labeled * gamma, 1 - F.exp(-gamma * t))


def total_before_labeling(total: Column, labeled: Column, new_share: Column) -> Column:
    return F.try_divide(total - labeled, 1 - new_share)


def labeled_before_decay(labeled: Column, gamma: Column, t) -> Column:
    return labeled / F.exp(-gamma * t)


def alpha_two_phase(t0, t1, alpha0, beta, u1) -> Column:
    """Rate of the second phase that leads to u1; 0 where the first phase has no duration."""
    d0, d1 = 1 - F.exp(-_c(beta) * t0), 1 - F.exp(-_c(beta) * t1)
    first = ratio(alpha0, beta) * d0 * F.exp(-_c(beta) * t1)
    return F.when(_c(t0) == 0, F.lit(0.0)).otherwise(_c(beta) * ratio(u1 - first, d1))


# information theory over arrays of probabilities


def entropy_bits(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0)))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Divergence in bits of two distributions of equal length; arguments need not sum to 1."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    unit = lambda a: F.transform(a, lambda x: F.try_divide(x, total(a)))
    a, b = unit(p), unit(q)
    mid = F.zip_with(a, b, lambda x, y: (x + y) / 2)
    return entropy_bits(mid) - (entropy_bits(a) + entropy_bits(b)) / 2


def specificity(p: Column, q: Column) -> Column:
    """1 - sqrt of the Jensen-Shannon divergence."""
    return 1 - F.sqrt(F.greatest(jensen_shannon(p, q), F.lit(0.0)))


# regulation


def hill_activating(x: Column, k, n, top=1.0) -> Column:
    xn = F.pow(x, _c(n))
    return top * xn / (F.pow(_c(k), _c(n)) + xn)


def hill_inhibiting(x: Column, k, n, top=1.0) -> Column:
    kn = F.pow(_c(k), _c(n))
    return top * kn / (kn + F.pow(x, _c(n)))


def hill_activating_slope(x: Column, k, n, top=1.0) -> Column:
    kn = F.pow(_c(k), _c(n))
    return top * n * kn * F.pow(x, _c(n) - 1) / F.pow(kn + F.pow(x, _c(n)), 2)


def hill_inhibiting_slope(x: Column, k, n, top=1.0) -> Column:
    return -hill_activating_slope(x, k, n, top)


# vectors as arrays of doubles


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scaled(a: Column, k) -> Column:
    return F.transform(a, lambda x: x * k)


def unit(a: Column) -> Column:
    """a / |a|; a zero vector gives nulls."""
    return F.transform(a, lambda x: F.try_divide(x, norm(a)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def angle(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.least(cosine(a, b), F.lit(1.0)), F.lit(-1.0)))


def mean_of(a: Column) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a).cast("double"))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays; null where one is constant."""
    ca, cb = F.transform(a, lambda x: x - mean_of(a)), F.transform(b, lambda x: x - mean_of(b))
    return cosine(ca, cb)


def gaussian_kernel(a: Column, b: Column, beta) -> Column:
    return F.exp(-_c(beta) * F.pow(distance(a, b), 2))


def project(v: Column, loadings: list[list[float]]) -> Column:
    """v Q^T for loadings Q given as rows of components."""
    return F.array(*[dot(v, F.array(*[F.lit(float(x)) for x in row])) for row in loadings])


# strings


def gene_pair(name: Column) -> Column:
    """Struct (regulator, effector) of names written as ``A - B``."""
    parts = F.split(name, " - ", 2)
    return F.struct(F.get(parts, 0).alias("regulator"), F.get(parts, 1).alias("effector"))


def has_prefix(name: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | name.startswith(p)
    return out
