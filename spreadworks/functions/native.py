"""Distribution functions as column expressions: nothing leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Chebyshev fit of the complementary error function (Numerical Recipes, erfcc; relative error below 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
# MacKinnon (2010) p-value polynomials of the Engle-Granger statistic for two series with a constant:
# the statistic where they change, its bounds, and both polynomials.
EG_STAR, EG_LOW, EG_HIGH, EG_SMALL, EG_LARGE = -2.62, -18.86, 0.92, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)


#: The same for the statistic of one series with a constant (Dickey-Fuller).
DF_STAR, DF_LOW, DF_HIGH, DF_SMALL, DF_LARGE = -1.61, -18.83, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def polynomial(x: Column, coefficients) -> Column:
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(float(c))
    return out


def erfc_of_positive(z: Column) -> Column:
    t = 1 / (1 + z * 0.5)
    return t * F.exp(-z * z + polynomial(t, ERFC))


def normal_cdf(x: Column) -> Column:
    tail = erfc_of_positive(F.abs(x) / math.sqrt(2)) / 2
    return F.when(x < 0, tail).otherwise(1 - tail)


def normal_two_sided(t: Column) -> Column:
    """Two-sided p of a standard normal statistic; null for null."""
    return F.when(t.isNotNull(), erfc_of_positive(F.abs(t) / math.sqrt(2)))


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t with a whole number of degrees of freedom: the finite sums in the cosine; null under 1."""
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    c, s = F.cos(theta), F.sin(theta)
    even = df % 2 == 0
    terms = F.greatest(F.floor((df - 2) / 2), F.lit(0)).cast("int")  # terms after the first
    start = F.when(even, F.lit(1.0)).otherwise(c)

    def step(state, k):
        ratio = F.when(even, (2 * k - 1) / (2.0 * k)).otherwise((2.0 * k) / (2 * k + 1))
        term = state["term"] * ratio * c * c
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    total = F.aggregate(F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")), F.struct(start.alias("term"), start.alias("sum")), step, lambda x: x["sum"])
    inside = F.when(even, s * total).when(df == 1, 2 / math.pi * theta).otherwise(2 / math.pi * (theta + s * total))
    return F.when(t.isNotNull() & (df >= 1), F.greatest(1 - inside, F.lit(0.0)))


def unit_root_p(tau: Column, n_series: int) -> Column:
    """p of a unit-root statistic with a constant: Dickey-Fuller (one series) or Engle-Granger (two)."""
    star, low, high, small, large = (DF_STAR, DF_LOW, DF_HIGH, DF_SMALL, DF_LARGE) if n_series == 1 else (EG_STAR, EG_LOW, EG_HIGH, EG_SMALL, EG_LARGE)
    p = normal_cdf(F.when(tau <= star, polynomial(tau, small)).otherwise(polynomial(tau, large)))
    return F.when(tau.isNotNull(), F.when(tau > high, 1.0).when(tau < low, 0.0).otherwise(p))


def eg_p(tau: Column) -> Column:
    """p of an Engle-Granger statistic (two series, constant)."""
    return unit_root_p(tau, 2)
