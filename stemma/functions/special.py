"""Special functions as Spark expressions: log-gamma, digamma, log-sum-exp, normal density, fixed uniforms."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LN_2PI = math.log(2 * math.pi)
#: The Stirling series is used from this argument on; smaller ones are shifted up by the recurrence.
SHIFT = 7
# Stirling coefficients of log-gamma and of digamma.
LGAMMA_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
DIGAMMA_SERIES = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132, 691 / 32760)


def as_column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def total(terms) -> Column:
    return reduce(lambda a, b: a + b, map(as_column, terms))


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0, to about 1e-11."""
    z = x + SHIFT
    series = total(c / F.pow(z, F.lit(2 * k + 1)) for k, c in enumerate(LGAMMA_SERIES))
    return (z - 0.5) * F.ln(z) - z + LN_2PI / 2 + series - total(F.ln(x + k) for k in range(SHIFT))


def digamma(x: Column) -> Column:
    """Derivative of ln Gamma for x > 0, to about 1e-11."""
    z = x + SHIFT
    series = total(c / F.pow(z, F.lit(2 * k + 2)) for k, c in enumerate(DIGAMMA_SERIES))
    return F.ln(z) - 0.5 / z + series - total(1 / (x + k) for k in range(SHIFT))


def lgamma_py(x: float) -> float:
    return math.lgamma(x)


def digamma_py(x: float) -> float:
    """The same series in plain Python, for parameters held on the driver."""
    z = x + SHIFT
    return math.log(z) - 0.5 / z + sum(c / z ** (2 * k + 2) for k, c in enumerate(DIGAMMA_SERIES)) - sum(1 / (x + k) for k in range(SHIFT))


def lse(*terms: Column) -> Column:
    """log-sum-exp of a few columns."""
    if len(terms) == 1:
        return terms[0]
    top = F.greatest(*terms)
    return top + F.ln(total(F.exp(t - top) for t in terms))


def lse_agg(w: str | Column) -> Column:
    """Aggregate: log-sum-exp of a group, shifted by the group's own maximum.

    The weights of a group are listed, so groups must be bounded by the product of a few state spaces.
    """
    w = F.col(w) if isinstance(w, str) else w
    top = F.max(w)
    return top + F.ln(F.aggregate(F.collect_list(w), F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def lse_array(xs: Column) -> Column:
    """log-sum-exp of an array's elements."""
    top = F.array_max(xs)
    return top + F.ln(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def normal_logpdf(x: Column, mean, var) -> Column:
    mean, var = as_column(mean), as_column(var)
    return -0.5 * ((x - mean) * (x - mean) / var + F.ln(var) + LN_2PI)


def normal_full_logpdf(residuals: list[Column], cov) -> Column:
    """ln N(residuals; 0, cov) for a whole covariance; null if a residual is.

    The residuals are whitened by the inverse of the Cholesky factor, whose entries are literals.
    """
    low = np.linalg.cholesky(np.asarray(cov, float))
    w = np.linalg.inv(low)
    z = [total(float(w[i, j]) * residuals[j] for j in range(i + 1)) for i in range(len(residuals))]
    return -0.5 * total(x * x for x in z) - float(np.log(np.diag(low)).sum() + len(residuals) / 2 * LN_2PI)


def key_md5(*keys: Column | str) -> Column:
    text = F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return F.md5(text.cast("binary"))


def uniform(*keys: Column | str) -> Column:
    """A number in (0, 1) that depends on the keys alone: 48 bits of their md5, the same on every run and engine."""
    return (F.conv(F.substring(key_md5(*keys), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def uniform_floor(d: int, *keys: Column | str) -> Column:
    """floor(uniform(*keys) * d) for d up to 8, where the product is exact, by comparing hex digits with those of the bounds.

    u * d >= j where the 48 bits are at least j * 2^48 / d - 1/2, rounded up; the digits after the twelfth never decide.
    """
    if not 1 <= d <= 8:
        return F.floor(uniform(*keys) * d).cast("long")
    digits = key_md5(*keys)
    bounds = [-((d - (j << 49)) // (2 * d)) for j in range(1, d)]
    return sum(((digits >= f"{b:012x}").cast("long") for b in bounds), F.lit(0).cast("long"))


def uniform_sql(*keys: str) -> str:
    """The DuckDB form of :func:`uniform`."""
    text = "concat_ws('|', " + ", ".join(f"cast({k} as varchar)" for k in keys) + ")"
    return f"((('0x' || substr(md5({text}), 1, 12))::bigint + 0.5) / 281474976710656.0)"


def lgamma_sql(x: str) -> str:
    return f"lgamma({x})"


def digamma_sql(x: str) -> str:
    z = f"(({x}) + {SHIFT})"
    series = " + ".join(f"({c!r}) / power({z}, {2 * k + 2})" for k, c in enumerate(DIGAMMA_SERIES))
    return f"(ln({z}) - 0.5 / {z} + {series} - (" + " + ".join(f"1.0 / (({x}) + {k})" for k in range(SHIFT)) + "))"


def gumbel(u: Column) -> Column:
    return -F.ln(-F.ln(u))
