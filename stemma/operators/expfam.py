"""Conjugate exponential families over DataFrames.

Sufficient statistics are plain Spark sums, so they combine on the map side; posterior updates,
expected statistics, entropies and divergences are scalar expressions over the few rows that are left.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.special import LN_2PI, as_column, digamma, lgamma, normal_full_logpdf, total, uniform
from stemma.operators.chain import bind, scan
from stemma.sources.scratch import staged

# ---- sufficient statistics ----------------------------------------------------------------------


def normal_stats(df: DataFrame, by: list[str], xs: list[str]) -> DataFrame:
    """by, n, s_i (sums) and s_i_j (sums of products, i <= j)."""
    sums = [F.sum(F.col(x)).alias(f"s_{i}") for i, x in enumerate(xs)]
    products = [F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"s_{i}_{j}") for i, j in combinations_with_replacement(range(len(xs)), 2)]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *sums, *products)


def normal_mle(df: DataFrame, by: list[str], xs: list[str]) -> DataFrame:
    """by, mean_i, cov_i_j of the centred maximum-likelihood estimate."""
    s = normal_stats(df, by, xs)
    means = [(F.col(f"s_{i}") / F.col("n")).alias(f"mean_{i}") for i in range(len(xs))]
    covs = [(F.col(f"s_{i}_{j}") / F.col("n") - F.col(f"s_{i}") / F.col("n") * F.col(f"s_{j}") / F.col("n")).alias(f"cov_{i}_{j}") for i, j in combinations_with_replacement(range(len(xs)), 2)]
    return s.select(*by, "n", *means, *covs)


def regression_stats(df: DataFrame, by: list[str], inputs: list[Column], output: Column) -> DataFrame:
    """by, n, xx_i_j (i <= j), xy_i, yy: the moments of y on the inputs."""
    p = range(len(inputs))
    xx = [F.sum(inputs[i] * inputs[j]).alias(f"xx_{i}_{j}") for i, j in combinations_with_replacement(p, 2)]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *xx, *[F.sum(inputs[i] * output).alias(f"xy_{i}") for i in p], F.sum(output * output).alias("yy"))


def counts(df: DataFrame, *keys: str) -> DataFrame:
    """Counts of combinations: categorical for one key, transition for two, tensor for more."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def transitions(df: DataFrame, seq: str, order: list[str], state: str) -> DataFrame:
    """src, dst of adjacent states in each sequence."""
    from pyspark.sql import Window

    w = Window.partitionBy(seq).orderBy(*order)
    return df.select(F.col(seq), F.lag(state).over(w).alias("src"), F.col(state).alias("dst")).filter(F.col("src").isNotNull())


def proportions(c: DataFrame, given: list[str], n: str = "n", name: str = "p") -> DataFrame:
    """Counts to conditional proportions: the maximum-likelihood table, a zero cell being an absent row."""
    if not given:
        return c.crossJoin(F.broadcast(c.agg(F.sum(n).alias("_all")))).withColumn(name, F.col(n) / F.col("_all")).drop("_all")
    sums = c.groupBy(*given).agg(F.sum(n).alias("_all"))
    return c.join(sums, given).withColumn(name, F.col(n) / F.col("_all")).drop("_all")


# ---- normal inverse Wishart and matrix normal inverse Wishart -----------------------------------


def niw_update(stats: DataFrame, by: list[str], dim: int, mean0: list[float], kappa0: float, nu0: float, psi0: list[list[float]]) -> DataFrame:
    """Posterior of a normal's mean and covariance: by, kappa, nu, mean_i, psi_i_j (i <= j)."""
    kappa = F.col("n") + float(kappa0)
    mean = [(F.lit(kappa0 * mean0[i]) + F.col(f"s_{i}")) / kappa for i in range(dim)]
    psi = [(F.col(f"s_{i}_{j}") + psi0[i][j] + kappa0 * mean0[i] * mean0[j] - kappa * mean[i] * mean[j]).alias(f"psi_{i}_{j}") for i, j in combinations_with_replacement(range(dim), 2)]
    return stats.select(*by, kappa.alias("kappa"), (F.col("n") + float(nu0)).alias("nu"), *[m.alias(f"mean_{i}") for i, m in enumerate(mean)], *psi)


def niw_log_marginal_1d(stats: DataFrame, by: list[str], mean0: float, kappa0: float, nu0: float, psi0: float) -> DataFrame:
    """ln P(x) of scalar data under a normal inverse Wishart prior: prior and posterior normalisers."""
    u = niw_update(stats, [*by, "n"], 1, [mean0], kappa0, nu0, [[psi0]])
    a = lambda nu, psi: lgamma(nu / 2) - nu / 2 * F.ln(psi / 2)
    value = a(F.col("nu"), F.col("psi_0_0")) - a(as_column(nu0), as_column(psi0)) + 0.5 * F.ln(F.lit(kappa0) / F.col("kappa")) - F.col("n") / 2 * LN_2PI
    return u.select(*by, value.alias("log_marginal"))


def mniw_update_1d(stats: DataFrame, by: list[str], m0: float, v0: float, nu0: float, psi0: float) -> DataFrame:
    """Posterior of a scalar regression y = a x + noise: by, v_inv, m, nu, psi."""
    v_inv = F.col("xx_0_0") + 1 / v0
    m = (F.col("xy_0") + m0 / v0) / v_inv
    return stats.select(*by, v_inv.alias("v_inv"), m.alias("m"), (F.col("n") + float(nu0)).alias("nu"), (F.col("yy") + psi0 + m0 * m0 / v0 - m * m * v_inv).alias("psi"))


# ---- inverse Wishart (one dimension) ---------------------------------------------------------------


def inverse_wishart_1d(stats: DataFrame, by: list[str], mean: float, nu0: float, psi0: float) -> DataFrame:
    """Posterior of a variance around a known mean, from normal statistics: by, nu, psi, mode, expected_precision, expected_log, log_marginal."""
    nu, psi = F.col("n") + float(nu0), F.col("s_0_0") - 2 * mean * F.col("s_0") + F.col("n") * mean * mean + float(psi0)
    norm = lambda v, p: v / 2 * math.log(2) + lgamma(v / 2) - v / 2 * F.ln(p)
    log_marginal = norm(nu, psi) - norm(as_column(nu0), as_column(psi0)) - F.col("n") / 2 * LN_2PI
    return stats.select(*by, nu.alias("nu"), psi.alias("psi"), (psi / (nu + 2)).alias("mode"), (nu / psi).alias("expected_precision"), (F.ln(psi / 2) - digamma(nu / 2)).alias("expected_log"), log_marginal.alias("log_marginal"))


# ---- Dirichlet ----------------------------------------------------------------------------------


def dirichlet_update(c: DataFrame, prior: float) -> DataFrame:
    return c.withColumn("alpha", F.col("n") + float(prior))


def dirichlet_log_partition(df: DataFrame, by: list[str], alpha: str = "alpha") -> DataFrame:
    return df.groupBy(*by).agg((F.sum(lgamma(F.col(alpha))) - lgamma(F.sum(alpha).cast("double"))).alias("log_partition"))


def with_total(df: DataFrame, by: list[str], alpha: str = "alpha", name: str = "alpha_sum") -> DataFrame:
    """The group's sum beside each row (groups are parameter tables, a few rows each)."""
    from pyspark.sql import Window

    return df.withColumn(name, F.sum(alpha).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))))


def dirichlet_expected_log(df: DataFrame, by: list[str], alpha: str = "alpha") -> DataFrame:
    return with_total(df, by, alpha).withColumn("expected_log", digamma(F.col(alpha).cast("double")) - digamma(F.col("alpha_sum").cast("double"))).drop("alpha_sum")


def dirichlet_kl(df: DataFrame, by: list[str], q: str, p: str) -> DataFrame:
    """KL(Dir(q) || Dir(p)) for each group."""
    t = with_total(df, by, q, "_q")
    part = lgamma(F.col(p)) - lgamma(F.col(q)) + (F.col(q) - F.col(p)) * (digamma(F.col(q)) - digamma(F.col("_q")))
    return t.groupBy(*by).agg((F.sum(part) + lgamma(F.sum(q)) - lgamma(F.sum(p))).alias("kl"))


def dirichlet_entropy(df: DataFrame, by: list[str], alpha: str = "alpha") -> DataFrame:
    t = with_total(df, by, alpha, "_a")
    part = lgamma(F.col(alpha)) - (F.col(alpha) - 1) * digamma(F.col(alpha))
    a, k = F.sum(alpha), F.count("*")
    return t.groupBy(*by).agg((F.sum(part) - lgamma(a) + (a - k) * digamma(a)).alias("entropy"))


def dirichlet_mode(df: DataFrame, by: list[str], alpha: str = "alpha") -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return df.withColumn("mode", (F.col(alpha) - 1) / F.sum(F.col(alpha) - 1).over(w))


def dirichlet_evidence(c: DataFrame, by: list[str], prior: float) -> DataFrame:
    """ln of the probability of the counted sequence under a Dirichlet prior."""
    return c.groupBy(*by).agg((lgamma(F.count("*") * float(prior)) - lgamma(F.sum("n") + F.count("*") * float(prior)) + F.sum(lgamma(F.col("n") + float(prior)) - lgamma(as_column(prior)))).alias("log_marginal"))


#: Proposals of a gamma draw; each is refused in less than one of twenty cases.
PROPOSALS = 16


def log_gamma_draw(alpha: Column, *keys: str) -> Column:
    """ln of a Gamma(alpha, 1) draw for any alpha > 0: Marsaglia and Tsang's squeeze-free test over fixed uniforms.

    The first of ``PROPOSALS`` cubes of a normal that passes is taken; alpha below 1 is raised by one and
    brought back by a power of a further uniform, in logarithms, so that tiny alphas don't vanish.
    ``keys`` with a number and a letter fix each uniform.
    """
    d = F.greatest(alpha, F.lit(0.0)) + F.when(alpha < 1, 1.0).otherwise(0.0) - 1 / 3

    def proposal(i: Column) -> Column:
        x = F.sqrt(-2 * F.ln(uniform(*keys, i, F.lit("a")))) * F.cos(F.lit(2 * math.pi) * uniform(*keys, i, F.lit("b")))
        return F.struct(x.alias("x"), F.pow(1 + x / F.sqrt(9 * d), F.lit(3)).alias("v"), F.ln(uniform(*keys, i, F.lit("c"))).alias("lu"))

    passed = F.filter(F.transform(F.sequence(F.lit(1), F.lit(PROPOSALS)), proposal), lambda p: (p["v"] > 0) & (p["lu"] < p["x"] * p["x"] / 2 + d - d * p["v"] + d * F.ln(F.greatest(p["v"], F.lit(1e-300)))))
    v = F.coalesce(F.get(passed, F.lit(0))["v"], F.lit(1.0))
    return F.ln(d * v) + F.when(alpha < 1, F.ln(uniform(*keys, F.lit("boost"))) / alpha).otherwise(0.0)


def dirichlet_draw(df: DataFrame, by: list[str], alpha: str, *keys: str) -> DataFrame:
    """A draw from Dir(alpha) in each group: gammas normalised in logarithms.  ``keys`` name the columns that fix the uniforms."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by)
    drawn = df.withColumn("_g", log_gamma_draw(F.col(alpha).cast("double"), *keys)).withColumn("_g", F.exp(F.col("_g") - F.max("_g").over(w)))
    return drawn.withColumn("theta", F.col("_g") / F.sum("_g").over(w)).drop("_g")


def dirichlet_log_terms(c: DataFrame, by: list[str], theta: str, prior: float) -> DataFrame:
    """by, log_params, log_likelihood, log_joint, log_marginal, log_posterior of given proportions ``theta`` and counts ``n``.

    One row per cell; the prior is symmetric.  The joint is that of the proportions and the counted sequence.
    """
    size, n, t = F.count("*"), F.sum("n"), F.ln(F.col(theta))
    front = lgamma(size * float(prior)) - size * lgamma(as_column(prior))
    params = front + F.sum((float(prior) - 1) * t)
    likelihood = F.sum(F.col("n") * t)
    marginal = front - lgamma(n + size * float(prior)) + F.sum(lgamma(F.col("n") + float(prior)))
    terms = c.groupBy(*by).agg(params.alias("log_params"), likelihood.alias("log_likelihood"), marginal.alias("log_marginal"))
    return terms.withColumn("log_joint", F.col("log_params") + F.col("log_likelihood")).withColumn("log_posterior", F.col("log_joint") - F.col("log_marginal"))


# ---- tensors --------------------------------------------------------------------------------------


def along(cells: list[Column], shape: list[int], axis: int, matrix: np.ndarray) -> list[Column]:
    """The cells (last axis fastest) of a tensor multiplied by a matrix along one axis; zeros cost nothing."""
    at = np.arange(len(cells)).reshape(shape)
    lines, out = np.moveaxis(at, axis, -1).reshape(-1, shape[axis]), [F.lit(0.0)] * len(cells)
    for line in lines:
        for i, k in enumerate(line):
            out[k] = total(float(m) * cells[j] for m, j in zip(matrix[i], line, strict=True) if m)
    return out


def tensor_normal_loglik(cells: list[Column], mean: np.ndarray, covs: list) -> Column:
    """Log density of a tensor given as columns (last axis fastest) with one covariance per axis: each axis is whitened for itself."""
    mean = np.asarray(mean, float)
    lows = [np.linalg.cholesky(np.asarray(c, float)) for c in covs]
    z = [x - float(m) for x, m in zip(cells, mean.ravel(), strict=True)]
    for axis, low in enumerate(lows):
        z = along(z, list(mean.shape), axis, np.linalg.inv(low))
    log_det = sum(mean.size / len(low) * float(np.log(np.diag(low)).sum()) for low in lows)
    return -0.5 * total(x * x for x in z) - (log_det + mean.size / 2 * LN_2PI)


def tensor_regression_predict(a: np.ndarray, inputs: list[list[Column]]) -> list[Column]:
    """The outputs (first axis of ``a``) of a form that is linear in each of the inputs."""
    a = np.asarray(a, float)
    return [total(float(a[(o, *k)]) * reduce(lambda p, x: p * x, [x[i] for x, i in zip(inputs, k, strict=True)]) for k in np.ndindex(*a.shape[1:])) for o in range(a.shape[0])]


def tensor_regression_loglik(a: np.ndarray, cov, inputs: list[list[Column]], outputs: list[Column]) -> Column:
    return normal_full_logpdf([y - m for y, m in zip(outputs, tensor_regression_predict(a, inputs), strict=True)], cov)


def tensor_regression_stats(df: DataFrame, by: list[str], inputs: list[list[Column]], output: Column) -> DataFrame:
    """Moments of an output on all products of one entry of each input, last input fastest (see :func:`regression_stats`)."""
    products = reduce(lambda p, x: [a * b for a in p for b in x], inputs)
    return regression_stats(df, by, products, output)


# ---- Metropolis -----------------------------------------------------------------------------------


def metropolis_chain(log_p, start: Column, steps: int, width: float, *keys) -> Column:
    """array<struct(x, lp, moved)> of a random walk per row, the start first: proposals within ``width``, uniforms fixed by the keys.

    ``log_p`` maps a state column to its unnormalised log density; ``keys`` are columns of the row.
    """
    row = lambda x, lp, moved: F.struct(x.alias("x"), lp.alias("lp"), moved.alias("moved"))
    u = lambda k, letter: uniform(*keys, k, F.lit(letter))

    def step(s: Column, k: Column) -> Column:
        proposed = s["x"] + width * (2 * u(k, "step") - 1)
        tried = bind(proposed, lambda y: F.struct(y.alias("y"), log_p(y).alias("lq")))
        return bind(tried, lambda t: F.when(F.ln(u(k, "take")) < t["lq"] - s["lp"], row(t["y"], t["lq"], F.lit(1))).otherwise(row(s["x"], s["lp"], F.lit(0))))

    return scan(F.sequence(F.lit(1), F.lit(steps)), bind(start, lambda x: row(x, log_p(x), F.lit(0))), step)


# ---- scalar normals -------------------------------------------------------------------------------


def normal_entropy(var: Column) -> Column:
    return 0.5 * (F.ln(var) + 1 + LN_2PI)


def normal_kl(m1: Column, v1: Column, m2: Column, v2: Column) -> Column:
    return 0.5 * (v1 / v2 + (m2 - m1) * (m2 - m1) / v2 - 1 + F.ln(v2 / v1))


def marginalize_scalar(j11: Column, j12: Column, j22: Column, h1: Column, h2: Column) -> tuple[Column, Column, Column]:
    """J, h and log normaliser of x1 after x2 is integrated out of a Gaussian in information form."""
    return j11 - j12 * j12 / j22, h1 - j12 * h2 / j22, 0.5 * h2 * h2 / j22 - 0.5 * F.ln(j22) + 0.5 * LN_2PI


# ---- generic forms ------------------------------------------------------------------------------


def natural_loglik(stats: list[Column], naturals: list, n: Column, log_partition) -> Column:
    """<natural parameters, statistics> - n A."""
    return total(s * as_column(p) for s, p in zip(stats, naturals, strict=True)) - n * as_column(log_partition)


def score(stats: list[Column], expected: list, n: Column) -> list[Column]:
    """Derivatives of the log-likelihood in the natural parameters: statistics minus n times their expectation."""
    return [s - n * as_column(e) for s, e in zip(stats, expected, strict=True)]


def log_stat_mgf(naturals: list[Column], shifts: list, log_partition) -> Column:
    """ln E exp(<shift, statistics>): the log partition at the shifted parameters minus that at the parameters."""
    moved = [p + as_column(s) for p, s in zip(naturals, shifts, strict=True)]
    return log_partition(moved) - log_partition(naturals)


def normal_log_partition(naturals: list[Column]) -> Column:
    """A(eta) of a scalar normal, eta = (-1 / 2v, m / v), statistics (x^2, x)."""
    a, b = naturals
    return -b * b / (4 * a) - 0.5 * F.ln(-2 * a) + 0.5 * LN_2PI


def regression_joint(slope: Column, intercept: Column, noise: Column, mean: Column, var: Column) -> dict[str, Column]:
    """The joint of y = slope x + intercept + noise and x: mean and variance of y, covariance, and x given y turned round."""
    y, cov = slope * slope * var + noise, slope * var
    return {"mean_y": slope * mean + intercept, "var_y": y, "cov_xy": cov, "slope_back": cov / y, "intercept_back": mean - cov / y * (slope * mean + intercept), "noise_back": var - cov * cov / y}


def medians(df: DataFrame, by: list[str], x: str, name: str) -> DataFrame:
    """by.., the exact median of x (nulls are skipped), however many rows a group has.

    Equal values are counted first; the values are dealt to ranges; the ranges' sums tell in which the
    middle lies, and only that range is ranked.
    """
    from pyspark.sql import Window

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.filter(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("_x")).agg(F.count("*").alias("_n"))
    values = staged(values.repartitionByRange(parts, *by, "_x").withColumn("_p", F.spark_partition_id()), "values")
    group, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_p")
    sums = values.groupBy(*by, "_p").agg(F.sum("_n").alias("_m")).withColumn("_before", F.sum("_m").over(order) - F.col("_m")).withColumn("_all", F.sum("_m").over(group))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    holds = lambda k, begin, n: ((k >= begin) & (k < begin + n)).cast("int")
    middle = sums.filter(holds(low, F.col("_before"), F.col("_m")) + holds(high, F.col("_before"), F.col("_m")) > 0).drop("_m")
    ranked = values.join(middle, [*by, "_p"]).withColumn("_begin", F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_p").orderBy("_x")) - F.col("_n"))
    times = holds(low, F.col("_begin"), F.col("_n")) + holds(high, F.col("_begin"), F.col("_n"))
    return ranked.groupBy(*by).agg((F.sum(F.col("_x") * times) / 2).alias(name))


def is_outlier(df: DataFrame, by: list[str], x: str, threshold: float = 3.5) -> DataFrame:
    """Rows with the modified z-score 0.6745 |x - median| / MAD and whether it exceeds the threshold."""
    dev = df.join(medians(df, by, x, "_median"), by).withColumn("_dev", F.abs(F.col(x) - F.col("_median")))
    mad = medians(dev, by, "_dev", "_mad")
    return dev.join(mad, by).withColumn("z", 0.6745 * F.col("_dev") / F.col("_mad")).withColumn("is_outlier", F.col("z") > threshold).drop("_median", "_dev", "_mad")
