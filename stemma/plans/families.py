"""Queries on exponential families: statistics, updates, likelihoods, divergences."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement, product

import numpy as np
from pyspark.sql import functions as F

from stemma.functions.special import digamma_sql, gumbel, normal_logpdf, uniform, uniform_sql
from stemma.operators import evaluation, expfam
from stemma.plans.registry import longs, query, r, rounded, table

XS = ["x0", "x1", "x2"]
XS_SQL = "select l_returnflag, l_linestatus, l_quantity as x0, l_extendedprice / 1000 as x1, l_discount * 10 as x2 from lineitem"
PAIRS = list(combinations_with_replacement(range(3), 2))


def measures(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("x0"), (F.col("l_extendedprice") / 1000).alias("x1"), (F.col("l_discount") * 10).alias("x2"))


STATS_SQL = f"select l_returnflag, count(*) as n, {', '.join(f'sum(x{i}) as s_{i}' for i in range(3))}, {', '.join(f'sum(x{i} * x{j}) as s_{i}_{j}' for i, j in PAIRS)} from ({XS_SQL}) group by l_returnflag"


@query(f"select l_returnflag, n, {', '.join(f'round(s_{i}, 3) as s_{i}' for i in range(3))}, {', '.join(f'round(s_{i}_{j}, 3) as s_{i}_{j}' for i, j in PAIRS)} from ({STATS_SQL})")
def normal_suffstats(spark, d):
    df = expfam.normal_stats(measures(spark, d), ["l_returnflag"], XS)
    return rounded(df, *[c for c in df.columns if c.startswith("s_")], digits=3)


@query(f"select l_returnflag, n, {', '.join(f'round(s_{i} / n, 6) as mean_{i}' for i in range(3))}, {', '.join(f'round(s_{i}_{j} / n - s_{i} / n * s_{j} / n, 6) + 0.0 as cov_{i}_{j}' for i, j in PAIRS)} from ({STATS_SQL})")
def normal_mle(spark, d):
    df = expfam.normal_mle(measures(spark, d), ["l_returnflag"], XS)
    return rounded(df, *[c for c in df.columns if c[:4] in ("mean", "cov_")])


@query(
    f"""select l_returnflag, round(sum(-0.5 * (power(x0 - 25.0, 2) / 200.0 + ln(200.0) + ln(2 * pi()))), 4) as loglik,
    round(sum(x0) * (25.0 / 200.0) + sum(x0 * x0) * (-0.5 / 200.0) - count(*) * (0.5 * 25.0 * 25.0 / 200.0 + 0.5 * ln(200.0) + 0.5 * ln(2 * pi())), 4) as loglik_natural
    from ({XS_SQL}) group by l_returnflag"""
)
def normal_loglik_1d(spark, d):
    """The log-likelihood twice: by the density, and by natural parameters and sufficient statistics."""
    x, n = F.col("x0"), F.count("*")
    part = 0.5 * 25.0 * 25.0 / 200.0 + 0.5 * F.ln(F.lit(200.0)) + 0.5 * F.ln(2 * F.pi())
    return measures(spark, d).groupBy("l_returnflag").agg(r(F.sum(normal_logpdf(x, 25.0, 200.0)), 4).alias("loglik"), r(expfam.natural_loglik([F.sum(x), F.sum(x * x)], [25.0 / 200.0, -0.5 / 200.0], n, part), 4).alias("loglik_natural"))


K0, NU0 = 2.0, 5.0
MU0 = [20.0, 30.0, 0.5]
PSI0 = [[4.0, 0.5, 0.0], [0.5, 9.0, 0.1], [0.0, 0.1, 1.0]]
_m = lambda i: f"(({K0} * {MU0[i]} + s_{i}) / (n + {K0}))"


@query(
    f"""select l_returnflag, n + {K0} as kappa, n + {NU0} as nu, {', '.join(f'round({_m(i)}, 6) as mean_{i}' for i in range(3))},
    {', '.join(f'round(s_{i}_{j} + {PSI0[i][j]} + {K0} * {MU0[i]} * {MU0[j]} - (n + {K0}) * {_m(i)} * {_m(j)}, 3) + 0.0 as psi_{i}_{j}' for i, j in PAIRS)} from ({STATS_SQL})"""
)
def niw_posterior_update(spark, d):
    df = expfam.niw_update(expfam.normal_stats(measures(spark, d), ["l_returnflag"], XS), ["l_returnflag"], 3, MU0, K0, NU0, PSI0)
    return rounded(rounded(df, "mean_0", "mean_1", "mean_2"), *[f"psi_{i}_{j}" for i, j in PAIRS], digits=3)


@query(
    f"""with u as (select l_returnflag, n, n + 2.0 as k, n + 5.0 as nu, s_0_0 + 4.0 + 2.0 * 20.0 * 20.0 - (n + 2.0) * power((40.0 + s_0) / (n + 2.0), 2) as psi from ({STATS_SQL}))
    select l_returnflag, round((lgamma(nu / 2) - nu / 2 * ln(psi / 2)) - (lgamma(2.5) - 2.5 * ln(2.0)) + 0.5 * ln(2.0 / k) - n / 2.0 * ln(2 * pi()), 3) as log_marginal from u"""
)
def niw_log_marginal(spark, d):
    df = expfam.niw_log_marginal_1d(expfam.normal_stats(measures(spark, d), ["l_returnflag"], XS), ["l_returnflag"], 20.0, 2.0, 5.0, 4.0)
    return rounded(df, "log_marginal", digits=3)


REG_SQL = "select l_linestatus, count(*) as n, sum(x0 * x0) as xx, sum(x0 * x1) as xy, sum(x1 * x1) as yy from (" + XS_SQL + ") group by l_linestatus"


@query("select l_linestatus, count(*) as n, round(sum(1.0), 3) as xx_0_0, round(sum(x0), 3) as xx_0_1, round(sum(x0 * x0), 3) as xx_1_1, round(sum(x1), 3) as xy_0, round(sum(x0 * x1), 3) as xy_1, round(sum(x1 * x1), 3) as yy from (" + XS_SQL + ") group by l_linestatus")
def regression_suffstats(spark, d):
    df = expfam.regression_stats(measures(spark, d), ["l_linestatus"], [F.lit(1.0), F.col("x0")], F.col("x1"))
    return rounded(df, *[c for c in df.columns if c[0] in "xy"], digits=3)


@query("select l_linestatus, round(regr_slope(x1, x0), 6) as slope, round(regr_intercept(x1, x0), 6) as intercept, round(regr_r2(x1, x0), 6) as r2 from (" + XS_SQL + ") group by l_linestatus")
def regression_mle_1d(spark, d):
    s = expfam.regression_stats(measures(spark, d), ["l_linestatus"], [F.lit(1.0), F.col("x0")], F.col("x1"))
    n, sx, sy = F.col("n"), F.col("xx_0_1"), F.col("xy_0")
    cxy, cxx, cyy = F.col("xy_1") - sx * sy / n, F.col("xx_1_1") - sx * sx / n, F.col("yy") - sy * sy / n
    return s.select("l_linestatus", r(cxy / cxx).alias("slope"), r((sy - cxy / cxx * sx) / n).alias("intercept"), r(cxy * cxy / (cxx * cyy)).alias("r2"))


@query(f"select l_linestatus, round(xx + 1 / 4.0, 3) as v_inv, round((xy + 1.0 / 4.0) / (xx + 1 / 4.0), 6) as m, n + 3.0 as nu, round(yy + 2.0 + 1.0 / 4.0 - power((xy + 1.0 / 4.0) / (xx + 1 / 4.0), 2) * (xx + 1 / 4.0), 3) as psi from ({REG_SQL})")
def mniw_posterior_update_1d(spark, d):
    df = expfam.mniw_update_1d(expfam.regression_stats(measures(spark, d), ["l_linestatus"], [F.col("x0")], F.col("x1")), ["l_linestatus"], 1.0, 4.0, 3.0, 2.0)
    return rounded(rounded(df, "m"), "v_inv", "psi", digits=3)


MOMENTS = f"(select l_returnflag, s_0 / n as m0, s_1 / n as m1, s_0_0 / n - s_0 / n * s_0 / n as v0, s_1_1 / n - s_1 / n * s_1 / n as v1, s_0_1 / n - s_0 / n * s_1 / n as c from ({STATS_SQL}))"


def moments(spark, d):
    m = expfam.normal_mle(measures(spark, d), ["l_returnflag"], XS)
    return m.select("l_returnflag", F.col("mean_0").alias("m0"), F.col("mean_1").alias("m1"), F.col("cov_0_0").alias("v0"), F.col("cov_1_1").alias("v1"), F.col("cov_0_1").alias("c"))


@query(f"select l_returnflag, round(0.5 * (ln(v0) + 1 + ln(2 * pi())), 8) as entropy, round(0.5 * (v0 / v1 + power(m1 - m0, 2) / v1 - 1 + ln(v1 / v0)), 6) as kl from {MOMENTS}")
def normal_entropy_kl(spark, d):
    """Entropy of one measure's normal and its divergence from another's."""
    m = moments(spark, d)
    return m.select("l_returnflag", r(expfam.normal_entropy(F.col("v0")), 8).alias("entropy"), r(expfam.normal_kl(F.col("m0"), F.col("v0"), F.col("m1"), F.col("v1"))).alias("kl"))


@query(f"select l_returnflag, round(1 / v0, 9) as j, round(m0 / v0, 6) as h from {MOMENTS}")
def normal_marginalize(spark, d):
    """The joint of two measures in information form, one of them integrated out: the marginal's own parameters."""
    det = F.col("v0") * F.col("v1") - F.col("c") * F.col("c")
    j11, j12, j22 = F.col("v1") / det, -F.col("c") / det, F.col("v0") / det
    j, h, _ = expfam.marginalize_scalar(j11, j12, j22, j11 * F.col("m0") + j12 * F.col("m1"), j12 * F.col("m0") + j22 * F.col("m1"))
    return moments(spark, d).select("l_returnflag", r(j, 9).alias("j"), r(h).alias("h"))


# ---- categorical and Dirichlet --------------------------------------------------------------------

FLAGS = "select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2"


def flags(spark, d):
    return expfam.counts(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("select l_returnflag, count(*) as n from lineitem group by 1")
def categorical_suffstats(spark, d):
    return expfam.counts(table(spark, d, "lineitem"), "l_returnflag")


@query("select l_returnflag, count(*) as n, round(count(*) / (select count(*)::double from lineitem), 9) as p from lineitem group by 1")
def categorical_mle(spark, d):
    return rounded(expfam.proportions(categorical_suffstats(spark, d), []), "p", digits=9)


@query("select o_orderpriority, count(*) as n, count(*) + 1.5 as alpha from orders group by 1")
def dirichlet_posterior(spark, d):
    return expfam.dirichlet_update(expfam.counts(table(spark, d, "orders"), "o_orderpriority"), 1.5)


ALPHA = "select o_orderstatus, o_orderpriority, count(*) + 0.5 as alpha from orders group by 1, 2"


def alphas(spark, d):
    return expfam.dirichlet_update(expfam.counts(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority"), 0.5).drop("n")


@query(f"select o_orderstatus, round(sum(lgamma(alpha)) - lgamma(sum(alpha)), 4) as log_partition from ({ALPHA}) group by 1")
def dirichlet_log_partition(spark, d):
    return rounded(expfam.dirichlet_log_partition(alphas(spark, d), ["o_orderstatus"]), "log_partition", digits=4)


@query(f"with a as (select *, sum(alpha) over (partition by o_orderstatus) as t from ({ALPHA})) select o_orderstatus, o_orderpriority, alpha, round({digamma_sql('alpha')} - {digamma_sql('t')}, 8) as expected_log from a")
def dirichlet_expected_log(spark, d):
    return rounded(expfam.dirichlet_expected_log(alphas(spark, d), ["o_orderstatus"]), "expected_log", digits=8)


KL_SQL = f"with a as (select *, alpha * 0.5 + 1 as prior, sum(alpha) over (partition by o_orderstatus) as t from ({ALPHA})) select o_orderstatus, round(sum(lgamma(prior) - lgamma(alpha) + (alpha - prior) * ({digamma_sql('alpha')} - {digamma_sql('t')})) + lgamma(sum(alpha)) - lgamma(sum(prior)), 4) as kl from a group by 1"


@query(KL_SQL)
def dirichlet_kl(spark, d):
    return rounded(expfam.dirichlet_kl(alphas(spark, d).withColumn("prior", F.col("alpha") * 0.5 + 1), ["o_orderstatus"], "alpha", "prior"), "kl", digits=4)


@query(f"select o_orderstatus, round(sum(lgamma(alpha) - (alpha - 1) * {digamma_sql('alpha')}) - lgamma(sum(alpha)) + (sum(alpha) - count(*)) * {digamma_sql('sum(alpha)')}, 4) as entropy from ({ALPHA}) group by 1")
def dirichlet_entropy(spark, d):
    return rounded(expfam.dirichlet_entropy(alphas(spark, d), ["o_orderstatus"]), "entropy", digits=4)


@query(f"select o_orderstatus, o_orderpriority, alpha, round((alpha - 1) / sum(alpha - 1) over (partition by o_orderstatus), 9) as mode from ({ALPHA})")
def dirichlet_mode(spark, d):
    return rounded(expfam.dirichlet_mode(alphas(spark, d), ["o_orderstatus"]), "mode", digits=9)


@query("with c as (select l_linestatus, l_returnflag in ('R', 'A') as y, count(*) as n from lineitem group by 1, 2) select l_linestatus, round(lgamma(count(*) * 2.0) - lgamma(sum(n) + count(*) * 2.0) + sum(lgamma(n + 2.0) - lgamma(2.0)), 4) as log_marginal from c group by 1")
def beta_binomial_log_marginal(spark, d):
    c = table(spark, d, "lineitem").withColumn("y", F.col("l_returnflag").isin("R", "A"))
    return rounded(expfam.dirichlet_evidence(expfam.counts(c, "l_linestatus", "y"), ["l_linestatus"], 2.0), "log_marginal", digits=4)


_U = lambda *k: uniform_sql("o_orderstatus", "o_orderpriority", *k)
_ALPHA = "case count(*) % 4 when 0 then 0.3 when 1 then 0.9 when 2 then 2.5 else count(*) / 7.0 end"
GAMMA_SQL = f"""with a as (select o_orderstatus, o_orderpriority, ({_ALPHA})::double as alpha from orders group by 1, 2),
    d as (select *, alpha + (case when alpha < 1 then 1 else 0 end) - {1 / 3!r} as d from a),
    x as (select *, sqrt(-2 * ln({_U('i', "'a'")})) * cos({2 * math.pi!r} * {_U('i', "'b'")}) as x, ln({_U('i', "'c'")}) as lu from d, range(1, {expfam.PROPOSALS + 1}) t(i)),
    v as (select *, power(1 + x / sqrt(9 * d), 3) as v from x),
    f as (select o_orderstatus, o_orderpriority, min(i) as i from v where v > 0 and lu < x * x / 2 + d - d * v + d * ln(greatest(v, 1e-300)) group by 1, 2),
    g as (select o_orderstatus, o_orderpriority, alpha, ln(d * v) + case when alpha < 1 then ln({_U("'boost'")}) / alpha else 0 end as g from v join f using (o_orderstatus, o_orderpriority, i)),
    m as (select *, exp(g - max(g) over (partition by o_orderstatus)) as e from g)"""


@query(f"{GAMMA_SQL} select o_orderstatus, o_orderpriority, round(alpha, 6) as alpha, round(e / sum(e) over (partition by o_orderstatus), 8) as theta from m")
def dirichlet_sample(spark, d):
    """Draws with parameters below and above one, fixed by hash uniforms."""
    n = F.col("n")
    alpha = F.when(n % 4 == 0, 0.3).when(n % 4 == 1, 0.9).when(n % 4 == 2, 2.5).otherwise(n / 7.0)
    a = expfam.counts(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority").withColumn("alpha", alpha).drop("n")
    return rounded(rounded(expfam.dirichlet_draw(a, ["o_orderstatus"], "alpha", "o_orderstatus", "o_orderpriority"), "theta", digits=8), "alpha")


# ---- transitions and tensors ----------------------------------------------------------------------

STEPS = "select * from (select user_id, lag(event_type) over (partition by user_id order by ts, event_id) as src, event_type as dst from events) where src is not null"


def steps(spark, d):
    return expfam.transitions(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query(f"select src, dst, count(*) as n from ({STEPS}) group by 1, 2")
def transition_suffstats(spark, d):
    return expfam.counts(steps(spark, d), "src", "dst")


@query(f"with c as (select src, dst, count(*) as n from ({STEPS}) group by 1, 2) select src, dst, n, round(n / sum(n) over (partition by src), 9) as p from c")
def transition_mle(spark, d):
    return rounded(expfam.proportions(transition_suffstats(spark, d), ["src"]), "p", digits=9)


@query(f"with c as (select src, dst, count(*) + 1.0 as alpha from ({STEPS}) group by 1, 2), a as (select *, sum(alpha) over (partition by src) as t from c) select src, dst, alpha, round({digamma_sql('alpha')} - {digamma_sql('t')}, 8) as expected_log from a")
def transition_dirichlet_expected_log(spark, d):
    a = expfam.dirichlet_update(transition_suffstats(spark, d), 1.0).drop("n")
    return rounded(expfam.dirichlet_expected_log(a, ["src"]), "expected_log", digits=8)


JOINED = "select o_orderstatus, o_orderpriority, c_mktsegment from orders join customer on o_custkey = c_custkey"


def joined(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))


@query(f"select o_orderstatus, o_orderpriority, c_mktsegment, count(*) as n from ({JOINED}) group by 1, 2, 3")
def tensor_transition_suffstats(spark, d):
    return expfam.counts(joined(spark, d), "o_orderstatus", "o_orderpriority", "c_mktsegment")


@query(f"with c as (select o_orderstatus, o_orderpriority, c_mktsegment, count(*) as n from ({JOINED}) group by 1, 2, 3) select o_orderstatus, o_orderpriority, c_mktsegment, n, round(n / sum(n) over (partition by o_orderstatus, o_orderpriority), 9) as p from c")
def tensor_transition_mle(spark, d):
    return rounded(expfam.proportions(tensor_transition_suffstats(spark, d), ["o_orderstatus", "o_orderpriority"]), "p", digits=9)


@query(f"with c as (select o_orderstatus, o_orderpriority, c_mktsegment, count(*) as n from ({JOINED}) group by 1, 2, 3) select o_orderstatus, round(sum(n * ln(n / (select sum(n) from c))), 4) as loglik from c group by 1")
def tensor_categorical_loglik(spark, d):
    """Log-likelihood of the rows under the joint table of three variables."""
    c = expfam.proportions(tensor_transition_suffstats(spark, d), [])
    return c.groupBy("o_orderstatus").agg(r(F.sum(F.col("n") * F.ln("p")), 4).alias("loglik"))


@query(
    f"""with c as (select o_orderstatus, o_orderpriority, count(*) / (select count(*)::double from orders) as p from orders group by 1, 2),
    k as (select *, sum(p) over (order by o_orderstatus, o_orderpriority) as hi, sum(p) over (order by o_orderstatus, o_orderpriority) - p as lo, sum(p) over () as t from c),
    u as (select c_custkey, {uniform_sql("'tensor'", 'c_custkey')} as u from customer)
    select o_orderstatus, o_orderpriority, count(*) as n from u join k on u.u * k.t >= k.lo and u.u * k.t < k.hi group by 1, 2"""
)
def tensor_categorical_sample(spark, d):
    """A joint state drawn for each customer by the inverse CDF; counts of what was drawn."""
    c = expfam.proportions(expfam.counts(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority"), [])
    cells = c.agg(F.array_sort(F.collect_list(F.struct("o_orderstatus", "o_orderpriority", "p"))).alias("cells"))  # as many rows as states
    u = table(spark, d, "customer").select(uniform(F.lit("tensor"), F.col("c_custkey")).alias("u")).crossJoin(F.broadcast(cells))
    total = F.aggregate("cells", F.lit(0.0), lambda a, x: a + x["p"])
    walk = F.aggregate("cells", F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k")), lambda a, x: F.struct((a["s"] + x["p"]).alias("s"), (a["k"] + (a["s"] + x["p"] <= F.col("u") * total).cast("int")).alias("k")))
    return u.select(F.get("cells", walk["k"]).alias("c")).groupBy("c.o_orderstatus", "c.o_orderpriority").agg(F.count("*").alias("n"))


@query(f"with c as (select o_orderstatus, o_orderpriority, c_mktsegment, count(*) + 2.0 as alpha from ({JOINED}) group by 1, 2, 3), a as (select *, sum(alpha) over (partition by o_orderstatus, o_orderpriority) as t from c) select o_orderstatus, o_orderpriority, c_mktsegment, alpha, round({digamma_sql('alpha')} - {digamma_sql('t')}, 8) as expected_log from a")
def tensor_transition_dirichlet_expected_log(spark, d):
    """A Dirichlet row for each pair of parents' states: posterior and expected logarithms."""
    a = expfam.dirichlet_update(tensor_transition_suffstats(spark, d), 2.0).drop("n")
    return rounded(expfam.dirichlet_expected_log(a, ["o_orderstatus", "o_orderpriority"]), "expected_log", digits=8)


LOGS = "select event_type, count(*) as n, sum(x) as s, sum(x * x) as ss from (select event_type, ln(1 + value) as x from events) group by 1"


def log_values(spark, d):
    return expfam.normal_stats(table(spark, d, "events").withColumn("x", F.ln(1 + F.col("value"))), ["event_type"], ["x"])


@query(
    f"with m as (select event_type, n + 4.0 as nu, ss - 6 * s + 9 * n + 2.5 as psi, n from ({LOGS})) select event_type, nu, round(psi, 4) as psi, round(psi / (nu + 2), 6) as mode, round(nu / psi, 6) as expected_precision, round(ln(psi / 2) - {digamma_sql('nu / 2')}, 6) as expected_log, "
    "round(nu / 2 * ln(2) + lgamma(nu / 2) - nu / 2 * ln(psi) - (2 * ln(2) + lgamma(2.0) - 2 * ln(2.5)) - n / 2.0 * ln(2 * pi()), 3) as log_marginal from m"
)
def inverse_wishart_update_1d(spark, d):
    """Posterior of the variance of values around a known mean, its mode, expectations and evidence."""
    out = expfam.inverse_wishart_1d(log_values(spark, d), ["event_type"], 3.0, 4.0, 2.5)
    out = rounded(rounded(out, "mode", "expected_precision", "expected_log"), "psi", digits=4)
    return rounded(out, "log_marginal", digits=3)


@query(f"select event_type, round(ss - n * (9.0 + 1.5), 3) as d_square, round(s - n * 3.0, 3) as d_linear from ({LOGS})")
def normal_score(spark, d):
    """Derivatives of the log-likelihood of a normal (mean 3, variance 1.5) in its natural parameters."""
    a, b = expfam.score([F.col("s_0_0"), F.col("s_0")], [9.0 + 1.5, 3.0], F.col("n"))
    return log_values(spark, d).select("event_type", r(a, 3).alias("d_square"), r(b, 3).alias("d_linear"))


@query(f"with m as (select event_type, s / n as m, ss / n - (s / n) * (s / n) as v from ({LOGS})), k as (select *, 1 - 2 * 0.05 * v as k from m) select event_type, round(-0.5 * ln(k) + (0.05 * m * m + 0.3 * m + 0.045 * v) / k, 6) as log_mgf from k")
def normal_log_stat_mgf(spark, d):
    """ln E exp(0.05 x^2 + 0.3 x) under each type's fitted normal."""
    m, v = F.col("mean_0"), F.col("cov_0_0")
    fitted = expfam.normal_mle(table(spark, d, "events").withColumn("x", F.ln(1 + F.col("value"))), ["event_type"], ["x"])
    return fitted.select("event_type", r(expfam.log_stat_mgf([-0.5 / v, m / v], [0.05, 0.3], expfam.normal_log_partition)).alias("log_mgf"))


@query(f"select l_linestatus, round(regr_slope(x0, x1), 6) as slope_back, round(regr_intercept(x0, x1), 6) as intercept_back, round(avg(x1), 6) as mean_y, round(covar_pop(x0, x1), 6) as cov_xy from ({XS_SQL}) group by 1")
def regression_turned_round(spark, d):
    """The joint of a fitted regression and its input, and the regression of the input on the output that follows from it."""
    s = expfam.regression_stats(measures(spark, d), ["l_linestatus"], [F.lit(1.0), F.col("x0")], F.col("x1"))
    n, mean = F.col("n"), F.col("xx_0_1") / F.col("n")
    var = F.col("xx_1_1") / n - mean * mean
    slope = (F.col("xy_1") / n - mean * F.col("xy_0") / n) / var
    intercept = F.col("xy_0") / n - slope * mean
    noise = F.col("yy") / n - F.col("xy_0") / n * F.col("xy_0") / n - slope * slope * var
    j = expfam.regression_joint(slope, intercept, noise, mean, var)
    return s.select("l_linestatus", *[r(j[k]).alias(k) for k in ("slope_back", "intercept_back", "mean_y", "cov_xy")])


_g = lambda k: f"(ln(0.2 * {k + 1}) - ln(-ln(" + uniform_sql("'gumbel'", "event_id", str(k)) + ")))"


@query(f"with g as (select event_id, {', '.join(f'{_g(k)} / 0.7 as g{k}' for k in range(3))} from events), m as (select *, greatest(g0, g1, g2) as m from g), e as (select event_id, exp(g0 - m) as e0, exp(g1 - m) as e1, exp(g2 - m) as e2 from m) select event_id, {', '.join(f'round(e{k} / (e0 + e1 + e2), 6) + 0.0 as w{k}' for k in range(3))} from e")
def gumbel_softmax_sample(spark, d):
    """Relaxed categorical draws at temperature 0.7."""
    ws = [(F.ln(F.lit(0.2 * (k + 1))) + gumbel(uniform(F.lit("gumbel"), F.col("event_id"), F.lit(k)))) / 0.7 for k in range(3)]
    e = table(spark, d, "events").select("event_id", *[w.alias(f"g{k}") for k, w in enumerate(ws)]).withColumn("m", F.greatest("g0", "g1", "g2"))
    e = e.select("event_id", *[F.exp(F.col(f"g{k}") - F.col("m")).alias(f"e{k}") for k in range(3)])
    return e.select("event_id", *[r(F.col(f"e{k}") / (F.col("e0") + F.col("e1") + F.col("e2"))).alias(f"w{k}") for k in range(3)])


@query(
    """with m as (select event_type, median(value) as med from events group by 1), dv as (select event_id, event_type, abs(value - med) as dev from events join m using (event_type)),
    md as (select event_type, median(dev) as mad from dv group by 1) select event_id, event_type, round(0.6745 * dev / mad, 6) as z, cast(0.6745 * dev / mad > 3.5 as bigint) as is_outlier from dv join md using (event_type)"""
)
def mad_outliers(spark, d):
    df = expfam.is_outlier(table(spark, d, "events"), ["event_type"], "value")
    return longs(df.select("event_id", "event_type", r("z").alias("z"), "is_outlier"), "is_outlier")


@query("select truth, guess, count(*) as n from (select quality as truth, 1 - toxic as guess from labels) group by 1, 2")
def confusion_matrix(spark, d):
    return longs(evaluation.confusion(judged(spark, d), "truth", "guess"), "n")


U_SOFT, U_CONF, U_FOLD, U_UP = (uniform_sql(f"'{x}'", "doc_id") for x in ("soft", "conf", "fold", "up"))


def judged(spark, d):
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("guess"))


@query(
    """with c as (select quality as truth, 1 - toxic as guess, count(*) as n from labels group by 1, 2), t as (select sum(n)::bigint as n, sum(case when truth = guess then n else 0 end) as same from c),
    e as (select sum(a.r * b.c) as rc from (select truth as k, sum(n) as r from c group by 1) a join (select guess as k, sum(n) as c from c group by 1) b using (k))
    select n, round(same / n, 9) as accuracy, round((same / n - rc / (n * n)) / (1 - rc / (n * n)), 9) as kappa from t, e"""
)
def cohen_kappa(spark, d):
    return rounded(evaluation.agreement(evaluation.confusion(judged(spark, d), "truth", "guess")), "accuracy", "kappa", digits=9)


@query("select quality as truth, count(*) as n, round(avg(case when quality = 1 - toxic then 1.0 else 0.0 end), 9) as accuracy from labels group by 1")
def class_accuracy(spark, d):
    return rounded(evaluation.class_accuracy(judged(spark, d), "truth", "guess"), "accuracy", digits=9)


@query(f"with u as (select quality as truth, {U_SOFT} as p from labels) select truth, guess, round(sum(case when guess = 'yes' then p else 1 - p end), 6) as mass from u, (values ('yes'), ('no')) g(guess) group by 1, 2")
def soft_confusion(spark, d):
    u = uniform(F.lit("soft"), F.col("doc_id"))
    return rounded(evaluation.soft_confusion(judged(spark, d), "truth", {"yes": u, "no": 1 - u}), "mass")


@query(f"with u as (select quality = 1 - toxic as ok, {U_CONF} as p from labels) select case when p > 0.8 then 'sure' when p > 0.5 then 'leaning' else 'open' end as band, ok::bigint as is_right, count(*) as n from u group by 1, 2")
def confidence_bands(spark, d):
    return evaluation.bands(judged(spark, d), uniform(F.lit("conf"), F.col("doc_id")), F.col("truth") == F.col("guess"))


@query(f"select floor({U_FOLD} * 5)::bigint as fold, toxic, count(*) as n from labels group by 1, 2")
def cv_folds(spark, d):
    return evaluation.folds(table(spark, d, "labels"), "doc_id").groupBy("fold", "toxic").agg(F.count("*").alias("n"))


@query(
    f"""with c as (select toxic, count(*) as n from labels group by 1), q as (select l.doc_id, l.toxic, (select max(n) from c) / n::double as ratio from labels l join c using (toxic)),
    k as (select doc_id, toxic, floor(ratio)::bigint + ({U_UP} < ratio - floor(ratio))::bigint as copies from q) select doc_id, toxic, unnest(range(1, copies + 1)) as copy from k"""
)
def class_upsample(spark, d):
    return evaluation.upsample(table(spark, d, "labels"), "toxic", "doc_id").select("doc_id", "toxic", "copy")


# ---- tensors ----------------------------------------------------------------------------------------

CELLS = ["l_quantity / 25", "l_extendedprice / 30000", "l_discount * 20", "l_tax * 25"]
TENSOR_MEAN = [[1.0, 1.2], [1.0, 0.9]]
TENSOR_COVS = [[[1.0, 0.3], [0.3, 0.8]], [[0.9, -0.2], [-0.2, 0.7]]]
TENSOR_A = [[[0.5, 0.4], [0.2, -0.1]], [[1.0, -0.3], [0.1, 0.25]]]


def kron_sql(z: list[str], mean: list[float], cov) -> str:
    """ln N(z; mean, cov) with the whole inverse written out."""
    back = np.linalg.inv(np.asarray(cov))
    quad = " + ".join(f"({float(back[i, j])!r}) * ({z[i]} - {mean[i]!r}) * ({z[j]} - {mean[j]!r})" for i, j in product(range(len(z)), repeat=2))
    return f"-0.5 * ({quad}) - {0.5 * float(np.log(np.linalg.det(np.asarray(cov))))!r} - {len(z) / 2} * ln(2 * pi())"


@query(f"select l_returnflag, round(sum({kron_sql(CELLS, [x for row in TENSOR_MEAN for x in row], np.kron(*TENSOR_COVS))}), 3) as loglik from lineitem group by 1")
def tensor_normal_loglik(spark, d):
    """Two by two tensors of a line's measures with one covariance per axis; the SQL uses their Kronecker product."""
    part = expfam.tensor_normal_loglik([F.expr(c) for c in CELLS], TENSOR_MEAN, TENSOR_COVS)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r(F.sum(part), 3).alias("loglik"))


INPUTS = [["1.0::double", "l_quantity / 25"], ["1.0::double", "l_extendedprice / 30000"]]
FORM = [" + ".join(f"({TENSOR_A[o][i][j]!r}) * ({INPUTS[0][i]}) * ({INPUTS[1][j]})" for i, j in product(range(2), repeat=2)) for o in range(2)]


def tensor_inputs():
    return [[F.lit(1.0), F.expr(xs[1])] for xs in INPUTS]


@query(f"select l_returnflag, round(sum({kron_sql([f'(l_discount * 20 - ({FORM[0]}))', f'(l_tax * 25 - ({FORM[1]}))'], [0.0, 0.0], TENSOR_COVS[0])}), 3) as loglik from lineitem group by 1")
def tensor_regression_loglik(spark, d):
    """Two outputs that are linear in each of two inputs."""
    part = expfam.tensor_regression_loglik(TENSOR_A, TENSOR_COVS[0], tensor_inputs(), [F.col("l_discount") * 20, F.col("l_tax") * 25])
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r(F.sum(part), 3).alias("loglik"))


PRODUCTS = [f"({a}) * ({b})" for a in INPUTS[0] for b in INPUTS[1]]


@query(
    f"select l_returnflag, count(*) as n, {', '.join(f'round(sum({PRODUCTS[i]} * {PRODUCTS[j]}), 3) as xx_{i}_{j}' for i, j in combinations_with_replacement(range(4), 2))}, "
    f"{', '.join(f'round(sum({x} * l_discount * 20), 3) as xy_{i}' for i, x in enumerate(PRODUCTS))}, round(sum(power(l_discount * 20, 2)), 3) as yy from lineitem group by 1"
)
def tensor_regression_suffstats(spark, d):
    out = expfam.tensor_regression_stats(table(spark, d, "lineitem"), ["l_returnflag"], tensor_inputs(), F.col("l_discount") * 20)
    return rounded(out, *[c for c in out.columns if c not in ("l_returnflag", "n")], digits=3)


# ---- joint, posterior and a random walk --------------------------------------------------------------

PRIOR = 1.5
FRONT = f"lgamma(k * {PRIOR}) - k * lgamma({PRIOR})"


@query(
    f"""with c as (select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2), p as (select o_orderpriority, count(*) / (select count(*)::double from orders) as theta from orders group by 1),
    s as (select o_orderstatus, count(*) as k, sum(n) as n, sum(({PRIOR} - 1) * ln(theta)) as a, sum(n * ln(theta)) as b, sum(lgamma(n + {PRIOR})) as g from c join p using (o_orderpriority) group by 1),
    t as (select o_orderstatus, {FRONT} + a as log_params, b as log_likelihood, {FRONT} - lgamma(n + k * {PRIOR}) + g as log_marginal from s)
    select o_orderstatus, round(log_params, 5) as log_params, round(log_likelihood, 4) as log_likelihood, round(log_marginal, 4) as log_marginal, round(log_params + log_likelihood, 4) as log_joint,
    round(log_params + log_likelihood - log_marginal, 4) as log_posterior from t"""
)
def dirichlet_log_terms(spark, d):
    """Prior, joint and posterior density of the overall proportions of priorities, given the counts of each status."""
    orders = table(spark, d, "orders")
    p = expfam.proportions(expfam.counts(orders, "o_orderpriority"), [], name="theta").select("o_orderpriority", "theta")
    c = expfam.counts(orders, "o_orderstatus", "o_orderpriority").join(p, "o_orderpriority")
    out = rounded(expfam.dirichlet_log_terms(c, ["o_orderstatus"], "theta", PRIOR), "log_params", digits=5)
    return rounded(out, "log_likelihood", "log_marginal", "log_joint", "log_posterior", digits=4)


WALK, WIDTH = 100, 0.5
WALK_P = "(-abs(({x}) - m) * 4.0 - 0.5 * power({x}, 2) / 9.0)"


@query(
    f"""with recursive m as (select event_type, s / n as m from ({LOGS})), u as (select event_type, m, k, {uniform_sql("'mh'", 'event_type', 'k', "'step'")} as us, {uniform_sql("'mh'", 'event_type', 'k', "'take'")} as ut from m, range(1, {WALK + 1}) as t(k)),
    w as (select event_type, 0::bigint as k, m + 1.0 as x, {WALK_P.format(x='m + 1.0')} as lp, 0 as moved from m
      union all select event_type, k, case when ok then y else x end, case when ok then lq else lp end, ok::int from (
        select *, ln(ut) < lq - lp as ok from (select *, {WALK_P.format(x='y')} as lq from (select u.event_type, u.k, u.m, w.x, w.lp, u.ut, w.x + {WIDTH} * (2 * u.us - 1) as y from w join u on u.event_type = w.event_type and u.k = w.k + 1))))
    select event_type, sum(moved)::bigint as moved, round(avg(x), 6) as mean, round(arg_max(x, k), 6) as last from w group by 1"""
)
def metropolis_chain(spark, d):
    """A random walk per event type to a peaked density around its mean, with fixed uniforms."""
    rows = log_values(spark, d).select("event_type", (F.col("s_0") / F.col("n")).alias("m"))
    density = lambda x: -F.abs(x - F.col("m")) * 4.0 - 0.5 * F.pow(x, F.lit(2)) / 9.0
    out = rows.withColumn("w", expfam.metropolis_chain(density, F.col("m") + 1.0, WALK, WIDTH, F.lit("mh"), "event_type"))
    fold = lambda name: F.aggregate("w", F.lit(0.0), lambda a, s: a + s[name])
    return longs(out.select("event_type", fold("moved").alias("moved"), r(fold("x") / F.size("w")).alias("mean"), r(F.element_at("w", -1)["x"]).alias("last")), "moved")
