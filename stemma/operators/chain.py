"""Hidden Markov chains as folds over arrays: one row per sequence, everything inside Spark expressions.

A sequence is collected once (one shuffle on its key) into an array ordered by time; filters, smoothing,
Viterbi and sampling are ``aggregate`` folds over that array, so nothing is shuffled again.  Parameters
are small driver values that become literals.  All probabilities are natural logarithms; transition
tables are [from][to].
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.special import lse, lse_array, normal_full_logpdf, normal_logpdf, total

NEVER = -1e300


def ln(x: float) -> float:
    return math.log(x) if x > 0 else NEVER


@dataclass(frozen=True)
class HMM:
    """Initial, transition and (for categorical emissions) emission probabilities."""

    pi: tuple[float, ...]
    a: tuple[tuple[float, ...], ...]
    e: tuple[tuple[float, ...], ...] = ()

    @property
    def k(self) -> int:
        return len(self.pi)


def vector(xs) -> Column:
    return F.array(*[x if isinstance(x, Column) else F.lit(float(x)) for x in xs])


def at(array: Column, i) -> Column:
    return F.get(array, i if isinstance(i, Column) else F.lit(i))


def bind(value: Column, f) -> Column:
    """f(value) with the value computed once.

    A column that is named once inside a lambda may be replaced by its own expression there and then be
    computed for every element; a lambda's argument never is.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Steps that a scan appends to one list before it starts the next.
RUN = 512


def scan(xs: Column, start: Column, step) -> Column:
    """Array of ``start`` and of the state after each x, state' = step(state, x).

    A fold that appends copies all it has at each step.  Here it appends to a run of ``RUN`` states, and
    the runs are joined at the end, so the time is linear but for the list of runs.
    """

    def runs(values: Column) -> Column:
        n = F.ceil(F.size(values) / RUN).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(values, i * RUN + 1, F.lit(RUN)))

        def run(acc: Column, part: Column) -> Column:
            made = F.aggregate(part, F.array(acc["last"]), lambda got, x: F.concat(got, F.array(step(F.element_at(got, -1), x))))
            return bind(made, lambda got: F.struct(F.element_at(got, -1).alias("last"), F.concat(acc["done"], F.array(F.slice(got, F.lit(2), F.size(got)))).alias("done")))

        zero = F.transform(F.array(start), lambda x: F.struct(x.alias("last"), F.array(F.array(x)).alias("done")))
        return F.flatten(F.aggregate(cut, F.get(zero, F.lit(0)), run)["done"])

    return bind(xs, runs)


def rest(xs: Column) -> Column:
    """All but the first."""
    return F.slice(xs, F.lit(2), F.size(xs))


def together(*names: str) -> Column:
    return F.struct(*[F.col(n) for n in names])


def sequences(df: DataFrame, seq: str, order: list[str], *obs: str) -> DataFrame:
    """seq_id and xs: the observations (a struct of ``obs`` columns) ordered in an array."""
    item = F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(o) for o in obs])
    rows = df.groupBy(F.col(seq).alias("seq_id")).agg(F.array_sort(F.collect_list(item)).alias("_x"))
    return rows.select("seq_id", F.transform("_x", lambda x: F.struct(*[x[o].alias(o) for o in obs])).alias("xs"))


# ---- log-likelihood of one observation under each state, as array<double> -------------------------


def categorical(model: HMM, y: Column) -> Column:
    """Zero for a missing observation."""
    return vector([F.coalesce(at(vector([ln(p) for p in row]), y.cast("int")), F.lit(0.0)) for row in model.e])


def gaussian(means, variances, y: Column) -> Column:
    return vector([F.coalesce(normal_logpdf(y, m, v), F.lit(0.0)) for m, v in zip(means, variances, strict=True)])


def gaussian_diagonal(means, variances, ys: Column) -> Column:
    """Several dimensions with a diagonal covariance per state; ``ys`` is an array, null entries are missing."""
    one = lambda m, v: total(F.coalesce(normal_logpdf(at(ys, i), a, b), F.lit(0.0)) for i, (a, b) in enumerate(zip(m, v, strict=True)))
    return vector([one(m, v) for m, v in zip(means, variances, strict=True)])


def gaussian_full(means, covs, ys: Column) -> Column:
    """Several dimensions with a whole covariance per state; null entries of the array ``ys`` are integrated out.

    There is one marginal for each set of entries that may be seen, so the dimensions must be few.
    """
    d = len(means[0])
    seen = [list(s) for n in range(d, 0, -1) for s in combinations(range(d), n)]

    def one(m, cov) -> Column:
        # the first that isn't null is that of exactly the entries that are seen
        return F.coalesce(*[normal_full_logpdf([at(ys, i) - float(m[i]) for i in s], np.asarray(cov, float)[np.ix_(s, s)]) for s in seen], F.lit(0.0))

    return vector([one(m, c) for m, c in zip(means, covs, strict=True)])


def regression_full(matrices, intercepts, covs, previous: Column, xs: Column) -> Column:
    """Mode likelihoods of a step of a vector chain, x = A previous + b + noise; zero for a step without a predecessor."""

    def one(a, b, cov) -> Column:
        d = range(len(b))
        return F.coalesce(normal_full_logpdf([at(xs, i) - (total(float(a[i][j]) * at(previous, j) for j in d) + float(b[i])) for i in d], cov), F.lit(0.0))

    return vector([one(a, b, c) for a, b, c in zip(matrices, intercepts, covs, strict=True)])


def regression(slopes, intercepts, variances, previous: Column, x: Column) -> Column:
    """Mode likelihoods of a step of a continuous chain; zero for the first step, which has no predecessor."""
    return vector([F.coalesce(normal_logpdf(x, s * previous + b, v), F.lit(0.0)) for s, b, v in zip(slopes, intercepts, variances, strict=True)])


# ---- recursions ----------------------------------------------------------------------------------


def step_tables(model: HMM, known: Column | None = None) -> list[list[Column]]:
    """ln P(j -> k) as columns; where ``known`` gives a state, the chain is cut: 0 into it, never elsewhere."""
    table = [[F.lit(ln(p)) for p in row] for row in model.a]
    if known is None:
        return table
    return [[F.when(known.isNull(), t).otherwise(F.when(known == k, 0.0).otherwise(NEVER)) for k, t in enumerate(row)] for row in table]


def start_row(model: HMM, known: Column | None = None) -> list[Column]:
    row = [F.lit(ln(p)) for p in model.pi]
    if known is None:
        return row
    return [F.when(known.isNull(), t).otherwise(F.when(known == k, 0.0).otherwise(NEVER)) for k, t in enumerate(row)]


def forward_step(model: HMM, alpha: Column, like: Column, known: Column | None = None) -> Column:
    t = step_tables(model, known)
    return vector([lse(*[at(alpha, j) + t[j][k] for j in range(model.k)]) + at(like, k) for k in range(model.k)])


def backward_step(model: HMM, beta: Column, like: Column, known: Column | None = None) -> Column:
    """beta before the step from beta, likelihood and cut after it."""
    t = step_tables(model, known)
    return vector([lse(*[t[j][k] + at(like, k) + at(beta, k) for k in range(model.k)]) for j in range(model.k)])


def known_of(x: Column, known: bool) -> Column | None:
    return x["known"] if known else None


def forward(model: HMM, steps: Column, known: bool = False) -> Column:
    """array<array<double>>: ln P(y_1..y_t, x_t) for each t.  ``steps``: array of struct(like[, known])."""
    first = at(steps, 0)
    start = vector([s + at(first["like"], k) for k, s in enumerate(start_row(model, known_of(first, known)))])

    return scan(rest(steps), start, lambda alpha, x: forward_step(model, alpha, x["like"], known_of(x, known)))


def last_alpha(model: HMM, steps: Column, known: bool = False) -> Column:
    """Only the last forward message; nothing is kept on the way."""
    first = at(steps, 0)
    start = vector([s + at(first["like"], k) for k, s in enumerate(start_row(model, known_of(first, known)))])
    return F.aggregate(F.slice(steps, F.lit(2), F.size(steps)), start, lambda acc, x: forward_step(model, acc, x["like"], known_of(x, known)))


def log_marginal(model: HMM, steps: Column, known: bool = False) -> Column:
    return lse_array(last_alpha(model, steps, known))


def backward(model: HMM, steps: Column, known: bool = False) -> Column:
    """array<array<double>>: ln P(y_t+1.. | x_t) for each t."""
    return F.reverse(scan(F.reverse(rest(steps)), vector([0.0] * model.k), lambda beta, x: backward_step(model, beta, x["like"], known_of(x, known))))


def messages(model: HMM, seqs: DataFrame, like, known: bool = False) -> DataFrame:
    """seq_id, steps, alpha, beta, logz.  ``like`` maps an observation struct to the likelihood array."""
    prepared = lambda x: F.struct(like(x).alias("like"), *([x["known"].alias("known")] if known else []))
    both = lambda s: F.struct(s.alias("steps"), forward(model, s, known).alias("alpha"), backward(model, s, known).alias("beta"))
    out = seqs.withColumn("_m", bind(F.transform("xs", prepared), both))
    # every field is wanted twice at least, so the struct is not computed anew for each
    return out.select(*seqs.columns, "_m.steps", "_m.alpha", "_m.beta", bind(F.col("_m"), lambda m: lse_array(F.element_at(m["alpha"], -1))).alias("logz"))


def exploded(df: DataFrame, array: Column, name: str) -> DataFrame:
    """seq_id, t, state, value from an array of arrays."""
    rows = df.select("seq_id", F.posexplode(array).alias("t", "_v"))
    return rows.select("seq_id", F.col("t").cast("long").alias("t"), F.posexplode("_v").alias("state", name)).withColumn("state", F.col("state").cast("long"))


def smoothed(m: DataFrame) -> Column:
    """P(x_t | Y) from the messages, as arrays."""
    return bind(together("alpha", "beta", "logz"), lambda m: F.zip_with(m["alpha"], m["beta"], lambda a, b: F.zip_with(a, b, lambda x, y: F.exp(x + y - m["logz"]))))


def pair_joint(model: HMM) -> Column:
    """array over t of arrays over (j, k): P(x_t = j, x_t+1 = k | Y)."""

    def pairs(m: Column) -> Column:
        def pair(t: Column) -> Column:
            a, b, like = at(m["alpha"], t), at(m["beta"], t + 1), at(m["steps"], t + 1)["like"]
            return vector([F.exp(at(a, j) + ln(model.a[j][k]) + at(like, k) + at(b, k) - m["logz"]) for j in range(model.k) for k in range(model.k)])

        inner = F.sequence(F.lit(0), F.size(m["steps"]) - 2)
        return F.when(F.size(m["steps"]) > 1, F.transform(inner, pair)).otherwise(F.array().cast("array<array<double>>"))

    return bind(together("alpha", "beta", "steps", "logz"), pairs)


def argmax(xs: list[Column]) -> Column:
    """Index of the largest, the first among equals."""
    out, best = F.lit(0), xs[0]
    for k in range(1, len(xs)):
        out, best = F.when(xs[k] > best, k).otherwise(out), F.greatest(best, xs[k])
    return out


def viterbi(model: HMM, steps: Column) -> Column:
    """The most probable states: a scan with back pointers and one back along them; ties go to the lower state."""
    first = at(steps, 0)
    ks = range(model.k)
    start = F.struct(vector([ln(model.pi[k]) + at(first["like"], k) for k in ks]).alias("score"), F.array(*[F.lit(0)] * model.k).alias("back"))

    def add(acc: Column, x: Column) -> Column:
        came = [[at(acc["score"], j) + ln(model.a[j][k]) for j in ks] for k in ks]
        score = vector([(F.greatest(*c) if model.k > 1 else c[0]) + at(x["like"], k) for k, c in enumerate(came)])
        return F.struct(score.alias("score"), F.array(*[argmax(c) for c in came]).alias("back"))

    def path(done: Column) -> Column:
        end = F.element_at(done, -1)["score"]
        return F.reverse(scan(F.reverse(rest(done)), argmax([at(end, k) for k in ks]), lambda state, x: at(x["back"], state)))

    return bind(scan(rest(steps), start, add), path)


def draw(weights: list[Column], u: Column) -> Column:
    """Inverse-CDF draw from unnormalised log weights with the uniform ``u``."""
    top = F.greatest(*weights) if len(weights) > 1 else weights[0]
    p = [F.exp(w - top) for w in weights]
    goal = u * total(p)
    out, left = F.lit(len(p) - 1), F.lit(0.0)
    cuts = []
    for k in range(len(p) - 1):
        left = left + p[k]
        cuts.append((k, goal < left))
    for k, cond in reversed(cuts):
        out = F.when(cond, k).otherwise(out)
    return out


def backwards(n: Column) -> Column:
    """n - 2, .., 0; empty for n < 2."""
    return F.when(n > 1, F.reverse(F.sequence(F.lit(0), n - 2))).otherwise(F.array().cast("array<int>"))


def ffbs(model: HMM, us: Column) -> Column:
    """States drawn from P(x | Y): filter forward (column alpha), sample backward with the uniforms ``us`` by t."""

    def walk(m: Column) -> Column:
        n = F.size(m["alpha"])
        last = at(m["alpha"], n - 1)
        end = draw([at(last, k) for k in range(model.k)], at(m["us"], n - 1))
        before = lambda nxt, t: draw([at(at(m["alpha"], t), j) + at(vector([ln(p) for p in model.a[j]]), nxt) for j in range(model.k)], at(m["us"], t))
        return F.reverse(scan(backwards(n), end, before))

    return bind(F.struct(F.col("alpha"), us.alias("us")), walk)


def simulate(model: HMM, us: Column) -> Column:
    """States drawn from the prior with the uniforms ``us``."""
    start = draw([F.lit(ln(p)) for p in model.pi], at(us, 0))
    return scan(rest(us), start, lambda prev, u: draw([at(vector([ln(model.a[j][k]) for j in range(model.k)]), prev) for k in range(model.k)], u))


def emit(model: HMM, state: Column, u: Column) -> Column:
    """An emission drawn given the state."""
    d = len(model.e[0])
    return draw([at(vector([ln(model.e[j][y]) for j in range(model.k)]), state) for y in range(d)], u)


# ---- expected statistics and learning ------------------------------------------------------------


def expected_stats(model: HMM, m: DataFrame, y: str = "y", with_loglik: bool = False) -> DataFrame:
    """kind ('initial', 'transition', 'emission'; 'loglik' if asked for), i, j, value: sums over all sequences, combined on the map side."""
    k, d = model.k, len(model.e[0])
    cell = lambda kind, i, j, v: F.struct(F.lit(kind).alias("kind"), F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), v.alias("value"))

    def sums(x: Column) -> Column:
        """The few expected counts of one sequence, summed over its steps by folds."""
        g, xi, ys = x["gamma"], x["xi"], x["ys"]
        first = [cell("initial", i, 0, at(at(g, 0), i)) for i in range(k)]
        moved = F.aggregate(xi, vector([0.0] * (k * k)), lambda a, p: F.zip_with(a, p, lambda u, v: u + v))
        seen = F.zip_with(ys, g, lambda y, p: F.struct(y.alias("y"), p.alias("p")))
        pairs = bind(moved, lambda m: F.array(*[cell("transition", i, j, at(m, i * k + j)) for i in range(k) for j in range(k)]))
        out = [cell("emission", i, y, emitted(seen, i, y)) for i in range(k) for y in range(d)]
        return F.concat(F.array(*first), pairs, F.array(*out))

    def emitted(seen: Column, i: int, y: int) -> Column:
        return F.aggregate(seen, F.lit(0.0), lambda a, s: a + F.when(s["y"] == y, at(s["p"], i)).otherwise(0.0))

    g = m.select(F.struct(smoothed(m).alias("gamma"), pair_joint(model).alias("xi"), F.transform("xs", lambda x: x[y].cast("long")).alias("ys")).alias("x"), "logz")
    every = bind(F.col("x"), sums)
    if with_loglik:
        every = F.concat(every, F.array(cell("loglik", 0, 0, F.col("logz"))))
    cells = g.select(F.explode(every).alias("c")).select("c.*")
    return cells.groupBy("kind", "i", "j").agg(F.sum("value").alias("value"))


def m_step(model: HMM, stats: list, prior: float = 0.0) -> HMM:
    """Normalised expected counts (a few rows, on the driver)."""
    d = len(model.e[0])
    got = {(r["kind"], r["i"], r["j"]): r["value"] for r in stats}
    norm = lambda xs: tuple(x / sum(xs) for x in xs)
    return HMM(norm([got.get(("initial", i, 0), 0) + prior for i in range(model.k)]), tuple(norm([got.get(("transition", i, j), 0) + prior for j in range(model.k)]) for i in range(model.k)), tuple(norm([got.get(("emission", i, j), 0) + prior for j in range(d)]) for i in range(model.k)))


def fit_em(model: HMM, seqs: DataFrame, rounds: int = 10, tolerance: float = 1e-8) -> tuple[HMM, list[float]]:
    """EM until the log-likelihood settles; each round one Spark job, only parameter-sized results return."""
    trace: list[float] = []
    for _ in range(rounds):
        m = messages(model, seqs, lambda x, p=model: categorical(p, x["y"]))
        stats = expected_stats(model, m, with_loglik=True).collect()
        trace.append(next(r["value"] for r in stats if r["kind"] == "loglik"))
        model = m_step(model, stats)
        if len(trace) > 1 and abs(trace[-1] - trace[-2]) <= tolerance * abs(trace[-2]):
            break
    return model, trace


# ---- scalar linear dynamical systems -------------------------------------------------------------


@dataclass(frozen=True)
class LDS1:
    """x_1 ~ N(m0, v0), x_t = a x_t-1 + u_t + N(0, q), y_t = c x_t + N(0, r)."""

    m0: float
    v0: float
    a: float
    q: float
    c: float
    r: float


def kalman_update(mean: Column, var: Column, ys: Column, c: float, r: float) -> tuple[Column, Column, Column]:
    """Mean, variance and log-density after the measurements ``ys`` (an array; nulls and none are skipped)."""
    zero = F.struct(mean.alias("m"), var.alias("v"), F.lit(0.0).alias("l"))

    def add(s: Column, y: Column) -> Column:
        spread = c * c * s["v"] + r
        gain = c * s["v"] / spread
        return F.when(y.isNull(), s).otherwise(F.struct((s["m"] + gain * (y - c * s["m"])).alias("m"), (s["v"] - gain * c * s["v"]).alias("v"), (s["l"] + normal_logpdf(y, c * s["m"], spread)).alias("l")))

    return F.aggregate(ys, zero, add)


def kalman_filter(steps: Column, model: LDS1, a: Column | None = None, entering: tuple[Column, Column] | None = None) -> Column:
    """array<struct(m, v, l)> of filtered means, variances and cumulative log-likelihoods.

    steps: array of struct(ys array<double>, u double, z int); u is a control (null: none); with modes,
    ``a`` is an array of transition factors that z picks from.  ``entering``: mean and variance predicted
    for the first step, if it isn't the start.
    """
    first, (m0, v0) = at(steps, 0), entering or (F.lit(model.m0), F.lit(model.v0))

    def add(s: Column, x: Column) -> Column:
        f = factor_of(model, a, x)
        new = kalman_update(f * s["m"] + F.coalesce(x["u"], F.lit(0.0)), f * f * s["v"] + model.q, x["ys"], model.c, model.r)
        return bind(new, lambda n: F.struct(n["m"].alias("m"), n["v"].alias("v"), (s["l"] + n["l"]).alias("l")))

    return scan(rest(steps), kalman_update(m0, v0, first["ys"], model.c, model.r), add)


def factor_of(model: LDS1, a: Column | None, x: Column) -> Column:
    return at(a, x["z"]) if a is not None else F.lit(model.a)


def kalman_smoother(filtered: Column, steps: Column, model: LDS1) -> Column:
    """array<struct(m, v, c)>: smoothed means, variances and the covariance with the next step (0 for the last)."""

    def walk(m: Column) -> Column:
        n = F.size(m["f"])
        last = at(m["f"], n - 1)
        end = F.struct(last["m"].alias("m"), last["v"].alias("v"), F.lit(0.0).alias("c"))
        return F.reverse(scan(backwards(n), end, lambda s, t: smoothed_step(model, at(m["f"], t), s, F.lit(model.a), at(m["s"], t + 1)["u"])))

    return bind(F.struct(filtered.alias("f"), steps.alias("s")), walk)


def smoothed_step(model: LDS1, f: Column, s: Column, a: Column, u: Column) -> Column:
    """struct(m, v, c) of a step from its filtered f and the smoothed s after it, to which a and u lead."""
    p = a * a * f["v"] + model.q
    g = f["v"] * a / p
    return F.struct((f["m"] + g * (s["m"] - a * f["m"] - F.coalesce(u, F.lit(0.0)))).alias("m"), (f["v"] + g * g * (s["v"] - p)).alias("v"), (g * s["v"]).alias("c"))


def lds_moments(df: DataFrame) -> DataFrame:
    """One row of expected moments over all sequences, from columns ``smooth`` and ``steps`` (no control)."""
    rows = df.select(F.explode(F.arrays_zip("smooth", "steps", F.concat(F.slice("smooth", F.lit(2), F.size("smooth")), F.array(F.lit(None).cast("struct<m:double,v:double,c:double>"))).alias("nxt"))).alias("z"), F.col("smooth")[0].alias("first"))
    m, v = F.col("z.smooth.m"), F.col("z.smooth.v")
    nm, nv = F.col("z.nxt.m"), F.col("z.nxt.v")
    y = F.col("z.steps.ys")[0]
    return rows.agg(F.sum(F.when(nm.isNotNull(), m * m + v)).alias("xx"), F.sum(nm * m + F.col("z.smooth.c")).alias("xn"), F.sum(nm * nm + nv).alias("nn"), F.count(nm).alias("steps"), F.sum(m * m + v).alias("all_xx"), F.sum(y * m).alias("yx"), F.sum(y * y).alias("yy"), F.count(y).alias("obs"))


def lds_m_step(row, model: LDS1) -> LDS1:
    a = row["xn"] / row["xx"]
    c = row["yx"] / row["all_xx"]
    return LDS1(model.m0, model.v0, a, (row["nn"] - a * row["xn"]) / row["steps"], c, (row["yy"] - c * row["yx"]) / row["obs"])
