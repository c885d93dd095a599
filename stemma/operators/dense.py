"""Small dense linear algebra for grouped work: matrix distributions, Kalman filters and LDS learning in numpy.

Statistics are summed by Spark; what is here runs on matrices of a few dimensions, per key inside
``mapInPandas`` (many sequences in one pass) or on the driver for parameters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LN_2PI = math.log(2 * math.pi)


def sym(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def logdet(a: np.ndarray) -> float:
    return 2 * float(np.log(np.diag(np.linalg.cholesky(sym(a)))).sum())


def multigammaln(x: float, p: int) -> float:
    return p * (p - 1) / 4 * math.log(math.pi) + sum(math.lgamma(x - i / 2) for i in range(p))


def mvn_logpdf(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> float:
    c = np.linalg.cholesky(sym(cov))
    z = np.linalg.solve(c, x - mean)
    return float(-0.5 * z @ z - np.log(np.diag(c)).sum() - len(mean) / 2 * LN_2PI)


# ---- distributions --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Normal:
    mean: np.ndarray
    cov: np.ndarray

    def natural(self):
        p = np.linalg.inv(self.cov)
        return -0.5 * p, p @ self.mean

    @classmethod
    def from_natural(cls, n1, n2):
        cov = np.linalg.inv(-2 * n1)
        return cls(cov @ n2, cov)

    def log_partition(self) -> float:
        return float(0.5 * self.mean @ np.linalg.solve(self.cov, self.mean) + 0.5 * logdet(self.cov) + len(self.mean) / 2 * LN_2PI)

    def log_likelihood(self, x) -> float:
        return mvn_logpdf(np.asarray(x), self.mean, self.cov)

    def entropy(self) -> float:
        return 0.5 * (logdet(self.cov) + len(self.mean) * (1 + LN_2PI))

    def kl(self, other: Normal) -> float:
        d, k = other.mean - self.mean, len(self.mean)
        return float(0.5 * (np.trace(np.linalg.solve(other.cov, self.cov)) + d @ np.linalg.solve(other.cov, d) - k + logdet(other.cov) - logdet(self.cov)))

    def sample(self, g: np.random.Generator, n: int) -> np.ndarray:
        return self.mean + g.normal(size=(n, len(self.mean))) @ np.linalg.cholesky(self.cov).T

    def marginal(self, keep: list[int]) -> Normal:
        return Normal(self.mean[keep], self.cov[np.ix_(keep, keep)])


def marginalize(j11, j12, j22, h1, h2, logz=0.0):
    """Integrates x2 out of a Gaussian in information form: (J, h, logZ) of x1."""
    s = np.linalg.solve(j22, np.column_stack([j12.T, h2]))
    return j11 - j12 @ s[:, :-1], h1 - j12 @ s[:, -1], logz + 0.5 * float(h2 @ s[:, -1]) - 0.5 * logdet(j22) + len(h2) / 2 * LN_2PI


@dataclass(frozen=True)
class InverseWishart:
    psi: np.ndarray
    nu: float

    def log_partition(self) -> float:
        p = len(self.psi)
        return self.nu * p / 2 * math.log(2) + multigammaln(self.nu / 2, p) - self.nu / 2 * logdet(self.psi)

    def log_likelihood(self, x) -> float:
        p = len(self.psi)
        return -self.log_partition() - (self.nu + p + 1) / 2 * logdet(x) - 0.5 * float(np.trace(np.linalg.solve(x, self.psi)))

    def sample(self, g: np.random.Generator) -> np.ndarray:
        """Bartlett: a Wishart draw from chi-squares and normals, inverted through its factor."""
        p = len(self.psi)
        c = np.linalg.cholesky(np.linalg.inv(self.psi))
        a = np.tril(g.normal(size=(p, p)), -1) + np.diag(np.sqrt(g.chisquare(self.nu - np.arange(p))))
        f = np.linalg.inv(c @ a)
        return sym(f.T @ f)

    def mode(self) -> np.ndarray:
        return self.psi / (self.nu + len(self.psi) + 1)


@dataclass(frozen=True)
class NormalInverseWishart:
    mean: np.ndarray
    kappa: float
    psi: np.ndarray
    nu: float

    def update(self, n: float, s: np.ndarray, ss: np.ndarray) -> NormalInverseWishart:
        k = self.kappa + n
        m = (self.kappa * self.mean + s) / k
        return NormalInverseWishart(m, k, sym(self.psi + ss + self.kappa * np.outer(self.mean, self.mean) - k * np.outer(m, m)), self.nu + n)

    def log_partition(self) -> float:
        p = len(self.mean)
        return InverseWishart(self.psi, self.nu).log_partition() + p / 2 * LN_2PI - p / 2 * math.log(self.kappa)

    def log_marginal(self, n: float, s, ss) -> float:
        return self.update(n, s, ss).log_partition() - self.log_partition() - n * len(self.mean) / 2 * LN_2PI

    def sample(self, g) -> Normal:
        cov = InverseWishart(self.psi, self.nu).sample(g)
        return Normal(Normal(self.mean, cov / self.kappa).sample(g, 1)[0], cov)


@dataclass(frozen=True)
class Regression:
    """y = a x + N(0, cov)."""

    a: np.ndarray
    cov: np.ndarray

    def log_likelihood(self, x, y) -> float:
        return mvn_logpdf(np.asarray(y), self.a @ np.asarray(x), self.cov)

    def inverse(self, x: Normal) -> tuple[Regression, Normal]:
        """x given y as a regression (with an intercept, in the normal of y): the same joint, turned round."""
        y = Normal(self.a @ x.mean, sym(self.a @ x.cov @ self.a.T + self.cov))
        gain = np.linalg.solve(y.cov, self.a @ x.cov).T
        return Regression(gain, sym(x.cov - gain @ self.a @ x.cov)), y

    def to_joint(self, n1, n2):
        """Natural parameters of (y, x) when x has natural parameters n1, n2."""
        p = np.linalg.inv(self.cov)
        pa = p @ self.a
        return -0.5 * p, pa, n1 - 0.5 * self.a.T @ pa, n2

    @classmethod
    def mle(cls, xx, yx, yy, n: float) -> Regression:
        a = np.linalg.solve(xx, yx.T).T
        return cls(a, sym(yy - a @ yx.T) / n)


@dataclass(frozen=True)
class MatrixNormalInverseWishart:
    m: np.ndarray
    v: np.ndarray
    psi: np.ndarray
    nu: float

    def update(self, n: float, xx, yx, yy) -> MatrixNormalInverseWishart:
        vi = np.linalg.inv(self.v)
        vn = np.linalg.inv(vi + xx)
        mn = (self.m @ vi + yx) @ vn
        return MatrixNormalInverseWishart(mn, sym(vn), sym(self.psi + yy + self.m @ vi @ self.m.T - mn @ (vi + xx) @ mn.T), self.nu + n)

    def log_partition(self) -> float:
        n, p = self.m.shape
        return InverseWishart(self.psi, self.nu).log_partition() + n / 2 * logdet(self.v) + n * p / 2 * LN_2PI

    def sample(self, g) -> Regression:
        cov = InverseWishart(self.psi, self.nu).sample(g)
        a = self.m + np.linalg.cholesky(cov) @ g.normal(size=self.m.shape) @ np.linalg.cholesky(self.v).T
        return Regression(a, cov)


@dataclass(frozen=True)
class TensorNormal:
    """A tensor with one covariance per axis; the whole covariance is their Kronecker product."""

    mean: np.ndarray
    covs: tuple[np.ndarray, ...]

    def flat(self) -> Normal:
        c = np.ones((1, 1))
        for x in self.covs:
            c = np.kron(c, x)
        return Normal(self.mean.ravel(), c)

    def log_likelihood(self, x: np.ndarray) -> float:
        z, size = x - self.mean, self.mean.size
        det = sum(size / len(c) * logdet(c) for c in self.covs)
        w = z
        for i, c in enumerate(self.covs):
            w = np.moveaxis(np.tensordot(np.linalg.inv(c), w, axes=(1, i)), 0, i)
        return float(-0.5 * (z * w).sum() - 0.5 * det - size / 2 * LN_2PI)

    def sample(self, g) -> np.ndarray:
        z = g.normal(size=self.mean.shape)
        for i, c in enumerate(self.covs):
            z = np.moveaxis(np.tensordot(np.linalg.cholesky(c), z, axes=(1, i)), 0, i)
        return self.mean + z


@dataclass(frozen=True)
class TensorRegression:
    """y = A(x_1, .., x_N) + N(0, cov), multilinear in the inputs; the output axis of A is the first."""

    a: np.ndarray
    cov: np.ndarray

    def predict(self, xs) -> np.ndarray:
        out = self.a
        for x in reversed(xs):
            out = out @ np.asarray(x)
        return out

    def log_likelihood(self, xs, y) -> float:
        return mvn_logpdf(np.asarray(y), self.predict(xs), self.cov)


@dataclass(frozen=True)
class TensorCategorical:
    p: np.ndarray

    def log_likelihood(self, states) -> float:
        return float(np.log(self.p[tuple(states)]))

    def sample(self, u: np.ndarray) -> np.ndarray:
        flat = np.searchsorted(np.cumsum(self.p.ravel()), u * self.p.sum(), side="right")
        return np.stack(np.unravel_index(np.minimum(flat, self.p.size - 1), self.p.shape), axis=1)


def metropolis(log_p, start: np.ndarray, n: int, scale: float, g: np.random.Generator, burn_in: int = 0, skip: int = 1) -> np.ndarray:
    """Random-walk Metropolis-Hastings."""
    x, lp, out = np.array(start, float), log_p(start), []
    for k in range(burn_in + n * skip):
        y = x + g.normal(scale=scale, size=x.shape)
        lq = log_p(y)
        if math.log(g.random()) < lq - lp:
            x, lp = y, lq
        if k >= burn_in and (k - burn_in) % skip == 0:
            out.append(x.copy())
    return np.array(out)


# ---- linear dynamical systems ---------------------------------------------------------------------


@dataclass(frozen=True)
class LDS:
    """x_1 ~ N(m0, v0), x_t = a x_t-1 + u_t + N(0, q), y_t = c x_t + N(0, r).  ``modes``: one a per mode."""

    m0: np.ndarray
    v0: np.ndarray
    a: np.ndarray
    q: np.ndarray
    c: np.ndarray
    r: np.ndarray
    modes: tuple[np.ndarray, ...] = ()

    def step(self, z) -> np.ndarray:
        return self.modes[int(z)] if self.modes else self.a

    def filter(self, ys, us=None, zs=None, stable: bool = True):
        """Means, covariances and log P(Y).  ys[t] is a list of measurement vectors (none: missing).

        stable: Joseph's form, which keeps covariances positive definite; both forms agree otherwise.
        """
        means, covs, loglik, eye = [], [], 0.0, np.eye(len(self.m0))
        m, v = self.m0, self.v0
        for t, measured in enumerate(ys):
            if t:
                a = self.step(zs[t]) if zs is not None else self.a
                m, v = a @ m + (np.nan_to_num(us[t]) if us is not None else 0), sym(a @ v @ a.T + self.q)
            for y in measured:
                s = sym(self.c @ v @ self.c.T + self.r)
                k = np.linalg.solve(s, self.c @ v).T
                loglik += mvn_logpdf(np.asarray(y), self.c @ m, s)
                m = m + k @ (y - self.c @ m)
                v = sym((eye - k @ self.c) @ v @ (eye - k @ self.c).T + k @ self.r @ k.T) if stable else sym(v - k @ self.c @ v)
            means.append(m)
            covs.append(v)
        return means, covs, loglik

    def smooth(self, ys, us=None, zs=None):
        """Smoothed means, covariances, covariances with the next step, and log P(Y)."""
        means, covs, loglik = self.filter(ys, us, zs)
        ms, vs, cross = [means[-1]], [covs[-1]], []
        for t in range(len(ys) - 2, -1, -1):
            a = self.step(zs[t + 1]) if zs is not None else self.a
            p = sym(a @ covs[t] @ a.T + self.q)
            g = np.linalg.solve(p, a @ covs[t]).T
            u = np.nan_to_num(us[t + 1]) if us is not None else 0
            cross.append(g @ vs[-1])
            ms.append(means[t] + g @ (ms[-1] - a @ means[t] - u))
            vs.append(sym(covs[t] + g @ (vs[-1] - p) @ g.T))
        return ms[::-1], vs[::-1], cross[::-1], loglik

    def sample_states(self, ys, g: np.random.Generator) -> np.ndarray:
        """States drawn from P(x | Y): filter forward, sample backward."""
        means, covs, _ = self.filter(ys)
        out = [Normal(means[-1], covs[-1]).sample(g, 1)[0]]
        for m, v in zip(means[-2::-1], covs[-2::-1], strict=True):
            p = sym(self.a @ v @ self.a.T + self.q)
            k = np.linalg.solve(p, self.a @ v).T
            out.append(Normal(m + k @ (out[-1] - self.a @ m), sym(v - k @ self.a @ v)).sample(g, 1)[0])
        return np.array(out[::-1])

    def log_joint(self, xs: np.ndarray, ys) -> float:
        """ln P(x, y) of complete data."""
        lp = mvn_logpdf(xs[0], self.m0, self.v0) + sum(mvn_logpdf(b, self.a @ a, self.q) for a, b in zip(xs, xs[1:], strict=False))
        return lp + sum(mvn_logpdf(np.asarray(y), self.c @ x, self.r) for x, t in zip(xs, ys, strict=True) for y in t)

    def information_filter(self, ys):
        """The same log P(Y) by information-form messages: predict with a Schur complement, update by addition."""
        qi, ri = np.linalg.inv(self.q), np.linalg.inv(self.r)
        j = np.linalg.inv(self.v0)
        h = j @ self.m0
        logz = -0.5 * float(self.m0 @ h) - 0.5 * logdet(self.v0) - len(h) / 2 * LN_2PI
        for t, measured in enumerate(ys):
            if t:
                j12 = -qi @ self.a
                j, h, logz = marginalize(qi, j12, self.a.T @ qi @ self.a + j, np.zeros(len(h)), h, logz)
                logz += -0.5 * logdet(self.q) - len(h) / 2 * LN_2PI
            for y in measured:
                j = j + self.c.T @ ri @ self.c
                h = h + self.c.T @ ri @ y
                logz += -0.5 * float(np.asarray(y) @ ri @ y) - 0.5 * logdet(self.r) - len(self.r) / 2 * LN_2PI
        return logz + 0.5 * float(h @ np.linalg.solve(j, h)) - 0.5 * logdet(j) + len(h) / 2 * LN_2PI

    def simulate(self, n: int, m: int, g: np.random.Generator):
        """States (n, d) and measurements (n, m, d_obs)."""
        x, xs = Normal(self.m0, self.v0).sample(g, 1)[0], []
        for _ in range(n):
            xs.append(x)
            x = self.a @ x + Normal(np.zeros(len(x)), self.q).sample(g, 1)[0]
        ys = [[self.c @ x + Normal(np.zeros(len(self.r)), self.r).sample(g, 1)[0] for _ in range(m)] for x in xs]
        return np.array(xs), np.array(ys)

    def stabilised(self, low: float = 0.1, high: float = 0.9) -> LDS:
        """Singular values of the dynamics clamped, so that simulations stay bounded."""
        u, s, w = np.linalg.svd(self.a)
        return replace(self, a=u @ np.diag(np.clip(s, low, high)) @ w)


#: Steps of all sequences that numpy works on side by side.
SIDE_BY_SIDE = 200_000


def smooth_many(model: LDS, ys: np.ndarray, lengths: np.ndarray, us: np.ndarray | None = None, zs: np.ndarray | None = None):
    """:meth:`LDS.smooth` for N sequences at once: ys (N, T, M, d_obs) with NaN for what is missing, us (N, T, d), zs (N, T).

    Gives means (N, T, d), covariances (N, T, d, d), covariances with the next step (N, T - 1, d, d), log P(Y) (N).
    """
    n, steps, repeats, _ = ys.shape
    d, c, eye = len(model.m0), model.c, np.eye(len(model.m0))
    trans = (lambda t: np.stack(model.modes)[zs[:, t]]) if zs is not None and model.modes else (lambda t: np.broadcast_to(model.a, (n, d, d)))
    move = lambda t: np.nan_to_num(us[:, t]) if us is not None else 0.0
    turned = lambda x: np.swapaxes(x, -1, -2)
    means, covs, loglik = np.empty((n, steps, d)), np.empty((n, steps, d, d)), np.zeros(n)
    m, v = np.tile(model.m0, (n, 1)), np.tile(model.v0, (n, 1, 1))
    for t in range(steps):
        if t:
            a = trans(t)
            m, v = np.einsum("nij,nj->ni", a, m) + move(t), a @ v @ turned(a) + model.q
        for k in range(repeats):
            seen = ~np.isnan(ys[:, t, k]).any(axis=1)
            if not seen.any():
                continue
            s = c @ v @ c.T + model.r
            gain = turned(np.linalg.solve(s, c @ v))
            gap = np.where(seen[:, None], ys[:, t, k], 0.0) - m @ c.T
            loglik += np.where(seen, -0.5 * (np.einsum("ni,ni->n", gap, np.linalg.solve(s, gap[..., None])[..., 0]) + np.linalg.slogdet(s)[1] + len(c) * LN_2PI), 0.0)
            left = eye - gain @ c
            m = np.where(seen[:, None], m + np.einsum("nij,nj->ni", gain, gap), m)
            v = np.where(seen[:, None, None], left @ v @ turned(left) + gain @ model.r @ turned(gain), v)
        means[:, t], covs[:, t] = m, v
    cross = np.zeros((n, max(0, steps - 1), d, d))
    for t in range(steps - 2, -1, -1):
        a, inside = trans(t + 1), t + 1 < lengths
        p = a @ covs[:, t] @ turned(a) + model.q
        g = turned(np.linalg.solve(p, a @ covs[:, t]))
        cross[:, t] = np.where(inside[:, None, None], g @ covs[:, t + 1], 0.0)
        gap = means[:, t + 1] - np.einsum("nij,nj->ni", a, means[:, t]) - move(t + 1)
        covs[:, t] = np.where(inside[:, None, None], covs[:, t] + g @ (covs[:, t + 1] - p) @ turned(g), covs[:, t])
        means[:, t] = np.where(inside[:, None], means[:, t] + np.einsum("nij,nj->ni", g, gap), means[:, t])
    return means, covs, cross, loglik


def packed(obs: DataFrame, controls: DataFrame | None = None, modes: DataFrame | None = None) -> DataFrame:
    """seq_id, ys, us, zs: a sequence in a row, from obs (seq_id, t, m, d, y), controls (seq_id, t, d, u) and modes (seq_id, t, z)."""
    lists = lambda df, name, *cols: df.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    out = lists(obs, "ys", "t", "m", "d", "y")
    for df, name, cols in ((controls, "us", ("t", "d", "u")), (modes, "zs", ("t", "z"))):
        out = out.join(lists(df, name, *cols), "seq_id", "left") if df is not None else out.withColumn(name, F.lit(None).cast("array<struct<t:bigint>>"))
    return out


def batches(pdf: pd.DataFrame, model: LDS):
    """(ids, ys, lengths, us, zs) of sequences of like length, a bounded number of steps at a time."""
    rows = []
    for r in pdf.itertuples(index=False):
        a = np.array([(x["t"], x["m"], x["d"], np.nan if x["y"] is None else x["y"]) for x in r.ys], float)
        rows.append((int(a[:, 0].max()) + 1, r, a))
    rows.sort(key=lambda x: x[0])
    while rows:
        width = rows[-1][0]
        take = max(1, SIDE_BY_SIDE // width)
        part, rows = rows[-take:], rows[:-take]
        n, repeats = len(part), int(max(a[:, 1].max() for *_, a in part)) + 1
        ys = np.full((n, width, repeats, len(model.r)), np.nan)
        us = np.zeros((n, width, len(model.m0))) if part[0][1].us is not None or any(r.us is not None for _, r, _ in part) else None
        zs = np.zeros((n, width), np.int64) if model.modes else None
        for k, (_, r, a) in enumerate(part):
            ys[(k, *a[:, :3].astype(np.int64).T)] = a[:, 3]
            for x in r.us if us is not None and r.us is not None else []:
                us[k, x["t"], x["d"]] = np.nan if x["u"] is None else x["u"]
            for x in r.zs if zs is not None and r.zs is not None else []:
                zs[k, x["t"]] = x["z"]
        yield [int(r.seq_id) for _, r, _ in part], ys, np.array([t for t, *_ in part]), us, zs


def kalman(model: LDS, seqs: DataFrame, controls: DataFrame | None = None, modes: DataFrame | None = None) -> DataFrame:
    """seq_id, t, d, mean, variance (smoothed) and logz; many sequences in one pass of numpy."""

    def run(parts):
        for pdf in parts:
            for ids, ys, lengths, us, zs in batches(pdf, model):
                ms, vs, _, z = smooth_many(model, ys, lengths, us, zs)
                var = np.diagonal(vs, axis1=2, axis2=3)
                yield pd.DataFrame({"seq_id": ids, "logz": z, "mean": [m[:k].ravel() for m, k in zip(ms, lengths, strict=True)], "variance": [v[:k].ravel() for v, k in zip(var, lengths, strict=True)]})

    d = len(model.m0)
    out = packed(seqs, controls, modes).mapInPandas(run, "seq_id long, logz double, mean array<double>, variance array<double>")
    rows = out.select("seq_id", "logz", F.posexplode(F.arrays_zip("mean", "variance")).alias("_i", "_x"))
    return rows.select("seq_id", F.floor(F.col("_i") / d).alias("t"), (F.col("_i") % d).cast("long").alias("d"), "_x.mean", "_x.variance", "logz")


def log_marginals(model: LDS, rows: DataFrame) -> DataFrame:
    """seq_id, logz of packed sequences."""

    def run(parts):
        for pdf in parts:
            for ids, ys, lengths, us, zs in batches(pdf, model):
                yield pd.DataFrame({"seq_id": ids, "logz": smooth_many(model, ys, lengths, us, zs)[3]})

    return rows.mapInPandas(run, "seq_id long, logz double")


def summed(ms: np.ndarray, second: np.ndarray, after: np.ndarray, ys: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """Moments for the M-step, summed over sequences: second = E[x x'], after = E[x_t+1 x_t']."""
    n, steps = ms.shape[:2]
    at = np.arange(steps)[None]
    inside, has_next = at < lengths[:, None], at[:, : steps - 1] + 1 < lengths[:, None]
    seen = ~np.isnan(ys).any(axis=3)
    y = np.where(seen[..., None], ys, 0.0)
    masked = lambda x, m: np.einsum("ntij,nt->ij", x, m.astype(float))
    return {
        "n": np.array([float(n)]), "m0": ms[:, 0].sum(axis=0), "e0": second[:, 0].sum(axis=0), "steps": np.array([float(has_next.sum())]),
        "xx": masked(second[:, : steps - 1], has_next), "nn": masked(second[:, 1:], has_next), "nx": masked(after, has_next),
        "obs": np.array([float((seen & inside[..., None]).sum())]), "oxx": np.einsum("ntij,ntm->ij", second, seen.astype(float)),
        "yx": np.einsum("ntmi,ntj->ij", y, ms), "yy": np.einsum("ntmi,ntmj->ij", y, y),
    }


def named(tot: dict[str, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame([(k, i, float(x)) for k, v in tot.items() for i, x in enumerate(np.ravel(v))], columns=["name", "i", "value"])


def totals(rows: DataFrame, run) -> dict[str, np.ndarray]:
    """Flat sums by name; only they return to the driver."""
    got: dict[str, dict[int, float]] = {}
    for r in rows.mapInPandas(run, "name string, i long, value double").groupBy("name", "i").agg(F.sum("value").alias("value")).collect():
        got.setdefault(r["name"], {})[r["i"]] = r["value"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in got.items()}


def lds_em_step(model: LDS, rows: DataFrame) -> tuple[LDS, float]:
    """rows: packed sequences without controls.  One Spark job; moments are summed by Spark."""

    def run(parts):
        for pdf in parts:
            for _, ys, lengths, us, zs in batches(pdf, model):
                ms, vs, cross, z = smooth_many(model, ys, lengths, us, zs)
                second = np.einsum("nti,ntj->ntij", ms, ms) + vs
                after = np.einsum("nti,ntj->ntij", ms[:, 1:], ms[:, :-1]) + np.swapaxes(cross, -1, -2)
                yield named(summed(ms, second, after, ys, lengths) | {"loglik": np.array([z.sum()])})

    a = totals(rows, run)
    d = len(model.m0)
    sq = lambda k: a[k].reshape(d, d)
    n = a["n"][0]
    m0 = a["m0"] / n
    dyn = Regression.mle(sq("xx"), sq("nx"), sq("nn"), a["steps"][0])
    out = Regression.mle(sq("oxx"), a["yx"].reshape(model.c.shape), a["yy"].reshape(model.r.shape), a["obs"][0])
    return LDS(m0, sym(sq("e0") / n - np.outer(m0, m0)), dyn.a, dyn.cov, out.a, out.cov), float(a["loglik"][0])


def lds_gibbs_step(model: LDS, rows: DataFrame, prior: MatrixNormalInverseWishart, out_prior: MatrixNormalInverseWishart, start: NormalInverseWishart, seed: int) -> LDS:
    """States drawn from P(x | Y) on the executors (seeded by sequence), then parameters from their conjugate posteriors."""

    def run(parts):
        for pdf in parts:
            for ids, ys, lengths, _, _ in batches(pdf, model):
                for i, y, k in zip(ids, ys, lengths, strict=True):
                    xs = model.sample_states([[r for r in step if not np.isnan(r).any()] for step in y[:k]], np.random.default_rng([seed, i % (1 << 32), i >> 32 & 0xFFFF_FFFF]))[None]
                    pairs = np.einsum("nti,ntj->ntij", xs, xs)
                    yield named(summed(xs, pairs, np.einsum("nti,ntj->ntij", xs[:, 1:], xs[:, :-1]), y[None, :k], np.array([k])))

    a, g, d = totals(rows, run), np.random.default_rng(seed), len(model.m0)
    sq = lambda k: a[k].reshape(d, d)
    first = start.update(a["n"][0], a["m0"], sq("e0")).sample(g)
    dyn = prior.update(a["steps"][0], sq("xx"), sq("nx"), sq("nn")).sample(g)
    out = out_prior.update(a["obs"][0], sq("oxx"), a["yx"].reshape(model.c.shape), a["yy"].reshape(model.r.shape)).sample(g)
    return LDS(first.mean, first.cov, dyn.a, dyn.cov, out.a, out.cov)
