"""Models with one face: fit, predict, generate and score, over sequences or over graphs.

    HMMModel(start).fit(sequences, method="em" | "cavi" | "gibbs").predict(sequences)
    LDSModel(start).fit(packed(obs), method="em" | "gibbs").predict(obs)
    GraphModel(start).fit(packed, method="em" | "cavi" | "svi" | "gibbs").posterior(packed)
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions.special import digamma_py, uniform
from stemma.operators import chain, dense, learning, local
from stemma.operators.chain import HMM
from stemma.operators.factors import Model
from stemma.sources.scratch import staged


def rows_of(m: HMM) -> list[tuple[float, ...]]:
    return [m.pi, *m.a, *m.e]


def each(m: HMM, f) -> HMM:
    return HMM(tuple(f(m.pi)), tuple(tuple(f(r)) for r in m.a), tuple(tuple(f(r)) for r in m.e))


def plus(a: HMM, b: HMM, times: float = 1.0) -> HMM:
    """a + times * b, cell by cell."""
    row = lambda x, y: tuple(p + times * q for p, q in zip(x, y, strict=True))
    return HMM(row(a.pi, b.pi), tuple(map(row, a.a, b.a)), tuple(map(row, a.e, b.e)))


def expected_log(alpha: HMM) -> HMM:
    return each(alpha, lambda r: [float(np.exp(digamma_py(a) - digamma_py(sum(r)))) for a in r])


def chain_counts(m: HMM, stats: list) -> HMM:
    """Expected or drawn counts in the shape of the parameters."""
    got = {(r["kind"], r["i"], r["j"]): r["value"] for r in stats}
    k, d = m.k, len(m.e[0])
    return HMM(tuple(got.get(("initial", i, 0), 0.0) for i in range(k)), tuple(tuple(got.get(("transition", i, j), 0.0) for j in range(k)) for i in range(k)), tuple(tuple(got.get(("emission", i, j), 0.0) for j in range(d)) for i in range(k)))


def drawn_counts(m: HMM, seqs: DataFrame, seed: int) -> list:
    """kind, i, j, value of states drawn from P(x | Y), counted with SQL."""
    msg = chain.messages(m, seqs, lambda x: chain.categorical(m, x["y"]))
    us = F.transform(F.sequence(F.lit(0), F.size("alpha") - 1), lambda t: uniform(F.lit(seed), F.col("seq_id"), t))
    x = msg.select(chain.ffbs(m, us).alias("x"), F.transform("xs", lambda v: v["y"]).alias("y"))
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("i"), j.cast("long").alias("j"))
    first = F.array(cell("initial", F.get("x", F.lit(0)), F.lit(0)))
    moves = F.zip_with(F.slice("x", F.lit(1), F.size("x") - 1), F.slice("x", F.lit(2), F.greatest(F.size("x") - 1, F.lit(0))), lambda a, b: cell("transition", a, b))
    seen = F.filter(F.zip_with("x", "y", lambda s, y: cell("emission", s, y)), lambda c: c["j"].isNotNull())
    return x.select(F.explode(F.concat(first, moves, seen)).alias("c")).select("c.*").groupBy("kind", "i", "j").agg(F.count("*").cast("double").alias("value")).collect()


class HMMModel:
    """A chain with categorical emissions.  Sequences: seq_id, xs (array of structs with y)."""

    def __init__(self, start: HMM, prior: float = 1.0):
        self.params, self.prior, self.trace, self.draws = start, each(start, lambda r: [prior] * len(r)), [], []
        self.posterior: HMM | None = None

    def fit(self, seqs: DataFrame, method: str = "em", rounds: int = 20, burn_in: int = 5, seed: int = 0) -> HMMModel:
        seqs = staged(seqs, "sequences")
        if method == "em":
            self.params, self.trace = chain.fit_em(self.params, seqs, rounds)
        elif method == "cavi":
            alpha = plus(self.prior, self.params, 10.0)
            for _ in range(rounds):
                m = expected_log(alpha)
                msg = chain.messages(m, seqs, lambda x, m=m: chain.categorical(m, x["y"]))
                stats = chain.expected_stats(m, msg, with_loglik=True).collect()
                z = next(r["value"] for r in stats if r["kind"] == "loglik")
                kl = sum(learning.dirichlet_kl(list(q), list(p)) for q, p in zip(rows_of(alpha), rows_of(self.prior), strict=True))
                self.trace.append(z - kl)
                c = chain_counts(m, stats)
                alpha = plus(self.prior, c)
            self.posterior, self.params = alpha, each(alpha, lambda r: [a / sum(r) for a in r])
        elif method == "gibbs":
            g = np.random.default_rng(seed)
            for k in range(burn_in + rounds):
                c = chain_counts(self.params, drawn_counts(self.params, seqs, seed * 100_003 + k))
                flat = [g.dirichlet(np.array(x) + np.array(p)).tolist() for x, p in zip(rows_of(c), rows_of(self.prior), strict=True)]
                n = self.params.k
                self.params = HMM(tuple(flat[0]), tuple(map(tuple, flat[1 : 1 + n])), tuple(map(tuple, flat[1 + n :])))
                if k >= burn_in:
                    self.draws.append(self.params)
        else:
            raise ValueError(f"no method {method}")
        return self

    def predict(self, seqs: DataFrame) -> DataFrame:
        """seq_id, t, state of the most probable path."""
        m = self.params
        steps = F.transform("xs", lambda x: F.struct(chain.categorical(m, x["y"]).alias("like")))
        return seqs.select("seq_id", F.posexplode(chain.viterbi(m, steps)).alias("t", "state"))

    def score(self, seqs: DataFrame) -> DataFrame:
        m = self.params
        steps = F.transform("xs", lambda x: F.struct(chain.categorical(m, x["y"]).alias("like")))
        return seqs.select("seq_id", chain.log_marginal(m, steps).alias("log_marginal"))

    def generate(self, ids: DataFrame, length: int, seed: int = 0) -> DataFrame:
        """seq_id, t, x, y for each seq_id of ``ids``."""
        us = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda t: uniform(F.lit(seed), F.col("seq_id"), t))
        rows = ids.select("seq_id", F.posexplode(chain.simulate(self.params, us)).alias("t", "x"))
        return rows.withColumn("y", chain.emit(self.params, F.col("x"), uniform(F.lit(seed + 1), F.col("seq_id"), F.col("t"))))


class LDSModel:
    """A linear dynamical system.  Sequences: rows of :func:`stemma.operators.dense.packed`."""

    def __init__(self, start: dense.LDS):
        self.params, self.trace, self.draws = start, [], []

    def fit(self, rows: DataFrame, method: str = "em", rounds: int = 20, burn_in: int = 5, seed: int = 0, tolerance: float = 1e-8) -> LDSModel:
        rows = staged(rows, "sequences")
        if method == "em":
            for _ in range(rounds):
                self.params, z = dense.lds_em_step(self.params, rows)
                self.trace.append(z)
                if len(self.trace) > 1 and abs(z - self.trace[-2]) <= tolerance * abs(self.trace[-2]):
                    break
        elif method == "gibbs":
            d, o = len(self.params.m0), len(self.params.r)
            flat = lambda a: dense.MatrixNormalInverseWishart(np.zeros(a.shape), 10 * np.eye(a.shape[1]), np.eye(len(a)), len(a) + 2.0)
            priors = flat(np.zeros((d, d))), flat(np.zeros((o, d))), dense.NormalInverseWishart(np.zeros(d), 0.1, np.eye(d), d + 2.0)
            for k in range(burn_in + rounds):
                self.params = dense.lds_gibbs_step(self.params, rows, *priors, seed * 100_003 + k)
                if k >= burn_in:
                    self.draws.append(self.params)
        else:
            raise ValueError(f"no method {method}")
        return self

    def predict(self, obs: DataFrame, controls: DataFrame | None = None, modes: DataFrame | None = None) -> DataFrame:
        """seq_id, t, d, mean, variance, logz of the smoothed states."""
        return dense.kalman(self.params, obs, controls, modes)

    def score(self, rows: DataFrame) -> DataFrame:
        return dense.log_marginals(self.params, rows)

    def generate(self, ids: DataFrame, length: int, seed: int = 0) -> DataFrame:
        """seq_id, t, d, y for each seq_id of ``ids``, from dynamics that stay bounded."""
        model = self.params.stabilised()

        def run(parts):
            import pandas as pd

            for pdf in parts:
                for i in pdf["seq_id"]:
                    _, ys = model.simulate(length, 1, np.random.default_rng([seed, int(i) % (1 << 32), int(i) >> 32 & 0xFFFF_FFFF]))
                    yield pd.DataFrame([(int(i), t, d, float(y)) for t, row in enumerate(ys[:, 0]) for d, y in enumerate(row)], columns=["seq_id", "t", "d", "y"])

        return ids.select("seq_id").mapInPandas(run, "seq_id long, t long, d long, y double")


class GraphModel:
    """Hypergraphs, grouped or not, with or without evidence and feedback.  ``packed``: one row per graph."""

    def __init__(self, start: Model, prior: float = 1.0):
        self.params, self.prior, self.trace, self.draws = start, learning.each(start, lambda r: [prior] * len(r)), [], []
        self.alpha: Model | None = None

    def fit(self, packed: DataFrame, method: str = "em", rounds: int = 20, share: float = 0.5, rate: float = 0.1, burn_in: int = 5, seed: int = 0) -> GraphModel:
        start = learning.each(self.params, lambda r: [1 + 10 * p for p in r])
        if method == "em":
            self.params, self.trace = learning.fit_em(packed, self.params, rounds)
        elif method == "cavi":
            self.alpha, self.trace = learning.fit_cavi(packed, self.prior, start, rounds)
        elif method == "svi":
            self.alpha = start
            for k in range(rounds):
                self.alpha = learning.svi_step(packed, self.alpha, self.prior, share, seed + k, rate)
        elif method == "gibbs":
            self.draws = learning.fit_gibbs(packed, self.params, self.prior, burn_in, rounds, 1, seed)
            self.params = self.draws[-1]
        else:
            raise ValueError(f"no method {method}")
        if self.alpha is not None:
            self.params = learning.each(self.alpha, learning.normal)
        return self

    def posterior(self, packed: DataFrame) -> DataFrame:
        return local.posteriors(packed, self.params)

    def marginal(self, packed: DataFrame) -> DataFrame:
        return learning.log_marginals(packed, [self.params]).drop("draw")

    def sample(self, packed: DataFrame, seed: int = 0) -> DataFrame:
        return learning.sample_states(packed, self.params, seed)
