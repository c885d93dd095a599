"""Learning on many graphs: EM, Gibbs, CAVI, SVI, direct maximisation.

Graphs are independent: each step packs a graph into one row, runs the exact posterior for all graphs
of a structure in a batch, and sums expected counts on the map side.  Only parameter-sized tables
return to the driver, where the next parameters are made; every iteration is one Spark job.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions.special import digamma_py, uniform
from stemma.operators import local
from stemma.operators.factors import Model

COUNTS = "kind string, key string, cell string, value double"


def count_table(ids: np.ndarray, g: local.Batch):
    """Expected counts summed over a batch of graphs: 'root', 'cpt' (by the groups of parents and child), 'emission'; and the sum of their logz.

    A graph whose evidence is impossible has no posterior and is an error, as no parameters can explain it.
    """
    import pandas as pd

    z = g.joint()
    if not np.isfinite(z).all():
        raise ValueError(f"impossible evidence in graph {ids[~np.isfinite(z)][0]}")
    rows = [("logz", "", "", float(z.sum())), ("graphs", "", "", float(len(ids)))]
    for n in g.nodes:
        names, w = g.family(n)
        p = np.exp(w - z.reshape(-1, *[1] * (w.ndim - 1)))
        kind, key = ("cpt", ",".join(str(g.grp[m]) for m in names)) if len(names) > 1 else ("root", str(g.grp[n]))
        rows += [(kind, key, ",".join(map(str, cell)), float(x)) for cell, x in np.ndenumerate(p.sum(axis=0))]
        own = p.sum(axis=tuple(range(1, p.ndim - 1))) if p.ndim > 2 else p
        seen: dict[int, np.ndarray] = {}
        for b, o in enumerate(g.obs):
            for y in o.get(n, []):
                seen[y] = seen.get(y, 0.0) + own[b]
        rows += [("emission", str(g.grp[n]), f"{k},{y}", float(x)) for y, xs in seen.items() for k, x in enumerate(xs)]
    df = pd.DataFrame(rows, columns=["kind", "key", "cell", "value"])
    return df.groupby(["kind", "key", "cell"], as_index=False)["value"].sum()


def expected_counts(packed: DataFrame, params) -> dict[tuple[str, str, str], float]:
    """kind, key, cell -> sum over all graphs (parameter-sized)."""

    def work(parts):
        for pdf in parts:
            yield from local.batches(pdf, params, count_table)

    per = packed.mapInPandas(work, COUNTS)
    return {(r["kind"], r["key"], r["cell"]): r["value"] for r in per.groupBy("kind", "key", "cell").agg(F.sum("value").alias("value")).collect()}


def like(table, f, prefix=()):
    """A nested table of the same shape with f(cell) at the bottom."""
    return [like(t, f, (*prefix, i)) for i, t in enumerate(table)] if isinstance(table, (list, tuple)) else f(prefix)


def count_tables(params: Model, c: dict) -> Model:
    """Counts in the shape of the parameters."""
    cell = lambda p: ",".join(map(str, p))
    return Model(
        {g: like(t, lambda p, g=g: c.get(("root", str(g), cell(p)), 0.0)) for g, t in params.prior.items()},
        {g: like(t, lambda p, g=g: c.get(("emission", str(g), cell(p)), 0.0)) for g, t in params.emission.items()},
        {k: like(t, lambda p, k=k: c.get(("cpt", ",".join(map(str, k)), cell(p)), 0.0)) for k, t in params.cpt.items()},
    )


def over_rows(table, f):
    """f applied to every innermost row."""
    return f(table) if not isinstance(table[0], (list, tuple)) else [over_rows(t, f) for t in table]


def each(m: Model, f) -> Model:
    return Model({k: over_rows(t, f) for k, t in m.prior.items()}, {k: over_rows(t, f) for k, t in m.emission.items()}, {k: over_rows(t, f) for k, t in m.cpt.items()})


def both(a: Model, b: Model, f) -> Model:
    def zip_rows(x, y):
        return f(x, y) if not isinstance(x[0], (list, tuple)) else [zip_rows(p, q) for p, q in zip(x, y, strict=True)]

    return Model({k: zip_rows(t, b.prior[k]) for k, t in a.prior.items()}, {k: zip_rows(t, b.emission[k]) for k, t in a.emission.items()}, {k: zip_rows(t, b.cpt[k]) for k, t in a.cpt.items()})


def rows_of(m: Model) -> list[list[float]]:
    out: list = []
    each(m, lambda r: out.append(list(r)) or r)
    return out


def normal(row: list[float]) -> list[float]:
    s = sum(row)
    return [x / s for x in row] if s > 0 else [1 / len(row)] * len(row)


def em_step(packed: DataFrame, params: Model) -> tuple[Model, float]:
    """Maximum-likelihood tables from expected counts, and log P(Y) under the old ones; unused rows stay as they were."""
    c = expected_counts(packed, params)
    new = count_tables(params, c)
    return both(new, params, lambda r, old: normal(r) if sum(r) > 0 else list(old)), c["logz", "", ""]


def fit_em(packed: DataFrame, params: Model, rounds: int = 20, tolerance: float = 1e-8) -> tuple[Model, list[float]]:
    trace: list[float] = []
    for _ in range(rounds):
        params, z = em_step(packed, params)
        trace.append(z)
        if len(trace) > 1 and abs(trace[-1] - trace[-2]) <= tolerance * abs(trace[-2]):
            break
    return params, trace


# ---- variational ---------------------------------------------------------------------------------


def expected_log(alpha: Model) -> Model:
    """exp E[ln theta] under Dirichlet rows: sub-normalised tables that the filter takes as parameters."""
    return each(alpha, lambda r: [math.exp(digamma_py(a) - digamma_py(sum(r))) for a in r])


def dirichlet_kl(q: list[float], p: list[float]) -> float:
    return math.lgamma(sum(q)) - sum(map(math.lgamma, q)) - math.lgamma(sum(p)) + sum(map(math.lgamma, p)) + sum((a - b) * (digamma_py(a) - digamma_py(sum(q))) for a, b in zip(q, p, strict=True))


@dataclass(frozen=True)
class Elbo:
    """The bound is log normaliser minus the divergence of the parameters' posterior from their prior."""

    log_normaliser: float
    kl: float

    @property
    def value(self) -> float:
        return self.log_normaliser - self.kl


def cavi_step(packed: DataFrame, alpha: Model, prior: Model, scale: float = 1.0) -> tuple[Model, Elbo]:
    """New Dirichlet parameters (prior + scaled expected counts), and the bound at the old ones."""
    c = expected_counts(packed, expected_log(alpha))
    new = both(count_tables(alpha, c), prior, lambda n, p: [scale * x + y for x, y in zip(n, p, strict=True)])
    kl = sum(dirichlet_kl(q, p) for q, p in zip(rows_of(alpha), rows_of(prior), strict=True))
    return new, Elbo(c["logz", "", ""], kl)


def fit_cavi(packed: DataFrame, prior: Model, start: Model | None = None, rounds: int = 20, tolerance: float = 1e-8) -> tuple[Model, list[float]]:
    alpha, trace = start or prior, []
    for _ in range(rounds):
        alpha, e = cavi_step(packed, alpha, prior)
        trace.append(e.value)
        if len(trace) > 1 and abs(trace[-1] - trace[-2]) <= tolerance * abs(trace[-2]):
            break
    return alpha, trace


def svi_step(packed: DataFrame, alpha: Model, prior: Model, share: float, seed: int, rate: float) -> Model:
    """A natural-gradient step from a minibatch, drawn by a hash of graph_id and seed; counts are scaled by node numbers."""
    sizes = packed.select("graph_id", F.size("nodes").alias("n"))
    chosen = uniform(F.lit("svi"), F.lit(seed), F.col("graph_id")) < share
    total, part = sizes.agg(F.sum("n"), F.sum(F.when(chosen, F.col("n")))).first()
    if not part:
        return alpha
    target, _ = cavi_step(packed.filter(chosen), alpha, prior, total / part)
    return both(alpha, target, lambda a, b: [(1 - rate) * x + rate * y for x, y in zip(a, b, strict=True)])


# ---- sampling ------------------------------------------------------------------------------------


def with_uniforms(packed: DataFrame, seed: int) -> DataFrame:
    return packed.withColumn("uniforms", F.transform("nodes", lambda n: F.struct(n["node"].alias("node"), uniform(F.lit(seed), F.col("graph_id"), n["node"]).alias("u"))))


def sample_states(packed: DataFrame, params: Model, seed: int) -> DataFrame:
    """graph_id, node, state drawn from P(x | Y), fixed by the seed."""
    return local.per_graph(with_uniforms(packed, seed), local.sampled_rows(params), "graph_id long, node long, state long")


def state_counts(packed: DataFrame, states: DataFrame) -> DataFrame:
    """kind, key, cell, value of complete data, as SQL: states joined to hyperedges and observations."""
    nodes = packed.select("graph_id", F.explode("nodes").alias("n")).select("graph_id", "n.node", "n.grp").join(states, ["graph_id", "node"])
    edges = packed.select("graph_id", F.explode("edges").alias("e")).select("graph_id", "e.*").join(nodes, ["graph_id", "node"])
    side = edges.filter("role = 'p'").groupBy("graph_id", "edge").agg(F.array_sort(F.collect_list(F.struct("ord", "grp", "state"))).alias("ps"))
    kids = edges.filter("role = 'c'").join(side, ["graph_id", "edge"])
    text = lambda f: F.concat_ws(",", F.transform("ps", lambda p: p[f].cast("string")), F.col(f).cast("string"))
    cpt = kids.select(F.lit("cpt").alias("kind"), text("grp").alias("key"), text("state").alias("cell"))
    root = nodes.join(edges.filter("role = 'c'").select("graph_id", "node"), ["graph_id", "node"], "left_anti").select(F.lit("root").alias("kind"), F.col("grp").cast("string").alias("key"), F.col("state").cast("string").alias("cell"))
    obs = packed.select("graph_id", F.explode("obs").alias("o")).select("graph_id", "o.node", "o.y").join(nodes, ["graph_id", "node"])
    emission = obs.select(F.lit("emission").alias("kind"), F.col("grp").cast("string").alias("key"), F.concat_ws(",", F.col("state").cast("string"), F.col("y").cast("string")).alias("cell"))
    return cpt.unionByName(root).unionByName(emission).groupBy("kind", "key", "cell").agg(F.count("*").cast("double").alias("value"))


def gibbs_step(packed: DataFrame, params: Model, prior: Model, seed: int) -> tuple[Model, dict]:
    """States given parameters, then parameters from their posterior given the states' counts."""
    c = {(r["kind"], r["key"], r["cell"]): r["value"] for r in state_counts(packed, sample_states(packed, params, seed)).collect()}
    g = np.random.default_rng(seed)
    post = both(count_tables(params, c), prior, lambda n, p: [x + y for x, y in zip(n, p, strict=True)])
    return each(post, lambda r: g.dirichlet(r).tolist()), c


def fit_gibbs(packed: DataFrame, params: Model, prior: Model, burn_in: int = 5, keep: int = 10, skip: int = 1, seed: int = 0) -> list[Model]:
    """Draws of the parameters after burn-in, one in ``skip``."""
    out = []
    for k in range(burn_in + keep * skip):
        params, _ = gibbs_step(packed, params, prior, seed * 100_003 + k)
        if k >= burn_in and (k - burn_in) % skip == 0:
            out.append(params)
    return out


def prior_draws(prior: Model, n: int, seed: int = 0) -> list[Model]:
    g = np.random.default_rng(seed)
    return [each(prior, lambda r: g.dirichlet(r).tolist()) for _ in range(n)]


def log_marginals(packed: DataFrame, draws: list[Model]) -> DataFrame:
    """graph_id, draw, logz: every graph under every parameter set, all in one pass."""
    import pandas as pd

    def run(pdf):
        gid = int(pdf["graph_id"].iloc[0])
        return pd.DataFrame([(gid, k, local.graph_of(pdf, d).log_marginal()) for k, d in enumerate(draws)], columns=["graph_id", "draw", "logz"])

    return local.per_graph(packed, run, "graph_id long, draw long, logz double")


# ---- neural emissions ----------------------------------------------------------------------------


class Recogniser:
    """A small tanh network from an observation to log state potentials, with its own gradient."""

    def __init__(self, d_in: int, k: int, hidden: int = 8, seed: int = 0):
        g = np.random.default_rng(seed)
        self.w = [g.normal(0, 0.5, (d_in, hidden)), np.zeros(hidden), g.normal(0, 0.5, (hidden, k)), np.zeros(k)]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.w[0] + self.w[1])
        y = h @ self.w[2] + self.w[3]
        return h, y - np.log(np.exp(y - y.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - y.max(axis=1, keepdims=True)

    def gradient(self, x: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        """Gradient of sum(d * log potentials) in the weights."""
        h, y = self.forward(x)
        dy = d - np.exp(y) * d.sum(axis=1, keepdims=True)
        dh = (dy @ self.w[2].T) * (1 - h * h)
        return [x.T @ dh, dh.sum(axis=0), h.T @ dy, dy.sum(axis=0)]


class Adam:
    def __init__(self, rate: float = 0.01, b1: float = 0.9, b2: float = 0.999):
        self.rate, self.b1, self.b2, self.m, self.v, self.t = rate, b1, b2, None, None, 0

    def step(self, w: list[np.ndarray], grad: list[np.ndarray]) -> list[np.ndarray]:
        self.m = self.m or [np.zeros_like(x) for x in w]
        self.v = self.v or [np.zeros_like(x) for x in w]
        self.t += 1
        self.m = [self.b1 * m + (1 - self.b1) * g for m, g in zip(self.m, grad, strict=True)]
        self.v = [self.b2 * v + (1 - self.b2) * g * g for v, g in zip(self.v, grad, strict=True)]
        return [x - self.rate * (m / (1 - self.b1**self.t)) / (np.sqrt(v / (1 - self.b2**self.t)) + 1e-8) for x, m, v in zip(w, self.m, self.v, strict=True)]


def neural_rows(params: Model, net: Recogniser, labels: bool):
    """logz and the weights' gradient of one graph: d logz / d potential is the smoothed probability.

    With labels (``target`` states by node) the objective is ln P(x | Y): smoothed given labels minus smoothed.
    """
    import pandas as pd

    def run(pdf):
        r = pdf.iloc[0]
        edges = local.hyperedges(pd.DataFrame([{k: e[k] for k in ("edge", "role", "node", "ord")} for e in r["edges"]]))
        feats = {int(f["node"]): np.array(f["features"], dtype=float) for f in r["features"]}
        order = sorted(feats)
        x = np.array([feats[n] for n in order])
        _, pot = net.forward(x)
        grp = {int(n["node"]): int(n["grp"]) for n in r["nodes"]}

        def run_once(allowed):
            g = local.Graph(edges, params, {}, grp, allowed)
            with np.errstate(divide="ignore"):
                g.tensors += [local.Tensor((n,), pot[i]) for i, n in enumerate(order)]
            z = g.log_marginal()
            return z, np.array([np.exp(g.joint(n) - z) for n in order])

        z, smooth = run_once(None)
        value, d = z, smooth
        if labels:
            allowed = {int(t["node"]): {int(t["state"])} for t in r["target"]}
            z2, fixed = run_once(allowed)
            value, d = z2 - z, fixed - smooth
        flat = np.concatenate([p.ravel() for p in net.gradient(x, d)])
        return pd.DataFrame({"i": np.arange(-1, len(flat)), "value": np.r_[value, flat]})

    return run


def fit_neural(packed: DataFrame, params: Model, net: Recogniser, rounds: int = 20, rate: float = 0.05, labels: bool = False) -> list[float]:
    """Maximises the summed objective by Adam; gradients are summed by Spark, the network stays on the driver."""
    adam, trace = Adam(rate), []
    for _ in range(rounds):
        per = local.per_graph(packed, neural_rows(params, net, labels), "i long, value double")
        got = {r["i"]: r["value"] for r in per.groupBy("i").agg(F.sum("value").alias("value")).collect()}
        flat, grads, at = np.array([got[i] for i in range(len(got) - 1)]), [], 0
        for w in net.w:
            grads.append(-flat[at : at + w.size].reshape(w.shape))
            at += w.size
        net.w = adam.step(net.w, grads)
        trace.append(got[-1])
    return trace
