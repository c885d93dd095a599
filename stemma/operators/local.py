"""Work on small graphs: a packed row each, or all rows of a graph_id by ``applyInPandas``.

What needs graph-shaped control flow (searches, schedules, loopy propagation) or dense tensors is done
here in numpy.  Graphs are independent, so this scales with their number; posteriors are found for all
graphs of one structure in a batch at once, the rest a graph per call.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd

MOST_CELLS = 100_000_000
#: Graphs that are solved in one pass, and cells of a tensor over more than one graph; a batch that needs more is halved.
BATCH_GRAPHS, BATCH_CELLS = 1024, 4_000_000
#: The name of the axis of graphs.
GRAPHS = "graphs"


class TooLarge(ValueError):
    pass


def per_graph(packed, run, schema: str):
    """run (a frame of one row to a frame) on every row of a packed table, where it is: nothing is shuffled."""

    def work(parts):
        for pdf in parts:
            for i in range(len(pdf)):
                yield run(pdf.iloc[i : i + 1])

    return packed.mapInPandas(work, schema)


def hyperedges(pdf: pd.DataFrame) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
    """(edge, parents in order, children in order), by edge."""
    out = []
    for e, g in pdf.sort_values(["edge", "role", "ord"]).groupby("edge"):
        side = {r: tuple(int(x) for x in s["node"]) for r, s in g.groupby("role")}
        out.append((int(e), side.get("p", ()), side.get("c", ())))
    return out


@lru_cache(maxsize=4096)
def gathered(incidence: tuple[tuple[int, str, int, int], ...]) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
    """The hyperedges of sorted (edge, role, ord, node)."""
    sides: dict[int, dict[str, list[int]]] = {}
    for e, role, _, n in incidence:
        sides.setdefault(e, {}).setdefault(role, []).append(n)
    return [(e, tuple(x.get("p", ())), tuple(x.get("c", ()))) for e, x in sides.items()]


def cyclic(edges) -> bool:
    todo = {n for _, p, c in edges for n in (*p, *c)}
    above = {n: set() for n in todo}
    for _, p, c in edges:
        for n in c:
            above[n] |= set(p)
    while True:
        ready = {n for n in todo if not above[n] & todo}
        if not ready:
            return bool(todo)
        todo -= ready


def cyclic_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    bad = cyclic(hyperedges(pdf))
    return pd.DataFrame({"graph_id": pdf["graph_id"].iloc[:1] if bad else pdf["graph_id"].iloc[:0]})


def walk_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Levels and path sums of one graph in topological order; rows (a, b) are steps, rows (a, a) name the nodes."""
    own = pdf["a"] == pdf["b"]
    marked = {int(n): bool(m) for n, m in zip(pdf.loc[own, "a"], pdf.loc[own, "marked"], strict=True)}
    after: dict[int, list[int]] = {n: [] for n in marked}
    waits = dict.fromkeys(marked, 0)
    for a, b in pdf.loc[~own, ["a", "b"]].itertuples(index=False):
        after[a].append(b)
        waits[b] += 1
    level, n = dict.fromkeys(marked, 0), dict.fromkeys(marked, 0)
    ready = [x for x, k in waits.items() if not k]
    for x in ready:
        for y in after[x]:
            level[y] = max(level[y], level[x] + 1)
            n[y] += n[x] + marked[x]
            waits[y] -= 1
            if not waits[y]:
                ready.append(y)
    if len(ready) < len(marked):
        raise ValueError("directed cycle")
    return pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "node": ready, "level": [level[x] for x in ready], "n": [n[x] for x in ready]})


def core(pairs: set[tuple[int, int]]) -> set[tuple[int, int]]:
    """The incidences that lie between cycles: nodes and hyperedges of degree one are stripped until none is left."""
    while True:
        dn, de = {}, {}
        for n, e in pairs:
            dn[n] = dn.get(n, 0) + 1
            de[e] = de.get(e, 0) + 1
        left = {(n, e) for n, e in pairs if dn[n] > 1 and de[e] > 1}
        if left == pairs:
            return left
        pairs = left


def feedback(edges) -> list[int]:
    """Greedy cut of the node with most incidences in the core (the lowest among equals), then what proves needless is put back."""
    pairs = {(n, e) for e, p, c in edges for n in (*p, *c)}
    cut, left = [], core(pairs)
    while left:
        degree = {}
        for n, _ in left:
            degree[n] = degree.get(n, 0) + 1
        best = min(degree, key=lambda n: (-degree[n], n))
        cut.append(best)
        left = core({(n, e) for n, e in left if n != best})
    for n in list(cut):
        rest = set(cut) - {n}
        if not core({(m, e) for m, e in pairs if m not in rest}):
            cut.remove(n)
    return sorted(cut)


def feedback_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    cut = feedback(hyperedges(pdf))
    return pd.DataFrame({"graph_id": [pdf["graph_id"].iloc[0]] * len(cut), "node": cut, "idx": list(range(len(cut)))}).astype("int64")


def needs(edges) -> dict[tuple, set[tuple]]:
    """Each message ('u', n, -1) or ('v', n, e) and the messages it waits for."""
    up = {n: e for e, _, c in edges for n in c}
    below: dict[int, list[int]] = {}
    side = {e: (p, c) for e, p, c in edges}
    nodes = {n for _, p, c in edges for n in (*p, *c)}
    for e, p, _ in edges:
        for n in p:
            below.setdefault(n, []).append(e)
    others = lambda n, e: {("v", n, f) for f in below.get(n, []) if f != e}
    out = {}
    for n in nodes:
        want = set()
        if n in up:
            p, c = side[up[n]]
            for m in p:
                want |= {("u", m, -1)} | others(m, up[n])
            for m in c:
                want |= others(m, None) if m != n else set()
        out["u", n, -1] = want
        for e in below.get(n, []):
            p, c = side[e]
            want = set()
            for m in p:
                want |= ({("u", m, -1)} | others(m, e)) if m != n else set()
            for m in c:
                want |= others(m, None)
            out["v", n, e] = want
    return out


def schedule_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    wait, level, rows, done = needs(hyperedges(pdf)), 0, [], set()
    while wait:
        ready = sorted(k for k, w in wait.items() if w <= done)
        if not ready:
            raise ValueError("the graph has an undirected cycle; give a feedback set")
        rows += [(int(pdf["graph_id"].iloc[0]), *k, level) for k in ready]
        done |= set(ready)
        wait = {k: w for k, w in wait.items() if k not in done}
        level += 1
    return pd.DataFrame(rows, columns=["graph_id", "kind", "node", "edge", "level"])


# ---- exact inference with dense log tensors -------------------------------------------------------


class Tensor:
    """A log tensor with named axes."""

    def __init__(self, names: tuple[int, ...], values: np.ndarray):
        self.names, self.values = tuple(names), np.asarray(values, dtype=float)

    def expand(self, names: tuple[int, ...]) -> np.ndarray:
        own = [n for n in names if n in self.names]
        v = np.transpose(self.values, [self.names.index(n) for n in own])
        return v.reshape([v.shape[own.index(n)] if n in own else 1 for n in names])

    def sum_to(self, keep: tuple[int, ...]) -> Tensor:
        axes = tuple(i for i, n in enumerate(self.names) if n not in keep)
        names = tuple(n for n in self.names if n in keep)
        return Tensor(names, lse(self.values, axes)) if axes else self


def lse(v: np.ndarray, axes) -> np.ndarray:
    top = np.max(v, axis=axes, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(v - top).sum(axis=axes)) + np.squeeze(top, axis=axes)


def product_of(tensors: list[Tensor]) -> Tensor:
    names = tuple(dict.fromkeys(n for t in tensors for n in t.names))
    shape = np.ones(len(names))
    for t in tensors:
        for n, size in zip(t.names, t.values.shape, strict=True):
            shape[names.index(n)] = size
    many = GRAPHS in names and shape[names.index(GRAPHS)] > 1
    if shape.prod() > (BATCH_CELLS if many else MOST_CELLS):
        raise TooLarge(f"a tensor over {names} would have {shape.prod():.0f} cells")
    return Tensor(names, sum((t.expand(names) for t in tensors), np.zeros(tuple(int(s) for s in shape))))


def reduce_to(tensors: list[Tensor], keep: tuple[int, ...]) -> Tensor:
    """The product summed down to ``keep``, eliminating the variable with the smallest product first."""
    tensors = list(tensors)
    while rest := {n for t in tensors for n in t.names} - set(keep):
        scope = lambda v: len({n for t in tensors if v in t.names for n in t.names})
        v = min(rest, key=lambda v: (scope(v), v))
        own = [t for t in tensors if v in t.names]
        joined = product_of(own)
        tensors = [t for t in tensors if v not in t.names] + [joined.sum_to(tuple(n for n in joined.names if n != v))]
    out = product_of(tensors)
    order = tuple(n for n in keep if n in out.names)
    return Tensor(order, out.expand(order))


class Graph:
    """Factors of one graph.  params: prior, emission, cpt as in ``factors.Model``; grp by node."""

    def __init__(self, edges, params, obs: dict[int, list[int]], grp: dict[int, int], allowed: dict[int, set[int]] | None = None):
        if cyclic(edges):
            raise ValueError("directed cycle")
        self.edges, self.grp = edges, grp
        self.parents = {n: p for _, p, c in edges for n in c}
        self.nodes = sorted({n for _, p, c in edges for n in (*p, *c)} | set(grp))
        self.fixed: list[Tensor] = []
        self.like: dict[int, np.ndarray] = {}
        with np.errstate(divide="ignore"):
            for n in self.nodes:
                g = grp[n]
                table = np.log(np.array(params.emission[g], dtype=float))
                like = sum((table[:, y] for y in obs.get(n, [])), np.zeros(len(table)))
                if allowed and n in allowed:
                    like = np.where([k in allowed[n] for k in range(len(like))], like, -np.inf)
                self.like[n] = like
                if n in self.parents:
                    p = self.parents[n]
                    self.fixed.append(Tensor((*p, n), np.log(np.array(params.cpt[(*(grp[m] for m in p), g)], dtype=float))))
                else:
                    self.fixed.append(Tensor((n,), np.log(np.array(params.prior[g], dtype=float))))
        self.tensors = [Tensor((n,), x) for n, x in self.like.items()] + self.fixed

    def joint(self, *nodes: int) -> np.ndarray:
        return reduce_to(self.tensors, nodes).values

    def log_marginal(self) -> float:
        return float(self.joint())

    def family(self, n: int) -> tuple[tuple[int, ...], np.ndarray]:
        names = (*self.parents.get(n, ()), n)
        return names, self.joint(*names)

    def sample(self, uniforms: dict[int, float]) -> dict[int, int]:
        """States from P(x | Y), ancestors first, by the inverse CDF of P(x_n | parents drawn, Y)."""
        drawn: dict[int, int] = {}
        todo = list(self.nodes)
        while todo:
            n = next(m for m in todo if all(p in drawn for p in self.parents.get(m, ())))
            todo.remove(n)
            fixed = [Tensor(t.names, t.values) for t in self.tensors]
            for m, s in drawn.items():
                fixed = [Tensor(tuple(x for x in t.names if x != m), np.take(t.values, s, axis=t.names.index(m))) if m in t.names else t for t in fixed]
            w = reduce_to(fixed, (n,)).values
            p = np.exp(w - w.max())
            drawn[n] = int(min(np.searchsorted(np.cumsum(p) / p.sum(), uniforms[n], side="right"), len(p) - 1))
        return drawn

    def loopy(self, rounds: int = 50, damping: float = 0.5, tolerance: float = 1e-9) -> dict[int, np.ndarray]:
        """Damped sum-product, one factor for each hyperedge; exact where there is no undirected cycle, approximate else."""
        at = {t.names[-1]: t for t in self.tensors if len(t.names) > 1}
        scopes = [t for t in self.tensors if len(t.names) == 1] + [product_of([at[n] for n in c]) for _, _, c in self.edges]
        msg = {(i, n): np.zeros(t.values.shape[t.names.index(n)]) for i, t in enumerate(scopes) for n in t.names}
        for _ in range(rounds):
            new, change = {}, 0.0
            for i, t in enumerate(scopes):
                inc = [Tensor((n,), sum((msg[j, n] for j, s in enumerate(scopes) if j != i and n in s.names), np.zeros(len(msg[i, n])))) for n in t.names]
                for n in t.names:
                    m = product_of([t, *[x for x in inc if x.names != (n,)]]).sum_to((n,)).values
                    m = m - lse(m, (0,))
                    old = msg[i, n]
                    with np.errstate(invalid="ignore"):
                        new[i, n] = np.where(np.isfinite(m), damping * np.where(np.isfinite(old), old, m) + (1 - damping) * m, m)
                        change = max(change, float(np.nanmax(np.abs(np.where(np.isfinite(m) & np.isfinite(old), m - old, 0.0)))))
            msg = new
            if change < tolerance:
                break
        out = {}
        for n in self.nodes:
            b = sum(msg[i, n] for i, t in enumerate(scopes) if n in t.names)
            out[n] = np.exp(b - lse(b, (0,)))
        return out


def incidence_of(r) -> tuple[tuple[int, str, int, int], ...]:
    return tuple(sorted((int(e["edge"]), e["role"], int(e["ord"]), int(e["node"])) for e in r["edges"]))


def groups_of(r) -> tuple[tuple[int, int], ...]:
    return tuple(sorted((int(n["node"]), int(n["grp"])) for n in r["nodes"]))


def observed(r) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for o in r["obs"] if r["obs"] is not None else []:
        out.setdefault(int(o["node"]), []).append(int(o["y"]))
    return out


def evidence_of(r) -> dict[int, set[int]]:
    out: dict[int, set[int]] = {}
    for a in r["allowed"] if r.get("allowed") is not None else []:
        out.setdefault(int(a["node"]), set()).add(int(a["state"]))
    return out


def graph_of(pdf: pd.DataFrame, params) -> Graph:
    """A graph from one packed row: its hyperedges, observations and evidence as arrays of structs."""
    r = pdf.iloc[0]
    return Graph(gathered(incidence_of(r)), params, observed(r), dict(groups_of(r)), evidence_of(r))


class Batch:
    """Graphs that share hyperedges and groups: their likelihoods have one more axis, tables have none."""

    def __init__(self, edges, params, grp: dict[int, int], rows: list):
        one = Graph(edges, params, {}, grp)
        self.grp, self.nodes, self.parents, self.size = grp, one.nodes, one.parents, len(rows)
        self.obs, allowed = [observed(r) for r in rows], [evidence_of(r) for r in rows]
        self.tensors = list(one.fixed)
        for n in self.nodes:
            with np.errstate(divide="ignore"):
                table = np.log(np.array(params.emission[grp[n]], dtype=float))
            like = np.zeros((len(rows), len(table)))
            seen = [(b, y) for b, o in enumerate(self.obs) for y in o.get(n, [])]
            if seen:
                at, ys = np.array(seen).T
                np.add.at(like, at, table.T[ys])
            for b, a in enumerate(allowed):
                if n in a:
                    like[b, [k for k in range(len(table)) if k not in a[n]]] = -np.inf
            self.tensors.append(Tensor((GRAPHS, n), like))

    def joint(self, *nodes: int) -> np.ndarray:
        """One entry per graph, then an axis for each node."""
        return reduce_to(self.tensors, (GRAPHS, *nodes)).values

    def family(self, n: int) -> tuple[tuple[int, ...], np.ndarray]:
        names = (*self.parents.get(n, ()), n)
        return names, self.joint(*names)


def batches(pdf: pd.DataFrame, params, work) -> Iterator[pd.DataFrame]:
    """work(graph_ids, Batch) for the graphs of each structure among the packed rows."""
    alike: dict[tuple, list] = {}
    for _, r in pdf.iterrows():
        alike.setdefault((incidence_of(r), groups_of(r)), []).append(r)
    for (incidence, grp), rows in alike.items():
        todo = [rows[at : at + BATCH_GRAPHS] for at in range(0, len(rows), BATCH_GRAPHS)]
        while todo:
            part = todo.pop()
            try:
                yield work(np.array([int(r["graph_id"]) for r in part]), Batch(gathered(incidence), params, dict(grp), part))
            except TooLarge:
                if len(part) == 1:
                    raise
                todo += [part[: len(part) // 2], part[len(part) // 2 :]]


def posterior_table(ids: np.ndarray, g: Batch) -> pd.DataFrame:
    z = g.joint()
    frames = [pd.DataFrame({"graph_id": ids, "kind": "logz", "node": -1, "parents": "", "state": -1, "value": z, "conditional": z})]

    def add(kind: str, n: int, w: np.ndarray, cond: np.ndarray) -> None:
        """Rows of the finite cells of w, whose first axis is the graphs' and whose last is the node's."""
        states = list(np.ndindex(w.shape[1:]))
        flat, given = w.reshape(len(ids), -1), cond.reshape(len(ids), -1)
        b, c = np.nonzero(np.isfinite(flat))
        parents = np.array([",".join(map(str, x[:-1])) for x in states], dtype=object)
        last = np.array([x[-1] for x in states])
        frames.append(pd.DataFrame({"graph_id": ids[b], "kind": kind, "node": n, "parents": parents[c], "state": last[c], "value": np.exp(flat[b, c]), "conditional": np.exp(given[b, c])}))

    with np.errstate(invalid="ignore"):
        for n in g.nodes:
            _, w = g.family(n)
            w = w - z.reshape(-1, *[1] * (w.ndim - 1))
            add("family", n, w, w - np.expand_dims(lse(w, (w.ndim - 1,)), w.ndim - 1))
            one = lse(w, tuple(range(1, w.ndim - 1))) if w.ndim > 2 else w
            add("node", n, one, one)
    return pd.concat(frames, ignore_index=True)


def posteriors(packed, params):
    """For each graph: logz, smoothed nodes, families and their conditionals, in one long table."""

    def work(parts):
        for pdf in parts:
            yield from batches(pdf, params, posterior_table)

    return packed.mapInPandas(work, POSTERIOR)


POSTERIOR = "graph_id long, kind string, node long, parents string, state long, value double, conditional double"


def sampled_rows(params):
    """For each graph: states drawn from P(x | Y) with the packed uniforms."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = graph_of(pdf, params)
        u = {int(x["node"]): float(x["u"]) for x in pdf.iloc[0]["uniforms"]}
        gid = int(pdf["graph_id"].iloc[0])
        return pd.DataFrame([(gid, n, s) for n, s in g.sample(u).items()], columns=["graph_id", "node", "state"])

    return run


def loopy_rows(params, rounds: int = 60):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g, gid = graph_of(pdf, params), int(pdf["graph_id"].iloc[0])
        return pd.DataFrame([(gid, n, k, float(p)) for n, b in g.loopy(rounds).items() for k, p in enumerate(b)], columns=["graph_id", "node", "state", "p"])

    return run
