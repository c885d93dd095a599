"""Log-semiring factors as DataFrames, and exact inference by eliminating variables.

A factor is a table (graph_id, one column per variable, logw); a missing row has probability zero.
Multiplying is a natural join that adds logw, summing a variable out is a group-by with log-sum-exp.
All graphs that share a structure go through one plan, partitioned by graph_id throughout: an exchange on
graph_id serves every join and aggregate, as each also groups by it.

Where only a number per graph is asked for, a graph is a row of its log-likelihoods, and the variables are summed
out of tensors with an axis of graphs: the plan then has as many joins as there are inputs, not as there are factors.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.special import lse_agg
from stemma.operators.chain import NEVER, ln

#: Largest number of rows per graph that an intermediate factor may have.
MOST_CELLS = 1_000_000
#: Cells of a tensor over more than one graph; a batch that needs more is cut into slices.
BATCH_CELLS = 2_000_000
GRAPH = "graph_id"


def var(node: int) -> str:
    return f"x{node}"


@dataclass(frozen=True)
class Factor:
    df: DataFrame
    vars: tuple[str, ...]

    def mul(self, other: Factor) -> Factor:
        shared = [v for v in self.vars if v in other.vars]
        joined = self.df.join(other.df.withColumnRenamed("logw", "_w"), [GRAPH, *shared])
        names = (*self.vars, *(v for v in other.vars if v not in self.vars))
        return Factor(joined.select(GRAPH, *names, (F.col("logw") + F.col("_w")).alias("logw")), names)

    def integrate(self, out: Iterable[str]) -> Factor:
        left = tuple(v for v in self.vars if v not in set(out))
        return self if left == self.vars else Factor(self.df.groupBy(GRAPH, *left).agg(lse_agg("logw").alias("logw")), left)

    def restrict(self, node: int, allowed: DataFrame) -> Factor:
        """Only allowed states of a node: a semi-join on (graph_id, node, state); graphs without an entry stay whole."""
        if var(node) not in self.vars:
            return self
        own = allowed.filter(F.col("node") == node).select(F.col(GRAPH), F.col("state").alias(var(node)))
        free = self.df.join(own.select(GRAPH).distinct(), GRAPH, "left_anti")
        return Factor(self.df.join(own, [GRAPH, var(node)], "left_semi").select(GRAPH, *self.vars, "logw").unionByName(free), self.vars)

    def normalize(self, given: Iterable[str] = ()) -> DataFrame:
        """With ``p``: logw normalised within the graph and the given variables."""
        z = self.df.groupBy(GRAPH, *given).agg(lse_agg("logw").alias("_z"))
        return self.df.join(z, [GRAPH, *given]).withColumn("p", F.exp(F.col("logw") - F.col("_z"))).drop("_z")

    def marginals(self) -> DataFrame:
        """Every single-variable marginal of the factor from one GROUPING SETS query: graph_id, var, state, logw."""
        sets = [[F.col(GRAPH), F.col(v)] for v in self.vars]
        g = self.df.groupingSets(sets, F.col(GRAPH), *[F.col(v) for v in self.vars]).agg(lse_agg("logw").alias("logw"))
        name = F.coalesce(*[F.when(F.col(v).isNotNull(), F.lit(v)) for v in self.vars])
        return g.select(GRAPH, name.alias("var"), F.coalesce(*[F.col(v) for v in self.vars]).alias("state"), "logw")


@dataclass(frozen=True)
class Structure:
    """Hyperedges: (parents in order, children)."""

    edges: tuple[tuple[tuple[int, ...], tuple[int, ...]], ...]

    @classmethod
    def parse(cls, text: str) -> Structure:
        """From the notation "0,1>2 ; 2>3"."""
        sides = [e.split(">") for e in text.split(";")]
        return cls(tuple((tuple(int(x) for x in p.split(",")), tuple(int(x) for x in c.split(","))) for p, c in sides))

    @property
    def nodes(self) -> tuple[int, ...]:
        return tuple(sorted({n for p, c in self.edges for n in (*p, *c)}))

    @property
    def parents(self) -> dict[int, tuple[int, ...]]:
        return {n: p for p, c in self.edges for n in c}

    @property
    def roots(self) -> tuple[int, ...]:
        return tuple(n for n in self.nodes if n not in self.parents)

    @property
    def leaves(self) -> tuple[int, ...]:
        inner = {n for p, _ in self.edges for n in p}
        return tuple(n for n in self.nodes if n not in inner)

    def order(self) -> list[int]:
        """Parents before children; raises on directed cycles."""
        done, todo = [], list(self.nodes)
        while todo:
            ready = [n for n in todo if all(p in done for p in self.parents.get(n, ()))]
            if not ready:
                raise ValueError("directed cycle")
            done += ready
            todo = [n for n in todo if n not in ready]
        return done

    def scopes(self) -> dict[tuple[str, int], tuple[str, ...]]:
        """Each factor once: ('prior', root), ('cpt', child), ('like', node) and the variables in it."""
        out = {("prior", n): (var(n),) for n in self.roots}
        out |= {("cpt", n): (*map(var, p), var(n)) for n, p in self.parents.items()}
        return out | {("like", n): (var(n),) for n in self.nodes}


def elimination_order(scopes: list[set[str]], keep: set[str]) -> list[str]:
    """Variables to sum out, least fill first (the structure is small and on the driver)."""
    scopes = [set(s) for s in scopes]
    order = []
    while rest := set().union(*scopes, set()) - keep:
        cost = lambda v: (len(set().union(*[s for s in scopes if v in s])), v)
        v = min(rest, key=cost)
        order.append(v)
        new = set().union(*[s for s in scopes if v in s]) - {v}
        scopes = [s for s in scopes if v not in s] + [new]
    return order


def eliminate(factors: list[Factor], keep: Iterable[str]) -> Factor:
    """The product of all factors, summed down to ``keep``; each factor enters exactly once."""
    keep = set(keep)
    factors = list(factors)
    for v in elimination_order([set(f.vars) for f in factors], keep):
        own = sorted((f for f in factors if v in f.vars), key=lambda f: len(f.vars))
        factors = [f for f in factors if v not in f.vars]
        factors.append(reduce(Factor.mul, own).integrate([v]))
    return reduce(Factor.mul, sorted(factors, key=lambda f: -len(f.vars)))


@dataclass(frozen=True)
class Tensor:
    """A factor of many graphs: an axis for each variable, then one of graphs (1: the same for all); probability zero is ``NEVER`` or less."""

    values: np.ndarray
    vars: tuple[str, ...]

    def over(self, names: tuple[str, ...]) -> np.ndarray:
        """With these axes before that of graphs; the ones it lacks have length 1."""
        own = [v for v in names if v in self.vars]
        moved = self.values.transpose([*(self.vars.index(v) for v in own), self.values.ndim - 1])
        sizes = iter(moved.shape)
        return moved.reshape([next(sizes) if v in self.vars else 1 for v in names] + [moved.shape[-1]])


def lse_first(x: np.ndarray) -> np.ndarray:
    """log-sum-exp over the first axis."""
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))


def eliminate_batch(tensors: list[Tensor]) -> np.ndarray:
    """For each graph the log of the product of all tensors, summed over every variable; each enters exactly once."""
    tensors = list(tensors)
    for v in elimination_order([set(t.vars) for t in tensors], set()):
        own = [t for t in tensors if v in t.vars]
        names = tuple(sorted({w for t in own for w in t.vars} - {v}))
        tensors = [t for t in tensors if v not in t.vars]
        tensors.append(Tensor(lse_first(reduce(np.add, sorted((t.over((v, *names)) for t in own), key=np.size))), names))
    return reduce(np.add, [t.values for t in tensors])


def log_table(table) -> np.ndarray:
    p = np.asarray(table, float)
    return np.where(p > 0, np.log(np.where(p > 0, p, 1.0)), NEVER)


def batch_solver(tables: dict[tuple[str, int], Tensor], sizes: dict[int, int], step: int, masked: bool, renormalize: bool):
    """For ``mapInArrow``: graph_id, l<node>_<state> and m<node>_<state> (log-likelihoods and masks) to graph_id, logz, ``step`` graphs at a time."""
    import pyarrow as pa

    def solved(columns: dict[str, np.ndarray]) -> np.ndarray:
        gathered = lambda kind: {n: Tensor(np.maximum([columns[f"{kind}{n}_{i}"] for i in range(k)], NEVER), (var(n),)) for n, k in sizes.items()}
        masks = gathered("m") if masked else {}
        tensors = [*tables.values(), *gathered("l").values(), *masks.values()]
        if masked and renormalize:
            for (kind, n), t in tables.items():
                if kind == "cpt":
                    *given, x = t.vars
                    z = lse_first(t.over((x, *given)) + masks[n].over((x, *given)))
                    tensors.append(Tensor(np.where(z > NEVER / 2, -z, 0.0), tuple(given)))
        z = eliminate_batch(tensors)
        return np.where(z > NEVER / 2, z, -math.inf)

    def work(parts):
        for whole in parts:
            for at in range(0, whole.num_rows, step):
                part = whole.slice(at, step)
                columns = {c: part.column(c).to_numpy(zero_copy_only=False) for c in part.schema.names if c != GRAPH}
                yield pa.RecordBatch.from_arrays([part.column(GRAPH), pa.array(solved(columns))], [GRAPH, "logz"])

    return work


def check_size(scopes: list[set[str]], dims: dict[int, int], keep: Iterable[str] = ()) -> int:
    """Refuses plans whose intermediate factors would exceed ``MOST_CELLS`` rows per graph; the most rows that one has."""
    scopes, keep, most = [set(s) for s in scopes], set(keep), 1
    cells = lambda joined: math.prod(dims[int(w[1:])] for w in joined)
    for v in elimination_order(scopes, keep):
        joined = set().union(*[s for s in scopes if v in s])
        if cells(joined) > MOST_CELLS:
            raise ValueError(f"a factor over {sorted(joined)} would have {cells(joined)} cells")
        most = max(most, cells(joined))
        scopes = [s for s in scopes if v not in s] + [joined - {v}]
    if cells(set().union(*scopes)) > MOST_CELLS:
        raise ValueError(f"the result over {sorted(set().union(*scopes))} would have {cells(set().union(*scopes))} cells")
    return max(most, cells(set().union(*scopes)))


@dataclass(frozen=True)
class Model:
    """Parameters by group, held on the driver: they become literals of the plan.

    prior[g][x]; emission[g][x][y]; cpt[(g of parents.., g of child)] nested by parent states, then child.
    """

    prior: dict[int, list]
    emission: dict[int, list]
    cpt: dict[tuple[int, ...], list]

    def dims(self, groups: dict[int, int]) -> dict[int, int]:
        return {n: len(self.emission[g]) for n, g in groups.items()}


def cells(table, prefix: tuple[int, ...] = ()) -> list[tuple[tuple[int, ...], float]]:
    """(states, probability) of a nested table; zeros are left out."""
    if not isinstance(table, (list, tuple)):
        return [(prefix, float(table))] if table > 0 else []
    return [c for i, t in enumerate(table) for c in cells(t, (*prefix, i))]


def spread(graphs: DataFrame, names: tuple[str, ...], table) -> Factor:
    """The same table for every graph."""
    rows = F.array(*[F.struct(*[F.lit(s).cast("long").alias(n) for n, s in zip(names, states, strict=True)], F.lit(math.log(p)).alias("logw")) for states, p in cells(table)])
    return Factor(graphs.select(GRAPH, F.explode(rows).alias("_r")).select(GRAPH, "_r.*"), names)


class Inference:
    """Queries over all graphs of one structure.

    nodes (graph_id, node), obs (graph_id, node, m, y; missing ones absent), allowed (graph_id, node,
    state) or None.  Restricting states is evidence: the tables are not renormalised unless asked for.
    """

    def __init__(self, structure: Structure, model: Model, graphs: DataFrame, obs: DataFrame, groups: dict[int, int] | None = None, allowed: DataFrame | None = None, renormalize: bool = False):
        structure.order()
        self.structure, self.model = structure, model
        self.groups = groups or dict.fromkeys(structure.nodes, 0)
        self.graphs = graphs.select(GRAPH).distinct()
        self.obs, self.allowed, self.renormalize = obs, allowed, renormalize

    def loglik(self, n: int, y: Column) -> list[Column]:
        """Aggregates: the summed log-likelihood of each state of a node; a measurement out of range is missing."""
        rows = self.model.emission[self.groups[n]]
        return [F.coalesce(F.sum(F.get(F.array(*[F.lit(ln(p)) for p in row]), y.cast("int"))), F.lit(0.0)) for row in rows]

    @cached_property
    def parts(self) -> dict[tuple[str, int], Factor]:
        structure, groups, model, graphs, allowed = self.structure, self.groups, self.model, self.graphs, self.allowed
        parts: dict[tuple[str, int], Factor] = {}
        for kind, n in structure.scopes():
            x = var(n)
            if kind == "prior":
                f = spread(graphs, (x,), model.prior[groups[n]])
            elif kind == "cpt":
                ps = structure.parents[n]
                f = spread(graphs, (*map(var, ps), x), model.cpt[(*(groups[v] for v in ps), groups[n])])
            else:
                like = self.loglik(n, F.col("y"))
                seen = self.obs.filter(F.col("node") == n).groupBy(GRAPH).agg(F.array(*like).alias("_l"))
                none = F.array(*[F.lit(0.0)] * len(like))
                df = graphs.join(seen, GRAPH, "left").select(GRAPH, F.posexplode(F.coalesce("_l", none)).alias("_x", "logw"))
                f = Factor(df.select(GRAPH, F.col("_x").cast("long").alias(x), "logw").filter(F.col("logw") > NEVER / 2), (x,))
            if allowed is not None:
                f = f.restrict(n, allowed)
                if self.renormalize and kind == "cpt":
                    f = Factor(f.normalize([v for v in f.vars if v != x]).select(GRAPH, *f.vars, F.ln("p").alias("logw")), f.vars)
            parts[kind, n] = f
        return parts

    def solve(self, ks: Iterable[tuple[str, int]], keep: Iterable[str]) -> Factor:
        """The product of some parts, summed down to ``keep``."""
        own, keep = [self.parts[k] for k in ks], set(keep)
        check_size([set(f.vars) for f in own], self.model.dims(self.groups), keep)
        return eliminate(own, keep)

    def joint(self, *nodes: int) -> Factor:
        return self.solve(self.parts, map(var, nodes))

    def log_marginal(self) -> DataFrame:
        """graph_id, logz.  Components are multiplied, so graphs that fall apart count in full; impossible evidence gives minus infinity.

        What was seen and what is allowed are gathered by graph_id once, for all nodes.  The joins are stated as merges:
        the sizes that Spark estimates are those of a file of keys, and a broadcast would bring every graph to the driver.
        """
        scopes, sizes = self.structure.scopes(), self.model.dims(self.groups)
        most = check_size([set(vs) for vs in scopes.values()], sizes)
        cells = [(n, k) for n in self.structure.nodes for k in range(sizes[n])]
        seen = {n: self.loglik(n, F.when(F.col("node") == n, F.col("y"))) for n in self.structure.nodes}
        rows = self.graphs.hint("merge").join(self.obs.groupBy(GRAPH).agg(*[seen[n][k].alias(f"l{n}_{k}") for n, k in cells]), GRAPH, "left")
        if self.allowed is not None:
            named = {n: F.max(F.when(F.col("node") == n, 1)) for n in self.structure.nodes}
            barred = lambda n, k: named[n].isNotNull() & F.max(F.when((F.col("node") == n) & (F.col("state") == k), 1)).isNull()
            masks = self.allowed.groupBy(GRAPH).agg(*[F.when(barred(n, k), NEVER).otherwise(0.0).alias(f"m{n}_{k}") for n, k in cells])
            rows = rows.join(masks.hint("merge"), GRAPH, "left")
        rows = rows.select(GRAPH, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in rows.columns if c != GRAPH])
        tables = {(kind, n): Tensor(log_table(self.model.prior[self.groups[n]] if kind == "prior" else self.model.cpt[tuple(self.groups[int(v[1:])] for v in vs)])[..., None], vs) for (kind, n), vs in scopes.items() if kind != "like"}
        return rows.mapInArrow(batch_solver(tables, sizes, max(1, BATCH_CELLS // most), self.allowed is not None, self.renormalize), f"{GRAPH} {dict(rows.dtypes)[GRAPH]}, logz double")

    def family(self, child: int) -> Factor:
        return self.joint(*self.structure.parents.get(child, ()), child)

    def conditional(self, child: int) -> DataFrame:
        """P(child | parents, Y); for a root its smoothed distribution."""
        return self.family(child).normalize(map(var, self.structure.parents.get(child, ())))

    # ---- messages ----

    def reach(self, node: int, factor_ok, cut: set[int]) -> list[tuple[str, int]]:
        """Factors reached from a node through ``factor_ok`` ones at first, never through it again or through cut nodes."""
        scopes = self.structure.scopes()
        found = {k for k, vs in scopes.items() if var(node) in vs and factor_ok(k)}
        while True:
            seen = {v for k in found for v in scopes[k]} - {var(node)} - {var(c) for c in cut}
            more = {k for k, vs in scopes.items() if k not in found and seen & set(vs)}
            if not more:
                return sorted(found)
            found |= more

    def up(self, node: int, cut: Iterable[int] = ()) -> Factor:
        """U: everything that is reached by going up from the node, its own observation included."""
        own = {("prior", node), ("cpt", node), ("like", node)}
        cut = set(cut) - {node}
        ks = self.reach(node, lambda k: k in own, cut)
        return self.solve(ks, {var(node), *(var(c) for c in cut)} & {v for k in ks for v in self.parts[k].vars})

    def down(self, node: int, edge: int, cut: Iterable[int] = ()) -> Factor:
        """V: everything that is reached down one hyperedge from the node."""
        parents, children = self.structure.edges[edge]
        cut = set(cut) - {node}
        ks = self.reach(node, lambda k: k[0] == "cpt" and k[1] in children, cut)
        return self.solve(ks, {var(node), *(var(c) for c in cut)} & {v for k in ks for v in self.parts[k].vars})
