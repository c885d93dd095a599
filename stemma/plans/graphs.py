"""Queries on hypergraphs: navigation over the example corpus, exact inference over copies per nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions.special import digamma_sql, uniform, uniform_sql
from stemma.operators import hypergraph as hg
from stemma.operators import learning, local
from stemma.operators.factors import Inference, Model, Structure, var
from stemma.plans.registry import query, r, table
from stemma.sources import corpus

NAMED = dict(enumerate(corpus.ALL.values()))
E = corpus.edges_sql(NAMED)
P = f"(select graph_id, edge, node, ord from {E} where role = 'p')"
C = f"(select graph_id, edge, node, ord from {E} where role = 'c')"
N = f"(select distinct graph_id, node from {E})"


def edges(spark):
    return corpus.corpus_edges(spark)


# ---- navigation -----------------------------------------------------------------------------------


@query(f"select graph_id, node from {N} n where not exists (select 1 from {C} c where c.graph_id = n.graph_id and c.node = n.node)")
def graph_roots(spark, d):
    return hg.roots(edges(spark))


@query(f"select graph_id, node from {N} n where not exists (select 1 from {P} p where p.graph_id = n.graph_id and p.node = n.node)")
def graph_leaves(spark, d):
    return hg.leaves(edges(spark))


def rel_sql(own, other):
    return f"select a.graph_id, a.edge, a.node, b.node as other, b.ord from {own} a join {other} b on a.graph_id = b.graph_id and a.edge = b.edge and a.node <> b.node"


for _name, _rel, _own, _other in (("parents", hg.parents, C, P), ("children", hg.children, P, C), ("siblings", hg.siblings, C, C), ("mates", hg.mates, P, P)):
    query(rel_sql(_own, _other), f"graph_{_name}")(lambda spark, d, rel=_rel: rel(edges(spark)))


@query(f"select 'up' as side, graph_id, node, edge from {C} where not (graph_id = 1 and edge = 2) union all select 'down', graph_id, node, edge from {P} where not (graph_id = 1 and edge = 2)")
def graph_up_down_edges(spark, d):
    """Hyperedges above and below every node, without a skipped one."""
    skip = spark.createDataFrame([(1, 2)], "graph_id long, edge long")
    return hg.up_edges(edges(spark), skip).select(F.lit("up").alias("side"), "*").unionByName(hg.down_edges(edges(spark), skip).select(F.lit("down").alias("side"), "*"))


def count_sql(own, other):
    return f"(select graph_id, node, count(distinct other) as n from ({rel_sql(own, other)}) group by 1, 2)"


@query(
    f"""select n.graph_id, n.node, coalesce(a.n, 0) as n_parents, coalesce(b.n, 0) as n_children, coalesce(s.n, 0) as n_siblings, coalesce(m.n, 0) as n_mates from {N} n
    left join {count_sql(C, P)} a using (graph_id, node) left join {count_sql(P, C)} b using (graph_id, node) left join {count_sql(C, C)} s using (graph_id, node) left join {count_sql(P, P)} m using (graph_id, node)"""
)
def graph_relation_counts(spark, d):
    return hg.relation_counts(edges(spark))


PAIRS = f"(select p.graph_id, p.node as parent, c.node as child from {P} p join {C} c on p.graph_id = c.graph_id and p.edge = c.edge)"


def level_sql(start: str, a: str, b: str) -> str:
    return f"with recursive s as materialized (select * from {PAIRS}), w(graph_id, node, level) as (select graph_id, node, 0::bigint from ({start}) union all select s.graph_id, s.{b}, w.level + 1 from w join s on s.graph_id = w.graph_id and s.{a} = w.node) select graph_id, node, max(level) as level from w group by 1, 2"


ROOTS, LEAVES = (f"select graph_id, node from {N} n where not exists (select 1 from {x} c where c.graph_id = n.graph_id and c.node = n.node)" for x in (C, P))


@query(level_sql(ROOTS, "parent", "child"))
def graph_levels_forward(spark, d):
    return hg.levels(edges(spark))


@query(level_sql(LEAVES, "child", "parent"))
def graph_levels_backward(spark, d):
    return hg.levels(edges(spark), forward=False)


TREES = {k: v for k, v in NAMED.items() if k < len(corpus.ACYCLIC)}
TE = corpus.edges_sql(TREES)
SCHEDULE = f"""with recursive e as materialized (select * from {TE}), p as (select * from e where role = 'p'), c as (select * from e where role = 'c'),
  v as (select graph_id, node, edge from p),
  dep(graph_id, kind, node, edge, k2, n2, e2) as (
    select c.graph_id, 'u', c.node, -1, 'u', p.node, -1 from c join p using (graph_id, edge)
    union all select c.graph_id, 'u', c.node, -1, 'v', v.node, v.edge from c join p using (graph_id, edge) join v on v.graph_id = p.graph_id and v.node = p.node and v.edge <> c.edge
    union all select c.graph_id, 'u', c.node, -1, 'v', v.node, v.edge from c join c s using (graph_id, edge) join v on v.graph_id = s.graph_id and v.node = s.node where s.node <> c.node
    union all select a.graph_id, 'v', a.node, a.edge, 'u', m.node, -1 from p a join p m using (graph_id, edge) where m.node <> a.node
    union all select a.graph_id, 'v', a.node, a.edge, 'v', v.node, v.edge from p a join p m using (graph_id, edge) join v on v.graph_id = m.graph_id and v.node = m.node and v.edge <> a.edge where m.node <> a.node
    union all select a.graph_id, 'v', a.node, a.edge, 'v', v.node, v.edge from p a join c using (graph_id, edge) join v on v.graph_id = c.graph_id and v.node = c.node),
  m as (select distinct graph_id, 'u' as kind, node, -1::bigint as edge from e union all select graph_id, 'v', node, edge from v),
  w(graph_id, kind, node, edge, level) as (
    select graph_id, kind, node, edge, 0::bigint from m where not exists (select 1 from dep x where x.graph_id = m.graph_id and x.kind = m.kind and x.node = m.node and x.edge = m.edge)
    union select x.graph_id, x.kind, x.node, x.edge, w.level + 1 from w join dep x on x.graph_id = w.graph_id and x.k2 = w.kind and x.n2 = w.node and x.e2 = w.edge)
  select graph_id, kind, node, edge, max(level) as level from w group by 1, 2, 3, 4"""


@query(SCHEDULE)
def graph_message_schedule(spark, d):
    return hg.message_schedule(corpus.edge_table(spark, TREES))


COMPONENTS = f"""with recursive e as materialized (select * from {E}), link as (select distinct a.graph_id, a.node as x, b.node as y from e a join e b on a.graph_id = b.graph_id and a.edge = b.edge),
  w(graph_id, node, other) as (select graph_id, x, y from link union select w.graph_id, w.node, l.y from w join link l on l.graph_id = w.graph_id and l.x = w.other) select graph_id, node, min(other) as component from w group by 1, 2"""


@query(COMPONENTS)
def graph_components(spark, d):
    return hg.components(edges(spark))


BROKEN = {0: "0>1 ; 1>2", 1: "0,1>2 ; 3>2"}
B_SQL = corpus.edges_sql(BROKEN)
LOOSE = "(select 0::bigint as graph_id, 0::bigint as edge, 'p' as role, 0::bigint as node, 0::bigint as ord union all select 2, 0, 'p', 5, 0 union all select 2, 1, 'c', 5, 0)"


@query(
    f"""with e as (select * from {B_SQL} union select * from {LOOSE}), s as (select graph_id, edge, sum((role = 'p')::int) as p, sum((role = 'c')::int) as c from e group by 1, 2),
    named as (select distinct graph_id, node from e union select 0, 99 union select 1, 98 union select 1, 97)
    select graph_id, 'edge without a side' as defect, count(*) as n from s where p = 0 or c = 0 group by 1
    union all select graph_id, 'two edges above', count(*) from (select graph_id, node from e where role = 'c' group by 1, 2 having count(distinct edge) > 1) group by 1
    union all select graph_id, 'isolated node', count(*) from (select * from named except select graph_id, node from e) group by 1"""
)
def graph_defects(spark, d):
    """What makes a graph invalid: hyperedges without parents or children, nodes with two hyperedges above, nodes in none."""
    loose = spark.createDataFrame([(2, 0, "p", 5, 0), (2, 1, "c", 5, 0)], "graph_id long, edge long, role string, node long, ord long")
    e = corpus.edge_table(spark, BROKEN).union(loose)
    named = hg.nodes(e).union(spark.createDataFrame([(0, 99), (1, 98), (1, 97)], "graph_id long, node long"))
    return hg.defects(e, named)


@query(f"select graph_id, node from {N} except (select graph_id, node from {P} union select graph_id, node from {C} where edge = 0)")
def graph_set_operations(spark, d):
    """Nodes that are no parents and not in the first hyperedge: set union and difference of node tables."""
    e = edges(spark)
    first = hg.members(e, "c").filter("edge = 0").select("graph_id", "node")
    return hg.nodes(e).subtract(hg.members(e, "p").select("graph_id", "node").union(first))


@query(f"select graph_id, node from {P} intersect select graph_id, node from {C}")
def graph_inner_nodes(spark, d):
    """Nodes that are parents and children."""
    e = edges(spark)
    return hg.members(e, "p").select("graph_id", "node").intersect(hg.members(e, "c").select("graph_id", "node"))


@query(f"with s as (select graph_id, edge, sum(case when role = 'p' then 1 else 0 end)::bigint as n_parents from {E} group by 1, 2) select n_parents, count(*) as n_edges from s group by 1")
def graph_parameter_shapes(spark, d):
    return hg.parameter_shapes(edges(spark))


AFF = uniform_sql("'aff'", "graph_id", "node") + " < 0.4"
MARK = f"(select graph_id, node from {N} where {AFF})"


def marked(spark):
    return hg.nodes(edges(spark)).filter(uniform(F.lit("aff"), F.col("graph_id"), F.col("node")) < 0.4)


def paths_sql(a: str, b: str, mark: str = MARK) -> str:
    return f"(with recursive s as materialized (select * from {PAIRS}), w(graph_id, node, other) as (select graph_id, {a}, {b} from s union all select w.graph_id, w.node, s.{b} from w join s on s.graph_id = w.graph_id and s.{a} = w.other) select n.graph_id, n.node, coalesce(k.n, 0) as n from {N} n left join (select w.graph_id, w.node, count(*) as n from w join {mark} m on m.graph_id = w.graph_id and m.node = w.other group by 1, 2) k on k.graph_id = n.graph_id and k.node = n.node)"


@query(paths_sql("child", "parent")[1:-1])
def graph_affected_above(spark, d):
    return hg.path_counts(edges(spark), marked(spark), True)


@query(paths_sql("parent", "child")[1:-1])
def graph_affected_below(spark, d):
    return hg.path_counts(edges(spark), marked(spark), False)


UNMARK = f"(select graph_id, node from {N} where not ({AFF}))"


@query(
    f"""with r as (select q.graph_id, q.node, a.n as n_aff, u.n as n_unaff from ({ROOTS}) q join {MARK} m using (graph_id, node) join {paths_sql('parent', 'child')} a using (graph_id, node) join {paths_sql('parent', 'child', UNMARK)} u using (graph_id, node))
    select graph_id, node, n_aff, n_unaff from (select *, row_number() over (partition by graph_id order by n_aff desc, n_unaff, node) as k from r) where k = 1"""
)
def graph_select_root(spark, d):
    return hg.select_root(edges(spark), marked(spark))


CUTS = {i: fbs for i, (k, fbs) in enumerate((k, corpus.CYCLIC.get(k, ("", ()))[1]) for k in corpus.ALL)}
CUT_SQL = "(select graph_id::bigint as graph_id, node::bigint as node from (values " + ", ".join(str((g, n)) for g, ns in CUTS.items() for n in ns) + ") t(graph_id, node))"


def cuts(spark):
    return spark.createDataFrame([(g, n) for g, ns in CUTS.items() for n in ns], "graph_id long, node long")


@query(
    f"""with recursive left_ as materialized (select distinct graph_id, edge, node from {E} e where not exists (select 1 from {CUT_SQL} k where k.graph_id = e.graph_id and k.node = e.node)),
    link as (select distinct a.graph_id, a.node as x, b.node as y from left_ a join left_ b on a.graph_id = b.graph_id and a.edge = b.edge),
    w(graph_id, node, other) as (select graph_id, x, y from link union select w.graph_id, w.node, l.y from w join link l on l.graph_id = w.graph_id and l.x = w.other),
    c as (select graph_id, count(distinct comp) as c from (select graph_id, node, min(other) as comp from w group by 1, 2) group by 1)
    select graph_id, (i = n + e - c)::bigint as is_valid from (select graph_id, count(*) as i, count(distinct node) as n, count(distinct edge) as e from left_ group by 1) join c using (graph_id)"""
)
def graph_fbs_is_valid(spark, d):
    return hg.feedback_is_valid(edges(spark), cuts(spark))


@query()
def graph_feedback_search(spark, d):
    """A feedback set found for every graph, with the proof that it is one."""
    e = edges(spark)
    found = hg.feedback_set(e)
    return found.join(hg.feedback_is_valid(e, found), "graph_id")


@query(f"select graph_id, 'digraph g {{' || string_agg(a, '; ' order by a) || '}}' as dot from (select graph_id, case when role = 'p' then 'n' || node || ' -> e' || edge else 'e' || edge || ' -> n' || node end as a from {E}) group by 1")
def graph_dot(spark, d):
    return hg.dot(edges(spark))


@query("select * from (values (0::bigint), (1), (2)) t(graph_id)")
def graph_directed_cycles(spark, d):
    """Graphs that must be refused: all three are found among themselves and the corpus."""
    bad = corpus.edge_table(spark, dict(enumerate(corpus.REFUSED.values())))
    good = edges(spark).withColumn("graph_id", F.col("graph_id") + 100)
    return hg.directed_cycles(bad.unionByName(good))


# ---- inference: fixtures --------------------------------------------------------------------------


def row(k: int, seed: int) -> list[float]:
    w = [1 + (seed * 7 + i * 3 + (seed + i) ** 2) % 5 for i in range(k)]
    return [x / sum(w) for x in w]


def cpt(dims: tuple[int, ...], seed: int = 0):
    """A table without zeros, fixed by the parents' states."""
    if len(dims) == 1:
        return row(dims[0], seed)
    return [cpt(dims[1:], seed * 3 + i + 1) for i in range(dims[0])]


D_OBS, M_OBS = 3, 2


def model_for(structure: Structure, groups: dict[int, int], sizes: dict[int, int]) -> Model:
    tables = {}
    for n, ps in structure.parents.items():
        key = (*(groups[p] for p in ps), groups[n])
        tables[key] = cpt(tuple(sizes[g] for g in key))
    return Model({g: row(k, 11 + g) for g, k in sizes.items()}, {g: [row(D_OBS, 5 * g + i) for i in range(k)] for g, k in sizes.items()}, tables)


class Case:
    """One structure copied to every row of a table (nations unless told otherwise), with its parameters, and its enumeration in SQL."""

    def __init__(self, name: str, sizes=None, groups=None, missing: float = 0.0, evidence: dict[int, tuple[int, ...]] | None = None, source: tuple[str, str] = ("nation", "n_nationkey")):
        self.text = corpus.ALL[name]
        self.structure = Structure.parse(self.text)
        self.sizes = sizes or {0: 2}
        self.groups = groups or dict.fromkeys(self.structure.nodes, 0)
        self.model = model_for(self.structure, self.groups, self.sizes)
        self.missing, self.evidence, self.source = missing, evidence or {}, source

    def k(self, n: int) -> int:
        return self.sizes[self.groups[n]]

    def frames(self, spark, d):
        rows, key = table(spark, d, self.source[0]), self.source[1]
        e = corpus.replicate(rows, self.text, key)
        n = corpus.copies(rows, key).select("graph_id", F.explode(F.array(*[F.lit(x).cast("long") for x in self.structure.nodes])).alias("node"))
        grp = F.coalesce(*[F.when(F.col("node") == x, F.lit(g).cast("long")) for x, g in self.groups.items()])
        allowed = None
        if self.evidence:
            graphs = rows.select(F.col(key).cast("long").alias("graph_id"))
            states = F.array(*[F.struct(F.lit(x).cast("long").alias("node"), F.lit(s).cast("long").alias("state")) for x, ss in self.evidence.items() for s in ss])
            allowed = graphs.filter("graph_id % 2 = 0").select("graph_id", F.explode(states).alias("s")).select("graph_id", "s.*")
        return e, n.withColumn("grp", grp), corpus.observations(n, M_OBS, D_OBS, self.missing), allowed

    def inference(self, spark, d, renormalize: bool = False) -> Inference:
        _, _, obs, allowed = self.frames(spark, d)
        return Inference(self.structure, self.model, corpus.copies(table(spark, d, self.source[0]), self.source[1]), obs, self.groups, allowed, renormalize)

    def packed(self, spark, d):
        e, n, obs, allowed = self.frames(spark, d)
        return corpus.pack(e, obs, n, allowed)

    # SQL

    def joint_sql(self) -> str:
        """graph_id, x0.., w: every joint state of every graph, by plain enumeration."""
        s, m = self.structure, self.model
        ctes, joins, terms, wheres = [], [], [], []
        for n in s.nodes:
            e = m.emission[self.groups[n]]
            like = ", ".join(f"sum(ln(({r_!r})[y + 1]))" for r_ in e)
            ctes.append(f"l{n} as (select graph_id, [{like}] as l from obs where node = {n} group by 1)")
            joins.append(f"left join l{n} on l{n}.graph_id = g.graph_id")
            index = "".join(f"[x{v} + 1]" for v in (*s.parents.get(n, ()), n))
            source = m.cpt[(*(self.groups[v] for v in s.parents[n]), self.groups[n])] if n in s.parents else m.prior[self.groups[n]]
            terms.append(f"ln(({source!r}){index}) + coalesce(l{n}.l[x{n} + 1], 0.0)")
            if n in self.evidence:
                wheres.append(f"(g.graph_id % 2 = 1 or x{n} in ({', '.join(map(str, self.evidence[n]))}))")
        u = lambda *k: uniform_sql(*k)
        name, key = self.source
        nodes = ", ".join(f"({n})" for n in s.nodes)
        obs = f"""obs as (select graph_id, node, m, floor({u("'obs'", 'graph_id', 'node', 'm')} * {D_OBS})::bigint as y from (select {key}::bigint as graph_id, node, m from {name}, (values {nodes}) t(node), range({M_OBS}) r(m)) where {u("'seen'", 'graph_id', 'node')} >= {self.missing})"""
        states = ", ".join(f"range({self.k(n)}) r{n}(x{n})" for n in s.nodes)
        cond = f" where {' and '.join(wheres)}" if wheres else ""
        return f"with {obs}, {', '.join(ctes)}, joint_ as (select g.graph_id, {', '.join(f'x{n}' for n in s.nodes)}, {' + '.join(terms)} as w from (select {key}::bigint as graph_id from {name}) g {' '.join(joins)}, {states}{cond})"

    def sql(self, tail: str) -> str:
        return f"{self.joint_sql()} {tail}"


LSE = "((select max(w) from joint_) + ln(sum(exp(w - (select max(w) from joint_)))))"


def nodes_sql(case: Case) -> str:
    return case.sql(f", z as (select graph_id, {LSE} as z from joint_ group by 1) " + " union all ".join(f"select graph_id, {n}::bigint as node, x{n} as state, round(sum(exp(w - z)), 6) + 0.0 as p from joint_ join z using (graph_id) group by graph_id, x{n}" for n in case.structure.nodes))


def logz_sql(case: Case) -> str:
    return case.sql(f"select graph_id, round({LSE}, 6) as log_marginal from joint_ group by 1")


def posterior(case: Case, spark, d):
    return local.posteriors(case.packed(spark, d), case.model)


def nodes_query(case: Case):
    return lambda spark, d: posterior(case, spark, d).filter("kind = 'node'").select("graph_id", "node", "state", r("value").alias("p"))


def logz_query(case: Case):
    """Likelihoods gathered by graph in one plan, variables summed out of tensors over many graphs."""
    return lambda spark, d: case.inference(spark, d).log_marginal().select("graph_id", r("logz").alias("log_marginal"))


GROUPED = {0: 2, 1: 3}
CASES = {
    "": Case("graph2"),
    "_fbs": Case("cycleGraph2"),
    "_group": Case("graph4", GROUPED, {n: n % 2 for n in range(7)}),
    "_evidence": Case("cycleGraph10", evidence={1: (0,), 5: (1,)}),
    "_missing": Case("graph3", {0: 3}, missing=0.4),
    "_group_fbs": Case("cycleGraph7", GROUPED, {0: 1, 1: 0, 2: 1, 3: 0}),
    "_orders": Case("cycleGraph2", source=("orders", "o_orderkey")),  # as many graphs as orders
}
for _tag, _case in CASES.items():
    query(logz_sql(_case), f"graph_log_marginal{_tag}")(logz_query(_case))
    query(nodes_sql(_case), f"graph_node_smoothed{_tag}")(nodes_query(_case))


def family_sql(case: Case, conditional: bool) -> str:
    parts = []
    for n in case.structure.nodes:
        ps = case.structure.parents.get(n, ())
        text = " || ',' || ".join(f"x{p}" for p in ps) if ps else "''"
        over = "graph_id" + "".join(f", x{p}" for p in ps)
        value = f"sum(exp(w - z)) / sum(sum(exp(w - z))) over (partition by {over})" if conditional else "sum(exp(w - z))"
        parts.append(f"select graph_id, {n}::bigint as node, {text} as parents, x{n} as state, round({value}, 6) + 0.0 as p from joint_ join z using (graph_id) group by graph_id, x{n}{''.join(f', x{p}' for p in ps)}")
    return case.sql(f", z as (select graph_id, {LSE} as z from joint_ group by 1) " + " union all ".join(parts))


for _tag in ("", "_fbs", "_group", "_evidence"):
    query(family_sql(CASES[_tag], False), f"graph_family_joint{_tag}")(lambda spark, d, c=CASES[_tag]: posterior(c, spark, d).filter("kind = 'family'").select("graph_id", "node", "parents", "state", r("value").alias("p")))
    query(family_sql(CASES[_tag], True), f"graph_conditional{_tag}")(lambda spark, d, c=CASES[_tag]: posterior(c, spark, d).filter("kind = 'family'").select("graph_id", "node", "parents", "state", r("conditional").alias("p")))


@query(CASES["_fbs"].sql(f"select graph_id, x2, x3, x4, round({LSE}, 6) as logw from joint_ group by graph_id, x2, x3, x4"))
def graph_parents_joint(spark, d):
    """P(x of a hyperedge's parents, Y), relationally, across a cycle."""
    return CASES["_fbs"].inference(spark, d).joint(2, 3, 4).df.select("graph_id", "x2", "x3", "x4", r("logw").alias("logw"))


@query(CASES["_fbs"].sql(" union all ".join(f"select graph_id, 'x{n}' as var, x{n} as state, round({LSE}, 6) as logw from joint_ group by graph_id, x{n}" for n in (2, 3, 4, 5))))
def graph_all_marginals_gsets(spark, d):
    """Every single marginal of a family from one GROUPING SETS query."""
    return CASES["_fbs"].inference(spark, d).family(5).marginals().select("graph_id", "var", "state", r("logw").alias("logw"))


# ---- messages: the same factors enumerated over what each one covers -------------------------------


def message_sql(case: Case, members: dict[int, list], keep: int) -> str:
    """A message by enumeration: the factors named in ``members`` (node -> kinds), summed to one node's state."""
    s, m = case.structure, case.model
    names = sorted({v for n, kinds in members.items() for v in ((*s.parents.get(n, ()), n) if "cpt" in kinds else (n,))})
    terms, joins, ctes = [], [], []
    for n, kinds in members.items():
        if "prior" in kinds:
            terms.append(f"ln(({m.prior[case.groups[n]]!r})[x{n} + 1])")
        if "cpt" in kinds:
            terms.append(f"ln(({m.cpt[(*(case.groups[v] for v in s.parents[n]), case.groups[n])]!r})" + "".join(f"[x{v} + 1]" for v in (*s.parents[n], n)) + ")")
        if "like" in kinds:
            ctes.append(f"l{n} as (select graph_id, [{', '.join(f'sum(ln(({r_!r})[y + 1]))' for r_ in m.emission[case.groups[n]])}] as l from obs where node = {n} group by 1)")
            joins.append(f"left join l{n} on l{n}.graph_id = g.graph_id")
            terms.append(f"coalesce(l{n}.l[x{n} + 1], 0.0)")
    obs = f"""obs as (select graph_id, node, m, floor({uniform_sql("'obs'", 'graph_id', 'node', 'm')} * {D_OBS})::bigint as y from (select n_nationkey::bigint as graph_id, node, m from nation, (values {', '.join(f'({n})' for n in s.nodes)}) t(node), range({M_OBS}) r(m)))"""
    inner = f"select g.graph_id, {', '.join(f'x{v}' for v in names)}, {' + '.join(terms)} as w from (select n_nationkey::bigint as graph_id from nation) g {' '.join(joins)}, {', '.join(f'range({case.k(v)}) r{v}(x{v})' for v in names)}"
    return f"with {', '.join([obs, *ctes])}, joint_ as ({inner}) select graph_id, x{keep} as state, round({LSE}, 6) as logw from joint_ group by 1, 2"


# graph2: 0,1>4 ; 2,3>5 ; 4,5>6,7
@query(message_sql(CASES[""], {0: ["prior", "like"], 1: ["prior", "like"], 4: ["cpt", "like"]}, 4))
def graph_U(spark, d):
    """The upward message of node 4: its parents and its own observation."""
    return CASES[""].inference(spark, d).up(4).df.select("graph_id", F.col("x4").alias("state"), r("logw").alias("logw"))


@query(message_sql(CASES[""], {2: ["prior", "like"], 3: ["prior", "like"], 5: ["cpt", "like"], 6: ["cpt", "like"], 7: ["cpt", "like"]}, 4))
def graph_V(spark, d):
    """The downward message of node 4 over the last hyperedge: mates with what is above them, and children."""
    return CASES[""].inference(spark, d).down(4, 2).df.select("graph_id", F.col("x4").alias("state"), r("logw").alias("logw"))


@query(nodes_sql(CASES[""]))
def graph_model_posterior(spark, d):
    """Smoothed nodes by the model of graphs."""
    from stemma.operators.facade import GraphModel

    post = GraphModel(CASES[""].model).posterior(CASES[""].packed(spark, d))
    return post.filter("kind = 'node'").select("graph_id", "node", "state", r("value").alias("p"))


@query(logz_sql(CASES["_fbs"]))
def graph_model_marginal(spark, d):
    """log P(Y) across cycles by the model of graphs."""
    from stemma.operators.facade import GraphModel

    return GraphModel(CASES["_fbs"].model).marginal(CASES["_fbs"].packed(spark, d)).select("graph_id", r("logz").alias("log_marginal"))


@query()
def graph_loopy_bp(spark, d):
    """Damped loopy belief propagation on graphs with a cycle, beside the exact answer."""
    case = CASES["_fbs"]
    packed = case.packed(spark, d)
    loopy = local.per_graph(packed, local.loopy_rows(case.model), "graph_id long, node long, state long, p double")
    exact = posterior(case, spark, d).filter("kind = 'node'").select("graph_id", "node", "state", F.col("value").alias("exact"))
    return loopy.join(exact, ["graph_id", "node", "state"]).select("graph_id", "node", "state", r("p").alias("p"), r("exact").alias("exact"))


# ---- learning -------------------------------------------------------------------------------------

LEARN = CASES["_evidence"]


def counts_sql(case: Case) -> str:
    """kind, key, cell, value: expected counts over all graphs by enumeration."""
    s, parts = case.structure, []
    for n in s.nodes:
        ps = s.parents.get(n, ())
        vs = (*ps, n)
        cell = " || ',' || ".join(f"x{v}" for v in vs)
        kind, key = ("cpt" if ps else "root"), ",".join(str(case.groups[v]) for v in vs)
        parts.append(f"select '{kind}' as kind, '{key}' as key, cast({cell} as varchar) as cell, exp(w - z) as v from joint_ join z using (graph_id)")
        parts.append(f"select 'emission', '{case.groups[n]}', x{n} || ',' || y, exp(w - z) from joint_ join z using (graph_id) join obs on obs.graph_id = joint_.graph_id and obs.node = {n}")
    return case.sql(f", z as (select graph_id, {LSE} as z from joint_ group by 1), counts_ as (select kind, key, cell, sum(v) as value from (" + " union all ".join(parts) + ") group by 1, 2, 3)")


def long_table(spark, m: Model, name: str, digits: int = 8):
    from stemma.operators.factors import cells

    rows = [(kind, key, ",".join(map(str, c)), round(p, digits)) for kind, t in (("root", m.prior), ("emission", m.emission), ("cpt", m.cpt)) for k, x in t.items() for key in (",".join(map(str, k)) if isinstance(k, tuple) else str(k),) for c, p in cells(x)]
    return spark.createDataFrame(rows, f"kind string, key string, cell string, {name} double")


ROW_OF = "case when position(',' in cell) > 0 then regexp_replace(cell, ',[0-9]+$', '') else '' end"


@query(f"{counts_sql(LEARN)} select kind, key, cell, round(value / sum(value) over (partition by kind, key, {ROW_OF}), 8) as p from counts_")
def ghmm_em_step(spark, d):
    return long_table(spark, learning.em_step(LEARN.packed(spark, d), LEARN.model)[0], "p")


@query(f"{counts_sql(LEARN)} select kind, key, cell, round(value + 1.0, 6) as alpha from counts_")
def ghmm_cavi_step(spark, d):
    """Prior 1 plus expected counts under the model's tables."""
    new = learning.both(learning.count_tables(LEARN.model, learning.expected_counts(LEARN.packed(spark, d), LEARN.model)), LEARN.model, lambda n, _: [x + 1.0 for x in n])
    return long_table(spark, new, "alpha", 6)


RATE = 0.3


CHOSEN = uniform_sql("'svi'", "7", "n_nationkey") + " < 0.5"
SVI = counts_sql(LEARN).replace("from nation) g", f"from nation where {CHOSEN}) g") + f", s as (select 25.0 / count(*) as scale from nation where {CHOSEN})"


@query(f"{SVI} select kind, key, cell, round({1 - RATE} + {RATE} * (1.0 + scale * value), 6) as alpha from counts_, s")
def ghmm_svi_step(spark, d):
    """A natural-gradient step from a hashed half of the graphs, blended with flat Dirichlet rows."""
    packed = LEARN.packed(spark, d)
    chosen = uniform(F.lit("svi"), F.lit(7), F.col("graph_id")) < 0.5
    total, part = packed.agg(F.sum(F.size("nodes")), F.sum(F.when(chosen, F.size("nodes")))).first()
    c = learning.count_tables(LEARN.model, learning.expected_counts(packed.filter(chosen), LEARN.model))
    return long_table(spark, learning.each(c, lambda n: [(1 - RATE) + RATE * (1.0 + total / part * x) for x in n]), "alpha", 6)


def parameter_rows(m: Model) -> list[tuple[str, str, str, list[float]]]:
    """(kind, key, states before the last, row) of every innermost row."""
    from stemma.operators.factors import cells

    rows: dict[tuple, list] = {}
    for kind, t in (("root", m.prior), ("emission", m.emission), ("cpt", m.cpt)):
        for k, x in t.items():
            for c, p in cells(x):
                rows.setdefault((kind, ",".join(map(str, k)) if isinstance(k, tuple) else str(k), ",".join(map(str, c[:-1]))), []).append(p)
    return [(*k, v) for k, v in rows.items()]


def iterated_sql(case: Case, rounds: int, start: Model, used, after, bound: str = "0.0") -> str:
    """log P(Y) of every graph, again and again: cells p0.. of the rows, the tables made of them, the joint, the counts, new cells.

    used(names of a row) are the parameters that the joint takes, after(names of the row's counts) the next
    cells; bound is subtracted from log P(Y), an expression over the cells.
    """
    s, rows = case.structure, parameter_rows(start)
    names, n = {}, 0
    for kind, key, head, row_ in rows:
        names[kind, key, head] = [f"p{n + i}" for i in range(len(row_))]
        n += len(row_)

    def nested(kind: str, key: str, dims: tuple[int, ...], head: tuple[int, ...] = ()) -> str:
        if len(dims) == 1:
            return "[" + ", ".join(used(names[kind, key, ",".join(map(str, head))])) + "]"
        return "[" + ", ".join(nested(kind, key, dims[1:], (*head, i)) for i in range(dims[0])) + "]"

    key_of = lambda v: ",".join(str(case.groups[x]) for x in (*s.parents.get(v, ()), v))
    tables = {}
    for v in s.nodes:
        kind = "cpt" if v in s.parents else "root"
        tables[kind, key_of(v)] = nested(kind, key_of(v), tuple(case.k(x) for x in (*s.parents.get(v, ()), v)))
        tables["emission", str(case.groups[v])] = nested("emission", str(case.groups[v]), (case.k(v), D_OBS))
    column = {k: f"t{i}" for i, k in enumerate(tables)}
    nodes = ", ".join(f"({v})" for v in s.nodes)
    obs = f"""obs as materialized (select graph_id, node, m, floor({uniform_sql("'obs'", 'graph_id', 'node', 'm')} * {D_OBS})::bigint as y from (select n_nationkey::bigint as graph_id, node, m from nation, (values {nodes}) t(node), range({M_OBS}) r(m)))"""
    cells_ = ", ".join(f"{x!r}::double as {name}" for (*_, row_), of in zip(rows, names.values(), strict=True) for x, name in zip(row_, of, strict=True))
    ctes, out = [obs, f"s0 as (select {cells_})"], []
    where = " and ".join(f"(g.graph_id % 2 = 1 or x{v} in ({', '.join(map(str, states))}))" for v, states in case.evidence.items())
    for i in range(rounds):
        ctes.append(f"t_{i} as materialized (select {', '.join(f'{sql} as {column[k]}' for k, sql in tables.items())} from s{i})")
        terms, joins, parts = [], [], []
        for v in s.nodes:
            em, kind, vs = column["emission", str(case.groups[v])], ("cpt" if v in s.parents else "root"), (*s.parents.get(v, ()), v)
            ctes.append(f"l{v}_{i} as materialized (select graph_id, [{', '.join(f'sum(ln({em}[{k + 1}][y + 1]))' for k in range(case.k(v)))}] as l from obs, t_{i} where node = {v} group by 1)")
            joins.append(f"join l{v}_{i} l{v} on l{v}.graph_id = g.graph_id")
            terms.append(f"ln({column[kind, key_of(v)]}{''.join(f'[x{x} + 1]' for x in vs)}) + l{v}.l[x{v} + 1]")
            cell = " || ',' || ".join(f"x{x}" for x in vs)
            parts.append(f"select '{kind}' as kind, '{key_of(v)}' as key, cast({cell} as varchar) as cell, exp(w - z) as v from j_{i} join z_{i} using (graph_id)")
            parts.append(f"select 'emission', '{case.groups[v]}', x{v} || ',' || y, exp(w - z) from j_{i} join z_{i} using (graph_id) join obs on obs.graph_id = j_{i}.graph_id and obs.node = {v}")
        ctes.append(f"j_{i} as materialized (select g.graph_id, {', '.join(f'x{v}' for v in s.nodes)}, {' + '.join(terms)} as w from (select n_nationkey::bigint as graph_id from nation) g {' '.join(joins)}, t_{i}, {', '.join(f'range({case.k(v)}) r{v}(x{v})' for v in s.nodes)}" + (f" where {where}" if where else "") + ")")
        ctes.append(f"z_{i} as materialized (select graph_id, {LSE.replace('joint_', f'j_{i}')} as z from j_{i} group by 1)")
        out.append(f"select {i}::bigint as iteration, (select sum(z) from z_{i}) - (select {bound} from s{i}) as value")
        if i + 1 < rounds:
            ctes.append(f"c_{i} as materialized (select kind, key, cell, sum(v) as value from ({' union all '.join(parts)}) group by 1, 2, 3)")
            counted = ", ".join(f"sum(case when kind = '{k}' and key = '{key}' and cell = '{head + ',' if head else ''}{j}' then value else 0 end) as {name}" for (k, key, head), of in names.items() for j, name in enumerate(of))
            ctes.append(f"s{i + 1} as materialized (select {', '.join(f'{e} as {x}' for of in names.values() for e, x in zip(after(of), of, strict=True))} from (select {counted} from c_{i}))")
    return f"with {', '.join(ctes)} " + " union all ".join(out)


def row_sum(xs: list[str]) -> str:
    return f"({' + '.join(xs)})"


@query(f"select iteration, round(value, 5) as logp from ({iterated_sql(LEARN, 5, LEARN.model, lambda xs: xs, lambda xs: [f'{x} / {row_sum(xs)}' for x in xs])})")
def ghmm_em_5iters_logp(spark, d):
    """log P(Y) over five EM iterations; it never falls."""
    _, trace = learning.fit_em(LEARN.packed(spark, d), LEARN.model, rounds=5)
    return spark.createDataFrame([(i, round(z, 5)) for i, z in enumerate(trace)], "iteration long, logp double")


#: Dirichlet parameters that CAVI starts from; the prior is one everywhere.
START = learning.each(LEARN.model, lambda row_: [1.0 + 5 * p for p in row_])


def elbo_sql() -> str:
    expected = lambda xs: [f"exp({digamma_sql(x)} - {digamma_sql(row_sum(xs))})" for x in xs]
    rows, n, kl = parameter_rows(START), 0, []
    for *_, row_ in rows:
        xs = [f"p{n + i}" for i in range(len(row_))]
        n += len(row_)
        kl.append(f"lgamma({row_sum(xs)}) - lgamma({len(xs)}) - ({' + '.join(f'lgamma({x})' for x in xs)}) + " + " + ".join(f"({x} - 1) * ({digamma_sql(x)} - {digamma_sql(row_sum(xs))})" for x in xs))
    return iterated_sql(LEARN, 4, START, expected, lambda xs: [f"1.0 + {x}" for x in xs], " + ".join(kl))


@query(f"select iteration, round(value, 5) as elbo from ({elbo_sql()})")
def ghmm_elbo(spark, d):
    """The bound over four CAVI iterations; it never falls."""
    prior = learning.each(LEARN.model, lambda row_: [1.0] * len(row_))
    _, trace = learning.fit_cavi(LEARN.packed(spark, d), prior, START, rounds=4)
    return spark.createDataFrame([(i, round(z, 5)) for i, z in enumerate(trace)], "iteration long, elbo double")


GENE = CASES[""]
X_OF = lambda n: "floor(" + uniform_sql("'state'", "graph_id", str(n)) + " * 2)::bigint"


def given_states(n):
    return n.select("graph_id", "node", F.floor(uniform(F.lit("state"), F.col("graph_id"), F.col("node")) * 2).cast("long").alias("state"))


@query(GENE.sql("select graph_id, round(w, 6) as logp from joint_ where " + " and ".join(f"x{n} = {X_OF(n)}" for n in GENE.structure.nodes)))
def ghmm_generative_logprob(spark, d):
    """ln P(X, Y) of complete data: each factor looked up at the given states and added."""
    _, n, _, _ = GENE.frames(spark, d)
    inf, states = GENE.inference(spark, d), given_states(n)
    wide = states.groupBy("graph_id").agg(*[F.max(F.when(F.col("node") == x, F.col("state"))).alias(var(x)) for x in GENE.structure.nodes])
    looked = None
    for f in inf.parts.values():
        hit = wide.join(f.df, ["graph_id", *f.vars]).select("graph_id", "logw")
        looked = hit if looked is None else looked.unionByName(hit)
    return looked.groupBy("graph_id").agg(r(F.sum("logw")).alias("logp"))


@query(nodes_sql(CASES["_missing"]).replace(" as p from", " as gradient from"))
def ghmm_emission_gradient(spark, d):
    """The derivative of log P(Y) in each emission potential is the smoothed probability."""
    return nodes_query(CASES["_missing"])(spark, d).withColumnRenamed("p", "gradient")


def ancestral_sql(case: Case, seed: int) -> str:
    """States drawn in order of ancestors from P(x_n | parents drawn, Y), by enumeration with the drawn states fixed."""
    steps, fixed = [], []
    order = local_order(case)
    prev = "joint_"
    for i, n in enumerate(order):
        u = uniform_sql(str(seed), "graph_id", str(n))
        k = case.k(n)
        sums = ", ".join(f"sum(exp(w - m)) filter (where x{n} = {s}) as p{s}" for s in range(k))
        cum = "case " + " ".join(f"when u < ({' + '.join(f'coalesce(p{q}, 0)' for q in range(s + 1))}) / ({' + '.join(f'coalesce(p{q}, 0)' for q in range(k))}) then {s}" for s in range(k - 1)) + f" else {k - 1} end"
        steps.append(f"d{i} as (select graph_id, ({cum})::bigint as x{n} from (select graph_id, {u} as u, {sums} from {prev} join mx using (graph_id) group by graph_id))")
        steps.append(f"j{i} as materialized (select j.* from {prev} j join d{i} using (graph_id, x{n}))")
        prev = f"j{i}"
        fixed.append(n)
    return case.sql(", mx as (select graph_id, max(w) as m from joint_ group by 1), " + ", ".join(steps) + f", drawn as (" + " union all ".join(f"select graph_id, {n}::bigint as node, x{n} as state from {prev}" for n in case.structure.nodes) + ")")


def local_order(case: Case) -> list[int]:
    drawn, todo = [], list(case.structure.nodes)
    while todo:
        n = next(m for m in todo if all(p in drawn for p in case.structure.parents.get(m, ())))
        todo.remove(n)
        drawn.append(n)
    return drawn


@query(ancestral_sql(CASES["_missing"], 3) + " select graph_id, node, state from drawn")
def ghmm_posterior_sample(spark, d):
    """States drawn from P(x | Y) by fixed uniforms."""
    case = CASES["_missing"]
    return learning.sample_states(case.packed(spark, d), case.model, 3)


def gibbs_counts_sql(case: Case, seed: int) -> str:
    s, parts = case.structure, []
    for n in s.nodes:
        ps = s.parents.get(n, ())
        joins = " ".join(f"join drawn d{v} on d{v}.graph_id = d.graph_id and d{v}.node = {v}" for v in ps)
        cell = " || ',' || ".join([f"d{v}.state" for v in ps] + ["d.state"])
        key = ",".join(str(case.groups[v]) for v in (*ps, n))
        parts.append(f"select '{'cpt' if ps else 'root'}' as kind, '{key}' as key, cast({cell} as varchar) as cell from drawn d {joins} where d.node = {n}")
        parts.append(f"select 'emission', '{case.groups[n]}', d.state || ',' || y from drawn d join obs on obs.graph_id = d.graph_id and obs.node = d.node where d.node = {n}")
    return ancestral_sql(case, seed) + " select kind, key, cell, count(*)::double as value from (" + " union all ".join(parts) + ") group by 1, 2, 3"


@query(gibbs_counts_sql(CASES["_missing"], 3))
def ghmm_gibbs_counts(spark, d):
    """Counts of a Gibbs sweep: states drawn by fixed uniforms, joined to hyperedges and observations."""
    case = CASES["_missing"]
    packed = case.packed(spark, d)
    return learning.state_counts(packed, learning.sample_states(packed, case.model, 3))


SIM = Case("graph3")


def sim_sql(case: Case, seed: int) -> str:
    ctes, prev = [], "(select n_nationkey::bigint as graph_id from nation)"
    for i, n in enumerate(local_order(case)):
        ps = case.structure.parents.get(n, ())
        source = case.model.cpt[(*(case.groups[v] for v in ps), case.groups[n])] if ps else case.model.prior[case.groups[n]]
        dist = f"({source!r})" + "".join(f"[x{p} + 1]" for p in ps)
        ctes.append(f"s{i} as (select *, ({uniform_sql(str(seed), 'graph_id', str(n))} >= {dist}[1])::bigint as x{n} from {prev})")
        prev = f"s{i}"
    return f"with {', '.join(ctes)} " + " union all ".join(f"select graph_id, {n}::bigint as node, x{n} as state from {prev}" for n in case.structure.nodes)


@query(sim_sql(SIM, 5))
def ghmm_sample_states(spark, d):
    """Ancestral simulation from the prior, node by node in order of levels, all graphs at once."""
    from stemma.operators.chain import draw, ln

    df = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("graph_id"))
    for n in local_order(SIM):
        ps = SIM.structure.parents.get(n, ())
        source = SIM.model.cpt[(*(SIM.groups[v] for v in ps), SIM.groups[n])] if ps else SIM.model.prior[SIM.groups[n]]
        weights = [F.coalesce(*[F.when(cond(ps, states), F.lit(ln(p_row[k]))) for states, p_row in rows_of(source, len(ps))]) for k in range(SIM.k(n))]
        df = df.withColumn(var(n), draw(weights, uniform(F.lit(5), F.col("graph_id"), F.lit(n))).cast("long"))
    cells = F.array(*[F.struct(F.lit(n).cast("long").alias("node"), F.col(var(n)).alias("state")) for n in SIM.structure.nodes])
    return df.select("graph_id", F.explode(cells).alias("c")).select("graph_id", "c.*")


def rows_of(source, depth: int):
    """(parent states, distribution) of a nested table."""
    if depth == 0:
        return [((), source)]
    return [((i, *s), p) for i, t in enumerate(source) for s, p in rows_of(t, depth - 1)]


def cond(ps, states):
    out = F.lit(True)
    for p, s in zip(ps, states, strict=True):
        out = out & (F.col(var(p)) == s)
    return out


@query()
def ghmm_gibbs_chain(spark, d):
    """Root probabilities over a short Gibbs chain of parameters."""
    prior = learning.each(LEARN.model, lambda row_: [1.0] * len(row_))
    draws = learning.fit_gibbs(LEARN.packed(spark, d), LEARN.model, prior, burn_in=1, keep=3, seed=1)
    return spark.createDataFrame([(i, k, round(p, 6)) for i, m in enumerate(draws) for k, p in enumerate(m.prior[0])], "draw long, state long, p double")


@query()
def neural_emission_fit(spark, d):
    """log P(Y) while the weights of a recogniser are fitted by its analytic gradient."""
    case = SIM
    e, n, obs, _ = case.frames(spark, d)
    feats = obs.groupBy("graph_id", "node").agg(F.array(*[F.avg((F.col("y") == k).cast("double")) for k in range(D_OBS)]).alias("features"))
    packed = corpus.pack(e, obs, n, None, features=feats)
    net = learning.Recogniser(D_OBS, 2, hidden=4, seed=1)
    trace = learning.fit_neural(packed, case.model, net, rounds=4, rate=0.05)
    return spark.createDataFrame([(i, round(z, 5)) for i, z in enumerate(trace)], "iteration long, logp double")

