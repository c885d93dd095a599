"""Hypergraph navigation: joins over the incidence table edges(graph_id, edge, role, node, ord).

role is 'p' (parent) or 'c' (child); ord is the position within the hyperedge.  A node has at most one
hyperedge above it (its parents') and any number below.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.operators.components import components as linked
from stemma.sources.scratch import staged

KEY = ["graph_id", "edge"]
#: Rows of the incidence table of a graph that one task walks.
TASK_ROWS = 1_000_000


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", "node").distinct()


def members(edges: DataFrame, role: str) -> DataFrame:
    return edges.filter(F.col("role") == role)


def roots(edges: DataFrame) -> DataFrame:
    return nodes(edges).join(members(edges, "c"), ["graph_id", "node"], "left_anti")


def leaves(edges: DataFrame) -> DataFrame:
    return nodes(edges).join(members(edges, "p"), ["graph_id", "node"], "left_anti")


def up_edges(edges: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    out = members(edges, "c").select("graph_id", "node", "edge")
    return out.join(skip, KEY, "left_anti") if skip is not None else out


def down_edges(edges: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    out = members(edges, "p").select("graph_id", "node", "edge")
    return out.join(skip, KEY, "left_anti") if skip is not None else out


def related(edges: DataFrame, own: str, other: str) -> DataFrame:
    """(graph_id, edge, node, other, ord): pairs of a node in role ``own`` and another in role ``other`` of one hyperedge."""
    a = members(edges, own).select(*KEY, "node")
    b = members(edges, other).select(*KEY, F.col("node").alias("other"), F.col("ord"))
    return a.join(b, KEY).filter(F.col("node") != F.col("other")).select("graph_id", "edge", "node", "other", "ord")


def parents(edges: DataFrame) -> DataFrame:
    return related(edges, "c", "p")


def children(edges: DataFrame) -> DataFrame:
    return related(edges, "p", "c")


def siblings(edges: DataFrame) -> DataFrame:
    return related(edges, "c", "c")


def mates(edges: DataFrame) -> DataFrame:
    return related(edges, "p", "p")


def relation_counts(edges: DataFrame) -> DataFrame:
    """graph_id, node, n_parents, n_children, n_siblings, n_mates (distinct nodes)."""
    out = nodes(edges)
    for name, rel in (("n_parents", parents), ("n_children", children), ("n_siblings", siblings), ("n_mates", mates)):
        c = rel(edges).groupBy("graph_id", "node").agg(F.count_distinct("other").alias(name))
        out = out.join(c, ["graph_id", "node"], "left")
    return out.na.fill(0)


def parameter_shapes(edges: DataFrame) -> DataFrame:
    """The numbers of parents for which transition tables are needed, with how many hyperedges use each."""
    per = edges.groupBy(*KEY).agg(F.sum((F.col("role") == "p").cast("long")).alias("n_parents"))
    return per.groupBy("n_parents").agg(F.count("*").alias("n_edges"))


def pairs(edges: DataFrame) -> DataFrame:
    """(graph_id, parent, child)."""
    return parents(edges).select("graph_id", F.col("other").alias("parent"), F.col("node").alias("child"))


def by_size(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Graphs that a task may hold, and the larger ones (None: there are none)."""
    large = edges.groupBy("graph_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > TASK_ROWS).select("graph_id")
    if large.isEmpty():
        return edges, None
    large = staged(large, "large")
    return edges.join(large, "graph_id", "left_anti"), edges.join(large, "graph_id", "left_semi")


def levels(edges: DataFrame, forward: bool = True) -> DataFrame:
    """graph_id, node, level: the longest path from a root (or to a leaf).

    A node's work can start once all nodes of lower levels are done.  Graphs of up to ``TASK_ROWS`` rows
    are walked by one task each, larger ones by a frontier over tables, one job a level.  Directed cycles raise.
    """
    small, large = by_size(edges)
    done = walked(small, nodes(small).withColumn("marked", F.lit(False)), forward).select("graph_id", "node", "level")
    if large is None:
        return done
    step = staged(steps(large, forward).distinct(), "steps")
    now, seen = staged((roots if forward else leaves)(large).withColumn("level", F.lit(0).cast("long")), "frontier"), []
    most = nodes(large).count()
    while not now.isEmpty():
        if len(seen) > most:
            raise ValueError("directed cycle")
        seen.append(now)
        after = now.join(step, (step["graph_id"] == now["graph_id"]) & (step["a"] == now["node"])).select(step["graph_id"], F.col("b").alias("node"), (F.col("level") + 1).alias("level"))
        now = staged(after.distinct(), "frontier")
    reached = reduce(DataFrame.unionByName, seen, done.limit(0)).groupBy("graph_id", "node").agg(F.max("level").alias("level"))
    return done.unionByName(reached)


def steps(edges: DataFrame, forward: bool) -> DataFrame:
    """(graph_id, a, b): a comes before b; a pair once for each hyperedge."""
    ab = ("parent", "child") if forward else ("child", "parent")
    return pairs(edges).select("graph_id", F.col(ab[0]).alias("a"), F.col(ab[1]).alias("b"))


def walked(edges: DataFrame, marked: DataFrame, forward: bool) -> DataFrame:
    """graph_id, node, level, n (marked nodes before it, by paths), a graph in a task.  marked: graph_id, node, marked for every node."""
    from stemma.operators.local import walk_rows

    own = marked.select("graph_id", F.col("node").alias("a"), F.col("node").alias("b"), "marked")
    rows = steps(edges, forward).withColumn("marked", F.lit(False)).unionByName(own)
    return rows.groupBy("graph_id").applyInPandas(walk_rows, "graph_id long, node long, level long, n long")


def path_counts(edges: DataFrame, marked: DataFrame, above: bool) -> DataFrame:
    """graph_id, node, n: marked ancestors (or descendants), one reached over two paths counting twice.

    marked: graph_id, node.  Counts are sums over the neighbours' counts, never over paths; above 2^63 they raise.
    """
    flags = nodes(edges).join(marked.select("graph_id", "node").distinct().withColumn("marked", F.lit(True)), ["graph_id", "node"], "left").na.fill(False, ["marked"])
    small, large = by_size(edges)
    done = walked(small, flags.join(nodes(small), ["graph_id", "node"], "left_semi"), above).select("graph_id", "node", "n")
    if large is None:
        return done
    step = staged(steps(large, above).groupBy("graph_id", "a", "b").agg(F.count("*").alias("k")), "steps")
    at = staged(levels(large, above).join(flags, ["graph_id", "node"]), "levels")
    found = staged(at.filter("level = 0").select("graph_id", "node", "marked", F.lit(0).cast("long").alias("n")), "counts")
    for level in range(1, (at.agg(F.max("level")).first()[0] or 0) + 1):
        own = at.filter(F.col("level") == level)
        into = own.join(step, (step["graph_id"] == own["graph_id"]) & (step["b"] == own["node"])).select(own["graph_id"], "node", own["marked"], "a", "k")
        before = found.select("graph_id", F.col("node").alias("a"), (F.col("marked").cast("long") + F.col("n")).alias("m"))
        summed = into.join(before, ["graph_id", "a"]).groupBy("graph_id", "node", "marked").agg(F.sum(F.col("m") * F.col("k")).alias("n"))
        found = found.unionByName(staged(summed, "counts"))
    return done.unionByName(found.select("graph_id", "node", "n"))


def select_root(edges: DataFrame, affected: DataFrame) -> DataFrame:
    """graph_id, node: the affected root with most affected below, then fewest unaffected, then the lowest."""
    from pyspark.sql import Window

    others = nodes(edges).join(affected, ["graph_id", "node"], "left_anti")
    a = path_counts(edges, affected, False).withColumnRenamed("n", "n_aff")
    u = path_counts(edges, others, False).withColumnRenamed("n", "n_unaff")
    ranked = roots(edges).join(affected, ["graph_id", "node"], "left_semi").join(a, ["graph_id", "node"]).join(u, ["graph_id", "node"])
    w = Window.partitionBy("graph_id").orderBy(F.desc("n_aff"), F.asc("n_unaff"), F.asc("node"))
    return ranked.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def message_schedule(edges: DataFrame, cut: DataFrame | None = None) -> DataFrame:
    """graph_id, kind ('u' or 'v'), node, edge (-1 for u), level: the round in which each message is ready.

    u(n) needs its parents' u and their v over other hyperedges, and the v of its siblings; v(n, e) needs the mates' u and
    other v, and the v of e's children.  Roots and leaves are ready at once.  Rounds are computed by a
    driver loop over levels; nodes in ``cut`` (a feedback set) send nothing.
    """
    from stemma.operators.local import schedule_rows

    arrow = edges if cut is None else edges.join(cut.select("graph_id", "node"), ["graph_id", "node"], "left_anti")
    return arrow.groupBy("graph_id").applyInPandas(schedule_rows, "graph_id long, kind string, node long, edge long, level long")


def components(edges: DataFrame) -> DataFrame:
    """graph_id, node, component: the lowest node that can be reached; each hyperedge is a star around its lowest node."""
    together = edges.select(*KEY, "node").distinct()
    least = together.groupBy(*KEY).agg(F.min("node").alias("v"))
    links = together.join(least, KEY).select("graph_id", F.col("node").alias("u"), "v")
    return nodes(edges).join(linked(links, ["graph_id"]), ["graph_id", "node"], "left").select("graph_id", "node", F.coalesce("root", "node").alias("component"))


def defects(edges: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """graph_id, defect, n: hyperedges without parents or children, nodes (of ``named``: graph_id, node) in no hyperedge, nodes with two hyperedges above.

    A sound graph has no row.
    """
    sides = edges.groupBy(*KEY).agg(*[F.sum((F.col("role") == x).cast("long")).alias(x) for x in "pc"]).filter("p = 0 or c = 0")
    out = sides.groupBy("graph_id").agg(F.count("*").alias("n")).withColumn("defect", F.lit("edge without a side"))
    twice = members(edges, "c").groupBy("graph_id", "node").agg(F.count_distinct("edge").alias("k")).filter("k > 1").groupBy("graph_id").agg(F.count("*").alias("n")).withColumn("defect", F.lit("two edges above"))
    out = out.unionByName(twice)
    if named is not None:
        # the set difference of two node tables
        alone = named.select("graph_id", "node").exceptAll(nodes(edges)).groupBy("graph_id").agg(F.count("*").alias("n")).withColumn("defect", F.lit("isolated node"))
        out = out.unionByName(alone)
    return out.select("graph_id", "defect", "n")


def directed_cycles(edges: DataFrame) -> DataFrame:
    """graph_id of graphs with a directed cycle: what is left after taking away nodes without incoming steps, again and again."""
    from stemma.operators.local import cyclic_rows

    return edges.groupBy("graph_id").applyInPandas(cyclic_rows, "graph_id long")


def feedback_set(edges: DataFrame) -> DataFrame:
    """graph_id, node, idx: a set of nodes without which the node-hyperedge incidence graph is a forest."""
    from stemma.operators.local import feedback_rows

    return edges.groupBy("graph_id").applyInPandas(feedback_rows, "graph_id long, node long, idx long")


def feedback_is_valid(edges: DataFrame, cut: DataFrame) -> DataFrame:
    """graph_id, is_valid: a graph is a forest if incidences = nodes + hyperedges - components, over what is left."""
    left = edges.select("graph_id", "edge", "node").distinct().join(cut.select("graph_id", "node"), ["graph_id", "node"], "left_anti")
    comp = components(left.withColumn("role", F.lit("p")).withColumn("ord", F.lit(0)))
    n = left.groupBy("graph_id").agg(F.count("*").alias("incidences"), F.count_distinct("node").alias("n"), F.count_distinct("edge").alias("e"))
    c = comp.groupBy("graph_id").agg(F.count_distinct("component").alias("c"))
    return n.join(c, "graph_id").select("graph_id", (F.col("incidences") == F.col("n") + F.col("e") - F.col("c")).cast("long").alias("is_valid"))


def dot(edges: DataFrame) -> DataFrame:
    """graph_id, dot: a drawing in DOT, one box per hyperedge."""
    arc = F.when(F.col("role") == "p", F.concat(F.lit("n"), "node", F.lit(" -> e"), "edge")).otherwise(F.concat(F.lit("e"), "edge", F.lit(" -> n"), "node"))
    lines = edges.select("graph_id", arc.alias("a")).groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_list("a")), "; ").alias("a"))
    return lines.select("graph_id", F.concat(F.lit("digraph g {"), "a", F.lit("}")).alias("dot"))
