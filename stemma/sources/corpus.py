"""Example hypergraphs and the constructors that turn them, and the driver's tables, into model inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions.special import uniform, uniform_floor

# Example hypergraphs, parents>children of each hyperedge.
ACYCLIC = {
    "graph1": "0,1>2",
    "graph2": "0,1>4 ; 2,3>5 ; 4,5>6,7",
    "graph3": "0,1>3 ; 1,2>4",
    "graph4": "0,1,2>4,5 ; 2,3>6",
    "graph5": "0,1>6,7 ; 2>8 ; 3,4,5>9,10,11 ; 7,8>12 ; 6,9>13 ; 15,16>17 ; 13,17>14",
    "graph6": "0>1",
    "graph7": "0,1>2 ; 2>3 ; 3>4",
    "graph8": "0>1 ; 1>2 ; 2>3 ; 3>4 ; 4>5 ; 5>6 ; 6>7 ; 7>8 ; 8>9 ; 9>10 ; 10>11 ; 11>12 ; 12>13 ; 13>14 ; 14>15",
}
# Example hypergraphs with undirected cycles, and a feedback set of each.
CYCLIC = {
    "cycleGraph1": ("0,1>2,3 ; 2,3>4", (2,)),
    "cycleGraph2": ("0,1>3 ; 1,2>4 ; 2,3,4>5,6", (2, 4)),
    "cycleGraph3": ("0,1>2,3,9 ; 2,3>4 ; 1,2,3,8>5,6 ; 1,2,4,5,6,9>7,10", (1, 2, 3, 4, 6)),
    "cycleGraph7": ("0>1,2 ; 1,2>3", (2,)),
    "cycleGraph8": ("0>1,2 ; 1,2>3", (2,)),
    "cycleGraph9": ("7,8>0 ; 0,1>3 ; 1,2>4 ; 2,3,4>5,6", (2, 4)),
    "cycleGraph10": ("0>1,2 ; 1,2>3 ; 3>4,5 ; 4,5>6", (1, 4)),
    "cycleGraph11": ("0>1 ; 1,2>3,4,5 ; 3,4>6 ; 6>7 ; 5,6>8", (3, 5)),
    "cycleGraph12": ("0,1,2>6,7 ; 3>8 ; 4,5>9 ; 5,6>10 ; 6>11 ; 7,8>12 ; 11>13 ; 11,12>14 ; 9,10,11>15 ; 13,14>16 ; 8,14>17 ; 15,16,17>18,19,20", (5, 6, 11, 14)),
    "cycleGraph13": ("0,1>3 ; 1,2>4 ; 3>5 ; 4>7 ; 5,6>8 ; 6,7>9", (6,)),
    "cycleGraph14": ("0>1,2 ; 1>3 ; 2>4 ; 3,4>5", (1,)),
    "cycleGraph15": ("0>1,2 ; 1>3,4 ; 2>5 ; 3>6 ; 4,6>7 ; 4,5>8", (4,)),
    "cycleGraph16": ("0>2,3 ; 1>4,5 ; 2,3>6 ; 4,5>7 ; 6,7>8 ; 2,8>9 ; 5,8>10", (3, 4, 6, 7)),
}
# Directed cycles, which are refused.
REFUSED = {"cycleGraph4": "0>1 ; 1>0", "cycleGraph5": "0>1 ; 1>2 ; 2>0", "cycleGraph6": "0,1>2 ; 2,3>0"}

ALL = {**ACYCLIC, **{k: v for k, (v, _) in CYCLIC.items()}}


def incidence(text: str) -> list[tuple[int, str, int, int]]:
    """(edge, role, node, ord) rows of a graph in the notation above."""
    rows = []
    for e, part in enumerate(text.split(";")):
        for role, side in zip("pc", part.split(">"), strict=True):
            rows += [(e, role, int(n), i) for i, n in enumerate(side.split(","))]
    return rows


def edge_table(spark: SparkSession, graphs: dict[int, str]) -> DataFrame:
    """edges(graph_id, edge, role, node, ord) of named graphs."""
    rows = [(g, *r) for g, text in graphs.items() for r in incidence(text)]
    return spark.createDataFrame(rows, "graph_id long, edge long, role string, node long, ord long")


def corpus_edges(spark: SparkSession) -> DataFrame:
    """The whole corpus; graph_id is the place in the list of names."""
    return edge_table(spark, dict(enumerate(ALL.values())))


def edges_sql(graphs: dict[int, str]) -> str:
    """The same table as DuckDB VALUES."""
    rows = ", ".join(str((g, *r)) for g, text in graphs.items() for r in incidence(text))
    return f"(select graph_id::bigint as graph_id, edge::bigint as edge, role, node::bigint as node, ord::bigint as ord from (values {rows}) t(graph_id, edge, role, node, ord))"


def replicate(rows_of: DataFrame, text: str, key: str = "n_nationkey") -> DataFrame:
    """One copy of a graph for each row of a table: graph_id is the row's key."""
    rows = F.array(*[F.struct(F.lit(e).cast("long").alias("edge"), F.lit(r).alias("role"), F.lit(n).cast("long").alias("node"), F.lit(o).cast("long").alias("ord")) for e, r, n, o in incidence(text)])
    return rows_of.select(F.col(key).cast("long").alias("graph_id"), F.explode(rows).alias("r")).select("graph_id", "r.*")


def copies(rows_of: DataFrame, key: str = "n_nationkey") -> DataFrame:
    """graph_id of those copies, each once, partitioned by it.

    Only the keys are shuffled.  The number of partitions is stated, because the keys are small but the work on them isn't.
    """
    graphs = rows_of.select(F.col(key).cast("long").alias("graph_id"))
    return graphs.repartition(int(rows_of.sparkSession.conf.get("spark.sql.shuffle.partitions")), "graph_id").distinct()


def observations(nodes: DataFrame, m: int, d_obs: int, missing: float = 0.0) -> DataFrame:
    """obs(graph_id, node, m, y): measurements fixed by a hash of (graph, node, measurement); some nodes have none."""
    rows = nodes.withColumn("m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    obs = rows.select("graph_id", "node", "m", uniform_floor(d_obs, F.lit("obs"), F.col("graph_id"), F.col("node"), F.col("m")).alias("y"))
    return obs.filter(uniform(F.lit("seen"), F.col("graph_id"), F.col("node")) >= missing) if missing > 0 else obs


def pack(edges: DataFrame, obs: DataFrame, grp: DataFrame | None = None, allowed: DataFrame | None = None, **more: DataFrame) -> DataFrame:
    """One row per graph with everything about it in arrays, keyed by graph_id.

    Each input is gathered by graph_id on its own, so the joins reuse that partitioning.  The number of
    partitions is stated, because the rows are small but the work on them isn't.
    """
    from functools import reduce

    edges = edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "graph_id")

    listed = lambda df, name, *cols: df.groupBy("graph_id").agg(F.collect_list(F.struct(*cols)).alias(name))
    nodes = grp if grp is not None else edges.select("graph_id", "node").distinct().withColumn("grp", F.lit(0).cast("long"))
    parts = [listed(edges, "edges", "edge", "role", "node", "ord"), listed(nodes, "nodes", "node", "grp"), listed(obs, "obs", "node", "m", "y")]
    if allowed is not None:
        parts.append(listed(allowed, "allowed", "node", "state"))
    parts += [listed(df, name, *[c for c in df.columns if c != "graph_id"]) for name, df in more.items()]
    return reduce(lambda a, b: a.join(b, "graph_id", "left"), parts)
