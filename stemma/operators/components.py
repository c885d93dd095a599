"""Connected components of a link table, by alternating large and small stars over DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.sources.scratch import staged


def star(edges: DataFrame, large: bool, by: list[str]) -> DataFrame:
    """Links each node's neighbours to the smallest id around it.

    large: the neighbours above the node, over links in both directions; small: the node's lower
    neighbours and itself.  The minimum is aggregated before the shuffle and then joined back; in the large
    star, where a node may have very many links, from a table, so that adaptive execution may split its
    partition.
    """
    if large:
        both = edges.union(edges.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        near = F.least("u", F.min("v"))
    else:
        both = edges.select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        near = F.min("v")
    least = both.groupBy(*by, "u").agg(near.alias("m"))
    if large:
        least = staged(least, "least")
    joined = both.join(least, [*by, "u"])
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(*by, F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(*by, "u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, by: Iterable[str] = (), rounds: int = 50) -> DataFrame:
    """by.., node, root for every node of ``edges`` (by.., u, v long, not null); root is the component's smallest node.

    ``by`` names columns that set nodes apart, such as a graph's id.  Each round is written to the shared
    folder; the number of rounds grows with the logarithm of the longest path.  No edges: no rows.
    """
    by = list(by)
    now = staged(edges.select(*by, "u", "v").filter(F.col("u") != F.col("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        now = staged(star(star(now, True, by), False, by), "star")
        # a fixed point is a set of stars; the sums tell whether the set has changed
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64(*by, "u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(*by, F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(*by, F.col("v").alias("node"), F.col("v").alias("root")).distinct())
