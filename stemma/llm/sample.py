"""Bounded samples of labelled rows: exact, and the same for any order or partitioning of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm.common import staged

#: The hash that orders the ids of a class, and how many times the wanted ids are looked at.
RANGE, MARGIN = 1 << 30, 4
#: Slices of the hash below the cut, whose sizes come to the driver for each class.
SLICES = 256


def counted(marks: DataFrame) -> dict:
    """Rows of each class y; the classes are assumed to be few (labels, languages)."""
    return {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}


def drawn(marks: DataFrame, counts: dict, most: dict, seed: str, exclusive: bool = False) -> DataFrame:
    """y, i: of each class y the ``most[y]`` distinct ids i that come first by a hash of the id, then by the id; written.

    marks: y and i, not null.  Only ids below a cut of the hash are shuffled and ranked; where a class
    gets too few of them by that, its cut is raised until it has enough, or all.  ``exclusive``: ids
    found in two classes are left out.
    """
    place = F.pmod(F.xxhash64(F.lit(seed), "i"), F.lit(RANGE))
    marks = marks.select("y", "i", place.alias("place"))
    cuts = {y: min(1.0, MARGIN * most[y] / n) for y, n in counts.items()}
    of = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("y"))
    while True:
        if exclusive:
            cuts = dict.fromkeys(cuts, max(cuts.values()))
        below = {y: max(1, int(c * RANGE)) for y, c in cuts.items()}
        near = marks.filter(F.col("place") < of(below))
        if exclusive:
            near = near.groupBy("i", "place").agg(F.min("y").alias("y"), F.max("y").alias("_other")).filter(F.col("y") == F.col("_other")).select("y", "i", "place")
        else:
            near = near.distinct()
        near = staged(near.withColumn("slice", F.floor(F.col("place") * SLICES / of(below))), "near")
        sizes: dict = {y: {} for y in counts}
        for r in near.groupBy("y", "slice").count().collect():
            sizes[r["y"]][r["slice"]] = r["count"]
        short = {y for y, c in cuts.items() if c < 1 and sum(sizes[y].values()) < most[y]}
        if not short:
            break
        cuts = {y: min(1.0, 16 * c) if y in short else c for y, c in cuts.items()}
    # whole slices of the hash, and the first of the slice in which the sample ends
    last, left = {}, {}
    for y, own in sizes.items():
        last[y], left[y] = SLICES, most[y]
        for k in sorted(own):
            if own[k] > left[y]:
                last[y] = k
                break
            left[y] -= own[k]
    whole = near.filter(F.col("slice") < of(last)).select("y", "i")
    rank = F.row_number().over(Window.partitionBy("y").orderBy("place", "i"))
    rest = near.filter(F.col("slice") == of(last)).withColumn("_rank", rank).filter(F.col("_rank") <= of(left)).select("y", "i")
    return staged(whole.unionByName(rest), "drawn")


def with_texts(ids: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """The drawn ids with one text t each, from rows of ``on`` and t: of an id's texts that with the smallest hash.  Written."""
    least = F.min(F.struct(F.xxhash64("t").alias("h"), F.col("t"))).alias("x")
    return staged(rows.filter(F.col("t").isNotNull()).join(F.broadcast(ids), on).groupBy("y", "i").agg(least).select("y", "i", "x.t"), "sample")
