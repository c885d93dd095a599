"""Metrics, folds and resampling as plain aggregates; sampling is fixed by hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.special import uniform


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def soft_confusion(df: DataFrame, truth: str, probability: dict[str, Column]) -> DataFrame:
    """truth, guess, mass: summed probabilities of each class."""
    cells = F.array(*[F.struct(F.lit(k).alias("guess"), p.alias("p")) for k, p in probability.items()])
    return df.select(F.col(truth).alias("truth"), F.explode(cells).alias("c")).groupBy("truth", F.col("c.guess").alias("guess")).agg(F.sum("c.p").alias("mass"))


def agreement(c: DataFrame) -> DataFrame:
    """n, accuracy and Cohen's kappa from a confusion table (a few rows)."""
    n = c.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)).alias("same"))
    rows = c.groupBy(F.col("truth").alias("k")).agg(F.sum("n").alias("r"))
    cols = c.groupBy(F.col("guess").alias("k")).agg(F.sum("n").alias("c"))
    chance = rows.join(cols, "k").agg(F.coalesce(F.sum(F.col("r") * F.col("c")), F.lit(0)).alias("rc"))
    both = n.crossJoin(chance)
    po, pe = F.col("same") / F.col("n"), F.col("rc") / (F.col("n") * F.col("n"))
    return both.select("n", po.alias("accuracy"), ((po - pe) / (1 - pe)).alias("kappa"))


def class_accuracy(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth")).agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy"))


def bands(df: DataFrame, confidence: Column, right: Column) -> DataFrame:
    """band (sure over 0.8, leaning over 0.5, open), right, n."""
    band = F.when(confidence > 0.8, "sure").when(confidence > 0.5, "leaning").otherwise("open")
    return df.groupBy(band.alias("band"), right.cast("long").alias("is_right")).agg(F.count("*").alias("n"))


def folds(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    return df.withColumn("fold", F.floor(uniform(F.lit("fold"), F.col(key)) * k).cast("long"))


def upsample(df: DataFrame, label: str, key: str) -> DataFrame:
    """Rows repeated so that every class comes near the largest: each row floor(most / n) times, some once more by hash."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    sized = counts.crossJoin(counts.agg(F.max("_n").alias("_most")))
    joined = df.join(sized, label)
    ratio = F.col("_most") / F.col("_n")
    copies = F.floor(ratio) + (uniform(F.lit("up"), F.col(key)) < ratio - F.floor(ratio)).cast("long")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies.cast("long")))).drop("_n", "_most")


def compare_models(logz: DataFrame, by: list[str], hypothesis: str) -> DataFrame:
    """Mean over draws of P(Y | draw), normalised across hypotheses: by.., hypothesis, p, is_best (ties: first by name)."""
    from pyspark.sql import Window

    from stemma.functions.special import lse_agg

    mean = logz.groupBy(*by, hypothesis).agg((lse_agg("logz") - F.ln(F.count("*"))).alias("w"))
    w = Window.partitionBy(*by)
    top = mean.withColumn("_m", F.max("w").over(w))
    p = top.withColumn("p", F.exp(F.col("w") - F.col("_m")) / F.sum(F.exp(F.col("w") - F.col("_m"))).over(w))
    rank = F.row_number().over(w.orderBy(F.desc("w"), F.asc(hypothesis)))
    return p.withColumn("is_best", (rank == 1).cast("long")).select(*by, hypothesis, "p", "is_best")


def generate_pedigree(n_generations: int, kids: int, seed: int, graph: Column) -> Column:
    """array<struct<edge, role, node, ord>>: couples of founders and children, numbered as they come.

    Each generation's first child marries a founder and has between one and ``kids`` children by a hash.
    """
    edges, node, parent = [], 2, 0
    for e in range(n_generations):
        mate = 1 if e == 0 else node
        node += 0 if e == 0 else 1
        rows = [F.struct(F.lit(e).cast("long").alias("edge"), F.lit("p").alias("role"), F.lit(x).cast("long").alias("node"), F.lit(i).cast("long").alias("ord")) for i, x in enumerate((parent, mate))]
        born = [F.struct(F.lit(e).cast("long").alias("edge"), F.lit("c").alias("role"), F.lit(node + i).cast("long").alias("node"), F.lit(i).cast("long").alias("ord")) for i in range(kids)]
        number = (1 + F.floor(uniform(F.lit(seed), graph, F.lit(e)) * kids)).cast("int")
        edges.append(F.concat(F.array(*rows), F.slice(F.array(*born), F.lit(1), number)))
        parent, node = node, node + kids
    return F.concat(*edges)
