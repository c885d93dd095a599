"""Links between texts whose word-shingle sets have a Jaccard similarity of 0.8 or more.

A SimHash of 64 bits tells near-identical texts apart within two or three bits, but at a similarity of
0.8 two fingerprints differ in about ten bits, where a trie can no longer prune.  So the deduplication
stage completes the SimHash classes with these links.  A text's sketch holds 256 minhashes; bands of
four make bucket keys, and two texts of one bucket are candidates if enough of their minhashes agree.
Candidates only gather texts to clusters: within a cluster the shingle sets themselves are compared, all
pairs of them, so that a link never rests on an estimate.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import bounded, map_rows, staged
from stemma.operators.components import components

HASHES, ROWS, BANDS = 256, 4, 24
#: Of 256 minhashes so many agree in candidates: at a similarity of 0.8 fewer do in one pair of ten million, and no band does in three of a million.
LEAST = 0.66
#: A sketch row has the bands' minhashes in whole, then the low bytes of all of them, which are enough for the candidates.
BANDED = 2 * ROWS * BANDS
#: Members of a bucket that one task compares, all pairs at worst; all of a larger bucket are candidates, for the comparison of the sets to tell apart.
HOT_BUCKET = 4_096
#: Bytes of shingle hashes of a cluster that one task compares; a larger cluster is dealt to several tasks by pairs of parts.
PART_BYTES = 1 << 24
#: Bytes of a large cluster's row without its head, for the check of what is broadcast.
ROOT_BYTES = 64

_rng = np.random.default_rng(20_240_501)
MUL = (_rng.integers(0, 2**31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """64-bit hashes of the shingles, with repeats.  Words as in the SimHash; a text of fewer words is one shingle."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) > width else [b" ".join(words)]
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(7)), np.uint64, max(1, len(words) - width + 1))


def minhashes(text: str | None, width: int = 5) -> np.ndarray:
    """256 numbers of 16 bits."""
    h = shingle_hashes(text, width)
    h = (h >> np.uint64(32)).astype(np.uint32) ^ h.astype(np.uint32)
    least = np.empty(HASHES, np.uint32)
    for at in range(0, HASHES, 16):
        best = None
        for part in range(0, len(h), 1 << 14):
            m = (h[part : part + (1 << 14), None] * MUL[at : at + 16] + ADD[at : at + 16]).min(axis=0)
            best = m if best is None else np.minimum(best, m)
        least[at : at + 16] = best
    return (least * np.uint32(2_654_435_761) >> np.uint32(16)).astype(np.uint16)


def sketch(text: str | None, width: int = 5) -> bytes:
    m = minhashes(text, width).astype("<u2")
    return m[: ROWS * BANDS].tobytes() + m.astype(np.uint8).tobytes()


def linked(sketches: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (positions) that agree in ``LEAST`` of their minhashes: breadth first over what is not reached yet."""
    need, out = int(np.ceil(LEAST * HASHES)), []
    left = np.arange(len(sketches))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.zeros(len(left), bool)
            for at in range(0, len(left), 1 << 14):
                near[at : at + (1 << 14)] = (sketches[left[at : at + (1 << 14)]] == sketches[x]).sum(axis=1) >= need
            found = left[near].tolist()
            out += [(x, y) for y in found]
            queue += found
            left = left[~near]
    return out


def similar(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (positions) of sets with a Jaccard similarity of 4/5 or more, in whole numbers."""
    sizes = np.array([len(s) for s in sets])
    begin = np.r_[0, np.cumsum(sizes)]
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    flat, out = flat.astype(np.int32), []
    rest, left = flat, np.arange(len(sets))
    mark = np.zeros(len(words), bool)

    def keep(which: np.ndarray):
        return rest[np.repeat(which, sizes[left])], left[which]

    while len(left) > 1:
        queue = [int(left[0])]
        rest, left = keep(np.arange(len(left)) > 0)
        while queue and len(left):
            x = queue.pop()
            own = flat[begin[x] : begin[x + 1]]
            mark[own] = True
            both = np.add.reduceat(mark[rest], np.r_[0, np.cumsum(sizes[left])[:-1]], dtype=np.int64)
            mark[own] = False
            near = 9 * both >= 4 * (sizes[left] + sizes[x])
            if near.any():
                found = left[near].tolist()
                out += [(x, y) for y in found]
                queue += found
                rest, left = keep(~near)
    return out


def by_key(rows: DataFrame, read, link, schema: str) -> DataFrame:
    """Links among the rows (key, id, data) of each key, found by ``link`` from the list of what ``read`` makes of their data."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "key").sortWithinPartitions("key")

    def make():
        held: list = []
        at = [None]

        def close():
            if len(held) > 1:
                for i, j in link([read(x) for _, x in held]):
                    yield min(held[i][0], held[j][0]), max(held[i][0], held[j][0])
            held.clear()

        def work(columns):
            for key, i, data in zip(*columns, strict=True):
                if key != at[0]:
                    yield from close()
                    at[0] = key
                held.append((i, bytes(data)))

        work.finish = close
        return work

    return map_rows(dealt, make, schema)


def candidates(sketches: DataFrame) -> DataFrame:
    """u, v (longs): links of texts (tid, sketch) that share a band and ``LEAST`` of their minhashes."""
    band = lambda b: F.xxhash64(F.lit(b), F.substring("sketch", 2 * ROWS * b + 1, 2 * ROWS))
    keys = staged(sketches.select("tid", F.explode(F.array(*map(band, range(BANDS)))).alias("key")), "bands")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("tid").alias("least")).filter("n > 1")
    members = keys.join(sizes, "key")
    dealt = members.filter(F.col("n") <= HOT_BUCKET).join(sketches, "tid").select("key", "tid", F.substring("sketch", BANDED + 1, HASHES).alias("low"))
    hot = members.filter(F.col("n") > HOT_BUCKET).select(F.col("tid").alias("u"), F.col("least").alias("v")).filter("u != v")
    return by_key(dealt, lambda x: np.frombuffer(x, np.uint8), lambda rows: linked(np.stack(rows)), "u long, v long").unionByName(hot)


def shingle_sets(members: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """root, tid, fp, grams (the sorted set of 64-bit shingle hashes) of the members (tid, fp, root), one row each."""
    # copies of a text meet before they are shuffled
    own = texts.groupBy("tid").agg(F.first("text").alias("text")).join(members, "tid")
    make = lambda: lambda columns: [(r, i, f, np.unique(shingle_hashes(t, width)).tobytes()) for r, i, f, t in zip(*columns, strict=True)]
    return map_rows(own.select("root", "tid", "fp", "text"), make, "root long, tid long, fp long, grams binary")


def sketch_links(sketches: DataFrame, texts: DataFrame, width: int = 5) -> DataFrame:
    """u, v (fingerprints, longs) of texts at a similarity of 0.8 or more.

    sketches: tid (a text's hash, distinct), fp, sketch; texts: tid, text, repeats do no harm.
    """
    near = components(candidates(sketches))
    members = sketches.select("tid", "fp").join(near, F.col("tid") == F.col("node")).select("tid", "fp", "root")
    sets = staged(shingle_sets(members, texts, width), "sets")
    # sizes first: only the sets of large clusters are looked at for a head
    large = staged(sets.groupBy("root").agg(F.sum(F.length("grams")).alias("size")).filter(F.col("size") > PART_BYTES).select("root"), "large")
    n = large.count()
    if not n:
        return compared(sets.select(F.col("root").alias("key"), F.col("fp").alias("id"), "grams"))
    large = bounded(large, n * ROOT_BYTES)
    small = sets.join(large, "root", "left_anti").select(F.col("root").alias("key"), F.col("fp").alias("id"), "grams")
    heads = staged(sets.join(large, "root").groupBy("root").agg(F.min_by("grams", "tid").alias("head"), F.min_by("fp", "tid").alias("head_fp")), "heads")
    size = heads.agg(F.sum(F.length("head") + ROOT_BYTES)).first()[0]
    grid, stars = dealt_by_pairs(sets.join(bounded(heads, size), "root"), n)
    return compared(small.unionByName(grid)).unionByName(stars)


def compared(cells: DataFrame) -> DataFrame:
    return by_key(cells, lambda x: np.frombuffer(x, np.uint64), similar, "u long, v long")


def dealt_by_pairs(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Cells (key, id, grams) of large clusters in which every two texts meet that may still have to be linked, and the links to heads.

    rows: root, tid, fp, grams and the cluster's head, head_fp, of ``n`` clusters.  Texts at 0.8 from the head are linked to it
    and need not meet each other; every part of the others meets every part of all.
    """

    def make():
        def work(columns):
            for r, i, f, g, h, hf in zip(*columns, strict=True):
                a, b = np.frombuffer(g, np.uint64), np.frombuffer(h, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                yield r, i, f, hf, 9 * both >= 4 * (len(a) + len(b)), g

        return work

    rows = staged(map_rows(rows.select("root", "tid", "fp", "grams", "head", "head_fp"), make, "root long, tid long, fp long, head_fp long, held boolean, grams binary"), "held")
    bytes_of = lambda held: F.coalesce(F.sum(F.when(F.col("held") == held, F.length("grams"))), F.lit(0))
    parts = rows.groupBy("root").agg(*[F.ceil(bytes_of(held) / PART_BYTES).cast("int").alias(n) for n, held in (("apart", False), ("near", True))])
    rows = rows.join(bounded(parts, n * ROOT_BYTES), "root")
    own = F.pmod(F.xxhash64(F.lit(1), "tid"), F.when(F.col("held"), F.col("near")).otherwise(F.col("apart"))).cast("int")
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda kind, a, b: F.xxhash64(F.lit(kind), "root", a, b)
    others = F.concat(F.transform(upto("apart"), lambda k: cell(0, F.least(k, F.col("own")), F.greatest(k, F.col("own")))), F.transform(upto("near"), lambda k: cell(1, F.col("own"), k)))
    heads = F.transform(upto("apart"), lambda k: cell(1, k, F.col("own")))
    grid = rows.withColumn("own", own).select(F.explode(F.when(F.col("held"), heads).otherwise(others)).alias("key"), F.col("fp").alias("id"), "grams")
    stars = rows.filter("held").select(F.least("fp", "head_fp").alias("u"), F.greatest("fp", "head_fp").alias("v"))
    return grid, stars
