"""SimHash fingerprints of word shingles, and their near pairs by a self-join of the binary trie.

Documents with one fingerprint are one class.  Fingerprints at ``budget`` or fewer differing bits agree
in whole on one of ``budget + 1`` blocks of bits, so every fingerprint goes to that many tries, each with
another block as its topmost bits and shared only among equal blocks.  Inside a block's trie pairs of
nodes are walked down together, a pair gathers the bits in which its two paths differ, and is dropped
once they exceed the budget.  A block with very many fingerprints is dealt to several tasks by pairs of
nodes further down, the deeper the more fingerprints it has.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from stemma.llm.common import map_rows, staged
from stemma.llm.sketch import sketch, sketch_links
from stemma.operators.components import components

#: Node pairs walked at once; beyond it the walk goes part by part, so memory is bounded.
FRONTIER = 1 << 19
#: A block with more distinct fingerprints than this is dealt to several tasks; so many levels down, each for 16 times as many.
HOT_BLOCK = 1 << 15
HOT_LEVELS = (4, 8, 12)
BITS = 64


def simhash(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint; A-Z are folded, words are cut at blank, tab to carriage return."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) > width else [b" ".join(words)]
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_id(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, sketches: bool = False) -> DataFrame:
    """id, fp (the fingerprint's bits as a signed long) for every row; if asked for, its text's hash (tid) and sketch; a null text is an empty one."""

    def make():
        extra = (lambda t, h: (h, sketch(t, width))) if sketches else (lambda t: ())
        return lambda columns: [(i, signed(simhash(t, width)), *extra(t, *h)) for i, t, *h in zip(*columns, strict=True)]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col, *[text_id(text_col)] * sketches), make, f"{id_col} {kind}, fp long" + ", tid long, sketch binary" * sketches)


# ---- the trie join of one task -------------------------------------------------------------------


def walk(keys: np.ndarray, frontier: np.ndarray, depth: int, budget: int):
    """Pairs (i, j), i < j, of sorted distinct ``keys`` below the node pairs of ``frontier``.

    frontier: rows (a_lo, a_hi, b_lo, b_hi, differing bits so far), all at ``depth``; a <= b.  Yields
    arrays of pairs.  Nodes are ranges of the sorted keys, so children are found by binary search.
    """
    stack = [(frontier, depth)]
    while stack:
        f, d = stack.pop()
        if len(f) > FRONTIER:
            stack += [(part, d) for part in np.array_split(f, -(-len(f) // FRONTIER))]
            continue
        # a pair of small nodes is compared leaf by leaf; what differs above is in the keys as well
        na, nb = f[:, 1] - f[:, 0], f[:, 3] - f[:, 2]
        small = (na * nb <= 16) | (d >= BITS)
        if small.any():
            yield from leaves(keys, f[small], budget)
            f = f[~small]
        if not len(f):
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - d)
        mids = []
        for lo, hi in ((0, 1), (2, 3)):
            # the first key of the range whose bit is set; keys of a node agree above this bit
            prefix = (keys[f[:, lo]] & ~(bit | (bit - np.uint64(1)))) | bit
            mids.append(np.clip(np.searchsorted(keys, prefix), f[:, lo], f[:, hi]))
        am, bm = mids
        same = (f[:, 0] == f[:, 2]) & (f[:, 1] == f[:, 3])
        parts = []
        for al, ah, bl, bh, cost, keep in ((f[:, 0], am, f[:, 2], bm, 0, None), (am, f[:, 1], bm, f[:, 3], 0, None), (f[:, 0], am, bm, f[:, 3], 1, None), (am, f[:, 1], f[:, 2], bm, 1, ~same)):
            ok = (ah > al) & (bh > bl) & (f[:, 4] + cost <= budget)
            if keep is not None:
                ok &= keep
            parts.append(np.stack([al[ok], ah[ok], bl[ok], bh[ok], f[ok, 4] + cost], axis=1))
        stack.append((np.concatenate(parts), d + 1))


def leaves(keys: np.ndarray, f: np.ndarray, budget: int):
    sizes = (f[:, 1] - f[:, 0]) * (f[:, 3] - f[:, 2])
    for k in np.unique(sizes):
        g = f[sizes == k]
        wide = g[:, 3] - g[:, 2]
        for w in np.unique(wide):
            part = g[wide == w]
            n = np.arange(k)
            i = (part[:, :1] + n // w).ravel()
            j = (part[:, 2:3] + n % w).ravel()
            ok = i < j
            i, j = i[ok], j[ok]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            if near.any():
                yield i[near], j[near]


class Forest:
    """Union-find over positions; pairs go in as arrays, a spanning forest comes out."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if (up == x).all():
                return x
            self.parent[x] = self.parent[up]
            x = up

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.roots(i), self.roots(j)
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def trie_edges(keys: np.ndarray, depth: int, budget: int, nodes: tuple[int, int] | None = None, levels: int = 0):
    """Spanning edges (positions u < v) of the links among sorted ``keys`` that agree in their top ``depth`` bits.

    nodes: the keys below two different nodes, ``levels`` further down, of each block; only pairs
    across the two count.
    """
    top = keys >> np.uint64(BITS - depth)
    begin = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
    end = np.r_[begin[1:], len(keys)]
    if nodes is None:
        frontier = np.stack([begin, end, begin, end, np.zeros_like(begin)], axis=1)[end - begin > 1]
    else:
        second = ((keys >> np.uint64(BITS - depth - levels)) & np.uint64((1 << levels) - 1)) == np.uint64(nodes[1])
        middle = begin + np.add.reduceat(~second, begin, dtype=np.int64)
        frontier = np.stack([begin, middle, middle, end, np.full_like(begin, (nodes[0] ^ nodes[1]).bit_count())], axis=1)
        frontier = frontier[(middle > begin) & (end > middle)]
        depth += levels
    forest = Forest(len(keys))
    for i, j in walk(keys, frontier, depth, budget):
        forest.join(i, j)
    root = forest.roots(np.arange(len(keys)))
    v = np.flatnonzero(root != np.arange(len(keys)))
    return root[v], v


def blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit from the top, length) of budget + 1 blocks that cover all bits."""
    cuts = [BITS * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def listed(values: list[int]) -> Column:
    return F.array(*map(F.lit, values))


def rotated(fp: Column, by: int) -> Column:
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def links(fps: DataFrame, budget: int = 2) -> DataFrame:
    """Links u, v (signed longs) whose components are those of all pairs at ``budget`` or fewer bits.

    ``fps`` has distinct non-null fingerprints in ``fp``.  Each (block, value) group gives a spanning
    forest of its pairs, so at most budget + 1 links per fingerprint leave the tasks.
    """
    cut = blocks(budget)
    depth = min(n for _, n in cut)
    rows = fps.select(F.explode(F.array(*[F.struct(F.lit(k).alias("turn"), rotated(F.col("fp"), a).alias("key")) for k, (a, _) in enumerate(cut)])).alias("x")).select("x.*")
    rows = rows.withColumn("block", F.shiftrightunsigned("key", BITS - depth))
    sizes = rows.groupBy("turn", "block").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_BLOCK)
    rows = rows.join(sizes, ["turn", "block"], "left")
    # hot blocks: the next bits name a node; it meets each node at budget or fewer bits from it
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))

    def pairs(levels: int) -> Column:
        node = F.shiftrightunsigned(F.col("key"), BITS - depth - levels).bitwiseAND(F.lit((1 << levels) - 1)).cast("int")
        masks = [sum(1 << b for b in c) for r in range(budget + 1) for c in combinations(range(levels), r)]
        return F.transform(listed(masks), lambda m: pair(node, node.bitwiseXOR(m)))

    level, met = F.lit(0), F.array(pair(F.lit(-1), F.lit(-1)))
    for k, levels in enumerate(HOT_LEVELS):
        hot = F.coalesce(F.col("n"), F.lit(0)) > HOT_BLOCK << (4 * k)
        level, met = F.when(hot, F.lit(levels)).otherwise(level), F.when(hot, pairs(levels)).otherwise(met)
    rows = rows.select("turn", "block", "key", level.alias("level"), F.explode(met).alias("p")).select("turn", "block", "level", "key", "p.a", "p.b")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "turn", "block", "a", "b").select("turn", "level", "a", "b", "key")

    def make():
        held: list[np.ndarray] = []

        def work(columns):
            held.append(np.array(columns, dtype=np.int64))
            return ()

        def finish():
            if not held:
                return
            rows = np.concatenate(held, axis=1)
            rows = rows[:, np.lexsort((rows[4].view(np.uint64), *rows[3::-1]))]
            turns = np.flatnonzero(np.r_[True, (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)])
            for lo, hi in zip(turns.tolist(), [*turns[1:].tolist(), rows.shape[1]], strict=True):
                turn, level, x, y = rows[:4, lo].tolist()
                own = rows[4, lo:hi].view(np.uint64)
                # within a node, or a block that is not hot, all pairs count: deeper bits only say who is there
                u, v = trie_edges(own, depth, budget, None if x == y else (x, y), level)
                by = cut[turn][0]
                back = (own >> np.uint64(by)) | (own << np.uint64(BITS - by)) if by else own
                yield from zip(back[u].view(np.int64).tolist(), back[v].view(np.int64).tolist(), strict=True)

        work.finish = finish
        return work

    return map_rows(dealt, make, "u long, v long").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def classes(fps: DataFrame, budget: int = 2, more: DataFrame | None = None) -> DataFrame:
    """fp, root: every distinct fingerprint of ``fps`` and its component's smallest fingerprint; ``more`` are further links u, v."""
    distinct = staged(fps.select("fp").distinct(), "fps")
    found = links(distinct, budget)
    found = components(found.unionByName(more) if more is not None else found)
    return distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def classified(docs: DataFrame, budget: int, id_col: str, text_col: str, width: int = 3, similar: bool = False) -> tuple[DataFrame, DataFrame]:
    """(id, fp of every row; fp, root, component_id of every fingerprint), both written."""
    marked = staged(fingerprints(docs, id_col, text_col, width, similar), "simhash")
    least = marked.groupBy("fp").agg(F.min(id_col).alias("_least"))
    more = None
    if similar:
        texts = docs.select(text_id(text_col).alias("tid"), F.col(text_col).alias("text"))
        sketches = staged(marked.groupBy("tid").agg(F.min("fp").alias("fp"), F.min("sketch").alias("sketch")), "sketches")
        more = sketch_links(sketches, texts, width)
    root = staged(classes(least, budget, more).join(least, "fp"), "classes")
    # both sides are read from tables, so that adaptive execution may split the partition of a large component
    smallest = staged(root.groupBy("root").agg(F.min("_least").alias("component_id")), "smallest")
    return marked.select(id_col, "fp"), root.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, budget: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits), component_id: the smallest id that can be reached over links.

    A null or empty text has fingerprint zero and is linked like any other.  Null ids count for nothing
    in the minimum (a component of null ids alone has a null component_id); repeated rows stay, an empty
    table gives none, other columns are not looked at.
    """
    marked, of = classified(docs, budget, id_col, text_col)
    hexed = F.lower(F.lpad(F.hex(F.col("fp")), 16, "0"))
    return marked.join(of, "fp").select(id_col, hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, budget: int = 2, width: int = 5, similar: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, that with the smallest id; columns unchanged.

    Groups are the components of two kinds of links: fingerprints at ``budget`` or fewer bits and, with
    ``similar``, sets of ``width``-word shingles with a Jaccard similarity of 0.8 or more.  A group
    without ids keeps one of its rows with null id.  Where an id occurs in several rows, the row is found
    by its fingerprint and equal rows are dropped.
    """
    marked, of = classified(docs, budget, id_col, text_col, width, similar)
    one = marked.join(of, "fp").filter(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(id_col).alias("_id"), F.min("fp").alias("_fp"))
    often = marked.groupBy(F.col(id_col).alias("_id2")).agg((F.count("*") > 1).alias("_often")).filter("_often")
    kept = staged(one.join(often, one["_id"].eqNullSafe(often["_id2"]), "left").select("_id", "_fp", F.coalesce("_often", F.lit(False)).alias("_often")), "kept")
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    back = [F.col(n).alias(c) for c, n in names.items()]
    here = own[names[id_col]].eqNullSafe(kept["_id"])
    out = own.join(kept.filter(~F.col("_often")), here, "left_semi").select(*back)
    if kept.filter("_often").isEmpty():
        return out

    def fingerprint_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: signed(simhash(t, width)))

    fingerprint_of.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    again = own.join(kept.filter("_often"), here).filter(F.pandas_udf(fingerprint_of, LongType())(F.col(names[text_col])) == F.col("_fp"))
    return out.unionByName(again.dropDuplicates([names[id_col], "_fp"]).select(*back))
