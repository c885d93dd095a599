"""Benchmark decontamination: items that occur in documents with few edits.

Both sides are reduced to lower-case letters and digits with single blanks.  An item of n characters may
differ in ``budget(n)`` edits.  Cut into budget + 1 pieces, one piece at least must occur unchanged, so
one Aho-Corasick pass over the document finds every candidate place; each is verified with Myers'
bit-parallel distance in a window around it.  Items too short for an edit must stand as whole words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import map_rows, staged

OTHER = re.compile(r"[\W_]+")
#: Characters of items that one automaton may hold (about 60 bytes each in every worker); more go in further passes.
BLOCK_CHARS = 2_000_000


def plain(text: str | None) -> str:
    return OTHER.sub(" ", (text or "").lower()).strip()


def budget(n: int) -> int:
    """Edits allowed to an item of n characters: one in twenty, so pieces have 18 characters or more."""
    return n // 20


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 pieces of nearly the same length that make up the item; without edits the item between blanks."""
    if not k:
        return [(-1, f" {item} ")]
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' bit vectors of one item; Python integers hold any length."""

    def __init__(self, item: str):
        self.n, self.masks = len(item), {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end): the least edits with which the item matches a substring, and where that first ends."""
        full, top = (1 << self.n) - 1, 1 << (self.n - 1)
        pv, mv, score, best, end = full, 0, self.n, self.n, 0
        get = self.masks.get
        for j, c in enumerate(text, 1):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & full
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = ph << 1 & full, mh << 1 & full
            pv = (mh | ~(xv | ph)) & full
            mv = ph & xv
            if score < best:
                best, end = score, j
        return best, end


class Matcher:
    def __init__(self, items: list[tuple]):
        import ahocorasick

        found: dict[str, list] = {}
        self.items = []
        for item_id, text in items:
            p = plain(text)
            if not p:
                continue
            k = budget(len(p))
            at = len(self.items)
            self.items.append((item_id, Pattern(p), k))
            for offset, piece in pieces(p, k):
                found.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple]:
        """(item_id, distance, begin, end): the best place of each item that occurs, in the reduced text."""
        if not self.items:
            return []
        t = f" {plain(text)} "
        places: dict[int, set[int]] = {}
        for end, (n, uses) in self.automaton.iter(t):
            for at, offset in uses:
                places.setdefault(at, set()).add(end - n + 1 - offset)
        out = []
        for at, starts in places.items():
            item_id, pattern, k = self.items[at]
            best, low = None, None
            # windows that overlap are verified once, from the first start to the last
            for begin in sorted(starts):
                if low is not None and begin <= high + 2 * k:
                    high = begin
                    continue
                if low is not None:
                    best = self.verify(t, pattern, k, low, high, best)
                low = high = begin
            best = self.verify(t, pattern, k, low, high, best)
            if best:
                out.append((item_id, *best))
        return out

    @staticmethod
    def verify(t: str, pattern: Pattern, k: int, low: int, high: int, best):
        a, b = max(0, low - k), min(len(t), high + pattern.n + k)
        distance, end = pattern.best(t[a:b])
        if distance <= k and (best is None or distance < best[0]):
            return distance, max(0, a + end - pattern.n - 1), a + end - 1
        return best


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items in lists of bounded size, each read for itself: what is broadcast doesn't grow with the table."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).filter(F.col("t").isNotNull())
    chars = items.agg(F.sum(F.char_length("t") + 16)).first()[0] or 0
    n = max(1, -(-2 * chars // BLOCK_CHARS)) if chars > BLOCK_CHARS else 1
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else items
        rows = part.distinct().collect()
        yield sorted(((r["i"], r["t"]) for r in rows), key=lambda r: (str(r[0]), r[1]))


_MATCHERS: dict[int, Matcher] = {}


def matcher(items: list[tuple]) -> Matcher:
    """One automaton for a list of items in each worker, which holds one at a time."""
    key = hash(tuple(items))
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items)
    return _MATCHERS[key]


def in_passes(passes: Iterator[DataFrame]) -> DataFrame:
    """One pass as it is; several one after the other, each written before the next block of items is read."""
    first = next(passes)
    second = next(passes, None)
    if second is None:
        return first
    return reduce(DataFrame.unionByName, (staged(p, "found") for p in chain([first, second], passes)))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """id, item id, distance (edits), begin, end (in the reduced text): one row per document and item that occurs in it.

    A null or empty text has no matches; items that are null or have no letter or digit match nothing.
    Null ids and repeated rows stay; items with equal texts each match; an empty table on either side
    gives no rows; other columns are not looked at.  A benchmark of over ``BLOCK_CHARS`` characters takes
    several passes over the documents, each with the automaton of one block.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    rows = docs.select(id_col, text_col)

    def found(items: list[tuple]) -> DataFrame:
        def make():
            m = matcher(items)
            return lambda columns: [(i, *hit) for i, t in zip(*columns, strict=True) for hit in m.matches(t)]

        return map_rows(rows, make, f"{id_col} {kind}, {item_col} {item_kind}, distance int, begin_char long, end_char long")

    return in_passes(map(found, blocks_of(benchmark, item_col, "text")))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` in which no item occurs; columns unchanged.

    A benchmark of one block is a filter.  Several blocks are passes that find texts (by their SHA-256),
    whose rows then go by an anti-join.
    """
    import pandas as pd

    blocks = blocks_of(benchmark, item_col, "text")
    first = next(blocks)
    second = next(blocks, None)
    if second is None:

        def free(batches):
            m = matcher(first)
            for texts in batches:
                yield texts.map(lambda t: not m.matches(t)).astype(bool)

        free.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return docs.filter(F.pandas_udf(free, "boolean")(F.col(f"`{text_col}`")))

    digest = lambda c: F.sha2(c.cast("binary"), 256)
    texts = docs.select(F.col(f"`{text_col}`").alias("t")).filter(F.col("t").isNotNull()).select("t", digest(F.col("t")).alias("h"))

    def found(items: list[tuple]) -> DataFrame:
        def make():
            m = matcher(items)
            return lambda columns: [(h,) for t, h in zip(*columns, strict=True) if m.matches(t)]

        return map_rows(texts, make, "h string")

    gone = in_passes(map(found, chain([first, second], blocks))).distinct()
    # positions instead of names, which may repeat or clash
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    kept = own.join(gone, digest(F.col(names[docs.columns.index(text_col)])) == gone["h"], "left_anti")
    return kept.toDF(*docs.columns)
