"""Toxicity by a weighted lexicon that an Aho-Corasick automaton finds in the folded text.

Folding undoes disguises: letter case, accents, look-alike letters of other alphabets, digits and signs
that stand for letters, invisible characters.  Everything but letters then becomes a blank, so an entry is a
word (" idiot ") or the beginning of a word (" idiot").  Hits inside an exception phrase don't count.
The sum of weights is divided by a slowly growing function of the length and turned into a probability.
Weights are learned from a bounded sample of labelled rows, on top of a short list known beforehand.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import crc_mod, map_rows
from stemma.llm.sample import counted, drawn, with_texts

# Words known beforehand, and phrases in which such words are harmless.
SEED_WORDS = ("clown", "disgusting", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
EXCEPTIONS = ("clown fish", "loser pays", "pond scum", "trash bag", "trash bin", "trash can", "trash collection")
# Characters and the letters that they stand for.
LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ё": "e",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y", "η": "n",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "ս": "u", "օ": "o", "ѵ": "v", "ⅼ": "l", "ⅰ": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
# Soft hyphen, zero-width space, non-joiner, joiner, word joiner, byte-order mark.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
SIGNLESS = dict.fromkeys(map(ord, "@$!"), " ")

#: Bounds of the sample: toxic and other rows.
TOXIC_ROWS, OTHER_ROWS = 2_500, 5_000
SIGNS = re.compile(r"[@$!](?=\w)")
WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _table() -> dict[int, str | None]:
    """What a lower-case decomposed character becomes: marks and invisible characters go, what is no ASCII letter is a blank."""
    marks = (c for c in chain(range(0x300, 0x1F000), range(0xE0100, 0xE01F0)) if unicodedata.category(chr(c)) == "Mn")
    blanks = {c: " " for c in range(128) if not chr(c).isalpha() and chr(c) not in "@$!"}
    # l and i look alike once digits are letters; both sides fold to i
    return blanks | dict.fromkeys(marks) | {ord(k): v for k, v in LOOK_ALIKE.items()} | {ord(c): v for c, v in DIGITS.items() if c.isdigit()} | {ord("l"): "i"} | {ord(c): None for c in INVISIBLE}


def fold(text: str) -> str:
    """The folded text: letters and single blanks, a blank at either end.

    Characters are decomposed (accents, wide and raised forms), which changes nothing in ASCII texts.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    text = text.lower().translate(_table())
    if "@" in text or "$" in text or "!" in text:
        text = SIGNS.sub(lambda m: DIGITS[m[0]], text).translate(SIGNLESS)
    words = text.split() if text.isascii() else WORD.findall(text)
    return f" {' '.join(words)} "


@dataclass(frozen=True)
class Lexicon:
    """entry (folded, blank first) -> weight; exception phrases; the probability's slope and offset."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 4.0
    offset: float = -3.0
    _made: list = field(default_factory=list, compare=False, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def __setstate__(self, state):
        self.__dict__.update(state, _made=[])

    def automaton(self):
        if not self._made:
            import ahocorasick

            a = ahocorasick.Automaton()
            for w, x in self.weights.items():
                a.add_word(w, (len(w), x))
            for e in self.exceptions:
                e = fold(e)
                a.add_word(e, (len(e), None))
            a.make_automaton()
            self._made.append(a)
        return self._made[0]

    def density(self, text: str | None) -> tuple[float, int]:
        """Weight of the hits over 1 + ln(1 + words / 100), and the number of hits."""
        folded = fold(text or "")
        hits, spared = {}, []
        for end, (n, weight) in self.automaton().iter(folded):
            begin = end - n + 1
            if weight is None:
                spared.append((begin, end))
            elif weight > hits.get(begin, (0, 0.0))[1]:
                hits[begin] = (end, weight)
        if spared:
            hits = {b: (e, w) for b, (e, w) in hits.items() if not any(x <= b and min(e, b + 2) <= y for x, y in spared)}
        total = sum(w for _, w in hits.values())
        return total / (1 + math.log1p(folded.count(" ") / 100)), len(hits)

    def score(self, text: str | None) -> tuple[float, int]:
        d, n = self.density(text)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * d + self.offset)))), n


def entries(words: list[str]) -> set[str]:
    """Words and beginnings of words of 3 to 8 letters."""
    out = set()
    for w in words:
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(3, min(8, len(w)) + 1))
    return out


@dataclass(frozen=True)
class Seen:
    """What is learned from a text: its different folded words, its beginning and its end."""

    words: list[str]
    head: str
    tail: str


def seen(text: str | None) -> Seen:
    folded = fold(text or "")
    return Seen(sorted(set(folded.split())), folded[:60], folded[-60:])


def learn(toxic: list[Seen], other: list[Seen], least: int = 3, purity: float = 3.0) -> Lexicon:
    """Log-odds weights of the entries that tell toxic texts from others."""
    seeds = {f" {fold(w).strip()} ": 3.0 for w in SEED_WORDS}
    bad, good = Counter(), Counter()
    # near copies of one text are no independent evidence: they share their first or last words
    ends: set[str] = set()
    for texts, into in ((toxic, bad), (other, good)):
        for t in texts:
            own = {"^" + t.head, "$" + t.tail}
            if into is good or not own & ends:
                into.update(entries(t.words))
            ends |= own
    # clean rows show which entries are common speech; without any, nothing is learned
    base = math.log((len(toxic) + 1) / (len(other) + 1))
    part = len(toxic) / max(1, len(toxic) + len(other))
    odds = {}
    for w, n in bad.items():
        m = good.get(w, 0)
        if n < least or not other or m > 0.02 * n:
            continue
        # the number of toxic rows must exceed chance, given how many entries were looked at
        q = n / (n + m)
        gap = q * math.log(q / part) + (0 if q == 1 else (1 - q) * math.log((1 - q) / (1 - part)))
        x = math.log(n + 0.5) - math.log(m + 0.5) - base
        if x >= purity and q > part and (n + m) * gap >= math.log(100 * len(bad)):
            odds[w] = x
    # of a word's beginnings the longest that covers nearly as many rows: " moron" rather than " mor"
    shadowed = {w[:-1] for w in odds if bad[w] >= 0.8 * bad[w[:-1]] and good.get(w, 0) <= good.get(w[:-1], 0)}
    weights = dict(seeds)
    for w in sorted(odds, key=lambda w: (len(w), w)):
        # a beginning stands for the words that start with it, unless they are purer
        if w not in shadowed and not any(weights.get(w[:k], 0) >= min(6.0, odds[w]) - 1.5 for k in range(4, len(w))):
            weights[w] = min(6.0, odds[w])
    return Lexicon(weights)


def calibrated(lexicon: Lexicon, densities: list[tuple[int, float]]) -> Lexicon:
    """The lexicon with slope and offset from (label, density) pairs, by Newton steps."""
    y, x = (np.array(c, float) for c in zip(*densities, strict=True)) if densities else (np.zeros(0), np.zeros(0))
    toxic = int(y.sum())
    if not toxic or toxic == len(y):
        return lexicon
    # both classes weigh alike; a ridge keeps the slope finite
    share = np.where(y == 1, 0.5 / toxic, 0.5 / (len(y) - toxic)) * len(y)
    a = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -60, 60)))
        grad = design.T @ (share * (p - y)) + 1e-3 * a
        hess = (design * (share * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return replace(lexicon, slope=float(max(a[0], 0.5)), offset=float(a[1]))


def held_out(id_col: str = "doc_id") -> Column:
    """crc32(id as text) mod 5 is 0; false for null ids, which are never learned from either."""
    return F.coalesce(crc_mod(id_col, 5) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """The lexicon learned from at most ``TOXIC_ROWS`` and ``OTHER_ROWS`` labelled rows, whole texts.

    Drawn are the ids that come first by a hash, so the sample doesn't depend on the order of rows.  Null
    ids, texts and labels teach nothing, nor do ids labelled both ways; of the texts of a repeated id one
    counts.  ``usable`` is a condition on column ``i``, the id.  Texts stay on the executors: only their
    different words, and then their densities, come to the driver.
    """
    marks = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("i").isNotNull())
    if usable is not None:
        marks = marks.filter(usable)
    counts = counted(marks)
    if not counts:
        return learn([], [])
    ids = drawn(marks, counts, {0: OTHER_ROWS, 1: TOXIC_ROWS}, "toxicity", exclusive=True)
    texts = with_texts(ids, docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), ["i"])
    kind = texts.schema["i"].dataType.simpleString()

    def words():
        return lambda columns: [(y, i, " ".join(x.words), x.head, x.tail) for y, i, x in zip(columns[0], columns[1], map(seen, columns[2]), strict=True)]

    got = sorted(map(tuple, map_rows(texts, words, f"y int, i {kind}, words string, head string, tail string").collect()), key=lambda r: r[1])
    found = learn(*[[Seen(w.split(), head, tail) for y, _, w, head, tail in got if y == k] for k in (1, 0)])

    def densities():
        return lambda columns: [(y, found.density(t)[0]) for y, t in zip(*columns, strict=True)]

    return calibrated(found, sorted(map(tuple, map_rows(texts.select("y", "t"), densities, "y int, density double").collect())))


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted, hits of every row; the whole text counts, a null text is an empty one.

    Null ids and repeated rows stay, an empty table gives none, other columns are not looked at.
    """

    def make():
        def work(columns):
            for i, t in zip(*columns, strict=True):
                p, n = lexicon.score(t)
                yield i, p, int(p >= 0.5), n

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), make, f"{id_col} {kind}, score double, predicted int, hits int")


def keep_clean(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score under 0.5; columns unchanged."""
    import pandas as pd

    def clean(batches):
        for texts in batches:
            yield texts.map(lambda t: lexicon.score(t)[0] < 0.5).astype(bool)

    clean.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.filter(F.pandas_udf(clean, "boolean")(F.col(f"`{text_col}`")))
