"""Token counts with overlap resynchronisation, and memoised encoders for the public tokenizers.

The slow part of a byte-pair tokenizer is the merging inside a word.  Both encoders here cut a text at
places which the tokenizer's own splitting pattern can never join, encode each distinct piece once per
worker with the library, and look repeated pieces up; a word with signs at its ends is made of its parts.
The table of pieces is bounded.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from stemma.llm.common import map_rows

#: Pieces that a worker remembers (about 200 bytes each); further pieces are encoded each time they occur.
REMEMBERED = 600_000
#: Pieces longer than this are encoded but not remembered.
LONGEST_REMEMBERED = 64
#: Signs at the ends of a word that its letters are parted from; not the apostrophe (contractions) nor what special tokens are written with.
ENDS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~¡«»¿"


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Remembered(dict):
    """piece -> value.  A piece that is not there is made on the spot, and kept while there is room."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, piece: str):
        value = self.make(piece)
        if len(self) < REMEMBERED and len(piece) <= LONGEST_REMEMBERED:
            self[piece] = value
        return value


def parted(piece: str) -> tuple[str, str, str] | None:
    """Signs, letters, signs, if a piece is that, in Latin-1: the patterns of both tokenizers cut there for certain.

    Most new pieces are a known word beside another sign.
    """
    core = piece.strip(ENDS)
    if core and len(core) < len(piece) and core.isalpha() and max(core) <= "\xff":
        at = piece.index(core)
        return piece[:at], core, piece[at + len(core) :]
    return None


class WordIds:
    """Ids of ``word_bpe`` style tokenizers (white space dropped), as little-endian uint32 bytes.

    White space separates pieces for certain, so a text is the sequence of its blank-separated pieces.
    Python's idea of white space is wider than the tokenizer's by the four separators 1C to 1F; texts
    with those are encoded whole.  Lower case is folded before look-up for Latin-1 texts, where it is
    letter by letter as in the tokenizer's own normaliser.
    """

    odd = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.pieces = Remembered(self._made)

    def _encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _made(self, piece: str) -> bytes:
        parts = parted(piece)
        return b"".join(self.pieces[p] for p in parts if p) if parts else self._encode(piece)

    def one(self, text: str) -> bytes:
        if self.odd.search(text):
            return self._encode(text)
        try:
            text.encode("latin-1")
            # the strings of special tokens are matched before folding, exactly as written
            text = text if "<|" in text else text.lower()
        except UnicodeEncodeError:
            pass
        return b"".join(map(self.pieces.__getitem__, text.split()))

    def many(self, texts: list[str]) -> list[bytes]:
        return list(map(self.one, texts))


class ByteCounts:
    """Token counts of byte-level BPE tokenizers whose pattern puts one leading blank with a word.

    Before a single blank between two visible characters the pattern always starts a new token, so the
    counts of the pieces cut there add up.  Where blanks and other white space meet, the cut is made
    only at such single blanks.
    """

    #: a blank next to other white space, including the rarer kinds
    doubtful = re.compile(r" \s|\s ")
    sure = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.first, self.rest = Remembered(self._bare), Remembered(self._after_blank)

    def _count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def _bare(self, piece: str) -> int:
        parts = parted(piece)
        return sum(self.first[p] for p in parts if p) if parts else self._count(piece)

    def _after_blank(self, piece: str) -> int:
        """The blank goes with the first part."""
        parts = [p for p in parted(piece) or () if p]
        return self.rest[parts[0]] + sum(self.first[p] for p in parts[1:]) if parts else self._count(" " + piece)

    def one(self, text: str) -> int:
        words = self.sure.split(text) if self.doubtful.search(text) else text.split(" ")
        return self.first[words[0]] + sum(map(self.rest.__getitem__, words[1:]))

    def many(self, texts: list[str]) -> list[int]:
        return list(map(self.one, texts))

    def starts(self, text: str) -> np.ndarray:
        """Character offset at which each token starts."""
        offsets = self.tokenizer.encode(text, add_special_tokens=False).offsets
        return np.fromiter((a for a, _ in offsets), np.int64, len(offsets))


def stable_boundary(text: str, left: np.ndarray, right: np.ndarray, low: int, high: int) -> int | None:
    """The first place in (low, high) where both encodings start a token and none can reach across.

    That is a single blank between visible characters: the pattern starts a token there whatever stands
    around it, so the tokens before it are those of the whole text (they come from the left chunk, which
    goes on beyond it), and so are the tokens after it, from the right chunk.
    """
    both = np.intersect1d(left[(left > low) & (left < high)], right[(right > low) & (right < high)])
    for p in both.tolist():
        if text[p] == " " and p + 1 < high and not text[p + 1].isspace() and not text[p - 1].isspace():
            return p
    return None


def count_long(counts: ByteCounts, text: str, chunk: int, overlap: int) -> int:
    """Tokens of one huge text from overlapping chunks.

    The part that is certain grows from boundary to boundary; if two chunks share no stable boundary the
    overlap doubles, and once it has reached the chunk's start the chunk itself doubles, up to the text.
    """
    total, begin, size = 0, 0, chunk
    left = counts.starts(text[:size])
    while begin + size < len(text):
        end, width, cut = begin + size, overlap, None
        while cut is None and width < size:
            again = end - width
            right = counts.starts(text[again : again + chunk]) + again
            cut = stable_boundary(text, left, right, again, min(end, again + chunk))
            width *= 2
        if cut is None:
            size *= 2
            left = counts.starts(text[begin : begin + size]) + begin
            continue
        total += int(np.count_nonzero(left < cut))
        left, begin, size = right[right >= cut], cut, again + chunk - cut
        if size <= 0:
            size = chunk
            left = counts.starts(text[begin : begin + size]) + begin
    return total + len(left)


@lru_cache(maxsize=4)
def byte_counts(path: str) -> ByteCounts:
    return ByteCounts(path)


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", chunk: int = 16_384, overlap: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    A null text counts as empty: 0 bytes, 0 tokens.  Null ids and repeated rows stay as they are, an
    empty table gives none, other columns of ``docs`` are not looked at.  Texts of over ``chunk``
    characters are encoded in overlapping chunks, so memory for offsets is bounded by the chunk.
    """

    def make():
        counts = byte_counts(tokenizer)

        def work(columns):
            ids, texts = columns[0], [t or "" for t in columns[1]]
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            n = dict(zip(short, counts.many([texts[i] for i in short]), strict=True))
            for i, t in enumerate(texts):
                k = n[i] if i in n else count_long(counts, t, chunk, overlap)
                yield ids[i], len(t.encode()), k, k > limit

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), make, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")
