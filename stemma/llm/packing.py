"""Bounded-space online packing of token ids into fixed-size training sequences.

Each task keeps at most ``windows`` open windows.  A document's ids first fill whole sequences of their
own; what is left goes best-fit: into the open window with the least room that still takes it.  If none
does and all windows are open, the fullest is topped up from the piece (pieces may be cut anywhere),
emitted, and the rest is placed again.  Windows still open at the end of a task are leftovers: they are
packed again in ever fewer tasks, the ids travelling with them, until one task fills the last few up
one after the other.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import map_rows, staged
from stemma.llm.tokens import word_ids

#: Leftover windows that one task of the next round merges: 16 tasks' worth of 16 windows of 4096 ids are 4 MB.
FAN_IN = 16
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, level int, task int, ids binary"


class Packer:
    """The open windows of one task.  A piece is (doc_id, start, ids as bytes, doc_tokens)."""

    def __init__(self, size: int, windows: int, base: int):
        self.size, self.windows, self.base, self.made = size, windows, base, 0
        self.open: list[tuple[int, list]] = []  # (room, pieces)

    def emit(self, pieces: list, ids: bool = False) -> list[tuple]:
        out, offset, sequence = [], 0, self.base + self.made
        self.made += 1
        for doc, start, data, total in pieces:
            n = len(data) // 4
            out.append((doc, start, n, zlib.crc32(data), total, sequence, offset, data if ids else None))
            offset += n
        return out

    def place(self, doc, start: int, data, total: int) -> list[tuple]:
        """Sequences that are full after this piece (bytes or a view of them) has been placed.

        Of windows with equal room the older one is taken.
        """
        out, n = [], len(data) // 4
        if n >= self.size:
            data = memoryview(data)
            while n >= self.size:
                out += self.emit([(doc, start, data[: 4 * self.size], total)])
                data, start, n = data[4 * self.size :], start + self.size, n - self.size
            data = bytes(data)
        if not n:
            return out
        fits = [(room, k) for k, (room, _) in enumerate(self.open) if room >= n]
        if fits:
            room, k = min(fits)
            _, pieces = self.open.pop(k)
        elif len(self.open) < self.windows:
            room, pieces = self.size, []
        else:
            room, k = min((room, k) for k, (room, _) in enumerate(self.open))
            _, full = self.open.pop(k)
            out += self.emit([*full, (doc, start, data[: 4 * room], total)])
            data, start, n = data[4 * room :], start + room, n - room
            room, pieces = self.size, []
        pieces.append((doc, start, data, total))
        if room == n:
            return out + self.emit(pieces)
        self.open.append((room - n, pieces))
        return out


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, windows: int = 16, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone.  Null ids and repeated rows are packed like any other, an
    empty table gives no rows, other columns are not looked at.  All sequences but the very last hold
    exactly ``size`` ids: the last task fills one window at a time.  Sequence ids are unique: round, task
    and running number.
    """
    import struct

    end = struct.pack("<I", end_id)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, {PIECES}"

    def rows(found: list[tuple], level: int, task: int):
        return [(*r[:7], level, task, r[7]) for r in found]

    def maker(level: int, read, windows: int = windows):
        def make():
            from pyspark import TaskContext

            task = TaskContext.get().partitionId()
            packer = Packer(size, windows, (level << 56) | (task << 28))

            def work(columns):
                for piece in read(columns):
                    yield from rows(packer.place(*piece), level, task)

            work.finish = lambda: [r for room, pieces in packer.open for r in rows(packer.emit(pieces, ids=True), level, task)]
            return work

        return make

    def encoded(columns):
        encoder = word_ids(tokenizer)
        texts = [t or "" for t in columns[1]]
        for doc, data in zip(columns[0], encoder.many(texts), strict=True):
            yield doc, 0, data + end, len(data) // 4 + 1

    def again(columns):
        yield from zip(*columns, strict=True)

    done, level = [], 0
    table = staged(map_rows(docs.select(id_col, text_col), maker(0, encoded), schema), "pack0")
    while True:
        loose = table.filter(F.col("ids").isNotNull())
        tasks, sequences = loose.agg(F.count_distinct("task"), F.count_distinct("sequence_id")).first()
        if sequences <= 1:
            return reduce(DataFrame.unionByName, [*done, table]).drop("ids", "level", "task")
        done.append(table.filter(F.col("ids").isNull()))
        level += 1
        fewer, last = -(-tasks // FAN_IN), tasks <= 1
        # a fixed order, so a task that runs again packs alike
        dealt = loose.withColumn("_group", F.col("task") % fewer)
        dealt = dealt.repartition(fewer, "_group").sortWithinPartitions(F.desc("length"), id_col, "start", "ids_crc32")
        table = staged(map_rows(dealt.select(id_col, "start", "ids", "doc_tokens"), maker(level, again, 1 if last else windows), schema), f"pack{level}")
