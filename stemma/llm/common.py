"""What the text operators share: reading tables, stage tables, batches of Arrow rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.sources.scratch import shared_dir, staged

__all__ = ["bounded", "crc_mod", "map_rows", "shared_dir", "staged", "table"]

#: Rows that a Python stage turns into Python objects at once; texts may be long.
SLICE_ROWS = 128
#: Bytes of a join's side that may be broadcast; beyond them it is shuffled, and adaptive execution splits hot keys.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def bounded(df: DataFrame, size: int) -> DataFrame:
    """``df`` marked for broadcast if its measured ``size`` in bytes allows it, as it is otherwise."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[list]], Iterable[tuple]]], schema: str) -> DataFrame:
    """``mapInArrow`` with plain lists.

    ``make`` runs once per task and gives a function from a slice of input columns (lists) to output
    rows; if that function has an attribute ``finish`` it is called at the end of the partition for the
    rows that are left.  Memory is bounded by ``SLICE_ROWS`` input rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(at, SLICE_ROWS)
                rows = list(work([c.to_pylist() for c in part.columns]))
                if rows:
                    yield batch(rows)
        last = list(work.finish()) if hasattr(work, "finish") else []
        for at in range(0, len(last), 4096):
            yield batch(last[at : at + 4096])

    return df.mapInArrow(run, schema)
