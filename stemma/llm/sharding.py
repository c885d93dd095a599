"""Sharding by a permutation-filled lookup table, in DataFrame functions only.

Every shard has a preference order over the slots of a prime-sized table: slot (offset + j * skip) mod
size.  The shards take turns; on its turn a shard claims the first slot of its order that is free.  A
document's key hashes to a slot, the slot gives the shard: one broadcast look-up per row.  When a shard
joins or leaves, only few slots change hands.
"""

from __future__ import annotations

import math
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The table is broadcast: so many slots (rows of two numbers and a short name) at most.
MOST_SLOTS = 65_537


def hash60(text: Column) -> Column:
    """The first 15 hex digits of the text's md5, as a long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    """slot, shard_id, shard: the filled table, computed by one fold over the turns."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and distinct")
    if not is_prime(size) or not len(shards) <= size <= MOST_SLOTS:
        raise ValueError(f"the table size must be a prime from the number of shards to {MOST_SLOTS}")
    n = len(shards)
    names = F.array(*[F.lit(s) for s in shards])
    offsets = F.array(*[F.lit(int(md5(f"offset:{s}".encode()).hexdigest()[:15], 16) % size).cast("long") for s in shards])
    skips = F.array(*[F.lit(int(md5(f"skip:{s}".encode()).hexdigest()[:15], 16) % (size - 1) + 1).cast("long") for s in shards])
    # slots lie in rows of about the root of their number, so a claim rewrites one row and the list of rows
    wide = math.isqrt(size) + 1
    start = F.struct(F.array_repeat(F.array_repeat(F.lit(-1), wide), wide).alias("owner"), F.array_repeat(F.lit(0).cast("long"), n).alias("next"))
    put = lambda values, at, new: F.transform(values, lambda x, i: F.when(i == at, new(x)).otherwise(x))

    def turn(acc: Column, t: Column) -> Column:
        me = (t % n).cast("int")
        offset, skip = F.get(offsets, me), F.get(skips, me)
        slot = lambda j: ((offset + j * skip) % size).cast("int")
        row, place = (lambda s: F.floor(s / wide).cast("int")), (lambda s: s % wide)
        taken = lambda j: F.get(F.get(acc["owner"], row(slot(j))), place(slot(j))) >= 0
        # the next free preference: most turns find it among the first few
        near = F.filter(F.sequence(F.get(acc["next"], me), F.least(F.get(acc["next"], me) + 15, F.lit(size - 1))), lambda j: ~taken(j))
        rest = F.filter(F.sequence(F.get(acc["next"], me), F.lit(size - 1).cast("long")), lambda j: ~taken(j))
        j = F.coalesce(F.get(near, F.lit(0)), F.get(rest, F.lit(0)))
        claimed = F.struct(me.alias("me"), j.alias("j"), row(slot(j)).alias("row"), place(slot(j)).alias("place"))
        owner = lambda c: put(acc["owner"], c["row"], lambda own: put(own, c["place"], lambda _: c["me"]))
        done = F.transform(F.array(claimed), lambda c: F.struct(owner(c).alias("owner"), put(acc["next"], c["me"], lambda _: c["j"] + 1).alias("next")))
        return F.get(done, F.lit(0))

    folded = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), start, turn)["owner"]
    filled = spark.range(1).select(names.alias("names"), F.slice(F.flatten(folded), 1, size).alias("owner"))
    return filled.select("names", F.posexplode("owner").alias("slot", "shard_id")).select("slot", "shard_id", F.get("names", F.col("shard_id")).alias("shard"))


def shard(docs: DataFrame, shards: list[str], size: int = 2039, key: str = "doc_id", spread: str | None = None) -> DataFrame:
    """All columns of ``docs`` that are asked for by ``key`` and ``spread``, with slot, shard_id and shard.

    A row's place depends on its key alone.  ``spread`` names a column that is hashed along with the key,
    for keys of which one may hold much of the table (such as the source): its rows then go to all
    shards evenly.  A null key hashes as the text "null key"; repeated rows get the same place; an empty
    table gives none; other columns are dropped, so their names cannot clash.
    """
    salt = [F.lit("\u0001"), F.coalesce(F.col(spread).cast("string"), F.lit("null key"))] if spread else []
    hashed = F.concat(F.lit("key:"), F.coalesce(F.col(key).cast("string"), F.lit("null key")), *salt)
    keyed = docs.select(*dict.fromkeys([key, *([spread] if spread else [])])).withColumn("slot", (hash60(hashed) % size).cast("int"))
    return keyed.join(F.broadcast(lookup_table(docs.sparkSession, shards, size)), "slot", "left")
