"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A paragraph (line) hashes to a wide vector: two 64-bit numbers of its whole text, and 64 lanes of 32 bits
that count, over its runs of three words, the ones in each bit of the run's 64-bit hash.  A document's
fingerprint is the sum of its paragraphs' vectors modulo powers of two, so the order of paragraphs is
immaterial and a paragraph is put in or taken out by one addition or subtraction.  Equal multisets of
paragraphs have equal fingerprints.  Lanes centred by the number of runs are a tug-of-war sketch of the
multiset of runs: from two fingerprints alone the likeness of the texts can be estimated.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LANES = 64
PER_LONG = 2
#: longs of a fingerprint: packed lanes, number of runs, two numbers of whole paragraphs
PACKED = LANES // PER_LONG
#: One bit in each byte, and every fourth byte.
MASK, FOURTH = 0x0101_0101_0101_0101, 0x0000_00FF_0000_00FF
#: Runs that are counted in 8-bit lanes before these are widened; the topmost lane must stay below the sign.
CHUNK = 127


def bytes_of(h: Column) -> list[Column]:
    """The 64 bits of a hash as 8 longs of eight 8-bit lanes."""
    return [(F.shiftrightunsigned(h, k) if k else h).bitwiseAND(F.lit(MASK)) for k in range(8)]


def wrapped_add(a: Column, b: Column) -> Column:
    """a + b modulo 2^64; adding the low and high halves apart keeps ANSI mode from raising."""
    low = a.bitwiseAND(F.lit(0xFFFF_FFFF)) + b.bitwiseAND(F.lit(0xFFFF_FFFF))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFF_FFFF)))


def whole(lines: Column, seed: int) -> Column:
    """Sum of the seeded hashes of whole lines modulo 2^64."""
    return F.aggregate(lines, F.lit(0).cast("long"), lambda acc, line: wrapped_add(acc, F.xxhash64(F.lit(seed), line)))


def fingerprint(text: Column) -> Column:
    """array<long> of PACKED + 3 numbers; null is an empty text.

    Packed lanes are added as longs; a text holds at most 2^31 bytes, so no lane reaches the next one or the sign.
    """
    names, small = [f"l{k}" for k in range(PACKED)], [f"b{k}" for k in range(8)]
    long0 = F.lit(0).cast("long")
    zero = F.struct(F.lit("").alias("p"), F.lit("").alias("q"), long0.alias("n"), *[long0.alias(x) for x in names])

    def word(acc: Column, w: Column) -> Column:
        bits = bytes_of(F.xxhash64(acc["q"], acc["p"], w))
        return F.struct(w.alias("p"), acc["p"].alias("q"), *[(acc[x] + b).alias(x) for x, b in zip(small, bits, strict=True)])

    def chunk(acc: Column, words: Column) -> Column:
        """Counts of up to CHUNK runs fit 8-bit lanes; they are widened and added to the text's lanes."""
        start = F.struct(acc["p"].alias("p"), acc["q"].alias("q"), *[long0.alias(x) for x in small])

        def widened(done: Column) -> Column:
            wide = [(acc[f"l{8 * m + k}"] + (F.shiftrightunsigned(done[f"b{k}"], 8 * m) if m else done[f"b{k}"]).bitwiseAND(F.lit(FOURTH))).alias(f"l{8 * m + k}") for m in range(4) for k in range(8)]
            return F.struct(done["p"].alias("p"), done["q"].alias("q"), (acc["n"] + F.size(words)).alias("n"), *wide)

        return F.aggregate(words, start, word, widened)

    def paragraph(acc: Column, line: Column) -> Column:
        # runs don't reach over a paragraph's end: its first run starts afresh
        start = F.struct(F.lit("").alias("p"), F.lit("").alias("q"), acc["n"].alias("n"), *[acc[x].alias(x) for x in names])
        cut = F.get(F.transform(F.array(F.split(line, " ", -1)), lambda ws: F.transform(F.sequence(F.lit(0), F.floor((F.size(ws) - 1) / CHUNK).cast("int")), lambda i: F.slice(ws, i * CHUNK + 1, F.lit(CHUNK)))), F.lit(0))
        return F.aggregate(cut, start, chunk)

    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    runs = F.aggregate(lines, zero, paragraph, lambda a: F.array(*[a[x] for x in names], a["n"]))
    return F.concat(runs, F.array(whole(lines, 1), whole(lines, 2)))


def hexed(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def centred(packed: Column, n: Column) -> Column:
    """Sum over two lanes of (2 count - n), squared."""
    lane = lambda k: (2 * F.shiftrightunsigned(packed, 32 * k).bitwiseAND(F.lit(0xFFFF_FFFF)) - n).cast("double")
    return reduce(Column.__add__, [lane(k) * lane(k) for k in range(PER_LONG)])


def apart(x: Column, y: Column, nx: Column, ny: Column) -> Column:
    d = lambda k: (2 * (F.shiftrightunsigned(x, 32 * k).bitwiseAND(F.lit(0xFFFF_FFFF)) - F.shiftrightunsigned(y, 32 * k).bitwiseAND(F.lit(0xFFFF_FFFF))) - (nx - ny)).cast("double")
    return reduce(Column.__add__, [d(k) * d(k) for k in range(PER_LONG)])


def likeness(a: Column, b: Column) -> Column:
    """1 - |a - b|^2 / (|a|^2 + |b|^2), from the lanes, between 0 and 1; equal fingerprints give 1."""
    na, nb = F.get(a, F.lit(PACKED)), F.get(b, F.lit(PACKED))
    at = F.sequence(F.lit(0), F.lit(PACKED - 1))
    add = lambda x, y: x + y
    zero = F.lit(0.0)
    gap = F.aggregate(F.transform(at, lambda k: apart(F.get(a, k), F.get(b, k), na, nb)), zero, add)
    size = F.aggregate(F.transform(at, lambda k: centred(F.get(a, k), na) + centred(F.get(b, k), nb)), zero, add)
    return F.when(a == b, 1.0).when(size <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - gap / F.greatest(size, F.lit(1.0)))))


def below(x: Column, bounds: list, kind: str) -> Column:
    """How many of the sorted bounds are below x, looked up in two steps of about the root of their number."""
    step = max(1, math.isqrt(len(bounds)))
    coarse = F.size(F.filter(listed(bounds[step - 1 :: step], kind), lambda b: b < x)) * step
    return F.get(F.transform(F.array(coarse), lambda c: c + F.size(F.filter(F.slice(listed(bounds, kind), c + 1, F.lit(step)), lambda b: b < x))), F.lit(0))


def listed(values: list, kind: str) -> Column:
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def sliced(tie: Column, n: Column) -> Column:
    """Which of n equal slices of the hash, from its largest values down."""
    return F.least(n - 1, F.floor((0.5 - tie / F.lit(2.0**64)) * n).cast("int"))


def partition_keys(spark: SparkSession, ranges: int, parts: int) -> list[int]:
    """A number for each range; hash partitioning over ``parts`` deals the ranges out in turn, one to a partition."""
    drawn = spark.range(40 * parts).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(parts)).alias("p")).agg(F.slice(F.sort_array(F.collect_list("k")), 1, -(-ranges // parts)).alias("ks"))
    known = {r["p"]: r["ks"] for r in drawn.collect()}
    return [known[r % parts][r // parts] for r in range(ranges)]


def with_next(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Each row with the ``columns`` of its successor by descending id as ``next_...``; the last is followed by the first.

    Rows are dealt to ranges of ids (bounds are a bounded list of quantiles), one range to a partition.
    An id that fills more than one range, and null ids, which come last, are dealt further by a hash of
    the first column, by which ties are ordered; only rows equal in id and text stay together.  The top
    row of a range goes to the range before it as well, as a guest behind all its rows, so each range is
    ordered for itself.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_tie", F.xxhash64(columns[0]))
    kind = rows.schema[id_col].dataType.simpleString()
    i, tie = F.col(id_col), F.col("_tie")
    cuts, total, known = rows.agg(F.percentile_approx(id_col, [k / max(2, parts) for k in range(1, max(2, parts))], 10_000), F.count("*"), F.count(id_col)).first()
    often = Counter(cuts or [])
    bounds = sorted(often)
    # from the largest ids down: above the last bound, then for each bound its own rows if they fill ranges, and those below it
    own = [0, *[often[b] if often[b] > 1 else 0 for b in reversed(bounds)]]
    offsets = list(accumulate((n + 1 for n in own), initial=0))
    empty = max(1, round(parts * (total - known) / max(1, total)))
    at = F.lit(len(bounds)) - below(i, bounds, kind)
    here = F.get(listed(own, "int"), at)
    top = (here > 0) & i.eqNullSafe(F.get(listed([None, *reversed(bounds)], kind), at))
    placed = F.get(listed(offsets, "int"), at) + F.when(top, sliced(tie, here)).otherwise(here)
    rows = rows.withColumn("_range", F.when(i.isNull(), F.lit(offsets[-1]) + sliced(tie, F.lit(empty))).otherwise(placed).cast("int"))
    ranges = offsets[-1] + empty
    tops = {r["_range"]: (r["t"]["i"], r["t"]["tie"]) for r in rows.groupBy("_range").agg(F.max(F.struct(i.alias("i"), tie.alias("tie"))).alias("t")).collect()}
    used = sorted(tops)
    before = dict(zip(used, used[-1:] + used[:-1], strict=True))
    of = lambda values, k: F.get(listed([values.get(r) for r in range(ranges)], k), F.col("_range"))
    first = i.eqNullSafe(of({r: t[0] for r, t in tops.items()}, kind)) & (tie == of({r: t[1] for r, t in tops.items()}, "bigint"))
    stays, guest = F.struct(F.col("_range").alias("r"), F.lit(False).alias("guest")), F.struct(of(before, "int").alias("r"), F.lit(True).alias("guest"))
    dealt = rows.withColumn("_to", F.explode(F.when(first, F.array(stays, guest)).otherwise(F.array(stays))))
    dealt = dealt.withColumn("_key", F.get(listed(partition_keys(spark, ranges, parts), "int"), F.col("_to.r")))
    w = Window.partitionBy("_key").orderBy(F.col("_to.guest"), i.desc_nulls_last(), tie.desc())
    out = dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
    return out.filter(~F.col("_to.guest")).drop("_tie", "_range", "_to", "_key")


def edited(text: Column, other: Column) -> Column:
    """The last third of the code points replaced by the first as many (or all) of the other text."""
    n = F.char_length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(other, F.lit(1), k))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text (null: empty) and fp for every row of ``docs``; other columns are not looked at."""
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("fp", fingerprint(F.col("text")))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint beside that of its edited text and of the next document by descending id.

    An empty table gives no rows; a single row is its own next document; repeated rows follow each other.
    """
    rows = with_next(fingerprints(docs, id_col, text_col), id_col, ["text", "fp"])
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("edited_fp", fingerprint(F.col("edited")))
    return rows.select(
        id_col,
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        hexed(F.col("fp")).alias("fingerprint"),
        hexed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
