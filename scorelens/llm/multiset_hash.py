"""Operator 2 [native]: homomorphic multiset hash of a text's paragraphs, in SQL functions only.

A fingerprint is an array of longs that add up lane by lane modulo powers of two:

* 0, 1: numbers of paragraphs and of pieces;
* 2 to 5: sums of four 60-bit hashes of each paragraph (modulo 2**60): equality;
* 6 on: sums of 126 bits hashed from each piece, three lanes of 20 bits to a long (modulo 2**20 each): likeness.

Paragraphs are the lines of a text, pieces the parts of a paragraph between points, so a paragraph's
vector depends on it alone: the order of paragraphs doesn't matter, ``added`` and ``removed`` insert
and delete paragraphs.  With n pieces a lane of c ones stands for the number 2c-n; the cosine of two
such vectors estimates the share of common pieces, with a deviation of about 0.09.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelens.llm.common import blocks_of, with_id

PIECE_BREAK = r"[\n.,;:!?|]+"
EQUAL_LANES, EQUAL_MASK = 4, 2**60 - 1
BITS, PACKED = 21, 3  # bits to a packed lane (the top one takes the carry), lanes to a long
ONES = sum(1 << (BITS * f) for f in range(PACKED))
LANE = 2 ** (BITS - 1) - 1
PACK_MASK = sum(LANE << (BITS * f) for f in range(PACKED))
LONGS = 2 * BITS
LANES = LONGS * PACKED
#: Ranges of ids at most (their bounds are a literal of the plan).
MOST_RANGES = 50_000


def _sum(array: str, part, mask: int) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda acc, h: (acc + part(h)).bitwiseAND(F.lit(mask).cast("long")))


def _equal_lane(array: str, lane: int) -> Column:
    return _sum(array, lambda p: F.xxhash64(F.lit(lane), p).bitwiseAND(F.lit(EQUAL_MASK)), EQUAL_MASK)


def _packed_lane(array: str, shift: int) -> Column:
    return _sum(array, lambda h: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(ONES)), PACK_MASK)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the fingerprint of column ``text`` (null: empty) as array<bigint> ``name``."""
    clean = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__paragraphs", F.split(clean, "\n"))
    df = df.withColumn("__h", F.transform(F.filter(F.split(clean, PIECE_BREAK), lambda x: x != ""), lambda x: F.xxhash64(x)))
    df = df.withColumn("__g", F.transform("__h", lambda h: F.xxhash64(h)))
    counts = [F.size("__paragraphs").cast("long"), F.size("__h").cast("long")]
    equal = [_equal_lane("__paragraphs", lane) for lane in range(EQUAL_LANES)]
    packed = [_packed_lane(a, k) for a in ("__h", "__g") for k in range(BITS)]
    return df.withColumn(name, F.array(*counts, *equal, *packed)).drop("__paragraphs", "__h", "__g")


def _lanes(a: Column, b: Column, join) -> Column:
    mask = [F.lit(2**62 - 1)] * 2 + [F.lit(EQUAL_MASK)] * EQUAL_LANES + [F.lit(PACK_MASK)] * LONGS
    return F.zip_with(F.zip_with(a, b, join), F.array(*mask), lambda x, m: x.bitwiseAND(m))


def added(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    return _lanes(a, b, lambda x, y: x + y)


def removed(a: Column, b: Column) -> Column:
    """Fingerprint of a's paragraphs without b's (which must be among them)."""
    carry = sum(1 << (BITS * (f + 1) - 1) for f in range(PACKED))
    borrow = [F.lit(0)] * 2 + [F.lit(EQUAL_MASK + 1)] * EQUAL_LANES + [F.lit(carry)] * LONGS
    return _lanes(F.zip_with(a, F.array(*borrow), lambda x, c: x + c), b, lambda x, y: x - y)


def as_text(fingerprint: str) -> Column:
    """Lower-case hex, 16 digits a long."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: str, b: str) -> Column:
    """0 to 1: 1 for equal fingerprints, else the cosine of the piece lanes (0 at least)."""
    n, m = F.get(a, F.lit(1)), F.get(b, F.lit(1))

    def dot(x, y):
        lane = lambda v, f, count: (2 * F.shiftrightunsigned(v, BITS * f).bitwiseAND(F.lit(LANE)) - count).cast("double")
        return lane(x, 0, n) * lane(y, 0, m) + lane(x, 1, n) * lane(y, 1, m) + lane(x, 2, n) * lane(y, 2, m)

    def product(p, q):
        return F.aggregate(F.zip_with(F.slice(p, 7, LONGS), F.slice(q, 7, LONGS), dot), F.lit(0.0), lambda acc, x: acc + x)

    def square(p, count):
        def own(x):
            lane = lambda f: (2 * F.shiftrightunsigned(x, BITS * f).bitwiseAND(F.lit(LANE)) - count).cast("double")
            return lane(0) * lane(0) + lane(1) * lane(1) + lane(2) * lane(2)

        return F.aggregate(F.slice(p, 7, LONGS), F.lit(0.0), lambda acc, x: acc + own(x))

    norm = F.sqrt(square(a, n) * square(b, m))
    return F.when(F.col(a) == F.col(b), 1.0).when(norm > 0, F.least(F.greatest(product(a, b) / norm, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def id_ranges(ids: DataFrame, per_range: int) -> list[int]:
    """Least ids of ranges of about ``per_range`` rows, ascending; one id is never split.  Only ids are
    shuffled, and one number a range comes to the driver."""
    ranges = min(blocks_of(ids.count(), per_range), MOST_RANGES)
    dealt = ids.repartitionByRange(ranges, "__id").groupBy(F.spark_partition_id()).agg(F.min("__id").alias("low"))
    return sorted(r["low"] for r in dealt.collect())


def _range_of(bounds: list[int]) -> Column:
    """Number of the range (from 0) that holds __id, by binary search in the literal bounds."""
    array, n = F.array(*(F.lit(b).cast("long") for b in bounds)), len(bounds)
    steps = [2**k for k in range(int(math.log2(n)), -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda pos, step: F.when((pos + step < n) & (F.get(array, pos + step) <= F.col("__id")), pos + step).otherwise(pos))


def with_next(docs: DataFrame, columns: list[str], tie: Column, per_range: int = 2000) -> DataFrame:
    """Adds __next_<c>: column c of the next row in descending __id (after the last: the first); rows of
    one id are in the order of ``tie``.

    Rows are dealt by id range, in one shuffle.  The first row of each range also goes to the range
    before it in that order, as a guest; a window inside each range then sees every next row."""
    bounds = id_ranges(docs.select("__id"), per_range)
    if not bounds:
        return docs.select("*", *(F.col(c).alias(f"__next_{c}") for c in columns))
    df = docs.withColumn("__range", _range_of(bounds))
    tops = docs.select("__id", _range_of(bounds).alias("__range")).groupBy("__range").agg(F.max("__id").alias("top")).collect()
    top = {r["__range"]: r["top"] for r in tops}
    guests = F.array(*(F.lit(top[g]).cast("long") for g in range(len(bounds))))
    # the first row of range g is the next row of the last row of range g+1; of the top range, of range 0
    home = F.struct(F.col("__range").alias("range"), F.lit(False).alias("guest"))
    away = F.struct(F.when(F.col("__range") == len(bounds) - 1, 0).otherwise(F.col("__range") + 1).alias("range"), F.lit(True).alias("guest"))
    both = F.when(F.col("__id") == F.get(guests, F.col("__range")), F.array(home, away)).otherwise(F.array(home))
    df = df.withColumn("__tie", tie).withColumn("__at", F.explode(both))
    order = Window.partitionBy(F.col("__at.range")).orderBy(F.col("__at.guest"), F.col("__id").desc(), F.col("__tie"))
    df = df.select("*", *(F.lead(c).over(order).alias(f"__next_{c}") for c in columns))
    return df.where(~F.col("__at.guest")).drop("__range", "__at", "__tie")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per row.

    The edited text has its last floor(n_chars/3) code points replaced by the first as many (or all) of
    the next row's text, in descending id; after the last row comes the first, so a single row is its
    own next.  Null text is empty.  A null id is the smallest; rows of one id are in the order of a hash
    of their texts, equal rows are interchangeable.  An empty table gives an empty one.  Beyond a million
    pieces a lane wraps and likeness loses its meaning; equality stays.
    """
    df = with_id(docs.select(F.col(id_col).alias("__in"), F.coalesce(text_col, F.lit("")).alias("t")), "__in", "__id")
    df = with_fingerprint(df, "t", "f")
    df = with_next(df, ["t", "f"], F.xxhash64("t"))
    n = F.length("t")
    cut = F.floor(n / 3).cast("int")
    df = df.withColumn("n", n.cast("long")).withColumn("e", F.concat(F.substring("t", F.lit(1), n - cut), F.substring("__next_t", F.lit(1), cut)))
    df = with_fingerprint(df, "e", "g")
    return df.select(
        F.col("__in").alias(id_col), F.col("n").alias("n_chars"), F.sha2("e", 256).alias("edited_sha256"),
        as_text("f").alias("fingerprint"), as_text("g").alias("edited_fingerprint"),
        likeness("f", "g").alias("near_edited"), likeness("f", "__next_f").alias("near_next"),
    )
