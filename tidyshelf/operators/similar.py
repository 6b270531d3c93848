"""Difference hashes and near duplicates by exact neighbourhood keys."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyshelf.operators.graph import linked_groups
from tidyshelf.session import pin


def dhash(values: Column, width: int) -> Column:
    """One bit per neighbouring pair in each row of a grid: set where the right value is larger.

    ``values`` is the grid row by row. The first pair becomes the highest bit; at most 64 pairs fit, and a
    larger grid is an error. With 64 the number is negative where the first pair is set.
    """
    lefts = F.filter(values, lambda _, i: i % width != width - 1)
    rights = F.filter(values, lambda _, i: i % width != 0)
    bits = F.zip_with(lefts, rights, lambda a, b: F.when(b > a, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    fits = F.assert_true(F.size(bits) <= 64, F.lit("a difference hash holds at most 64 pairs"))
    return F.when(fits.isNull(), F.aggregate(bits, F.lit(0).cast("bigint"), lambda total, bit: F.shiftleft(total, 1).bitwiseOR(bit)))


def hex_hash(col: Column, bits: int) -> Column:
    """A hash as lower-case hex of fixed width."""
    digits = (bits + 3) // 4
    return F.lpad(F.lower(F.hex(col)), digits, "0")


def _within(col: Column, bits: int, radius: int) -> Column:
    """All hashes at most ``radius`` flipped bits away."""
    masks = [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.array(*[F.lit(m).cast("bigint") for m in signed]), lambda m: m.bitwiseXOR(col))


def hash_groups(df: DataFrame, col: str, order: str) -> DataFrame:
    """Distinct hashes with their number of rows and first row: distance 0, and copies folded."""
    return df.groupBy(F.col(col).alias("hash")).agg(F.count("*").alias("copies"), F.min(order).alias("first"))


def near_duplicates(df: DataFrame, col: str, order: str, bits: int, max_distance: int) -> DataFrame:
    """Pairs of distinct hashes at most ``max_distance`` bits apart, with the copies behind each.

    Copies of one hash are folded first, so a group of any size is one row and its members are
    named by the hash. One side is keyed by all hashes within half the distance, the other side
    within the rest: two hashes meet exactly when they are close enough, and since hashes are
    distinct, no key is held by more hashes than a ball of that radius has points. A hash costs
    1 + bits + ... + C(bits, far) keys: at 64 bits 65 for a distance of 2, and 2,081 on both sides for 4. In a
    pair ``hash_a`` is the smaller signed number.
    """
    if not 0 <= max_distance <= 4:
        raise ValueError("distances 0 to 4 are supported")
    groups = hash_groups(df, col, order)
    near, far = max_distance // 2, max_distance - max_distance // 2
    left = groups.select(F.col("hash").alias("hash_a"), F.explode(_within(F.col("hash"), bits, far)).alias("_key"))
    right = groups.select(F.col("hash").alias("hash_b"), F.explode(_within(F.col("hash"), bits, near)).alias("_key"))
    pairs = (
        left.join(right, "_key").where("hash_a < hash_b").select("hash_a", "hash_b").distinct()
        .withColumn("distance", F.bit_count(F.col("hash_a").bitwiseXOR(F.col("hash_b"))).cast("int"))
    )
    a = groups.select(F.col("hash").alias("hash_a"), F.col("copies").alias("copies_a"), F.col("first").alias("first_a"))
    b = groups.select(F.col("hash").alias("hash_b"), F.col("copies").alias("copies_b"), F.col("first").alias("first_b"))
    return pairs.join(a, "hash_a").join(b, "hash_b")


#: Hashes that may share a key before the key is refined.
CROWD = 1000
#: Hashes of a block; a task compares whole blocks, two at a time.
BLOCK = 1 << 14
#: Tasks that pairs of blocks are dealt to, at most; hashes compared by one call; pairs of an Arrow batch, at least.
MOST_TASKS, CHUNK, FULL = 20_000, 1 << 17, 1 << 16
PAIRS = "hash_a bigint, hash_b bigint, distance int"


def _parts(varying: Column, parts: int) -> Column:
    """The set bits of a mask, dealt into so many masks."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftrightunsigned", varying, b).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    placed = F.transform(bits, lambda b, i: F.struct(b.alias("bit"), (i % parts).alias("part")))

    def mask(part: Column) -> Column:
        mine = F.filter(placed, lambda x: x["part"] == part)
        return F.aggregate(mine, F.lit(0).cast("bigint"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x["bit"])))

    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), mask)


def _close(a: np.ndarray, b: np.ndarray, same: bool, max_distance: int) -> Iterator[pa.RecordBatch]:
    """The close pairs of two sorted blocks, or within one, some rows of ``a`` at a time."""
    held, n = [], 0
    step = max(1, CHUNK // len(b))
    for start in range(0, len(a), step):
        mine, rest = a[start:start + step], b[start:] if same else b
        apart = np.bitwise_count((mine[:, None] ^ rest).view(np.uint64))
        i, j = np.divmod(np.flatnonzero(apart <= max_distance), len(rest))
        if same:
            i, j = i[j > i], j[j > i]
        held.append((np.minimum(mine[i], rest[j]), np.maximum(mine[i], rest[j]), apart[i, j].astype(np.int32)))
        n += len(i)
        if n >= FULL or start + step >= len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], ["hash_a", "hash_b", "distance"])
            held, n = [], 0


def _compared(keyed: DataFrame, whole: DataFrame, max_distance: int, block: int) -> DataFrame:
    """All close pairs under the keys of ``whole`` (key, n), by comparing everything: hashes are dealt into blocks, and each two blocks of a
    key, and each with itself, meet in one task."""
    whole = whole.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    meetings = whole.agg(F.sum(F.expr("cast(blocks as bigint) * (blocks + 1) div 2"))).first()[0]
    placed = keyed.join(whole, "key").withColumn("mine", F.pmod(F.xxhash64(F.lit("block"), "hash"), F.col("blocks")).cast("int"))
    packed = placed.groupBy("key", "blocks", "mine").agg(F.collect_list("hash").alias("hashes"))
    dealt = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "hashes") \
        .repartition(min(meetings, MOST_TASKS), "key", "low", "high").sortWithinPartitions("key", "low", "high")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waits = None
        for batch in batches:
            for key, low, high, hashes in zip(*(batch.column(c) for c in ("key", "low", "high", "hashes"))):
                at, mine = (key.as_py(), low.as_py(), high.as_py()), np.sort(hashes.values.to_numpy())
                if at[1] == at[2]:
                    yield from _close(mine, mine, True, max_distance)
                elif waits and waits[0] == at:
                    yield from _close(waits[1], mine, False, max_distance)
                else:
                    waits = at, mine

    return dealt.mapInArrow(meet, PAIRS)


def close_pairs(hashes: DataFrame, col: str, max_distance: int, bits: int = 64, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """``(hash_a, hash_b, distance)`` for distinct hashes at most ``max_distance`` bits apart, by pigeonhole.

    Hashes meet under a key. Where more than ``crowd`` share one, the bits in which they differ are dealt into one part more than may
    differ, and they meet under the parts instead: two close hashes agree in a part, so no pair is lost. This goes on as long as a
    part tells more hashes apart than there are parts, which would else cost more than it saves. What is crowded still is compared whole:
    the work grows with the square of such a key's hashes (from a distance of 11 on that is all of them), but is cut into pairs of blocks of some
    ``block`` hashes, one task each. ``hash_a`` is the smaller signed number. Null hashes take no part.
    """
    if not 0 < max_distance < bits <= 64:
        raise ValueError("the distance must be at least 1 and less than the bits")
    parts = max_distance + 1
    worth = 1.5 * parts * log2(parts)
    keyed = hashes.select(F.col(col).alias("hash")).where("hash is not null").distinct().withColumn("key", F.lit(0).cast("bigint"))
    keyed, out, refined = pin(keyed, "keyed"), None, None
    while True:
        sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_or("hash").bitwiseXOR(F.bit_and("hash")).alias("varying"))
        crowded = F.col("n") > crowd
        sizes = pin(sizes.where("n > 1").withColumns({"crowded": crowded & (F.bit_count("varying") > worth), "whole": crowded & (F.bit_count("varying") <= worth)}), "sizes")
        few = keyed.join(sizes.where("not crowded and not whole").select("key"), "key", "left_semi")
        pairs = few.select(F.col("hash").alias("hash_a"), "key").join(few.select(F.col("hash").alias("hash_b"), "key"), "key").where("hash_a < hash_b") \
            .select("hash_a", "hash_b", F.bit_count(F.col("hash_a").bitwiseXOR(F.col("hash_b"))).cast("int").alias("distance")).where(F.col("distance") <= max_distance)
        out = pairs if out is None else out.unionByName(pairs)
        whole = sizes.where("whole").select("key", "n")
        if not whole.isEmpty():
            out = out.unionByName(_compared(keyed, whole, max_distance, block))
        crowded = sizes.where("crowded").select("key", _parts(F.col("varying"), parts).alias("masks"))
        if crowded.isEmpty():
            return out if refined is None else out.distinct()  # a pair may meet under several parts
        refined = keyed.join(crowded, "key").select("hash", "key", F.posexplode("masks").alias("part", "mask"))
        keyed = pin(refined.select("hash", F.xxhash64("key", "part", F.col("hash").bitwiseAND(F.col("mask"))).alias("key")), "keyed")


def look_alikes(df: DataFrame, col: str, order: str, max_distance: int, bits: int = 64, out: str = "group") -> DataFrame:
    """``df`` with the hash that stands for all look-alikes of a row's hash: that of the group's first row by ``order``.

    Hashes are alike if at most ``max_distance`` bits differ, or if a chain of such hashes leads from one to the other. Copies are
    folded first. A null hash has a null group. Ties of ``order`` go to the lesser hash.
    """
    copies = pin(df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_hash")).agg(F.min(order).alias("_first")), "copies")
    groups = linked_groups(close_pairs(copies, "_hash", max_distance, bits), "hash_a", "hash_b")
    placed = copies.join(groups, F.col("_hash") == F.col("member"))
    stands = placed.groupBy("group").agg(F.min(F.struct("_first", "_hash"))["_hash"].alias("_stands"))
    named = placed.join(stands, "group").where("_hash <> _stands").select("_hash", "_stands")
    return df.join(named, F.col(col) == F.col("_hash"), "left").withColumn(out, F.coalesce("_stands", col)).drop("_hash", "_stands")
