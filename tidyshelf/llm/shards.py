"""Sharding by sampled splitters.

Records are ordered by a hash of their text, then by id, so equal texts lie side by side. A sample that draws records
by size gives splitters, splitters give ranges, and ranges that turn out too full are subdivided by a
further sample until each is small. Range sums then place every record at its byte offset, and the offset
gives the shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyshelf.llm.common import query, table, whole
from tidyshelf.session import pin

SHARDS = 24
#: Keys drawn from one range, on average, and ranges made of it: bounds for what is gathered in one row.
SAMPLE, RANGES = 16_384, 1_024
#: A range of more records than this is subdivided.
FULL = 200_000


def subdivide(rows: DataFrame, round_: int, sample: int, ranges: int) -> DataFrame:
    """``rows`` (key, path, room, members and more), each path lengthened by the number of its part of the range.

    ``room`` and ``members`` are the range's size and its number of records. A record's chance to be drawn is the mean of its
    parts of both, times ``sample``, so that neither many small records nor few large ones stay together; one with a
    chance over 1 is drawn and weighs as much. Quantiles of the weighted sample are the splitters, at most a little over ``ranges``.
    """
    chance = F.lit(sample / 2) * (F.col("size") / F.col("room") + F.lit(1.0) / F.col("members"))
    draw = F.pmod(F.xxhash64("key", F.lit(round_)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.where(draw < chance).select("path", "key", F.greatest(F.lit(1.0), chance).alias("w"))
    order = Window.partitionBy("path").orderBy("key")
    step = F.floor(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)) * ranges / sample)
    cuts = drawn.withColumn("step", step).withColumn("before", F.lag("step", 1, 0).over(order)).where("step > before") \
        .groupBy("path").agg(F.sort_array(F.collect_list("key")).alias("splitters"))
    powers = F.array(*[F.lit(1 << s) for s in reversed(range((2 * ranges).bit_length()))])
    place = F.aggregate(powers, F.lit(0), lambda at, power: F.when(
        (at + power <= F.size("splitters")) & (F.get("splitters", at + power - 1) <= F.col("key")), at + power).otherwise(at))
    found = rows.join(pin(cuts, "splitters"), "path", "left")
    return found.withColumn("path", F.concat("path", F.array(F.when(F.col("splitters").isNull(), 0).otherwise(place)))).drop("splitters", "room", "members")


def ranged(rows: DataFrame, total: int, count: int, sample: int, ranges: int, full: int) -> DataFrame:
    """``rows`` (key, size and more) with a ``path`` that sorts as the keys do; at most ``full`` rows have the same.

    Keys must differ. Each round subdivides only the ranges that are still too full.
    """
    open_, done, round_ = rows.withColumns({"path": F.array().cast("array<int>"), "room": F.lit(total).cast("long"), "members": F.lit(count).cast("long")}), None, 0
    while True:
        round_ += 1
        split = pin(subdivide(open_, round_, sample, ranges), "ranges")
        heavy = pin(split.groupBy("path").agg(F.count("*").alias("members"), F.sum("size").alias("room")).where(F.col("members") > full), "overfull")
        if heavy.isEmpty():
            return split if done is None else done.unionByName(split)
        settled = split.join(heavy, "path", "left_anti").select(split.columns)
        done = settled if done is None else done.unionByName(settled)
        open_ = split.join(heavy, "path")


def shard_by_bytes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS,
                   sample: int = SAMPLE, ranges: int = RANGES, full: int = FULL) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    Size is the text's UTF-8 bytes plus 8. Shards are runs of the order whose sizes differ by one
    record at most; equal texts stay together but where a shard's end falls among them. ``slot`` numbers a shard's
    records from 0 without gaps, in the same order. Null texts are empty, null ids come first, repeated rows get
    a slot each, an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(whole(text)).cast("long") + 8).alias("size"),
                       F.crc32(whole(text).cast("binary")).alias("text_crc32"), F.xxhash64(whole(text)).alias("hash"))
    # the row number is fixed by writing it once; it only tells repeated rows apart
    rows = pin(rows.withColumn("row", F.monotonically_increasing_id()), "records")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(1)), F.greatest(F.count("*"), F.lit(1))).first()
    placed = ranged(rows.select(F.struct("hash", "doc_id", "row").alias("key"), "size", "text_crc32"), total, count, sample, ranges, full)
    order = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = placed.groupBy("path").agg(F.sum("size").alias("s"), F.count("*").alias("n")).select(
        "path", F.coalesce(F.sum("s").over(order), F.lit(0)).alias("start"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"))
    inside = Window.partitionBy("path").orderBy("key")
    until = F.col("start") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    # a record belongs where its middle lies, so an end errs by half a record
    middle = (until * 2 - F.col("size")).cast("decimal(38,0)")
    at = placed.join(starts, "path").select(
        "key.doc_id", "size", "text_crc32", F.least(F.floor(middle * shards / F.lit(2 * total)), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("first") + F.row_number().over(inside) - 1).alias("no"))
    at = pin(at, "offsets")
    first = at.groupBy("shard").agg(F.min("no").alias("from"))  # a row for each shard
    return at.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("no") - F.col("from")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query("op5_sharding")
def op5_sharding(spark, folder: str) -> DataFrame:
    return shard_by_bytes(table(spark, folder, "documents").select("doc_id", "text"))
