"""Row order: sorts and dense numbers without a single-task window over the data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyshelf.session import pin

# Bits of a 64-bit key resolved per level: rows, then groups of rows, then groups of groups.
ROW_BITS, GROUP_BITS = 16, 24


def _ascending(order) -> list[Column]:
    return [F.asc_nulls_first(o) if isinstance(o, str) else o for o in order]


def sort_rows(df: DataFrame, *cols: str, seq: str | None = None) -> DataFrame:
    """Ascending sort, nulls first; ``seq`` breaks ties in arrival order."""
    return df.orderBy(*_ascending(cols), *([F.asc(seq)] if seq else []))


def sort_rows_by(df: DataFrame, key: Column, seq: str | None = None) -> DataFrame:
    """Sort by an expression over the row."""
    return df.orderBy(key.asc_nulls_first(), *([F.asc(seq)] if seq else []))


def sort_array_column(df: DataFrame, col: str, key: Callable[[Column], Column] | None = None) -> DataFrame:
    """Sort the list inside each row, by its values or stably by a key of each value."""
    if key is None:
        return df.withColumn(col, F.array_sort(col))
    keyed = F.transform(F.col(col), lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return df.withColumn(col, F.transform(F.array_sort(keyed), lambda s: s["x"]))


def number_sorted(df: DataFrame, *order, name: str = "seq", start: int = 0) -> DataFrame:
    """Dense numbers in the order of any columns.

    One range-partitioned sort, pinned so that its row slots hold; then each partition's start is
    added. The start table has one row per sort partition, hence the window and the broadcast.
    End ``order`` with a unique column to break ties and to split runs of equal keys.
    """
    slots = df.orderBy(*_ascending(order)).withColumn("_slot", F.monotonically_increasing_id())
    slots = pin(slots, "sorted")
    block = F.shiftright("_slot", 33)
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        slots.groupBy(block.alias("_block")).agg(F.count("*").alias("_n"))
        .select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        slots.withColumn("_block", block).join(F.broadcast(starts), "_block")
        .withColumn(name, F.col("_start") + inside + F.lit(start)).drop("_block", "_slot", "_start")
    )


def _starts(counts: DataFrame, bits: int | None) -> DataFrame:
    """(_b, _n) -> (_b, _start): how many rows lie in lower groups."""
    if bits is None:
        before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        return counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    counts = counts.withColumn("_up", F.shiftright("_b", bits))
    upper = _starts(counts.groupBy(F.col("_up").alias("_b")).agg(F.sum("_n").alias("_n")), None)
    before = Window.partitionBy("_up").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("_in", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return within.join(upper.withColumnRenamed("_b", "_up"), "_up").select(
        "_b", (F.col("_start") + F.col("_in")).alias("_start"))


def number_by_key(df: DataFrame, key: str, name: str = "seq", start: int = 0) -> DataFrame:
    """Dense numbers in the order of a unique integer key; lazy, nothing is written.

    Rows are grouped by the upper bits of the key. Uniqueness bounds every group: 2**16 rows below,
    2**24 groups of rows above, 2**24 groups of those at the top, whatever the key's distribution.
    """
    base = F.col(key).cast("bigint")
    counts = df.groupBy(F.shiftright(base, ROW_BITS).alias("_b")).agg(F.count("*").alias("_n"))
    starts = _starts(counts, GROUP_BITS)
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(base))
    return (
        df.withColumn("_b", F.shiftright(base, ROW_BITS)).withColumn("_rank", rank)
        .join(starts, "_b")
        .withColumn(name, F.col("_start") + F.col("_rank") - 1 + F.lit(start))
        .drop("_b", "_rank", "_start")
    )
