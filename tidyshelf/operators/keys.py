"""Ids, hashes, duplicates and content-addressed paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyshelf.functions.encoding import record_hash
from tidyshelf.functions.text import file_extension, literal_map
from tidyshelf.operators.ordering import number_by_key, number_sorted
from tidyshelf.session import pin


def add_ids(df: DataFrame, *order: str, initial: int = -1, id_col: str = "id") -> DataFrame:
    """Dense ids ``initial + 1 ...`` in row order as the first column.

    Nothing happens when any row has an id already. A single integer order column must be unique but
    for nulls, which come first, in arrival order; several columns should end with a unique one.
    """
    if id_col in df.columns:
        if not df.where(F.col(id_col).isNotNull()).isEmpty():
            return df
        df = df.drop(id_col)
    if len(order) == 1 and isinstance(df.schema[order[0]].dataType, T.IntegralType):
        if df.where(F.col(order[0]).isNull()).isEmpty():
            numbered = number_by_key(df, order[0], id_col, initial + 1)
        else:  # null is no unique key; the arrival number keeps many of them apart
            arrived = df.withColumn("_arrival", F.monotonically_increasing_id())
            numbered = number_sorted(arrived, order[0], "_arrival", name=id_col, start=initial + 1)
    else:
        numbered = number_sorted(df, *order, name=id_col, start=initial + 1)
    return numbered.select(id_col, *df.columns)


def max_ids(tables: Mapping[str, DataFrame], id_cols: Mapping[str, str] | str = "id") -> DataFrame:
    """Highest id per table; each table is reduced to one row before they meet."""
    parts = []
    for name, df in tables.items():
        id_col = id_cols if isinstance(id_cols, str) else id_cols[name]
        parts.append(df.select(F.lit(name).alias("table"), F.col(id_col).cast("bigint").alias("id"))
                     .groupBy("table").agg(F.max("id").alias("max_id")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def add_hash(df: DataFrame, attr: str = "hash", exclude: Sequence[str] = (), include: Sequence[str] = (),
             bits: int = 512) -> DataFrame:
    """Digest of the chosen fields."""
    return df.withColumn(attr, record_hash(df, [*exclude, attr], include, bits))


def duplicate_hashes(df: DataFrame, key: str = "hash") -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")


def dedup_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row per key; null equals null. ``order`` differs between the rows of a key; rows that tie all stay.

    Only keys and orders are aggregated, by hash and map-side combined; the rows themselves are joined
    back once, by key and order, so a hot key spreads over its orders.
    """
    return _at(df, keys, order, df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(order).alias("_o"))).select(*df.columns)


def _at(df: DataFrame, keys: Sequence[str], order: str, first: DataFrame) -> DataFrame:
    """The rows of ``df`` at ``(_k0 ..., _o)``, with all columns of both."""
    same = F.col(order).eqNullSafe(F.col("_o"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(first, same)


def merged_values(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Distinct values per key with the place each was first seen: ``(key, value, first_seen)``.

    The long form of a merged list. It never gathers a group, so any number of copies is fine.
    """
    return df.groupBy(key, value).agg(F.min(order).alias("first_seen"))


def dedup_merge(df: DataFrame, key: str, collect: Sequence[str], order: str) -> DataFrame:
    """One row per key, the first, with the named columns as lists of distinct values in first-seen order.

    Values of all lists are made distinct by one aggregation before any list is built, so a list is as
    long as the result it becomes, and the first order of a key is the least among them. A null key is a key.
    For columns with a value per row use ``merged_values``.
    """
    kinds = {c: df.schema[c].dataType for c in collect}
    one_each = [F.struct(F.lit(i).alias("_c"), *[(F.col(c) if j == i else F.lit(None)).cast(kinds[c]).alias(f"_v{j}") for j, c in enumerate(collect)])
                for i in range(len(collect))]
    values = df.select(F.col(key).alias("_k0"), F.col(order).alias("_o"), F.inline(F.array(*one_each)))
    seen = values.groupBy("_k0", "_c", *[f"_v{j}" for j in range(len(collect))]).agg(F.min("_o").alias("_o"))

    def listed(i: int) -> Column:
        held = F.collect_list(F.when(F.col("_c") == i, F.struct("_o", F.col(f"_v{i}").alias("v"))))
        return F.transform(F.array_sort(held), lambda s: s["v"]).alias(f"_l{i}")

    lists = seen.groupBy("_k0").agg(F.min("_o").alias("_o"), *[listed(i) for i in range(len(collect))])
    out = _at(df.drop(*collect), [key], order, lists)
    return out.select(*[F.col(f"_l{list(collect).index(c)}").alias(c) if c in collect else F.col(c) for c in df.columns])


def content_hash(content: Column, bits: int = 512) -> Column:
    """Digest of bytes or text as lower-case hex."""
    return F.sha2(content, bits)


#: Digests that are sent to all tasks as they are; bits of the filter for each digest of a longer list, at most and at least, and
#: bits of the largest filter (64 MB). A filter has chunks of CHUNK bits.
FEW, BITS_EACH, MOST_BITS, CHUNK = 100_000, (16, 4), 1 << 29, 1 << 15


def known_filter(digests: DataFrame, col: str, bits: int) -> DataFrame:
    """``(bucket, bitmap)`` with a bit set for every digest; ``may_be_known`` asks it."""
    mark = F.pmod(F.xxhash64(col), F.lit(bits)) + 1
    return digests.select(F.bitmap_bucket_number(mark).alias("_bucket"), F.bitmap_bit_position(mark).alias("_bit")) \
        .groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))


def may_be_known(df: DataFrame, col: str, marks: DataFrame, bits: int, out: str) -> DataFrame:
    """``df`` with whether the filter has the bit of a row's digest: never false for a digest that is in it."""
    mark = F.pmod(F.xxhash64(col), F.lit(bits)) + 1
    at = F.bitmap_bit_position(mark)
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    asked = df.withColumn("_bucket", F.bitmap_bucket_number(mark)).join(F.broadcast(marks), "_bucket", "left")
    is_set = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return asked.withColumn(out, F.coalesce(is_set, F.lit(False))).drop("_bucket", "_bitmap")


def drop_known_content(df: DataFrame, content: str, denylist: DataFrame, digest: str = "digest",
                       bits: int = 512, few: int = FEW) -> DataFrame:
    """Drop rows whose content digest is on the list.

    A list of at most ``few`` digests is sent to all tasks. A longer one becomes a filter of bits, which is (16 bits a digest and fewer where
    there are very many, so its size is bounded); digests that may be on the list are looked up in it without their rows, and the
    few that are there are sent to all tasks. Content is shuffled only where more than ``few`` digests of the table are on the
    list, and then that of rows which may be on it. A stream is joined with the list by whatever its size allows. Rows without content stay.
    """
    known = denylist.select(F.col(digest).alias("_known")).where("_known is not null").distinct()
    of = content_hash(F.col(content), bits)
    if df.isStreaming:
        return df.join(known, of == F.col("_known"), "left_anti")
    known = pin(known, "known")
    count = known.count()
    if count <= few:
        return df.join(F.broadcast(known), of == F.col("_known"), "left_anti")
    size = -(-min(BITS_EACH[0] * count, MOST_BITS) // CHUNK) * CHUNK
    if size < BITS_EACH[1] * count:
        return df.join(known, of == F.col("_known"), "left_anti")
    marks = pin(known_filter(known, "_known", size), "marks")
    possible = may_be_known(df.select(of.alias("_digest")), "_digest", marks, size, "_may").where("_may").select("_digest").distinct()
    hits = pin(possible.join(known, F.col("_digest") == F.col("_known"), "left_semi"), "hits")
    if hits.count() <= max(few, FEW):
        return df.join(F.broadcast(hits), of == F.col("_digest"), "left_anti")
    flagged = may_be_known(df.withColumn("_of", of), "_of", marks, size, "_may")
    rest = flagged.where("_may").join(hits, F.col("_of") == F.col("_digest"), "left_anti")
    return flagged.where("not _may").unionByName(rest).drop("_of", "_may")


def fingerprint_path(kind: Column, fingerprint: Column, name: Column, roots: Mapping[str, str]) -> Column:
    """Type root, fingerprint and the extension of the name as one path; look-alikes share it."""
    return F.concat(F.try_element_at(literal_map(roots), kind), fingerprint, F.lit("."), file_extension(name))


def path_collisions(df: DataFrame, path: str = "path") -> DataFrame:
    """Paths claimed by more than one row."""
    return duplicate_hashes(df, path)
