"""Writing one file set per record type, and the override memory."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidyshelf.operators.quality import merge_answers
from tidyshelf.session import file_names, pin, put_new, read_small
from tidyshelf.sources.collections import MEMORY_SCHEMA, read_overrides


def write_by_type(df: DataFrame, type_col: str, folder: str, orders: Mapping[str, Sequence[str]] | None = None,
                  known: Sequence[str] = (), seq: str | None = None, fmt: str = "json", mode: str = "append") -> DataFrame:
    """One folder ``type_col=value`` per record type; returns the rows per type now in the folder,
    empty known types included. After an overwrite these are counted in the input's type column alone; only
    appending reads the folder.

    ``orders`` names the sort columns of some types, nulls first; ties and other types keep the order
    of ``seq``, or else of arrival. Rows are range-partitioned by type and all of these, so a large
    type, or one sort key of it, spreads over many files, in file-name order. Types without rows get
    an empty folder of their schema.
    """
    columns = df.columns
    if seq is None:
        seq, df = "_arrival", df.withColumn("_arrival", F.monotonically_increasing_id())
    keys = [F.col(type_col).asc_nulls_first()]
    for kind, names in (orders or {}).items():
        keys += [F.when(F.col(type_col) == kind, F.col(c)).asc_nulls_first() for c in names]
    keys.append(F.col(seq).asc())
    spark = df.sparkSession
    seen, source = None, df
    if known:
        seen = Observation()
        source = df.observe(seen, *[F.count_if(F.col(type_col) == k).alias(f"n{i}") for i, k in enumerate(known)])
    df = df.select(*columns)
    ordered = source.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*columns)
    ordered.write.mode(mode).format(fmt).partitionBy(type_col).save(folder)
    for i, kind in enumerate(known):
        if seen.get[f"n{i}"] == 0:
            df.drop(type_col).limit(0).write.mode(mode).format(fmt).save(f"{folder}/{type_col}={kind}")
    written = df if mode == "overwrite" else spark.read.format(fmt).schema(df.schema).load(folder)
    counts = written.groupBy(F.col(type_col).cast("string").alias(type_col)).agg(F.count("*").alias("rows"))
    expected = spark.createDataFrame([(k,) for k in known], f"{type_col} string")
    return counts.join(expected, type_col, "full").select(type_col, F.coalesce("rows", F.lit(0)).alias("rows"))


def pack_overrides(df: DataFrame, entries: int = 5000) -> DataFrame:
    """Long answers ``(source, field, pk, value)``, one per key, -> documents with a three-level map.

    Keys are spread over as many documents as keep a map at about ``entries``, so that none holds
    all answers of a field. ``read_overrides`` takes any number.
    """
    shards = -(-df.count() // entries) or 1
    shard = F.pmod(F.xxhash64("pk"), F.lit(shards)).alias("shard")
    answers = df.groupBy("source", "field", shard).agg(
        F.map_from_entries(F.collect_list(F.struct("pk", "value"))).alias("answers"))
    return answers.select(
        "shard", F.create_map("source", F.create_map("field", "answers")).alias("memory"))


def write_overrides(df: DataFrame, folder: str, entries: int = 5000) -> None:
    """The packed memory as JSON documents."""
    pack_overrides(df, entries).select("memory").write.mode("overwrite").json(folder)


def update_overrides(spark: SparkSession, folder: str, new: DataFrame, skip: str | None = "", shards: int = 256, entries: int = 5000) -> list[int]:
    """Merge new answers into a memory kept in place, and return the shards that were written.

    Keys are dealt over a number of shards that the folder keeps from its first use on, whatever ``shards`` says later. Only shards
    of new answers are read, merged as in ``merge_answers`` and replaced; each has documents of about ``entries`` answers, which
    ``read_overrides`` takes. Nothing is replaced before all new documents are written. One writer at a time.
    """
    put_new(spark, f"{folder.rstrip('/')}/_shards", str(shards))
    shards = int(read_small(spark, f"{folder.rstrip('/')}/_shards"))
    shard = F.pmod(F.xxhash64("source", "field", "pk"), F.lit(shards)).cast("int").alias("shard")
    new = pin(new.select("source", "field", "pk", "value", "version") if skip is None else
              new.where(~F.col("value").eqNullSafe(skip)).select("source", "field", "pk", "value", "version"), "answers")
    touched = sorted(r.shard for r in new.select(shard).distinct().collect())
    if not touched:
        return []
    present = {n for n in file_names(spark, folder) if n.startswith("shard=")}
    old = [f"{folder.rstrip('/')}/shard={s}" for s in touched if f"shard={s}" in present]
    memory = read_overrides(spark.read.schema(MEMORY_SCHEMA).json(old)) if old else new.limit(0)
    merged = pin(merge_answers(memory.select("source", "field", "pk", "value"), new, skip=None).withColumn("shard", shard), "merged")
    parts = -(-merged.groupBy("shard").count().agg(F.max("count")).first()[0] // entries)
    answers = merged.groupBy("shard", F.pmod(F.xxhash64("pk"), F.lit(parts)).alias("part"), "source", "field").agg(
        F.map_from_entries(F.collect_list(F.struct("pk", "value"))).alias("answers"))
    packed = answers.select("shard", F.create_map("source", F.create_map("field", "answers")).alias("memory"))
    packed.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false") \
        .partitionBy("shard").json(folder)
    return touched


def append_records(df: DataFrame, new: DataFrame) -> DataFrame:
    """Records added at the end; columns one side lacks are null."""
    return df.unionByName(new, allowMissingColumns=True)
