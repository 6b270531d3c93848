"""Record stages on arriving data: the batch functions, chained, and the stateful ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidyshelf.operators.keys import drop_known_content
from tidyshelf.sources.sinks import write_by_type

Stage = Callable[[DataFrame], DataFrame]
#: Records that are gathered before a task combines them, besides those it holds; bytes that it holds at most.
COMBINED, HELD_BYTES = 1 << 16, 1 << 25


def apply_stages(df: DataFrame, stages: Sequence[tuple[int, Stage]]) -> DataFrame:
    """Chain stages by ascending priority, ties in listed order. Works on batch and stream alike."""
    for _, stage in sorted(stages, key=lambda s: s[0]):
        df = df.transform(stage)
    return df


def dedup_arrivals(stream: DataFrame, keys: Sequence[str], event_time: str | None = None,
                   delay: str | None = None) -> DataFrame:
    """The first arrival per key passes, later ones are dropped.

    With an event time, keys are remembered for ``delay`` past the watermark, which bounds the
    state; a copy that arrives later than that passes again. Without one, keys are remembered for
    the whole run and the state grows with them.
    """
    if event_time is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def _firsts(rows: pa.Table, keys: Sequence[str], order: str) -> pa.Table:
    """The row of least order per key, nulls last, ties to the row that comes first."""
    ranked = pc.sort_indices(rows.select([order]), sort_keys=[(order, "ascending")])
    held = pa.Table.from_arrays([*rows.select(keys).take(ranked).columns, pa.array(np.arange(len(rows)))], [*map(str, range(len(keys))), "at"])
    best = held.group_by([str(i) for i in range(len(keys))], use_threads=False).aggregate([("at", "min")])["at_min"]
    return rows.take(ranked.take(best.combine_chunks()))


def first_arrivals(stream: DataFrame, keys: Sequence[str], order: str, buckets: int = 4096) -> DataFrame:
    """The whole first record per key: of the batch in which the key is first seen, the one of least ``order``.

    State is the key alone, kept for the whole run. A batch's records are combined before they are shuffled, so a hot key is no hot task, and
    once more bucket by bucket, many keys at a time; ``buckets`` bounds what is held at once. A batch of null orders alone keeps one of
    them. ``first_records`` bounds the state.
    """
    names, keys, types = stream.columns, list(keys), dict(stream.dtypes)
    # Arrow groups by plain values only
    plain = {c: f"_plain{i}" for i, c in enumerate(keys) if types[c].startswith(("struct", "array"))}
    held = stream.withColumns({p: F.to_json(F.struct(c), {"ignoreNullFields": "false"}) for c, p in plain.items()}) \
        .withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    by = [plain.get(c, c) for c in keys]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, kept = None, 0
        for batch in batches:
            rows = pa.Table.from_batches([*(rows.to_batches() if rows else []), batch])
            if len(rows) > 2 * kept + COMBINED:
                rows = _firsts(rows, by, order)
                kept = len(rows)
                if rows.nbytes > HELD_BYTES:
                    yield from rows.to_batches()
                    rows, kept = None, 0
        if rows:
            yield from _firsts(rows, by, order).to_batches()

    least = held.mapInArrow(combine, held.schema).groupBy("_bucket").applyInArrow(lambda rows: _firsts(rows, by, order).select(names), stream.schema)
    return least.dropDuplicates(keys)


def first_records(stream: DataFrame, keys: Sequence[str], order: str, event_time: str, gap: str, delay: str = "0 seconds") -> DataFrame:
    """The whole first record per key by ``order``, with bounded state.

    Records of a key belong together as long as no ``gap`` lies between their event times; of each such run the record of least order
    passes, once the watermark (``delay`` behind the latest event time) is past the run and its gap, and the key is forgotten. So
    the result does not depend on how records fall into batches, and a copy after the gap passes again. Later records than the
    watermark are dropped. Records are combined before they are shuffled, so a hot key is no hot task.
    """
    least = F.min_by(F.struct(*stream.columns), F.col(order)).alias("_first")
    runs = stream.withWatermark(event_time, delay).groupBy(*keys, F.session_window(event_time, gap).alias("_run")).agg(least)
    return runs.select("_first.*")


def drop_known_arrivals(stream: DataFrame, content: str, denylist: DataFrame, bits: int = 512) -> DataFrame:
    """Stream-static anti join with the list of known digests."""
    return drop_known_content(stream, content, denylist, bits=bits)


def resolve_arrivals(stream: DataFrame, ids: DataFrame, name: str, out: str) -> DataFrame:
    """Stream-static lookup name -> id; ``unresolved`` marks unknown names."""
    known = ids.select(F.col(name).alias("_name"), F.col(out))
    return (
        stream.join(known, F.col(name) == F.col("_name"), "left").drop("_name")
        .withColumn("unresolved", F.col(name).isNotNull() & F.col(out).isNull())
    )


def resolve_open_arrivals(facts: DataFrame, dims: DataFrame, name: str, out: str, at: str, since: str, wait: str,
                          delay: str = "0 seconds", salts: int = 16) -> DataFrame:
    """Facts with the id of their name, in whatever order facts and dimension rows arrive.

    A fact whose name is not known yet stays open until the dimension row comes. It is given up, and passes with ``unresolved`` set,
    once the watermark of both streams (the latest event time less ``delay``) is ``wait`` past the fact's own time ``at``; a dimension
    row whose own time ``since`` is later than that no longer counts, whether or not the fact is still open. The result is thus
    that of a batch join with the same condition. Facts without a name pass at that point, too, and are not unresolved.

    Dimension rows are remembered for good, open facts for ``wait``. ``dims`` has one row per name. A hot name's facts are dealt over
    ``salts`` tasks, by their time; each dimension row is copied to all of them.
    """
    salt = F.pmod(F.xxhash64(at), F.lit(salts)).cast("int")
    held = facts.withWatermark(at, delay).withColumn("_salt", salt)
    known = dims.select(F.col(name).alias("_name"), F.col(out).alias("_id"), F.col(since).alias("_since")).withWatermark("_since", delay) \
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    meets = (F.col(name) == F.col("_name")) & (F.col("_salt") == F.col("_part")) & (F.col("_since") <= F.col(at) + F.expr(f"INTERVAL {wait}"))
    joined = held.join(known, meets, "left")
    return joined.withColumn(out, F.col("_id")).withColumn("unresolved", F.col(name).isNotNull() & F.col("_name").isNull()) \
        .drop("_salt", "_name", "_id", "_since", "_part")


def start_fan_out(stream: DataFrame, type_col: str, folder: str, checkpoint: str,
                  orders: Mapping[str, Sequence[str]] | None = None, seq: str | None = None,
                  fmt: str = "json", available_now: bool = True):
    """Write each micro-batch as one file set per type.

    Every batch has its own folder, which a repeated batch replaces, so a restart neither loses nor
    doubles records.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        write_by_type(batch, type_col, f"{folder}/batch={batch_id}", orders, seq=seq, fmt=fmt, mode="overwrite")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_fan_out(spark: SparkSession, folder: str, schema: StructType, fmt: str = "json") -> DataFrame:
    """All batches of a fan-out as one table."""
    return spark.read.schema(schema).format(fmt).load(folder).select(*schema.names)


def run_to_table(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Run over everything available now into a parquet folder and read it back."""
    query = (
        stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)
