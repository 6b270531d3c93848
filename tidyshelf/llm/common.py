"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query of this subpackage, with the SQL that gives the same rows if there is any."""
    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def whole(text: str) -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The given names, lengthened until no column of ``df`` has them (case does not count)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of an Arrow batch; texts may be long, and a Python worker holds several copies of a batch.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches cut to BATCH_ROWS rows; a smaller setting stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


#: Rows that a table of marks has at most, a power of two; each holds the marks of 64 hashes as bits.
MARKS = 1 << 20


def sift(df: DataFrame, wanted: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` that may have their keys in ``wanted``, and those that surely have not.

    Both sides get a mark, a hash of the keys that takes at most 64 * MARKS values. The marks wanted are
    broadcast as bits, a table of bounded size, so only rows that may be needed go into the shuffle of a following join.
    """
    mark, bit, at, bits = fresh(df, "__mark", "__bit", "__at", "__bits")
    of = F.xxhash64(*keys)
    own = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(of, 32).bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
    row = of.bitwiseAND(F.lit(MARKS - 1).cast("bigint"))
    marks = F.broadcast(wanted.select(row.alias(at), own.alias(bit)).groupBy(at).agg(F.bit_or(bit).alias(bits)))
    marked = df.withColumns({mark: row, bit: own})
    met = (F.col(mark) == F.col(at)) & (F.col(bit).bitwiseAND(F.col(bits)) != 0)
    # marks are never null and have one row each; a semi join, or one on keys that may be null, would be pushed below the keys and work them out once more
    return marked.join(marks, met).drop(mark, bit, at, bits), marked.join(marks, met, "left_anti").drop(mark, bit)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole blocks from rows sorted by ``block``: several small ones together, none cut in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("block").to_numpy()
        cut = int(np.searchsorted(ids, ids[-1]))  # the last block may go on
        if cut or (held and held[-1].column("block")[-1].as_py() != ids[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def fixed(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """One array from a column of binary values of whole numbers of items."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def stacked(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix of doubles) for each length of the column's lists; there are no nulls in it."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    starts = np.cumsum(lengths) - lengths
    out = []
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        out.append((rows, flat[starts[rows][:, None] + np.arange(length)]))
    return out
