"""Large files that are one JSON array of objects each, read by many tasks.

A reader that starts somewhere in a file knows neither whether it is inside a string nor how deep it is. Both follow from what
lies before, so every byte range is first reduced to what it does to either: whether it ends in another string state than
it starts in, and how deep it goes for both states. Sums of these along a file give each range its start, and then all
ranges are cut into records at once. What a range holds of a record that it does not hold whole is put together by the
record's number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyshelf.session import pin

#: Ranges whose starts are sent to all tasks; a range is as long as the session's largest file partition.
MOST_RANGES = 1 << 20
_ESCAPED = re.compile(r"\\.", re.DOTALL)
_STRING_OR_OBJECT = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|\{', re.DOTALL)


def _depth(text: str) -> int:
    return text.count("{") + text.count("[") - text.count("}") - text.count("]")


def _plain(piece: str) -> str:
    return _ESCAPED.sub("", piece) if "\\" in piece else piece


def _first_object(piece: str, quoted: bool) -> int:
    """Where the first bracket of an object is, outside of strings; -1 if there is none."""
    found = (m.start() for m in _STRING_OR_OBJECT.finditer('"' + piece if quoted else piece) if m.group() == "{")
    return next(found, quoted - 1) - quoted


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, range, whether the string state turns, depth gained outside of strings from either state), in parts of a range.

    Parts are numbered, for the order of a range's batches counts.
    """
    part = 0
    for batch in batches:
        values, files, blocks = (batch.column(c).to_pylist() for c in ("value", "file", "block"))
        start = 0
        while start < len(values):
            end = start
            while end < len(values) and blocks[end] == blocks[start] and files[end] == files[start]:
                end += 1
            outside = _plain("}".join(values[start:end]) + "}").split('"')
            yield pa.RecordBatch.from_pydict({
                "file": [files[start]], "block": [blocks[start]], "part": [part], "turns": [(len(outside) - 1) % 2],
                "plain": [sum(map(_depth, outside[::2]))], "quoted": [sum(map(_depth, outside[1::2]))]})
            part, start = part + 1, end


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, range, number, whole, text): records that begin in the range by number from 0, and -1 for the rest of one that began before."""
    at, quoted, depth, number, held, rows = None, False, 0, -1, [], []

    def put(whole: bool) -> None:
        rows.append((*at, number, whole, "".join(held)))
        held.clear()

    for batch in batches:
        for value, file, block, q, d in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block", "quoted", "depth"))):
            if at != (file, block):
                if held:
                    put(False)
                at, quoted, depth, number = (file, block), bool(q), d, -1
                inside = depth > 1  # a record that began before
                begun_here = False
            outside = _plain(value).split('"')
            if not inside:
                opens = _first_object(value, quoted)
                if opens >= 0:
                    value, inside, begun_here, number = value[opens:], True, True, number + 1
            depth += sum(map(_depth, outside[quoted::2]))
            quoted ^= (len(outside) - 1) % 2 == 1
            if inside:
                held.append(value + "}")
            if not quoted:
                depth -= 1
                if inside and depth == 1:
                    put(begun_here)
                    inside = False
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["file", "block", "number", "whole", "text"])
            rows = []
    if held:
        put(False)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["file", "block", "number", "whole", "text"])


def read_array(spark: SparkSession, path: str, schema: T.StructType | str, seq: str = "seq") -> DataFrame:
    """The objects of the arrays at ``path``, with their dense order along file names and places as ``seq``.

    Files are split into ranges like files of lines, whether the array has line breaks or not. A record is read by one task, but may span
    ranges. Elements of an array are objects; other plain values give no rows.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    parts = pin(pieces.mapInArrow(_reduce, "file string, block long, part long, turns long, plain long, quoted long"), "ranges")
    before = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    state = parts.withColumn("quoted_at", F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2 == 1) \
        .withColumn("gain", F.when(F.col("quoted_at"), F.col("quoted")).otherwise(F.col("plain"))) \
        .withColumn("depth", F.coalesce(F.sum("gain").over(before), F.lit(0)))
    starts = state.groupBy("file", "block").agg(F.min_by("quoted_at", "part").alias("quoted"), F.min_by("depth", "part").alias("depth"))
    starts = pin(starts, "starts")
    if starts.count() > MOST_RANGES:
        raise ValueError(f"over {MOST_RANGES} ranges: set spark.sql.files.maxPartitionBytes higher")
    cut = pin(pieces.join(F.broadcast(starts), ["file", "block"]).select("value", "file", "block", "quoted", "depth")
              .mapInArrow(_cut, "file string, block long, number long, whole boolean, text string"), "records")
    counts = cut.groupBy("file", "block").agg((F.max("number") + 1).alias("n"))
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = counts.groupBy("file").agg(F.sum("n").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0))).select("file", "first")
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("base", F.coalesce(F.sum("n").over(along), F.lit(0))).join(files, "file") \
        .select("file", "block", (F.col("first") + F.col("base")).alias("first"))
    placed = cut.join(F.broadcast(firsts), ["file", "block"]).select((F.col("first") + F.col("number")).alias(seq), "block", "whole", "text")
    broken = placed.where("not whole").groupBy(seq).agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p")) \
        .select(seq, F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    records = placed.where("whole").select(seq, "text").unionByName(broken)
    return records.select(F.from_json("text", schema).alias("_record"), seq).select("_record.*", seq)
