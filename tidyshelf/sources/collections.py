"""Reading record collections, nested documents, override memories and file lists."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyshelf.operators.ordering import number_sorted

MEMORY_SCHEMA = "memory map<string, map<string, map<string, string>>>"


def read_collection(spark: SparkSession, path: str, schema: T.StructType | str, seq: str = "seq",
                    multi_line: bool = True, by_path: bool = False) -> DataFrame:
    """JSON records -> table with the input order as ``seq``.

    A file is one array of records; with ``multi_line=False`` every line is a record or an array of
    them, and files are split. ``seq`` grows along each file. With ``by_path`` it is dense and
    follows file name, then place in the file, at the price of one pinned sort.
    """
    rows = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    columns = rows.columns
    if not by_path:
        return rows.withColumn(seq, F.monotonically_increasing_id())
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_row"))
    return number_sorted(rows, "_file", "_block", "_row", name=seq).select(*columns, seq)


def explode_wrapped(df: DataFrame, arrays: tuple[str, str], wrappers: tuple[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of a nested document: the first array unless it is empty, unwrapped by the first key
    that is set. Adds ``pos``; ``keep`` names document columns to carry along."""
    array_fields = {a: df.schema[a].dataType.elementType.fieldNames() for a in arrays}

    def unwrapped(array):
        present = [w for w in wrappers if w in array_fields[array]]
        return F.transform(F.col(array), lambda x: F.coalesce(*[x[w] for w in present]))

    chosen = F.when(F.size(arrays[0]) > 0, unwrapped(arrays[0])).otherwise(unwrapped(arrays[1]))
    return df.select(*keep, F.posexplode(chosen).alias("pos", "record")).select(*keep, "pos", "record.*")


def read_overrides(df: DataFrame, memory: str = "memory") -> DataFrame:
    """Three-level map -> ``(source, field, pk, pk_number, value)``; any number of documents is read."""
    rows = df.select(F.explode(memory).alias("source", "_fields")) \
        .select("source", F.explode("_fields").alias("field", "_answers")) \
        .select("source", "field", F.explode("_answers").alias("pk", "value"))
    number = F.when(F.rlike("pk", F.lit("^[0-9]+$")), F.col("pk").try_cast("bigint"))
    return rows.select("source", "field", "pk", number.alias("pk_number"), "value")


def read_or_default(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str = "parquet",
                    default: bool = True, **options) -> DataFrame:
    """The table at the path; when nothing is there, an empty one of the schema if a default is wanted."""
    try:
        reader = spark.read.format(fmt).options(**options)
        return (reader.schema(schema) if schema is not None else reader).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND" or not default or schema is None:
            raise
        return spark.createDataFrame([], schema)


def read_hash_list(spark: SparkSession, path: str, out: str = "digest") -> DataFrame:
    """Digests of a white-space separated text as a table of distinct values."""
    words = F.explode(F.split("value", r"\s+")).alias(out)
    return spark.read.text(path).select(words).where(F.col(out) != "").distinct()


def list_files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """Every file below a folder with its relative path and length; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    # the known root in front, with or without scheme and host, and nothing further in
    marker = re.sub("^[a-z0-9+.-]+:", "", folder.rstrip("/")).lstrip("/") + "/"
    root = F.regexp_extract(F.col("path"), f"^(?:[a-z0-9+.-]+:)?/*(?:[^/]*/)?{re.escape(marker)}", 0)
    inside = F.when(root == "", F.locate(marker, F.col("path")) + len(marker)).otherwise(F.length(root) + 1)
    return reader.load(folder).select(F.substring(F.col("path"), inside, F.length("path")).alias("path"), "length")
