"""Relational modelling: foreign keys, dimensions, bridges and lookups.

Lookups are plain left joins without a hint. Spark broadcasts the dimension when its size allows,
and otherwise splits hot fact keys at run time, which a left join permits on the fact side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyshelf.functions.text import file_stem
from tidyshelf.operators.keys import add_ids
from tidyshelf.session import pin

UNRESOLVED = "unresolved"


def resolve_fk(facts: DataFrame, dim: DataFrame, name: str, dim_name: str, order: str, out: str,
               initial: int = -1) -> DataFrame:
    """Name -> id of the dimension numbered in arrival order; the last id wins on a repeated name.

    ``unresolved`` marks facts that hold a name without a match.
    """
    numbered = add_ids(pin(dim.select(dim_name, order), "dimension"), order, initial=initial, id_col=out)
    ids = numbered.groupBy(F.col(dim_name).alias(name)).agg(F.max(out).alias(out))
    return facts.join(ids, name, "left").withColumn(UNRESOLVED, F.col(name).isNotNull() & F.col(out).isNull())


def resolved(df: DataFrame) -> DataFrame:
    return df.where(~F.col(UNRESOLVED)).drop(UNRESOLVED)


def unresolved(df: DataFrame) -> DataFrame:
    return df.where(F.col(UNRESOLVED)).drop(UNRESOLVED)


def extract_dimension(facts: DataFrame, name: str, source: str, order: str, initial: int = -1,
                      existing: DataFrame | None = None) -> DataFrame:
    """Distinct names in first-seen order as ``(id, name, source)``; names already known keep their row."""
    first = facts.groupBy(F.col(name).alias("name")).agg(
        F.min(order).alias("_seen"), F.min_by(source, order).alias("source"))
    if existing is not None:
        known = existing.select(F.col("name").alias("_known"))
        first = first.join(known, F.col("name").eqNullSafe(F.col("_known")), "left_anti")
    new = add_ids(pin(first, "names"), "_seen", initial=initial).select("id", "name", "source")
    return new if existing is None else existing.select("id", "name", "source").unionByName(new)


def link_dimension(facts: DataFrame, dim: DataFrame, name: str, out: str) -> DataFrame:
    """Give each fact the lowest id its name has in the dimension; null is a name like any other."""
    ids = dim.groupBy(F.col("name").alias("_name")).agg(F.min("id").alias(out))
    return facts.join(ids, F.col(name).eqNullSafe(F.col("_name")), "left").drop("_name")


def bridge_table(facts: DataFrame, fk: str, content_type: str, pk: str = "id", present: Column | None = None,
                 bridge: DataFrame | None = None) -> DataFrame:
    """One row ``(source_id, content_type, content_id)`` per foreign key, scalar or list.

    A null key gives a row with a null; an empty list, and a fact that is not ``present``, give none.
    """
    if present is not None:
        facts = facts.where(present)
    if isinstance(facts.schema[fk].dataType, T.ArrayType):
        keys = F.coalesce(F.col(fk), F.array(F.lit(None).cast(facts.schema[fk].dataType.elementType)))
        rows = facts.select(F.explode(keys).alias("source_id"), F.col(pk).alias("content_id"))
    else:
        rows = facts.select(F.col(fk).alias("source_id"), F.col(pk).alias("content_id"))
    rows = rows.select("source_id", F.lit(content_type).alias("content_type"), "content_id")
    return rows if bridge is None else bridge.unionByName(rows)


def lookup_attribute(facts: DataFrame, dim: DataFrame, fk: str, key: str, attr: str, out: str) -> DataFrame:
    """Foreign key -> attribute of the dimension (unique key); ``unresolved`` marks missing parents."""
    parent = dim.select(F.col(key).alias("_key"), F.col(attr).alias(out), F.lit(True).alias("_hit"))
    return (
        facts.join(parent, F.col(fk) == F.col("_key"), "left")
        .withColumn(UNRESOLVED, F.col("_hit").isNull()).drop("_key", "_hit")
    )


def domain_check(facts: DataFrame, dim: DataFrame, col: str, key: str, out: str = "in_domain") -> DataFrame:
    """Whether each value is one of the rows of another table."""
    domain = dim.select(F.col(key).alias("_key")).distinct().withColumn("_hit", F.lit(True))
    return (
        facts.join(domain, F.col(col) == F.col("_key"), "left")
        .withColumn(out, F.col("_hit").isNotNull()).drop("_key", "_hit")
    )


def match_files(files: DataFrame, mapping: DataFrame, path: str = "path") -> DataFrame:
    """File path -> name: the stem of the file, mapped by ``(key, value)`` when it has an entry.

    Of a key with several values the last counts, by ``pos`` if the mapping has it, else by value.
    """
    stem = file_stem(F.substring_index(F.col(path), "/", -1))
    last = F.max_by("value", "pos") if "pos" in mapping.columns else F.max("value")
    entry = mapping.groupBy(F.col("key").alias("_stem")).agg(last.alias("_mapped"))
    return (
        files.withColumn("_stem", stem).join(entry, "_stem", "left")
        .withColumn("name", F.coalesce("_mapped", "_stem")).drop("_stem", "_mapped")
    )


def mapped_join(records: DataFrame, mapping: DataFrame, files: DataFrame, name: str, pk: str, image: str,
                path: str = "path") -> DataFrame:
    """Images of each record in long form ``(pk, image, added)``, and files without a record (null pk).

    The last record of a repeated name takes the files. Own images come with ``added = false``. The
    long form keeps a record with very many files out of any single row; ``fold_images`` makes lists.
    """
    owner = records.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.max(pk).alias(pk))
    added = match_files(files, mapping, path).join(owner, "name", "left").select(
        pk, F.col(path).alias("image"), F.lit(True).alias("added"))
    own = records.select(pk, F.col(image).alias("image"), F.lit(False).alias("added"))
    return own.unionByName(added)


def fold_images(long: DataFrame, pk: str) -> DataFrame:
    """One list per record, its own image first, then the added ones by path."""
    ordered = F.array_sort(F.collect_list(F.struct("added", "image")))
    return long.where(F.col(pk).isNotNull()).groupBy(pk).agg(F.transform(ordered, lambda s: s["image"]).alias("images"))


def chain_tables(tag: str = "table", **tables: DataFrame) -> DataFrame:
    """Several tables as one, tagged by name; columns a table lacks are null."""
    out = None
    for name, df in tables.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
