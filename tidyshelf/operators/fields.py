"""Columns and rows: rename, drop, order, filter, split off rejected rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Rules = Sequence[tuple[str, Column]]


def rename_field(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename when present; the renamed column moves to the end and replaces one of that name."""
    if old not in df.columns:
        return df
    rest = [F.col(c) for c in df.columns if c not in (old, new)]
    return df.select(*rest, F.col(old).alias(new))


def remove_field(df: DataFrame, name: str) -> DataFrame:
    """Drop a column when present."""
    return df.drop(name)


def order_columns(df: DataFrame, preferred: Sequence[str] | None = None) -> DataFrame:
    """Preferred columns first, the rest as they come; alphabetical without a preference."""
    if not preferred:
        return df.select(*sorted(df.columns))
    first = [c for c in preferred if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def filter_equals(df: DataFrame, **values) -> DataFrame:
    """Rows equal to every given value; null equals null, an unknown column matches nothing."""
    for name, value in values.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)) if name in df.columns else F.lit(False))
    return df


def get_one(df: DataFrame, **values) -> DataFrame:
    """The only matching row; running it fails when there is none or more than one."""
    matches = filter_equals(df, **values).limit(2)
    found = matches.agg(F.count("*").alias("n"), F.any_value(F.struct(*df.columns)).alias("row"))
    checked = (
        F.when(F.col("n") == 0, F.raise_error(F.lit("none found")).cast(T.StringType()))
        .when(F.col("n") > 1, F.raise_error(F.lit("several found")).cast(T.StringType()))
    )
    return found.where(checked.isNull()).select("row.*")


def is_named(col: Column, value: str) -> Column:
    """True for the marker name in any letter case."""
    return F.coalesce(F.lower(col) == value.lower(), F.lit(False))


def drop_named(df: DataFrame, col: str, value: str) -> DataFrame:
    """Drop rows whose name is the marker, in any letter case; null stays."""
    return df.where(~is_named(F.col(col), value))


def has_suffix(col: Column, suffix: str) -> Column:
    """True for a name that ends with the marker in any letter case."""
    return F.coalesce(F.endswith(F.lower(col), F.lit(suffix.lower())), F.lit(False))


def drop_suffix(df: DataFrame, col: str, suffix: str) -> DataFrame:
    """Drop rows whose name ends with the marker, in any letter case; null stays."""
    return df.where(~has_suffix(F.col(col), suffix))


def lacks_required(kind: Column, required: Column, kinds: Sequence[str]) -> Column:
    """True for a row of a listed kind without the required value."""
    return F.coalesce(kind.isin(list(kinds)), F.lit(False)) & required.isNull()


def require_when(df: DataFrame, kind: str, required: str, kinds: Sequence[str]) -> DataFrame:
    """Drop rows of listed kinds that lack the required value."""
    return df.where(~lacks_required(F.col(kind), F.col(required), kinds))


def with_drop_reason(df: DataFrame, rules: Rules, out: str = "drop_reason") -> DataFrame:
    """The name of the first rule each row breaks, null for rows to keep."""
    reason = F.lit(None).cast("string")
    for name, broken in reversed(list(rules)):
        reason = F.when(broken, F.lit(name)).otherwise(reason)
    return df.withColumn(out, reason)


def rows_dropped(df: DataFrame, rules: Rules, out: str = "drop_reason") -> DataFrame:
    """Rejected rows with their reason."""
    return with_drop_reason(df, rules, out).where(F.col(out).isNotNull())


def rows_kept(df: DataFrame, rules: Rules, out: str = "drop_reason") -> DataFrame:
    """The other half of ``rows_dropped``."""
    return with_drop_reason(df, rules, out).where(F.col(out).isNull()).drop(out)


def subset(df: DataFrame, predicate: Column | None = None, attr: str | None = None) -> DataFrame:
    """Rows that have the attribute and meet the predicate; a null predicate counts as unmet."""
    if attr is not None:
        df = df.where(F.col(attr).isNotNull() if attr in df.columns else F.lit(False))
    return df if predicate is None else df.where(predicate)


def is_in(col: Column, values: Sequence) -> Column:
    """Membership in a list that may hold null; null is a member only if listed."""
    listed = F.coalesce(col.isin([v for v in values if v is not None]), F.lit(False))
    return listed | col.isNull() if None in values else listed


def lacks(array: Column, value) -> Column:
    """True when the list does not hold the value."""
    return ~F.coalesce(F.array_contains(array, value), F.lit(False))
