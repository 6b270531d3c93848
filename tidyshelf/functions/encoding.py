"""Record digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode_field(df: DataFrame, name: str) -> Column:
    """Unambiguous text of one field: null, the word "None" and text holding a bar all differ."""
    col, kind = F.col(name), df.schema[name].dataType
    flat = F.to_json(col) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else col.cast("string")
    return F.coalesce(F.concat(F.length(flat).cast("string"), F.lit(":"), flat), F.lit("null"))


def record_hash(df: DataFrame, exclude: Sequence[str] = (), include: Sequence[str] = (), bits: int = 512) -> Column:
    """SHA-2 over the chosen fields in column order, joined by a bar."""
    chosen = [c for c in df.columns if c not in exclude and (not include or c in include)]
    return F.sha2(F.concat_ws("|", *[encode_field(df, c) for c in chosen]), bits)
