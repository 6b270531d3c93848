"""Cleaning and validation of single answers, as Column -> Column functions.

An answer arrives as text. The null token stands for "no value"; ``null_token=None`` switches it
off, and then null is not a permitted value either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidyshelf.functions.text import SPACE, strip

INTEGER = f"^[{SPACE}]*[+-]?[0-9]+[{SPACE}]*$"


def _without_token(col: Column, null_token: str | None) -> Column:
    return col if null_token is None else F.when(col != null_token, col)


def _permit_null(valid: Column, col: Column, allow_null: bool) -> Column:
    return F.when(col.isNull(), F.lit(allow_null)).otherwise(F.coalesce(valid, F.lit(False)))


def clean_int(col: Column, null_token: str | None = ".") -> Column:
    """Text that is an integer -> the number; the null token, and all other text, -> null."""
    text = _without_token(col, null_token)
    return F.when(F.rlike(text, F.lit(INTEGER)), strip(text).try_cast("bigint"))


def validate_int(col: Column, allow_null: bool = True, null_token: str | None = ".") -> Column:
    """True for an integer text, and for null or the null token where null is permitted."""
    return _permit_null(clean_int(col, None).isNotNull(), _without_token(col, null_token), allow_null)


def clean_text(col: Column, null_token: str | None = ".") -> Column:
    """Null token -> null, other text without the white space around it."""
    return strip(_without_token(col, null_token))


def validate_text(col: Column, allow_null: bool = True) -> Column:
    """True for any text, and for null where it is permitted."""
    return _permit_null(F.lit(True), col, allow_null)


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def decode_choice(col: Column, choices: Sequence[str], null_token: str | None = ".") -> Column:
    """Digits that are a position in the vocabulary -> the value there; other text passes."""
    text = _without_token(col, null_token)
    position = F.when(F.rlike(text, F.lit("^[0-9]+$")), text.try_cast("int"))
    return F.coalesce(F.get(_strings(choices), position), text)


def validate_choice(col: Column, choices: Sequence, allow_null: bool = True) -> Column:
    """True for a value of the vocabulary (a short list of literals)."""
    return _permit_null(col.isin(list(choices)), col, allow_null)


def validate_choice_list(col: Column, choices: Sequence[str], allow_null: bool = True) -> Column:
    """True when every element is valid; an empty list is."""
    every = F.forall(col, lambda x: validate_choice(x, choices, allow_null))
    return _permit_null(every, col, allow_null)
