"""Remembered answers, review queues and validation reports.

The override memory is a long table ``(source, field, pk, value)``; every row is an answer, and a
null value is an answer too.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["source", "field", "pk"]


class Rule(NamedTuple):
    """A named check on one field; ``valid`` must never be null."""

    field: str
    name: str
    valid: Column


def apply_overrides(df: DataFrame, overrides: DataFrame, source: str, field: str, pk: str, bad: str | None = None) -> DataFrame:
    """A remembered answer replaces the value, a valid one too, and also when the answer is null.

    Of several answers under one key the last counts, by ``version`` if the memory has it, else the greatest value; a null
    among those without version never wins. An answer that does not fit the field's type leaves the value as it is and sets ``bad``.
    """
    last = F.max_by(F.struct("value"), F.col("version")) if "version" in overrides.columns else F.struct(F.max("value").alias("value"))
    answers = overrides.where((F.col("source") == source) & (F.col("field") == field)).groupBy(F.col("pk").alias("_pk")).agg(
        last["value"].alias("_answer"), F.lit(True).alias("_hit"))
    answer = F.col("_answer").try_cast(df.schema[field].dataType)
    fits = F.col("_hit") & (F.col("_answer").isNull() | answer.isNotNull())
    rows = df.join(answers, F.col(pk).cast("string") == F.col("_pk"), "left").withColumn("_fits", F.coalesce(fits, F.lit(False)))
    out = rows.select(*[F.when(F.col("_fits"), answer).otherwise(F.col(field)).alias(field) if c == field else F.col(c) for c in df.columns],
                      (F.coalesce(F.col("_hit"), F.lit(False)) & ~F.col("_fits")).alias(bad or "_bad"))
    return out if bad else out.drop("_bad")


def append_choices(df: DataFrame, answers: DataFrame, pk: str, field: str, order: str, answer: str,
                   accept_duplicates: bool = False) -> DataFrame:
    """Add answers ``(pk, order, answer)`` to the list of each row in order.

    Values already present are not repeated unless accepted. A null answer makes the whole list
    null. Repeats are folded before lists are built.
    """
    nulls = F.max(F.when(F.col(answer).isNull(), F.lit(True)))
    keys = [pk, answer] + ([order] if accept_duplicates else [])
    first = answers.groupBy(*keys).agg(F.min(order).alias("_at") if not accept_duplicates else F.count("*").alias("_n"))
    at = F.col(order) if accept_duplicates else F.col("_at")
    given = F.collect_list(F.when(F.col(answer).isNotNull(), F.struct(at.alias("at"), F.col(answer).alias("v"))))
    lists = first.groupBy(F.col(pk).alias("_pk")).agg(
        F.transform(F.array_sort(given), lambda s: s["v"]).alias("_given"),
        F.coalesce(nulls, F.lit(False)).alias("_ended"))
    base = F.coalesce(F.col(field), F.array().cast(df.schema[field].dataType))
    added = F.concat(base, F.col("_given"))
    if not accept_duplicates:
        added = F.concat(base, F.array_except(F.col("_given"), base))
    return (
        df.join(lists, F.col(pk) == F.col("_pk"), "left")
        .withColumn(field, F.when(F.col("_pk").isNull(), F.col(field)).when(~F.col("_ended"), added))
        .drop("_pk", "_given", "_ended")
    )


def review_queue(df: DataFrame, source: str, pk: str, rules: Sequence[Rule], amend: bool = False) -> DataFrame:
    """What still needs an answer, one row per broken rule; in amend mode every row. One pass."""
    checks = F.array(*[
        F.struct(F.lit(source).alias("source"), F.lit(r.field).alias("field"), F.col(pk).cast("string").alias("pk"),
                 F.lit(r.name).alias("rule"), F.col(r.field).cast("string").alias("value"), r.valid.alias("valid"))
        for r in rules])
    if not amend:
        checks = F.filter(checks, lambda c: ~c["valid"])
    return df.select(F.inline(checks)).drop("valid")


def merge_answers(overrides: DataFrame, new: DataFrame, skip: str | None = "") -> DataFrame:
    """New answers overwrite the memory; later ``version`` wins among them, a skipped one writes nothing."""
    if skip is not None:
        new = new.where(~F.col("value").eqNullSafe(skip))
    old = overrides.select(*KEYS, "value", F.lit(-1).cast("bigint").alias("version"))
    both = old.unionByName(new.select(*KEYS, "value", F.col("version").cast("bigint").alias("version")))
    return both.groupBy(*KEYS).agg(F.max_by("value", "version").alias("value"))


def validation_summary(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Valid and invalid rows per rule, counted in one pass without multiplying rows."""
    counts = df.agg(*[F.count_if(r.valid).alias(f"ok{i}") for i, r in enumerate(rules)],
                    *[F.count_if(~r.valid).alias(f"bad{i}") for i, r in enumerate(rules)])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(r.field).alias("field"), F.lit(r.name).alias("rule"),
                 F.col(f"ok{i}").alias("valid"), F.col(f"bad{i}").alias("invalid"))
        for i, r in enumerate(rules)])))
