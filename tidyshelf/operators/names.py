"""Unique names by a cascade of strategies, and reconciliation with an outside list."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyshelf.functions.text import canonical_name
from tidyshelf.session import pin

def unique_names(df: DataFrame, pk: str, strategies: Sequence[Sequence[str]], out: str = "canonical",
                 **naming) -> DataFrame:
    """Name every record with the first strategy under which no other open record has its name.

    Adds ``out`` and ``level``; records no strategy can tell apart get an empty name and no level.
    Only the unique key and the candidate names go through the cascade. Each level is one count per
    name, combined map-side, that keeps the names held once together with their only key; settled
    records are then marked by key, so a hot name is never joined or gathered. Every level's table
    is pinned, which keeps the work linear in the number of levels, and the next reads what is open.
    """
    names = [f"_n{i}" for i in range(len(strategies))]
    candidates = [canonical_name(df, *s, **naming).alias(n) for s, n in zip(strategies, names)]
    open_rows = pin(df.select(F.col(pk).alias("_pk"), *candidates), "names")
    settled = None
    for level, name in enumerate(names):
        once = (
            open_rows.groupBy(name).agg(F.count("*").alias("_held"), F.min("_pk").alias("_pk")).where("_held = 1")
            .select("_pk", F.lit(level).alias("level"), F.col(name).alias(out))
        )
        if level < len(names) - 1:
            marked = open_rows.drop(name).join(once, "_pk", "left")
            marked = pin(marked, "names")
            once = marked.where("level IS NOT NULL").select("_pk", "level", out)
            open_rows = marked.where("level IS NULL").drop("level", out)
        settled = once if settled is None else settled.unionByName(once)
    return (
        df.join(settled, F.col(pk) == F.col("_pk"), "left").drop("_pk")
        .withColumn(out, F.coalesce(F.col(out), F.lit("")))
    )


def unresolved_names(named: DataFrame, out: str = "canonical") -> DataFrame:
    """Records that got no name."""
    return named.where(F.col(out) == "")


def level_report(named: DataFrame, level: str = "level", out: str = "canonical") -> DataFrame:
    """Settled names per strategy; a record whose name is empty counts as open, as in ``unresolved_names``."""
    return named.where(F.col(level).isNotNull() & (F.col(out) != "")).groupBy(level).agg(F.count("*").alias("names"))


def name_clashes(named: DataFrame, out: str = "canonical") -> DataFrame:
    """Names given at more than one level: later levels look at open records only."""
    return (
        named.where(F.col(out) != "").groupBy(out)
        .agg(F.count("*").alias("records"), F.count_distinct("level").alias("levels")).where("records > 1")
    )


def missing_names(expected: DataFrame, have: DataFrame, name: str = "name") -> DataFrame:
    """Expected names that do not exist, as often as they are expected."""
    return expected.join(have.select(name).distinct(), name, "left_anti")


def coverage(expected: DataFrame, have: DataFrame, name: str = "name") -> DataFrame:
    """Share of expected names that exist in percent, and their count; null for an empty list.

    Repeats are counted first, so each distinct name is joined once.
    """
    wanted = expected.groupBy(name).agg(F.count("*").alias("times"))
    known = have.select(name).distinct().withColumn("_hit", F.lit(True))
    return wanted.join(known, name, "left").agg(
        F.coalesce(F.sum("times"), F.lit(0)).alias("expected"),
        F.round(F.try_divide(F.lit(100.0) * F.sum(F.when(F.col("_hit"), F.col("times")).otherwise(0)),
                             F.sum("times")), 2).alias("percent"))


def _grams(name: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(name) - (size - 1))
    return F.when(F.length(name) >= size, F.transform(starts, lambda i: F.substring(name, i, F.lit(size)))) \
        .otherwise(F.array().cast("array<string>"))


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two names, the missing one first."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


# Marked so that the optimizer neither repeats it nor moves it below the step that makes pairs distinct.
matching_ratio = matching_ratio.asNondeterministic()


# Ratio of the lengths that bound a band; up to a dozen characters every length is a band of its own.
BAND = 1.1
# A cell is this part of a name of the band's length, and one place at least.
CELLS = 16


def _band(length: Column) -> Column:
    return F.floor(F.log(length) / F.lit(log(BAND)) + F.lit(1e-9)).cast("int")


def _cell(place: Column, band: Column) -> Column:
    """Number of the cell of a place in names of a band."""
    return F.floor(place / F.greatest(F.lit(1), F.floor(F.pow(F.lit(BAND), band) / CELLS))).cast("int")


def _least_match(total: Column, ratio: float) -> Column:
    """Fewest matched characters that lift names of this total length above the ratio."""
    return (F.floor(total * (ratio / 2)) + 1).cast("int")


def _needed(total: Column, ratio: float) -> Column:
    """Fewest bigrams such names share: each of the unmatched characters can break one run of them."""
    return F.greatest(F.lit(1), 3 * _least_match(total, ratio) - total - 1)


def _partner_lengths(length: Column, ratio: float) -> Column:
    """Lengths a name's partners can have."""
    reach = ratio / (2 - ratio)
    around = F.sequence(F.ceil(length * reach - 1e-9).cast("int"), F.floor(length / reach + 1e-9).cast("int"))
    return F.filter(around, lambda n: _least_match(n + length, ratio) <= F.least(n, length))


def _ranked_grams(names: DataFrame, often: DataFrame) -> DataFrame:
    """Each name with its bigrams and their places, rarest first."""
    places = names.select("name", F.posexplode(_grams(F.col("name"), 2)).alias("pos", "g"))
    ranked = places.join(often, "g").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "g", "pos"))).alias("ranked"))
    return ranked.withColumns({"len": F.length("name"), "size": F.size("ranked")})


def _ratio_pairs(missing: DataFrame, have: DataFrame, ratio: float) -> DataFrame:
    """Pairs above the ratio, found by keys and then checked exactly.

    The lengths of two names fix how many characters must match, hence how far a common run can be
    shifted and how many bigrams they share at least. So one of a few rarest bigrams of each must be
    common to both, at nearly the same place. The names of the longer list are listed under these bigrams with a band of
    lengths and a cell of places; a name of the shorter list looks under every band and cell that could do, some
    ten of each whatever its length. Exact lengths, places and the edit distance then decide.
    """
    if missing.count() > have.count():
        pairs = _close_names(have, missing, ratio).select(F.col("name_a").alias("name_b"), F.col("name_b").alias("name_a"))
    else:
        pairs = _close_names(missing, have, ratio)
    return pairs.withColumn("ratio", matching_ratio("name_a", "name_b")).where(F.col("ratio") > ratio)


def _close_names(missing: DataFrame, have: DataFrame, ratio: float) -> DataFrame:
    """Distinct pairs ``(name_a, name_b)`` that may be above the ratio, whose order makes no difference here."""
    every = missing.select("name").unionByName(have.select("name"))
    often = every.select(F.explode(_grams(F.col("name"), 2)).alias("g")).groupBy("g").agg(F.count("*").alias("n"))

    def listed(ranked: DataFrame, side: str, needed: Column) -> DataFrame:
        """One row per key bigram: as many of the rarest as must hold a common one."""
        keys = F.slice("ranked", F.lit(1), F.greatest(F.lit(0), F.size("ranked") - needed + 1))
        others = [c for c in ranked.columns if c not in ("name", "len", "size", "ranked")]
        rows = ranked.select(*others, F.col("name").alias(f"name_{side}"), F.col("len").alias(f"len_{side}"),
                             F.col("size").alias(f"size_{side}"), F.posexplode(keys).alias(f"at_{side}", "key"))
        return rows.withColumns({"g": F.col("key.g"), f"pos_{side}": F.col("key.pos")}).drop("key")

    length = F.col("len")
    partners = _partner_lengths(length, ratio)
    least_needed = F.array_min(F.transform(partners, lambda n: _needed(n + length, ratio)))
    known = listed(_ranked_grams(have, often), "b", least_needed)
    known = known.withColumn("band", _band(F.col("len_b"))).withColumn("cell", _cell(F.col("pos_b"), F.col("band")))
    wanted = _ranked_grams(missing, often)
    total = F.col("len_a") + F.col("len_b")
    match = _least_match(total, ratio)
    before, after = F.col("len_a") - match, F.col("len_b") - match
    within = (F.col("at_a") <= F.col("size_a") - _needed(total, ratio)) & (F.col("at_b") <= F.col("size_b") - _needed(total, ratio))
    # Unmatched characters of both names are edits, so the edit distance cannot exceed their number.
    edits = F.call_function("levenshtein", F.col("name_a"), F.col("name_b"), total - 2 * match)
    enough = edits >= 0

    bands = F.transform(F.array_distinct(F.transform(partners, _band)), lambda band: F.struct(
        band.alias("band"), F.filter(partners, lambda n: _band(n) == band).alias("lengths")))
    asking = wanted.withColumn("b", F.explode(bands)).select(
        "name", "len", "size", "ranked", F.col("b.band").alias("band"), F.array_min("b.lengths").alias("low"), F.array_max("b.lengths").alias("high"))
    asking = listed(asking, "a", _needed(length + F.col("low"), ratio))
    earliest = F.col("pos_a") - (F.col("len_a") - _least_match(F.col("len_a") + F.col("low"), ratio))
    latest = F.col("pos_a") + F.col("high") - _least_match(F.col("len_a") + F.col("high"), ratio)
    asking = asking.withColumn("cell", F.explode(F.sequence(_cell(F.greatest(earliest, F.lit(0)), F.col("band")), _cell(F.greatest(latest, F.lit(0)), F.col("band")))))
    shift = F.col("pos_b") - F.col("pos_a")
    feasible = (match <= F.least("len_a", "len_b")) & (shift >= -before) & (shift <= after)
    return asking.join(known, ["g", "band", "cell"]).where(feasible & within & enough).select("name_a", "name_b").distinct()


def _containing_pairs(missing: DataFrame, have: DataFrame) -> DataFrame:
    """Pairs where the known name holds the missing one, found by the missing name's rarest piece.

    Pieces are bigrams, and the character itself for one-character names. Known names are listed only under
    pieces that a missing name has. An empty name is held by all and goes a way of its own.
    """
    known = have.select("name").distinct()
    name = F.col("name")
    own = F.when(F.length(name) >= 2, F.array_distinct(_grams(name, 2))).otherwise(F.array(name))
    asked = missing.select("name").distinct().where(name != "").select(name.alias("name_a"), F.explode(own).alias("piece"))
    pieces = asked.select("piece").distinct()
    held = F.array_distinct(F.concat(_grams(name, 1), _grams(name, 2)))
    index = known.select(name.alias("name_b"), F.explode(held).alias("piece")).join(pieces, "piece", "left_semi")
    often = index.groupBy("piece").agg(F.count("*").alias("n"))
    rarest = (
        asked.join(often, "piece", "left")
        .groupBy("name_a").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"))
    )
    pairs = rarest.join(index, "piece").where(F.contains("name_b", "name_a")).select("name_a", "name_b")
    empty = missing.where(name == "").select(name.alias("name_a")).distinct()
    return pairs.unionByName(known.select(F.lit("").alias("name_a"), name.alias("name_b")).join(empty, "name_a", "left_semi"))


def containing_candidates(missing: DataFrame, have: DataFrame) -> DataFrame:
    """For each missing name the known names that contain it."""
    return _containing_pairs(missing, have).select(F.col("name_a").alias("missing"), F.col("name_b").alias("candidate"))


def fetch_manifest(records: DataFrame, table: str, url: str, name: str, exclude: str) -> DataFrame:
    """What to fetch, ``(table, url, name)``, without the URLs of a known host."""
    known = F.coalesce(F.contains(F.col(url), F.lit(exclude)), F.lit(False))
    return records.where(~known).select(F.lit(table).alias("table"), F.col(url).alias("url"), F.col(name).alias("name"))


def fuzzy_candidates(missing: DataFrame, have: DataFrame, ratio: float = 0.80) -> DataFrame:
    """For each missing name the known names with a ratio above the limit, or that contain it.

    Both name lists are read several times and are pinned first.
    """
    if ratio < 0.80:
        raise ValueError("below 0.80 close names need not share a bigram")
    wanted = pin(missing.select("name").distinct(), "missing-names")
    known = pin(have.select("name").distinct(), "known-names")
    close = _ratio_pairs(wanted, known, ratio).select("name_a", "name_b")
    return close.unionByName(_containing_pairs(wanted, known)).distinct().select(
        F.col("name_a").alias("missing"), F.col("name_b").alias("candidate"))
