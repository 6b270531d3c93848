"""Mixing sources to target weights over a tree of domain, language and source.

A node passes its budget to its children by weight; a child that cannot use its part (all its tokens,
``max_epochs`` times) leaves the rest to its siblings, and only what all of them cannot use was never given to
the parent. Each leaf reads its documents in a seeded order, whole epochs first, then a prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyshelf.llm.common import fresh, query, table, whole
from tidyshelf.session import pin

SEED = 20240
MAX_EPOCHS = 2
LEVELS = ["domain", "lang", "source"]
#: A plan of at most this many leaves is broadcast; a larger one is joined by its keys.
SMALL_PLAN = 20_000


def token_count(text: Column) -> Column:
    """Tokens of a text: runs of characters between blanks."""
    squeezed = F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", " "))
    return F.when(squeezed == "", F.lit(0)).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1).cast("long")


def row_key(text: str, doc_id: str) -> Column:
    return F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(whole(text).cast("binary")))


def place_of(seed: int, epoch: Column, row: Column) -> Column:
    """Where a row stands in the order of an epoch: 128 hashed bits as hex."""
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), row).cast("binary"))


def slice_of(place: Column, slices: Column) -> Column:
    """The order cut into even slices by the first 32 bits."""
    return F.floor(F.conv(F.substring(place, 1, 8), 16, 10).cast("long") * slices / F.lit(float(1 << 32))).cast("long")


def share_out(parents: DataFrame | int, children: DataFrame, up: list[str], name: str) -> DataFrame:
    """``budget`` of each child: its parent's (at the top, a number), by weight, never above the child's ``capacity``.

    Children are filled in the order of capacity to weight; one is full if its part of what is left by
    those before it reaches its capacity. Whole tokens; the few that rounding leaves go to the first open children.
    """
    decimal = "decimal(38,0)"
    every = Window.partitionBy(*up)
    before = every.orderBy(F.col("capacity") / F.col("weight"), name).rowsBetween(Window.unboundedPreceding, -1)
    rows = children.join(parents, up) if up else children.withColumn("budget", F.lit(parents).cast("long"))
    rows = rows.withColumns({"__full": F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast(decimal),
                             "__open": (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast(decimal)})
    left = F.col("budget").cast(decimal) - F.col("__full")
    rows = rows.withColumn("__fits", F.col("capacity").cast(decimal) * F.col("__open") <= left * F.col("weight"))
    # the first child that does not fill fixes the rate for all from there on
    rows = rows.withColumns({"__rest": F.max(F.when(~F.col("__fits"), left)).over(every),
                             "__weight": F.max(F.when(~F.col("__fits"), F.col("__open"))).over(every)})
    given = F.when(F.col("__fits"), F.col("capacity")).otherwise(F.expr("cast(__rest * weight div __weight as bigint)"))
    rows = rows.withColumn("__given", given)
    spare = F.col("budget") - F.sum("__given").over(every)
    place = F.row_number().over(every.orderBy("__fits", name))
    return rows.withColumn("__more", F.when(~F.col("__fits") & (place <= spare), 1).otherwise(0)) \
        .select(*children.columns, (F.col("__given") + F.col("__more")).alias("budget"))


def budget_leaves(leaves: DataFrame, weights: dict[str, dict[str, int]], budget: int | None, max_epochs: int, share: float = 1.0) -> DataFrame:
    """(domain, lang, source, tokens, budget) for (domain, lang, source, tokens).

    ``weights`` maps a level's name to whole weights by value; a value not named has weight 1. ``budget`` is the number of tokens
    to give out; without one, ``share`` of all tokens there are.
    """
    def weighed(df: DataFrame, level: str) -> DataFrame:
        named = weights.get(level, {})
        weight = F.coalesce(*[F.when(F.col(level) == k, F.lit(w)) for k, w in named.items()], F.lit(1)) if named else F.lit(1)
        return df.withColumn("weight", weight.cast("long"))

    nodes = [leaves.withColumn("capacity", F.col("tokens") * max_epochs)]
    for depth in (2, 1):
        nodes.insert(0, nodes[0].groupBy(*LEVELS[:depth]).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens")))
    total = nodes[0].agg(F.sum("tokens").alias("t"), F.sum("capacity").alias("c")).first()
    wanted = int((total["t"] or 0) * share) if budget is None else budget
    given = share_out(min(wanted, total["c"] or 0), weighed(nodes[0], LEVELS[0]), [], LEVELS[0])
    for depth in (1, 2):
        up = LEVELS[:depth]
        given = share_out(given.select(*up, "budget"), weighed(nodes[depth], LEVELS[depth]), up, LEVELS[depth])
    return given.select(*LEVELS, "tokens", "budget")


def mix(docs: DataFrame, weights: dict[str, dict[str, int]], text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source",
        domain: Column | None = None, budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
        names: tuple[str, ...] = ("domain", "n_tokens", "epochs")) -> DataFrame:
    """The rows of ``docs`` that are read, with their domain, tokens and ``epochs``, the number of times each is read.

    A leaf reads all its documents once, twice, ... as long as its budget lasts, then the longest prefix of the
    next epoch's order that still fits. The order is a hash of seed, epoch, id and text, so it is the same on every
    run and on any number of machines. Rows alike in id and text stand or fall together. Null in lang or source is a
    branch of its own (the empty name); null and empty texts have no tokens and are read in each whole epoch of
    their leaf; a leaf without tokens is read once.
    """
    d, n, e = fresh(docs, *[f"__{x}" for x in ("domain", "tokens", "epochs")])
    keys = fresh(docs, "__lang", "__source", "__leaf")
    domain = F.lit("all") if domain is None else domain
    keyed = docs.withColumns({d: F.coalesce(domain, F.lit("")), keys[0]: F.coalesce(F.col(lang).cast("string"), F.lit("")), keys[1]: F.coalesce(F.col(source).cast("string"), F.lit("")),
                              n: token_count(whole(text))})
    keyed = keyed.withColumn(keys[2], F.xxhash64(d, *keys[:2]))
    light = pin(keyed.select(F.col(d).alias("domain"), F.col(keys[0]).alias("lang"), F.col(keys[1]).alias("source"), F.col(keys[2]).alias("leaf"),
                             row_key(text, doc_id).alias("row"), F.col(n).alias("tokens")), "tokens")
    leaves = pin(light.groupBy("leaf", *LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "leaves")
    plan = budget_leaves(leaves.select(*LEVELS, "tokens"), weights, budget, max_epochs).select(*LEVELS, "budget")
    plan = pin(leaves.join(plan, LEVELS).select(
        "leaf", F.when(F.col("tokens") == 0, 1).otherwise(F.expr("budget div greatest(tokens, 1)")).cast("int").alias("whole"),
        F.when(F.col("tokens") == 0, 0).otherwise(F.expr("budget % greatest(tokens, 1)")).cast("long").alias("rest"),
        F.ceil(F.sqrt("n")).cast("long").alias("slices")), "plan")
    small = plan.count() <= SMALL_PLAN

    def planned(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(plan) if small else plan, "leaf")

    # the prefix of the last epoch: slices of the order summed first, then the one slice in which it ends; with as many
    # slices as a slice has documents, no window spans more than the root of a leaf's number
    part = planned(light).where("rest > 0").withColumn("place", place_of(seed, F.col("whole"), F.col("row")))
    part = part.groupBy("leaf", "rest", "slices", "place").agg(F.sum("tokens").alias("tokens")) \
        .withColumn("slice", slice_of(F.col("place"), F.col("slices")))
    sums = part.groupBy("leaf", "rest", "slice").agg(F.sum("tokens").alias("tokens"))
    running = Window.partitionBy("leaf").orderBy("slice")
    sums = sums.withColumn("until", F.sum("tokens").over(running.rowsBetween(Window.unboundedPreceding, 0)))
    cut = pin(sums.where(F.col("until") > F.col("rest")).groupBy("leaf").agg(
        F.min("slice").alias("cut"), F.min_by(F.col("rest") - F.col("until") + F.col("tokens"), "slice").alias("room")), "cuts")
    inside = part.join(F.broadcast(cut) if small else cut, "leaf").where("slice = cut")
    inner = Window.partitionBy("leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("sum", F.sum("tokens").over(inner)).where(F.col("sum") <= F.col("room")) \
        .groupBy("leaf").agg(F.max("place").alias("last"))
    ends = cut.join(last, "leaf", "left").select("leaf", "cut", "last")
    final = pin(plan.join(ends, "leaf", "left"), "ends").select(F.col("leaf").alias(keys[2]), *[F.col(c).alias(f"__plan_{c}") for c in ("whole", "rest", "slices", "cut", "last")])

    chosen = keyed.join(F.broadcast(final) if small else final, keys[2])
    place = place_of(seed, F.col("__plan_whole"), row_key(text, doc_id))
    slice_ = slice_of(place, F.col("__plan_slices"))
    extra = F.when((F.col("__plan_rest") > 0) & ((slice_ < F.col("__plan_cut")) | ((slice_ == F.col("__plan_cut")) & (place <= F.col("__plan_last")))), 1).otherwise(0)
    out = chosen.withColumn(e, F.col("__plan_whole") + extra).where(F.col(e) > 0)
    return out.select(*docs.columns, F.col(d).alias(names[0]), F.col(n).alias(names[1]), F.col(e).alias(names[2]))


#: Whole weights by value; sources are grouped into four domains by their number.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 3}}


def domain_of(source: str = "source") -> Column:
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9]+)$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("d"), F.pmod(F.substring(number, -4, 4).cast("int"), F.lit(4)).cast("string")))


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: as many tokens as come in, mixed to the weights; a document read twice is there twice."""
    mixed = mix(docs, WEIGHTS, domain=domain_of(), names=("__domain", "__tokens", "__epochs"))
    return mixed.withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.col("__epochs")))).select(*docs.columns)


def _share_sql(name: str, children: str, parents: str, up: list[str], level: str) -> str:
    every = f"PARTITION BY {', '.join(up)}" if up else "PARTITION BY 1"
    before = f"({every} ORDER BY capacity / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    cases = " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in WEIGHTS[level].items())
    return f"""
{name}_w AS (SELECT c.*, {parents}.budget, CASE {cases} ELSE 1 END AS weight FROM {children} c JOIN {parents} {'USING (' + ', '.join(up) + ')' if up else 'ON true'}),
{name}_a AS (SELECT *, budget - coalesce(sum(capacity) OVER {before}, 0) AS remains,
  sum(weight) OVER ({every}) - coalesce(sum(weight) OVER {before}, 0) AS opened FROM {name}_w),
{name}_b AS (SELECT *, capacity * opened <= remains * weight AS fits FROM {name}_a),
{name}_c AS (SELECT *, max(remains) FILTER (WHERE NOT fits) OVER ({every}) AS rest, max(opened) FILTER (WHERE NOT fits) OVER ({every}) AS over_w FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN fits THEN capacity ELSE rest * weight // over_w END AS given FROM {name}_c),
{name}_e AS (SELECT *, row_number() OVER ({every} ORDER BY fits, {level}) AS place, budget - sum(given) OVER ({every}) AS spare FROM {name}_d),
{name} AS (SELECT * EXCLUDE (budget, weight, remains, opened, fits, rest, over_w, given, place, spare),
  given + CASE WHEN NOT fits AND place <= spare THEN 1 ELSE 0 END AS budget FROM {name}_e)"""


OP10_SQL = r"""
WITH docs AS (
  SELECT doc_id, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s, regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS number,
         trim(regexp_replace(coalesce(text, ''), '[ \t\r\n\f\x0B]+', ' ', 'g')) AS squeezed, md5(coalesce(text, '')) AS body FROM documents
), keyed AS (
  SELECT doc_id, lang, source, l, s, body, CASE WHEN number = '' THEN 'other' ELSE 'd' || (right(number, 4)::INT % 4) END AS domain,
         CASE WHEN squeezed = '' THEN 0 ELSE length(squeezed) - length(replace(squeezed, ' ', '')) + 1 END AS tokens FROM docs
), third AS (SELECT domain, l AS lang, s AS source, sum(tokens) AS tokens, 2 * sum(tokens) AS capacity FROM keyed GROUP BY ALL),
second AS (SELECT domain, lang, sum(capacity) AS capacity FROM third GROUP BY ALL),
first AS (SELECT domain, sum(capacity) AS capacity FROM second GROUP BY ALL),
top AS (SELECT sum(tokens) AS budget FROM third),""" + ",".join([
    _share_sql("one", "first", "top", [], "domain"), _share_sql("two", "second", "one", ["domain"], "lang"),
    _share_sql("three", "third", "two", ["domain", "lang"], "source")]) + r""",
plan AS (SELECT domain, lang AS l, source AS s, CASE WHEN tokens = 0 THEN 1 ELSE budget // tokens END AS full_epochs,
  CASE WHEN tokens = 0 THEN 0 ELSE budget % tokens END AS rest FROM three),
placed AS (SELECT k.*, p.full_epochs, p.rest, md5('20240:' || full_epochs || ':' || coalesce(doc_id::VARCHAR, '') || ':' || body) AS place FROM keyed k JOIN plan p USING (domain, l, s)),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, l, s ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until FROM placed)
SELECT doc_id, domain, lang, source, tokens::BIGINT AS n_tokens, (full_epochs + CASE WHEN rest > 0 AND until <= rest THEN 1 ELSE 0 END)::INT AS epochs
FROM summed WHERE full_epochs > 0 OR (rest > 0 AND until <= rest)
"""


@query("op10_source_mixing", OP10_SQL)
def op10_source_mixing(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs, WEIGHTS, domain=domain_of()).select("doc_id", "domain", "lang", "source", "n_tokens", "epochs")
