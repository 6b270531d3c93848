"""Line dedup by a tree of line templates.

A line's digits are masked; its path in the tree is its number of tokens and its leading tokens, a
fixed depth whatever the line's length. Below a leaf, a token that recurs at its place is fixed, any other is a
variable field, as long as most of the line stays fixed. A template that occurs in several different texts
recurs: its lines stay in the document of least id and are dropped from all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyshelf.functions.markup import once
from tidyshelf.llm.common import fresh, query, sift, table, whole
from tidyshelf.session import pin

LAST = 2**63 - 1
#: A token of one level has so many times the texts of the level below; LEVELS reach to any size of table.
STEP, LEVELS = 4, 20
#: Tokens of a line that the pipeline takes for a passage; clean documents share shorter ones by chance.
LONG_LINE = 8
#: Share of the lines that two texts have in common from which the pipeline takes one for a near copy of the other.
NEAR_COPY = 0.8


def masked(line: Column) -> Column:
    """Digit runs become ``<*>``, runs of blanks one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, "[0-9]+", "<*>"), r"[ \t\r\f\x0B]+", " "))


def template_lines(docs: DataFrame, text: str, doc_id: str, depth: int) -> DataFrame:
    """(doc, body, pos, shape, n, leaf, key) of each line that is not blank; ``body`` is the hash of the whole text, ``n`` counts tokens."""
    lines = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(whole(text)).alias("body"),
                        F.posexplode(F.split(whole(text), "\n")).alias("pos", "line"))
    shaped = lines.withColumn("shape", masked(F.col("line"))).where("shape <> ''").drop("line")
    tokens = F.length("shape") - F.length(F.replace("shape", F.lit(" "), F.lit(""))) + 1
    return shaped.select("doc", "body", "pos", "shape", tokens.alias("n"), F.xxhash64(tokens, F.substring_index("shape", " ", depth)).alias("leaf"),
                         F.xxhash64(F.lit("line"), "shape").alias("key"))


def recurring_templates(docs: DataFrame, lines: DataFrame, text: str, doc_id: str, min_docs: int, depth: int, min_fixed: float, levels: int,
                        long_line: int | None) -> DataFrame:
    """(leaf, key, keep): the masked lines whose template recurs, and the document that keeps it. ``lines`` is pinned.

    A token is fixed at level 1 from ``min_docs`` texts on, and needs STEP times as many for each level more. Every line has a
    template at each of its levels, so one of them tells the fields of a common template from its fixed tokens, whatever its size.
    """
    # copies and repeats are folded before any count, so a hot line travels once per text
    long = [F.first("long").alias("long")] if long_line else []
    seen = lines.groupBy("leaf", "key", "body").agg(F.min("doc").alias("doc"), *long) \
        .groupBy("leaf", "key").agg(F.count("*").alias("texts"), F.min("doc").alias("first"), *long)
    seen = pin(seen, "templates")
    leaves = seen.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("texts").alias("s")) \
        .where((F.col("kinds") > 1) & (F.col("s") >= min_docs)).select("leaf")
    leaves = pin(leaves, "leaves")
    members = pin(sift(seen, leaves, "leaf")[0].join(leaves, "leaf", "left_semi"), "members")
    # the tokens of each masked line, read from one document that has it; lines that are not asked for stay out of the shuffle
    holders = members.withColumnRenamed("first", "doc")
    texts = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), F.col(text).alias("text"))
    held = template_lines(sift(texts, holders, "doc")[0], "text", "doc", depth).select("doc", "leaf", "key", "shape")
    shapes = sift(held, holders, "doc", "leaf", "key")[0].join(members.select("leaf", "key", "texts", "first"), ["leaf", "key"]).where("doc = first") \
        .groupBy("leaf", "key").agg(F.first("shape").alias("shape"), F.first("texts").alias("texts"))
    tokens = shapes.withColumn("split", F.split("shape", " ")).select("leaf", "key", "texts", F.size("split").alias("n"), F.posexplode("split").alias("at", "token"))
    tokens = pin(tokens.select("leaf", "key", "texts", "n", "at", F.xxhash64("at", "token").alias("token")), "tokens")
    fixed = tokens.groupBy("leaf", "at", "token").agg(F.sum("texts").alias("s")).where(F.col("s") >= min_docs)
    reach = [F.col("s") >= min_docs * STEP**k for k in range(levels)]
    fixed = fixed.select("leaf", "at", "token", sum((r.cast("int") for r in reach[1:]), reach[0].cast("int")).alias("top"))
    general = tokens.join(fixed, ["leaf", "at", "token"]).withColumn("level", F.explode(F.sequence(F.lit(1), "top"))).groupBy("leaf", "key", "level").agg(
        F.first("n").alias("n"), F.count("*").alias("fixed"), F.bit_xor("token").alias("a"), F.bit_xor(F.xxhash64(F.lit("b"), "token")).alias("b"))
    general = general.where(F.col("fixed") >= F.lit(min_fixed) * F.col("n")) \
        .select("leaf", "key", F.xxhash64("leaf", "level", "fixed", "a", "b").alias("template"))
    shared = general.groupBy("template").agg(F.count("*").alias("kinds")).where("kinds > 1").select("template")
    general = pin(general.join(shared, "template", "left_semi"), "general")
    wide = sift(lines, general, "leaf", "key")[0].join(general, ["leaf", "key"]).groupBy("template", "body").agg(F.min("doc").alias("doc")) \
        .groupBy("template").agg(F.count("*").alias("texts"), F.min("doc").alias("keep")).where(F.col("texts") >= min_docs)
    often = F.col("texts") >= min_docs
    exact = seen.where(often | F.col("long") & (F.col("texts") >= 2) if long_line else often).select("leaf", "key", F.col("first").alias("keep"))
    return exact.union(general.join(wide, "template").select("leaf", "key", "keep")) \
        .groupBy("leaf", "key").agg(F.min("keep").alias("keep"))


def drop_recurring_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 3, depth: int = 3,
                         min_fixed: float = 0.8, levels: int = LEVELS, long_line: int | None = None, near_copy: float | None = None, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """All columns of ``docs``, recurring lines taken out of the text, with the number of lines that are not blank and of those dropped.

    A template recurs if it is in at least ``min_docs`` different whole texts, so copies of a whole document
    don't count against each other. With one level a token that recurs is fixed; more levels find templates whose fields' values recur, at
    any size of table. A line of ``long_line`` tokens or more recurs from two such texts on, if that is given. With
    ``near_copy``, a text that would lose this share of its lines, but not all, to one document of which they are the same share, is a near
    copy and stays whole: what is left of it would be no copy any more. Of equal ids the rows count as one document; null ids as one that comes
    last. Blank lines always stay. A null text stays null, an empty one empty; repeated rows stay, each with its lines. Nothing is
    gathered but the line numbers to drop of one document.
    """
    doc, body, dropped = fresh(docs, "__doc", "__body", "__dropped")
    lines = template_lines(docs, text, doc_id, depth).drop("shape")
    lines = pin((lines.withColumn("long", F.col("n") >= long_line) if long_line else lines).drop("n"), "lines")
    recurring = pin(recurring_templates(docs, lines, text, doc_id, min_docs, depth, min_fixed, levels, long_line), "recurring")
    hits = sift(lines, recurring, "leaf", "key")[0].join(recurring, ["leaf", "key"]).where("doc <> keep").select("doc", "body", "pos", "keep")
    if near_copy:
        hits = pin(hits, "hits")
        sizes = pin(lines.groupBy("doc", "body").agg(F.count("*").alias("own")), "sizes")
        theirs = sizes.groupBy(F.col("doc").alias("keep")).agg(F.sum("own").alias("theirs"))
        near = hits.groupBy("doc", "body", "keep").agg(F.count("*").alias("n")).join(sizes, ["doc", "body"]) \
            .where((F.col("n") >= near_copy * F.col("own")) & (F.col("n") < F.col("own"))).join(theirs, "keep").where(F.col("n") >= near_copy * F.col("theirs"))
        hits = hits.join(near.select("doc", "body"), ["doc", "body"], "left_anti")
    gone = hits.groupBy(F.col("doc").alias(doc), F.col("body").alias(body)).agg(F.collect_set("pos").alias(dropped))
    gone = pin(gone, "gone")
    keyed = docs.withColumns({doc: F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)), body: F.xxhash64(whole(text))})
    parts = F.split(F.col(text), "\n")
    stays = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col(dropped))
    kept = once(parts, lambda p: F.array_join(F.transform(stays(p), lambda i: F.get(p, i)), "\n"))
    some, none = sift(keyed, gone, doc, body)
    marked = some.join(gone, [doc, body], "left").unionByName(none.withColumn(dropped, F.lit(None).cast("array<int>")))
    return marked.select(
        *[F.when(F.col(dropped).isNull(), F.col(text)).otherwise(kept).alias(c) if c == text else F.col(c) for c in docs.columns],
        F.coalesce(F.size(F.filter(parts, lambda line: F.trim(F.regexp_replace(line, r"[ \t\r\f\x0B]+", " ")) != "")), F.lit(0)).cast("long").alias(n_lines),
        F.coalesce(F.size(dropped), F.lit(0)).cast("long").alias(n_dropped))


def line_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without their recurring lines; one whose every line stays elsewhere goes.

    Near copies stay whole, for the stage after this to choose one. Rows without a text, repeated rows and other columns are kept, and an
    empty table stays empty.
    """
    done = drop_recurring_lines(docs, long_line=LONG_LINE, near_copy=NEAR_COPY, n_lines="__lines", n_dropped="__gone")
    left = done.where("__gone = 0 or __lines > __gone")
    return left.select(*[F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col(c)).cast("long").alias(c) if c == "n_chars" else F.col(c)
                         for c in docs.columns])


OP1_SQL = r"""
WITH raw AS (
  SELECT doc_id, coalesce(text, '') AS body, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), line AS (
  SELECT doc_id, body, unnest(range(len(parts))) AS pos, unnest(parts) AS line FROM raw
), shaped AS (
  SELECT doc_id, body, pos, trim(regexp_replace(regexp_replace(line, '[0-9]+', '<*>', 'g'), '[ \t\r\f\x0B]+', ' ', 'g')) AS shape FROM line
), lines AS (
  SELECT *, len(string_split(shape, ' ')) AS n, array_to_string(string_split(shape, ' ')[1:3], ' ') AS path FROM shaped WHERE shape <> ''
), seen AS (
  SELECT shape, n, path, count(DISTINCT body) AS texts, min(doc_id) AS first FROM lines GROUP BY ALL
), leaves AS (
  SELECT n, path FROM seen GROUP BY ALL HAVING count(*) > 1 AND sum(texts) >= 3
), tokens AS (
  SELECT shape, n, path, texts, unnest(range(n)) AS place, unnest(string_split(shape, ' ')) AS token FROM seen JOIN leaves USING (n, path)
), fixed AS (
  SELECT n, path, place, token, sum(texts) AS s FROM tokens GROUP BY ALL HAVING sum(texts) >= 3
), general AS (
  SELECT t.shape, n, path, level, string_agg(CASE WHEN f.s >= 3 * 4 ** level THEN t.token ELSE chr(1) END, ' ' ORDER BY place) AS template
  FROM tokens t LEFT JOIN fixed f USING (n, path, place, token), range(20) l(level)
  GROUP BY ALL HAVING count(*) FILTER (WHERE f.s >= 3 * 4 ** level) >= greatest(0.8 * n, 1)
), wide AS (
  SELECT g.n, g.path, level, template, min(doc_id) AS keep FROM general g JOIN lines l ON l.shape = g.shape
  GROUP BY ALL HAVING count(DISTINCT body) >= 3 AND count(DISTINCT g.shape) > 1
), recurring AS (
  SELECT shape, min(keep) AS keep FROM (
    SELECT shape, first AS keep FROM seen WHERE texts >= 3
    UNION ALL SELECT shape, keep FROM general JOIN wide USING (n, path, level, template)) GROUP BY ALL
), marked AS (
  SELECT s.doc_id, s.body, s.pos, s.line, r.shape IS NOT NULL AND s.doc_id <> r.keep AS gone, s.shape <> '' AS filled
  FROM (SELECT l.*, trim(regexp_replace(regexp_replace(line, '[0-9]+', '<*>', 'g'), '[ \t\r\f\x0B]+', ' ', 'g')) AS shape FROM line l) s
  LEFT JOIN recurring r ON r.shape = s.shape
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
       count(*) FILTER (WHERE filled) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped
FROM marked GROUP BY doc_id
"""


@query("op1_line_dedup", OP1_SQL)
def op1_line_dedup(spark, folder: str) -> DataFrame:
    return drop_recurring_lines(table(spark, folder, "documents").select("doc_id", "text"))
