"""Queries that run the record stages on file streams, over everything available."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyshelf.functions import text as t
from tidyshelf.operators import fields as f
from tidyshelf.operators.keys import content_hash
from tidyshelf.operators.model import extract_dimension
from tidyshelf.plans.registry import query, table
from tidyshelf.plans.tables import labelled
from tidyshelf.session import is_folder, shared_path
from tidyshelf.streaming import stages as s


def arriving(spark, sf, name):
    """One of the tables as a file stream, be it one file or a folder of files."""
    reader = spark.readStream.schema(table(spark, sf, name).schema)
    path = f"{sf.rstrip('/')}/{name}.parquet"
    return reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def to_table(spark, stream):
    return s.run_to_table(stream, shared_path(spark, "stream"), shared_path(spark, "progress"))


def document_stages():
    """Listed out of order; the priorities sort them."""
    return [(300, lambda d: f.drop_suffix(d, "title", "junk")),
            (100, lambda d: d.withColumn("title", t.slugify(F.col("text")))),
            (200, lambda d: d.withColumn("source", t.replace_exact(F.col("source"), {"src3": "Archive", "src5": "Mirror"}))),
            (200, lambda d: f.drop_named(d, "source", "ARCHIVE"))]


STAGES_SQL = r"""
    SELECT doc_id, CASE source WHEN 'src5' THEN 'Mirror' ELSE source END AS source, sha256(title) AS title FROM (SELECT *,
        regexp_replace(lower(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s-]', '', 'g'), '^\s+|\s+$', '', 'g')), '[\s-]+', '-', 'g') AS title
        FROM documents) WHERE source <> 'src3' AND NOT ends_with(title, 'junk')"""


@query("k1_apply_stages", STAGES_SQL)
def k1(spark, sf):
    return s.apply_stages(table(spark, sf, "documents"), document_stages()).select("doc_id", "source", F.sha2("title", 256).alias("title"))


@query("k1_stream_stages", STAGES_SQL)
def k1_stream(spark, sf):
    return to_table(spark, s.apply_stages(arriving(spark, sf, "documents"), document_stages()).select("doc_id", "source", F.sha2("title", 256).alias("title")))


@query("k2_dedup_arrivals", "SELECT DISTINCT user_id, event_type FROM events")
def k2(spark, sf):
    """Keys remembered for the whole run."""
    return to_table(spark, s.dedup_arrivals(arriving(spark, sf, "events").select("user_id", "event_type"), ["user_id", "event_type"]))


@query("k2_first_arrivals", "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def k2_first(spark, sf):
    """The whole first event of each user and kind."""
    return to_table(spark, s.first_arrivals(arriving(spark, sf, "events"), ["user_id", "event_type"], "event_id"))


@query("k2_first_records", """
    WITH gaps AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS starts FROM events),
    runs AS (SELECT *, sum(starts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS run FROM gaps)
    SELECT event_id, user_id, event_type, value FROM runs QUALIFY row_number() OVER (PARTITION BY user_id, event_type, run ORDER BY event_id) = 1""")
def k2_records(spark, sf):
    """The first event of every run of a user and kind, runs ending after six hours of silence.

    A last row far in the future moves the watermark past everything.
    """
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("at"))
    end = events.agg(F.expr("max(at) + INTERVAL 1 YEAR").alias("at"))
    folder = shared_path(spark, "events")
    events.unionByName(end, allowMissingColumns=True).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    firsts = s.first_records(stream, ["user_id", "event_type"], "event_id", "at", "6 hours")
    return to_table(spark, firsts.select("event_id", "user_id", "event_type", "value")).where("event_id IS NOT NULL")


@query("k2_dedup_within_watermark", "SELECT DISTINCT user_id, event_type FROM events")
def k2_watermark(spark, sf):
    """Keys remembered for a year of event time, which the given events do not exceed."""
    stream = arriving(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    return to_table(spark, s.dedup_arrivals(stream, ["user_id", "event_type"], "at", "366 days").select("user_id", "event_type"))


@query("k3_drop_known_arrivals", """
    SELECT doc_id, lang FROM documents WHERE sha256(text) NOT IN
        (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""")
def k3(spark, sf):
    bad = labelled(spark, sf).where("toxic = 1").select(content_hash(F.col("text"), 256).alias("digest"))
    return to_table(spark, s.drop_known_arrivals(arriving(spark, sf, "documents"), "text", bad, 256).select("doc_id", "lang"))


@query("k3_resolve_arrivals", """
    WITH dim AS (SELECT p_name AS name, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS name_id FROM part WHERE p_type = 'PROMO' GROUP BY p_name)
    SELECT p_partkey, name, name_id, name_id IS NULL AS unresolved FROM (SELECT p_partkey, p_name AS name FROM part) LEFT JOIN dim USING (name)""")
def k3_resolve(spark, sf):
    ids = extract_dimension(table(spark, sf, "part").where("p_type = 'PROMO'"), "p_name", "p_type", "p_partkey").select("name", F.col("id").alias("name_id"))
    stream = arriving(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"))
    return to_table(spark, s.resolve_arrivals(stream, ids, "name", "name_id"))


EARLY_SQL = """
    WITH dim AS (SELECT user_id, min(event_id) AS first_buy, min(ts) AS since FROM events WHERE event_type = 'purchase' GROUP BY user_id)
    SELECT event_id, e.user_id, first_buy, first_buy IS NULL AS unresolved
    FROM events e LEFT JOIN dim ON dim.user_id = e.user_id AND since <= ts + INTERVAL 2 HOURS"""


@query("k3_resolve_open_arrivals", EARLY_SQL)
def k3_open(spark, sf):
    """Events wait for two hours for the first purchase of their user; both arrive as streams, latest rows first.

    A last row far in the future moves the watermark past everything; it is left out of the table only, for a filter on the stream
    would be moved before the watermark.
    """
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    buys = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("event_id").alias("first_buy"), F.min("at").alias("since"))
    late = F.expr("max(at) + INTERVAL 1 YEAR")
    end = events.agg(late.alias("at")).select(F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("bigint").alias("user_id"), "at")
    facts, dims = (shared_path(spark, x) for x in ("facts", "dims"))
    events.select("event_id", "user_id", "at").unionByName(end).write.parquet(facts)
    buys.unionByName(end.select("user_id", F.col("event_id").alias("first_buy"), F.col("at").alias("since"))).write.parquet(dims)
    streams = [spark.readStream.schema(spark.read.parquet(x).schema).parquet(x) for x in (facts, dims)]
    out = s.resolve_open_arrivals(*streams, "user_id", "first_buy", "at", "since", "2 HOURS")
    return to_table(spark, out.select("event_id", "user_id", "first_buy", "unresolved")).where("event_id IS NOT NULL")


@query("k4_fan_out", "SELECT lang, source, doc_id, n_chars FROM documents")
def k4(spark, sf):
    """The stream written by language and read back."""
    folder, progress = shared_path(spark, "fan-out"), shared_path(spark, "progress")
    stream = arriving(spark, sf, "documents").select("lang", "source", "doc_id", "n_chars")
    s.start_fan_out(stream, "lang", folder, progress, {"en": ["source", "n_chars"]}, seq="doc_id").awaitTermination()
    return s.read_fan_out(spark, folder, stream.schema)
