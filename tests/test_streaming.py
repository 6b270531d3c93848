import hashlib
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidyshelf.functions import text as t
from tidyshelf.operators import fields as f
from tidyshelf.plans import streams
from tidyshelf.streaming import stages as s

SCHEMA = "id int, kind string, name string, at timestamp"


def feed(spark, tmp_path, *batches):
    """A file stream that takes one file per micro-batch."""
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA.replace("timestamp", "string")).coalesce(1).write.mode("append").json(str(folder / "data"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder / "data"))


BATCHES = ([(1, "a", "One Cards", "2024-01-01 00:00:00"), (2, "a", "back", "2024-01-01 00:00:01")],
           [(3, "b", "Two", "2024-01-01 00:00:02"), (4, "a", "One Cards", "2024-01-01 00:00:03")])
STAGES = [(200, lambda d: f.drop_named(d, "name", "back")), (100, lambda d: d.withColumn("name", t.strip_words(F.col("name"), [" Cards"]))),
          (200, lambda d: d.withColumn("slug", t.slugify(F.col("name"))))]


def test_stages_batch_equals_stream(spark, tmp_path):
    stream = s.apply_stages(feed(spark, tmp_path, *BATCHES), STAGES)
    out = s.run_to_table(stream.select("id", "slug"), str(tmp_path / "out"), str(tmp_path / "progress"))
    batch = s.apply_stages(spark.createDataFrame([r for b in BATCHES for r in b], SCHEMA.replace("timestamp", "string")), STAGES)
    assert rows(out) == rows(batch, "id", "slug") == [(1, "one"), (3, "two"), (4, "one")]


def test_priorities_order_the_chain(spark):
    df = spark.createDataFrame([("x",)], "v string")
    add = lambda c: lambda d: d.withColumn("v", F.concat("v", F.lit(c)))
    assert s.apply_stages(df, [(2, add("b")), (1, add("a")), (2, add("c"))]).first().v == "xabc"


def test_dedup_arrivals(spark, tmp_path):
    out = s.run_to_table(s.dedup_arrivals(feed(spark, tmp_path, *BATCHES), ["kind", "name"]), str(tmp_path / "out"), str(tmp_path / "progress"))
    assert rows(out, "kind", "name") == [("a", "One Cards"), ("a", "back"), ("b", "Two")]


def test_dedup_within_watermark(spark, tmp_path):
    stream = s.dedup_arrivals(feed(spark, tmp_path, *BATCHES), ["kind", "name"], "at", "1 hour")
    out = s.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "progress"))
    assert rows(out, "kind", "name") == [("a", "One Cards"), ("a", "back"), ("b", "Two")]


def test_static_joins(spark, frame, tmp_path):
    deny = frame([(hashlib.sha512(b"Two").hexdigest(),)], "digest string")
    ids = frame([("One Cards", 7)], "name string, name_id int")
    stream = s.resolve_arrivals(s.drop_known_arrivals(feed(spark, tmp_path, *BATCHES), "name", deny), ids, "name", "name_id")
    out = s.run_to_table(stream.select("id", "name_id", "unresolved"), str(tmp_path / "out"), str(tmp_path / "progress"))
    assert rows(out) == [(1, 7, False), (2, None, True), (4, 7, False)]


def test_fan_out_restarts_without_loss_or_doubles(spark, tmp_path):
    folder, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    def run(*batches):
        s.start_fan_out(feed(spark, tmp_path, *batches), "kind", folder, progress, {"a": ["name"]}, seq="id").awaitTermination()
        return rows(s.read_fan_out(spark, folder, StructType.fromDDL(SCHEMA)), "id", "kind")
    assert run(BATCHES[0]) == [(1, "a"), (2, "a")]
    assert run(BATCHES[1]) == [(1, "a"), (2, "a"), (3, "b"), (4, "a")]
    assert run() == [(1, "a"), (2, "a"), (3, "b"), (4, "a")]


def test_first_arrivals_keep_the_whole_first_record(spark, tmp_path):
    again = [(0, "a", "back", "2024-01-02 00:00:00"), (9, "c", "x", "2024-01-02 00:00:00"), (8, "c", "x", "2024-01-02 00:00:01")]
    out = s.run_to_table(s.first_arrivals(feed(spark, tmp_path, *BATCHES, again), ["kind", "name"], "id"), str(tmp_path / "out"), str(tmp_path / "progress"))
    got = {r.id for r in out.collect()}
    assert len(got) == 4 and 8 in got and 3 in got


def feed_in_order(spark, tmp_path, name, schema, batches):
    folder = tmp_path / name
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema.replace("timestamp", "string")).coalesce(1).write.mode("append").json(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


FACTS = [(1, "a", "2024-01-01 00:00:00"), (2, "b", "2024-01-01 00:10:00"), (3, None, "2024-01-01 00:20:00"), (4, "a", "2024-01-01 03:00:00"), (5, "c", "2024-01-01 00:05:00")]
DIMS = [("a", 10, "2024-01-01 00:30:00"), ("b", 11, "2024-01-01 05:00:00"), ("x", 12, "2024-01-01 00:00:00")]
END = "2025-01-01 00:00:00"


@pytest.mark.parametrize("facts_first", [True, False])
def test_facts_before_their_dimension(spark, tmp_path, facts_first):
    order = (lambda x: x) if facts_first else (lambda x: x[::-1])
    facts = feed_in_order(spark, tmp_path, "facts", "id int, name string, at timestamp", [[f] for f in order(FACTS)] + [[(9, None, END)]])
    pause = [[("z", 99, "2024-01-01 00:00:00")]] * 6 if facts_first else []
    dims = feed_in_order(spark, tmp_path, "dims", "name string, name_id int, since timestamp", pause + [[d] for d in order(DIMS)] + [[("end", 0, END)]])
    out = s.resolve_open_arrivals(facts, dims, "name", "name_id", "at", "since", "1 HOUR", delay="2 days", salts=3)
    got = s.run_to_table(out, str(tmp_path / "out"), str(tmp_path / "progress")).where("id < 9")
    # b's row comes more than an hour after the fact, c never comes; a's row counts before and after
    assert rows(got, "id", "name_id", "unresolved") == [(1, 10, False), (2, None, True), (3, None, False), (4, 10, False), (5, None, True)]


def test_first_records_have_bounded_state(spark, tmp_path):
    schema = "id int, kind string, at timestamp"
    day = lambda d, h: f"2024-01-{d:02} {h:02}:00:00"
    batches = [[(5, "a", day(1, 0)), (4, "a", day(1, 1)), (6, "b", day(1, 0))], [(2, "a", day(1, 2)), (9, "c", day(2, 0))], [(7, "a", day(3, 0)), (8, "a", day(3, 1))],
               [(10, "z", day(9, 0))], [(11, "z", day(20, 0))]]
    stream = feed_in_order(spark, tmp_path, "in", schema, batches)
    firsts = s.first_records(stream, ["kind"], "id", "at", "3 hours")
    query = firsts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")) \
        .trigger(availableNow=True).start()
    query.awaitTermination()
    # the run of "a" on the first day spans two batches; the last record's run is still open
    assert rows(spark.read.schema(schema).parquet(str(tmp_path / "out")), "id", "kind") == [(10, "z"), (2, "a"), (6, "b"), (7, "a"), (9, "c")]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json), query.recentProgress) if p["stateOperators"]]
    assert max(held) >= 2 and held[-1] == 1


def test_tables_arrive_from_a_file_and_from_a_folder_of_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Text {i}", "de" if i % 3 else "en", "src1", i) for i in range(20)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "one" / "documents.parquet")
    for folder in ("one", "many"):
        sf = str(tmp_path / folder)
        assert rows(streams.k4(spark, sf)) == rows(docs, "lang", "source", "doc_id", "n_chars")
        assert rows(streams.k1_stream(spark, sf)) == rows(streams.k1(spark, sf))


def test_first_arrivals_of_many_kinds_of_columns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(s, "COMBINED", 4)
    schema = "id string, kind string, tag struct<a:int,b:string>, big bigint"
    batches = [[(f"i{9 - i % 9}", "a" if i % 2 else None, (i % 3, None), 2**60 + i if i % 4 else None) for i in range(90)],
               [("i0", "a", (1, None), 1), ("z", "a", (1, "new"), 2), (None, "n", (0, ""), 3)]]
    stream = feed_in_order(spark, tmp_path, "in", schema, batches)
    firsts = s.first_arrivals(stream, ["kind", "tag"], "id", buckets=3)
    got = s.run_to_table(firsts, str(tmp_path / "out"), str(tmp_path / "progress")).collect()
    best = {}
    for batch in batches:
        least = {}
        for r in batch:
            if r[1:3] not in least or r[0] < least[r[1:3]]:
                least[r[1:3]] = r[0]
        best = {**least, **best}
    assert {(r.kind, tuple(r.tag)): r.id for r in got} == best and len(got) == len(best) == 8
    given = {(r[0], r[1], r[2], r[3]) for batch in batches for r in batch}
    assert all((r.id, r.kind, tuple(r.tag), r.big) in given for r in got)


def test_first_arrivals_are_combined_before_they_are_shuffled(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(300000).selectExpr("300000 - id AS id", "if(id % 1000 = 0, cast(id as string), 'hot') AS kind").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("id bigint, kind string").parquet(folder)
    query = s.first_arrivals(stream, ["kind"], "id").writeStream.format("parquet").option("path", str(tmp_path / "out")) \
        .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema("id bigint, kind string").parquet(str(tmp_path / "out"))
    assert out.count() == 301 and out.where("kind = 'hot'").first().id == 1
    # a key costs one row of state, and one row of a batch gets there
    state = [json.loads(p.json)["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]]
    assert [x["numRowsTotal"] for x in state] == [301] and state[0]["customMetrics"]["numDroppedDuplicateRows"] == 0
