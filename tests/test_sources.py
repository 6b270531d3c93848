import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidyshelf.session import pin, shared_path, shared_root
from tidyshelf.sources import collections as src
from tidyshelf.sources import sinks
from tidyshelf.sources.arrays import read_array
from tidyshelf.sources.catalog import Catalog, Outdated, forget_versions, versions


def test_collection_keeps_order_within_and_across_files(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"n": 10, "x": "é"}, {"n": 11}]), encoding="utf-8")
    (tmp_path / "a.json").write_text(json.dumps([{"n": i} for i in range(5)], indent=2))
    df = src.read_collection(spark, str(tmp_path), "n int, x string")
    for wanted in ([0, 1, 2, 3, 4], [10, 11]):
        assert [r.n for r in df.where(F.col("n").isin(wanted)).orderBy("seq").collect()] == wanted
    by_path = src.read_collection(spark, str(tmp_path), "n int, x string", by_path=True)
    assert rows(by_path, "seq", "n") == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 10), (6, 11)]
    assert rows(by_path.where("n = 10"), "x") == [("é",)]


AWKWARD = ["}", "{", '"', "\\", '\\"', "]}", '{"n": 1}', "[", "\n", "é}{", "\\}", ""]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", ["3000", "1m"])
def test_one_array_is_read_by_many_tasks(spark, tmp_path, indent, size):
    rng = random.Random(7)
    def record(i):
        return {"n": i, "x": "".join(rng.choices(AWKWARD, k=rng.randrange(9))), "in": {"y": rng.choice(AWKWARD), "l": [{"z": rng.choice(AWKWARD)} for _ in range(rng.randrange(4))]}}
    wanted = {"b.json": [record(i) for i in range(200)], "a.json": [record(1000 + i) for i in range(30)], "c.json": [], "d.json": [{"n": 5000, "x": "long}" * 500}]}
    for name, records in wanted.items():
        (tmp_path / name).write_text(json.dumps(records, indent=indent, ensure_ascii=name == "a.json"), encoding="utf-8")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        schema = "n int, x string, `in` struct<y: string, l: array<struct<z: string>>>"
        got = read_array(spark, str(tmp_path), schema)
        plain = src.read_collection(spark, str(tmp_path), schema, by_path=True)
        assert rows(got) == rows(plain)
        assert [r.n for r in got.orderBy("seq").collect()] == [r["n"] for name in sorted(wanted) for r in wanted[name]]
        if size == "3000":
            assert spark.read.option("lineSep", "}").text(str(tmp_path / "b.json")).rdd.getNumPartitions() > 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_nested_documents(frame):
    schema = ("doc string, commandCards array<struct<card: struct<name: string>, deployment: struct<name: string>>>, "
              "deployments array<struct<card: struct<name: string>, deployment: struct<name: string>>>")
    card, deployment = lambda n: ((n,), None), lambda n: (None, (n,))
    df = frame([("d1", [card("a"), deployment("b")], [card("no")]), ("d2", [], [deployment("c")]), ("d3", None, [card("d")]), ("d4", None, None)], schema)
    out = src.explode_wrapped(df, ("commandCards", "deployments"), ("card", "deployment"), keep=("doc",))
    assert rows(out) == [("d1", 0, "a"), ("d1", 1, "b"), ("d2", 0, "c"), ("d3", 0, "d")]


def test_override_memory_round_trip(spark, frame, tmp_path):
    answers = frame([("cards", "cost", str(i), None if i == 3 else f"v{i}") for i in range(40)] + [("cards", "name", "12a", "x"), ("maps", "cost", "007", "y")],
                    "source string, field string, pk string, value string")
    assert sinks.pack_overrides(answers, entries=10).count() > 4
    sinks.write_overrides(answers, str(tmp_path / "memory"), entries=10)
    back = src.read_overrides(spark.read.schema(src.MEMORY_SCHEMA).json(str(tmp_path / "memory")))
    assert rows(back, "source", "field", "pk", "value") == rows(answers)
    assert rows(back.where("field = 'name' or source = 'maps'"), "pk", "pk_number") == [("007", 7), ("12a", None)]
    assert sinks.pack_overrides(answers.limit(0)).count() == 0


def test_an_answer_rewrites_its_shard_only(spark, frame, tmp_path):
    folder, kinds = str(tmp_path / "memory"), "source string, field string, pk string, value string, version int"
    first = frame([("cards", "cost", str(i), None if i == 3 else f"v{i}", 1) for i in range(200)] + [("maps", "cost", "007", "y", 1), ("maps", "x", "1", "", 1)], kinds)
    assert sinks.update_overrides(spark, folder, first, shards=8, entries=10) == list(range(8))
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "memory").rglob("shard=*/*.json")}
    before = files()
    touched = sinks.update_overrides(spark, folder, frame([("cards", "cost", "5", "old", 1), ("cards", "cost", "5", "new", 2), ("cards", "cost", "9", "", 3)], kinds), shards=99)
    kept = {p for p in before if p in files()}
    assert len(touched) == 1 and {p.parent.name for p in before if p not in kept} == {f"shard={touched[0]}"}
    back = src.read_overrides(spark.read.schema(src.MEMORY_SCHEMA).json(folder))
    want = {("cards", "cost", str(i)): None if i == 3 else f"v{i}" for i in range(200)} | {("maps", "cost", "007"): "y", ("cards", "cost", "5"): "new"}
    assert {(r.source, r.field, r.pk): r.value for r in back.collect()} == want and back.count() == 201
    assert sinks.update_overrides(spark, folder, frame([], kinds)) == []


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_write_by_type(spark, frame, tmp_path, fmt):
    df = frame([("backs", "b", None, 0), ("backs", "a", "z", 1), ("backs", "a", None, 2), ("maps", "q", "y", 3), ("maps", "c", "x", 4)],
               "kind string, deck string, variant string, seq int", 4)
    folder = str(tmp_path / fmt)
    report = sinks.write_by_type(df, "kind", folder, {"backs": ["deck", "variant"]}, known=["backs", "maps", "none"], seq="seq", fmt=fmt)
    assert rows(report) == [("backs", 3), ("maps", 2), ("none", 0)]
    def written(kind):
        files = sorted((tmp_path / fmt / f"kind={kind}").glob("*." + fmt)) if fmt == "json" else []
        return [json.loads(line)["seq"] for f in files for line in f.read_text().splitlines()]
    if fmt == "json":
        assert written("backs") == [2, 1, 0] and written("maps") == [3, 4]
    assert (tmp_path / fmt / "kind=none").is_dir()
    assert spark.read.schema(df.schema).format(fmt).load(folder).count() == 5


def test_catalog(spark, frame, tmp_path):
    catalog = Catalog(spark)
    catalog.add("cards", frame([(1,), (2,)], "id int"))
    catalog.add("card-backs", frame([], "id int, deck string"))
    catalog.save(str(tmp_path))
    loaded = Catalog.load(spark, str(tmp_path), ["cards", "card-backs"])
    assert rows(loaded.summary()) == [("card-backs", 0, 2), ("cards", 2, 1)]
    assert spark.sql("select count(*) from card_backs").first()[0] == 0
    with pytest.raises(Exception, match="already exists"):
        loaded.save(str(tmp_path))


def test_catalog_is_saved_in_place(spark, frame, tmp_path):
    home = str(tmp_path / "home")
    first = Catalog(spark)
    first.add("cards", frame([(i, f"c{i}") for i in range(10)], "id int, name string"))
    first.add("decks", frame([(1,)], "id int"))
    assert Catalog.open(spark, home).version == 0 and first.commit(home) == 1
    opened = Catalog.open(spark, home)
    opened.add("cards", opened["cards"].where("id < 3"))
    assert opened.commit() == 2 and rows(opened["cards"], "id") == [(0,), (1,), (2,)]
    opened.drop("decks")
    opened.add("backs", frame([], "id int, at timestamp"))
    assert opened.commit() == 3 and list(opened) == ["cards", "backs"]
    assert versions(spark, home) == [1, 2, 3]
    assert {v: sorted(Catalog.open(spark, home, v)) for v in (1, 2, 3)} == {1: ["cards", "decks"], 2: ["cards", "decks"], 3: ["backs", "cards"]}
    assert Catalog.open(spark, home, 1)["cards"].count() == 10
    # a table that did not change is not written again
    assert Catalog.open(spark, home, 1)["decks"].inputFiles() == Catalog.open(spark, home, 2)["decks"].inputFiles()
    assert forget_versions(spark, home, keep=2) == [1]
    assert Catalog.open(spark, home, 2)["decks"].count() == 1 and Catalog.open(spark, home)["cards"].count() == 3
    with pytest.raises(ValueError, match="no version 1"):
        Catalog.open(spark, home, 1)


def test_a_save_that_fails_half_way_leaves_the_version_before(spark, frame, tmp_path):
    home = str(tmp_path / "home")
    first = Catalog(spark)
    first.add("a", frame([(1,), (2,)], "id int"))
    first.add("z", frame([(3,)], "id int"))
    first.commit(home)
    files = {p for p in (tmp_path / "home").rglob("*.parquet")}
    broken = Catalog.open(spark, home)
    broken.add("a", broken["a"].where("id = 1"))
    broken.add("z", broken["z"].withColumn("id", F.raise_error(F.lit("half way")).cast("int")))
    with pytest.raises(Exception, match="half way"):
        broken.commit()
    assert versions(spark, home) == [1] and rows(Catalog.open(spark, home)["a"]) == [(1,), (2,)]
    assert {p for p in (tmp_path / "home").rglob("*.parquet")} == files


def test_two_saves_from_one_version(spark, frame, tmp_path):
    home = str(tmp_path / "home")
    first = Catalog(spark)
    first.add("a", frame([(1,)], "id int"))
    first.commit(home)
    one, two = Catalog.open(spark, home), Catalog.open(spark, home)
    one.add("a", frame([(2,)], "id int"))
    two.add("a", frame([(3,)], "id int"))
    one.commit()
    with pytest.raises(Outdated):
        two.commit()
    assert rows(Catalog.open(spark, home)["a"]) == [(2,)]


def test_a_plain_save_never_empties_what_it_reads(spark, frame, tmp_path):
    catalog = Catalog(spark)
    catalog.add("a", frame([(1,), (2,)], "id int"))
    catalog.save(str(tmp_path))
    loaded = Catalog.load(spark, str(tmp_path), ["a"])
    loaded.add("a", loaded["a"].where("id = 1"))
    with pytest.raises(ValueError, match="commit"):
        loaded.save(str(tmp_path), mode="overwrite")
    assert rows(spark.read.parquet(str(tmp_path / "a.parquet"))) == [(1,), (2,)]
    loaded.save(str(tmp_path / "other"), mode="overwrite")


def test_append_and_default(spark, frame, tmp_path):
    out = sinks.append_records(frame([(1, "a")], "id int, x string"), frame([(2, True)], "id int, y boolean"))
    assert rows(out) == [(1, "a", None), (2, None, True)]
    missing = str(tmp_path / "missing")
    assert src.read_or_default(spark, missing, "id int").columns == ["id"]
    assert src.read_or_default(spark, missing, "id int", fmt="json").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        src.read_or_default(spark, missing, "id int", default=False)


def test_hash_list_and_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "hashes.txt").write_text("  aa bb\n\tcc aa\n\n")
    (tmp_path / "sub" / "x.png").write_bytes(b"12345")
    assert rows(src.read_hash_list(spark, str(tmp_path / "hashes.txt"))) == [("aa",), ("bb",), ("cc",)]
    assert rows(src.list_files(spark, str(tmp_path), "*.png")) == [("sub/x.png", 5)]


def test_pin_keeps_rows_in_the_shared_folder(spark, frame):
    df = frame([(1, "a"), (2, None)], "id int, x string")
    pinned = pin(df)
    assert rows(pinned) == rows(df)
    assert shared_path(spark, "x").startswith(shared_root(spark) + "/")
    assert shared_path(spark, "x") != shared_path(spark, "x")


class Unset:
    """A session as far as the shared folder looks at one, without the setting."""

    def __init__(self, master):
        self.conf = {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-" + master})


def test_only_local_sessions_may_lack_a_shared_folder():
    local = Unset("local[2]")
    assert shared_root(local) == shared_root(local)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(Unset("yarn"))


def test_the_folder_is_cut_off_at_its_own_place(spark, tmp_path):
    folder = tmp_path / "a" / "b" / "a" / "b"
    folder.mkdir(parents=True)
    (folder / "x.txt").write_text("1")
    (tmp_path / "a" / "b" / "y.txt").write_text("2")
    assert rows(src.list_files(spark, str(tmp_path / "a" / "b")), "path") == [("a/b/x.txt",), ("y.txt",)]


def test_a_finished_scope_leaves_no_files(spark, frame):
    import os

    from tidyshelf.session import pin, pinned, shared_path, shared_root

    root = os.path.join(shared_root(spark), spark.sparkContext.applicationId)
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(root) for f in names}
    kept = pin(frame([(1,)], "n int"))
    before = files()
    with pinned(spark):
        with pinned(spark):
            assert pin(frame([(2,)], "n int")).count() == 1
        inner = pin(frame([(3,)], "n int"))
        assert inner.count() == 1 and files() > before
    assert files() == before and kept.count() == 1 and "scope" not in shared_path(spark, "x")


def test_an_overwrite_reads_nothing_back(spark, frame, tmp_path):
    df = frame([("a", 1), ("b", 2), ("a", 3)], "kind string, n int")
    folder = str(tmp_path / "out")
    report = sinks.write_by_type(df, "kind", folder, known=["a", "z"], seq="n", mode="overwrite")
    assert folder not in report._jdf.queryExecution().analyzed().toString() and not [f for f in report.inputFiles() if folder in f]
    assert rows(report) == [("a", 2), ("b", 1), ("z", 0)]
