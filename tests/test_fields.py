import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidyshelf.operators import fields as f


def test_rename_moves_to_the_end_and_replaces(frame):
    df = frame([(1, 2, 3)], "a int, b int, c int")
    assert f.rename_field(df, "a", "z").columns == ["b", "c", "z"]
    replaced = f.rename_field(df, "a", "c")
    assert replaced.columns == ["b", "c"] and rows(replaced) == [(2, 1)]
    assert f.rename_field(df, "absent", "z").columns == ["a", "b", "c"]


def test_remove_is_no_op_when_absent(frame):
    df = frame([(1, 2)], "a int, b int")
    assert f.remove_field(df, "a").columns == ["b"]
    assert f.remove_field(df, "absent").columns == ["a", "b"]


def test_order_columns(frame):
    df = frame([(1, 2, 3)], "c int, a int, b int")
    assert f.order_columns(df).columns == ["a", "b", "c"]
    preferred = ["b", "zz"]
    assert f.order_columns(df, preferred).columns == ["b", "c", "a"]
    assert preferred == ["b", "zz"]


def test_filter_equals_null_and_absent(frame):
    df = frame([(1, None), (2, "x"), (None, None)], "a int, b string")
    assert rows(f.filter_equals(df, b=None)) == [(1, None), (None, None)]
    assert rows(f.filter_equals(df, a=1, b=None)) == [(1, None)]
    assert rows(f.filter_equals(df, absent=None)) == []


def test_get_one(frame):
    df = frame([(1, "x"), (2, "x"), (3, "y")], "a int, b string")
    assert rows(f.get_one(df, b="y")) == [(3, "y")]
    with pytest.raises(Exception, match="none found"):
        f.get_one(df, b="z").collect()
    with pytest.raises(Exception, match="several found"):
        f.get_one(df, b="x").collect()


def test_drops_keep_null(frame):
    df = frame([("back",), ("BACK",), ("Backs",), (None,), ("x Alternate ART",)], "name string")
    assert rows(f.drop_named(df, "name", "Back")) == [("Backs",), ("x Alternate ART",), (None,)]
    assert rows(f.drop_suffix(df, "name", "alternate art")) == [("BACK",), ("Backs",), ("back",), (None,)]


def test_require_when(frame):
    df = frame([("A", None), ("A", "v"), ("B", None), (None, None)], "kind string, variant string")
    assert rows(f.require_when(df, "kind", "variant", ["A"])) == [("A", "v"), ("B", None), (None, None)]


def test_drop_reasons_split_the_rows(frame):
    df = frame([(1, None), (2, "x"), (3, "bad")], "a int, b string")
    rules = [("no b", F.col("b").isNull()), ("bad", F.col("b") == "bad"), ("big", F.col("a") > 2)]
    assert rows(f.rows_dropped(df, rules), "a", "drop_reason") == [(1, "no b"), (3, "bad")]
    assert rows(f.rows_kept(df, rules)) == [(2, "x")]


def test_subset(frame):
    df = frame([(1, ["a"]), (2, ["b"]), (3, None)], "a int, tags array<string>")
    assert rows(f.subset(df, f.lacks(F.col("tags"), "a"), "tags"), "a") == [(2,)]
    assert rows(f.subset(df, f.is_in(F.col("a"), [1, None])), "a") == [(1,)]
    assert rows(f.subset(df, attr="absent")) == []
    nulls = frame([(1,), (None,), (2,)], "a int")
    assert rows(f.subset(nulls, f.is_in(F.col("a"), [1, None]))) == [(1,), (None,)]
