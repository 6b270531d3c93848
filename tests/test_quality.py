from conftest import rows
from pyspark.sql import functions as F

from tidyshelf.functions import cleaning as c
from tidyshelf.operators import quality as q


def one(frame, value, expr, kind="string"):
    return frame([(value,)], f"v {kind}", 1).select(expr(F.col("v"))).first()[0]


def test_integers(frame):
    cases = {"12": 12, " -3\t": -3, "+4": 4, "007": 7, ".": None, "1.5": None, "1_000": None, "x": None, "": None, None: None}
    for text, want in cases.items():
        assert one(frame, text, c.clean_int) == want, text
    valid = {"12": True, ".": True, None: True, "x": False, "": False, "1.5": False}
    for text, want in valid.items():
        assert one(frame, text, c.validate_int) is want, text
    assert one(frame, None, lambda v: c.validate_int(v, allow_null=False)) is False
    assert one(frame, ".", lambda v: c.validate_int(v, null_token=None)) is False


def test_text(frame):
    assert one(frame, " \t a b \n", c.clean_text) == "a b"
    assert one(frame, ".", c.clean_text) is None
    assert one(frame, " . ", c.clean_text) == "."
    assert one(frame, ".", lambda v: c.clean_text(v, None)) == "."
    assert one(frame, None, lambda v: c.validate_text(v, False)) is False
    assert one(frame, "", c.validate_text) is True


def test_choices(frame):
    choices = ["red", "green"]
    cases = {"0": "red", "1": "green", "2": "2", "-1": "-1", "red": "red", "01": "green", ".": None, "99999999999999": "99999999999999"}
    for text, want in cases.items():
        assert one(frame, text, lambda v: c.decode_choice(v, choices)) == want, text
    for value, want in {"red": True, "blue": False, None: True}.items():
        assert one(frame, value, lambda v: c.validate_choice(v, choices)) is want
    assert one(frame, None, lambda v: c.validate_choice(v, choices, False)) is False
    for value, want in ((["red"], True), ([], True), (["red", "blue"], False), (None, True), (["red", None], True)):
        assert one(frame, value, lambda v: c.validate_choice_list(v, choices), "array<string>") is want, value
    assert one(frame, ["red", None], lambda v: c.validate_choice_list(v, choices, False), "array<string>") is False


def test_overrides_beat_valid_values_even_with_null(frame):
    df = frame([(1, 5), (2, 6), (3, None)], "id int, cost int")
    memory = frame([("cards", "cost", "1", "9"), ("cards", "cost", "2", None), ("cards", "cost", "77", "1"), ("maps", "cost", "3", "4")],
                   "source string, field string, pk string, value string")
    assert rows(q.apply_overrides(df, memory, "cards", "cost", "id")) == [(1, 9), (2, None), (3, None)]


def test_repeated_and_unfit_answers(frame):
    df = frame([(1, 5), (2, 6), (3, None)], "id int, cost int")
    memory = frame([("cards", "cost", "1", "9", 1), ("cards", "cost", "1", "8", 2), ("cards", "cost", "2", "abc", 1), ("cards", "cost", "3", "4", 1), ("cards", "cost", "3", None, 2)],
                   "source string, field string, pk string, value string, version int")
    assert rows(q.apply_overrides(df, memory, "cards", "cost", "id", bad="bad")) == [(1, 8, False), (2, 6, True), (3, None, False)]
    assert rows(q.apply_overrides(df, memory.drop("version"), "cards", "cost", "id")) == [(1, 9), (2, 6), (3, 4)]


def test_append_choices(frame):
    df = frame([(1, ["a"]), (2, None), (3, ["x"]), (4, ["k", "k"])], "id int, tags array<string>")
    answers = frame([(1, 0, "b"), (1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 0, "z"), (3, 0, "y"), (3, 1, None), (3, 2, "w"), (4, 0, "k")],
                    "id int, n int, tag string")
    got = {r.id: r.tags for r in q.append_choices(df, answers, "id", "tags", "n", "tag").collect()}
    assert got == {1: ["a", "b", "c"], 2: ["z"], 3: None, 4: ["k", "k"]}
    twice = {r.id: r.tags for r in q.append_choices(df, answers, "id", "tags", "n", "tag", accept_duplicates=True).collect()}
    assert twice == {1: ["a", "b", "a", "b", "c"], 2: ["z"], 3: None, 4: ["k", "k", "k"]}


def rules():
    return [q.Rule("cost", "integer", c.validate_int(F.col("cost"), False)), q.Rule("kind", "known", c.validate_choice(F.col("kind"), ["A"]))]


def test_review_queue_and_summary(frame):
    df = frame([(1, "3", "A"), (2, None, "B"), (3, "x", None)], "id int, cost string, kind string")
    assert rows(q.review_queue(df, "cards", "id", rules())) == [
        ("cards", "cost", "2", "integer", None), ("cards", "cost", "3", "integer", "x"), ("cards", "kind", "2", "known", "B")]
    assert q.review_queue(df, "cards", "id", rules(), amend=True).count() == 6
    assert rows(q.validation_summary(df, rules())) == [("cost", "integer", 1, 2), ("kind", "known", 2, 1)]


def test_merge_answers(frame):
    schema = "source string, field string, pk string, value string"
    memory = frame([("c", "f", "1", "old"), ("c", "f", "2", "old"), ("c", "f", "3", "old")], schema)
    new = frame([("c", "f", "1", "n1", 1), ("c", "f", "1", "n2", 2), ("c", "f", "2", "", 1), ("c", "f", "3", None, 1), ("c", "f", "4", "x", 1)],
                schema + ", version int")
    assert rows(q.merge_answers(memory, new), "pk", "value") == [("1", "n2"), ("2", "old"), ("3", None), ("4", "x")]
