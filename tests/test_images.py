import statistics
import struct

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidyshelf.operators import images as j

PNG = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">ii", 300, 200) + b"\x08\x06"
GIF = b"GIF89a" + struct.pack("<HH", 640, 480) + b"\x00" * 20
START = b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"
FRAME = b"\xff\xc2\x00\x11\x08" + struct.pack(">HH", 77, 99) + b"\x03\x01\x22\x00"
CASES = {
    "png": (PNG, ("png", 300, 200)), "gif": (GIF, ("gif", 640, 480)), "jpeg": (START + FRAME, ("jpeg", 99, 77)),
    "padded": (START + b"\xff\xff" + FRAME, ("jpeg", 99, 77)),
    "long": (START + b"\xff\xe1\xff\xff" + b"x" * 65533 + FRAME, ("jpeg", 99, 77)),
    "noframe": (START + b"\xff\xdb\x00\x04ab", ("jpeg", None, None)), "cut": (START + FRAME[:6], ("jpeg", None, None)),
    "badcheck": (b"\x89PNG\r\n\x1a\x0b" + PNG[8:], (None, None, None)), "short": (PNG[:23], (None, None, None)),
    "text": (b"<html>this is no image at all</html>", (None, None, None)), "null": (None, (None, None, None)),
    "tables": (START + b"\xff\xc4\x00\x06abcd\xff\xcc\x00\x04ab" + FRAME, ("jpeg", 99, 77)),
    "raw": (b"\xff\xd8\xff\xdb\x00\x10" + b"y" * 14 + FRAME, ("jpeg", 99, 77)),
}


def test_headers(frame):
    df = frame([(name, bytearray(c) if c is not None else None) for name, (c, _) in CASES.items()], "name string, content binary")
    got = {r.name: (r.format, r.width, r.height) for r in j.image_sizes(df).collect()}
    assert got == {name: want for name, (_, want) in CASES.items()}
    assert rows(j.image_inventory(df)) == [("gif", 1, 0), ("jpeg", 7, 2), ("png", 1, 0), (None, 4, 4)]


SIZES = [("a", 400, 300), ("b", 100, 150), ("c", 90, 500), ("d", 90, 150)]


def test_summary_and_plan(frame):
    df = frame(SIZES, "path string, width bigint, height bigint")
    assert rows(j.dimension_summary(df)) == [(400, 90, 500, 150)]
    assert rows(j.dimension_summary(df, predicate=F.col("path") != "c")) == [(400, 90, 300, 150)]
    # 400x300 -> 90x67; 100x150 -> 90x135; 90x500 -> 27x150; 90x150 is on target.
    assert rows(j.resize_plan(df), "path", "new_width", "new_height", "offset_x", "offset_y") == [
        ("a", 90, 67, 0, 41), ("b", 90, 135, 0, 7), ("c", 27, 150, 31, 0)]
    # Never enlarged; offsets cut towards minus infinity.
    grow = frame([("s", 10, 11)], "path string, width bigint, height bigint")
    assert rows(j.resize_plan(grow, 101, 100), "new_width", "new_height", "offset_x", "offset_y") == [(10, 11, 45, 44)]
    thin = frame([("t", 1000, 1)], "path string, width bigint, height bigint")
    assert rows(j.resize_plan(thin, 10, 10), "new_width", "new_height") == [(10, 1)]


def test_choose_one(frame):
    sizes = frame([("big", 20, 20), ("small", 10, 10), ("wide", 30, 5)], "path string, width bigint, height bigint")
    records = frame([(1, ["x"]), (2, ["big", "small"]), (3, ["small", "big"]), (4, ["wide", "small"]), (5, None), (6, []),
                     (7, ["big", "small", "wide"]), (8, ["big", "lost"])], "id int, images array<string>")
    assert rows(j.choose_one(records, "images", sizes), "id", "chosen", "needs_review") == [
        (1, "x", False), (2, "big", False), (3, None, True), (4, None, True), (5, None, False), (6, None, False), (7, "big", False), (8, None, True)]


def test_references(frame):
    df = frame([(1, "a.png", None), (2, None, ""), (3, "b.png", "c.png")], "id int, image string, healthy string")
    long = j.unpivot_images(df, "heroes", "id")
    assert rows(long) == [("heroes", 1, "image", "a.png"), ("heroes", 3, "healthy", "c.png"), ("heroes", 3, "image", "b.png")]
    assert rows(j.unprocessed(long, frame([("a.png",), ("a.png",)], "path string")), "path") == [("b.png",), ("c.png",)]
    assert rows(j.copy_manifest(long, "in/", "out"), "read_path", "write_path")[0] == ("in/a.png", "out/a.png")


@pytest.mark.parametrize("kind,make", [("double", lambda i: (i * 37 % 101) / 7 - 3), ("bigint", lambda i: i * i * 7919 % 300007 - 1000),
                                       ("double", lambda i: 5.0), ("double", lambda i: i * 1e-7), ("double", lambda i: 1e300 * (i % 5) - 1e-9 * i)])
def test_median_equals_statistics(frame, kind, make):
    data = [(g, make(i)) for g, size in (("a", 7), ("b", 100), ("c", 1), ("d", 2)) for i in range(size)] + [("a", None), (None, make(1))]
    got = {r.g: r.median for r in j.exact_median(frame(data, f"g string, v {kind}"), "g", "v").collect()}
    want = {g: statistics.median([v for h, v in data if h == g and v is not None]) for g in {g for g, _ in data}}
    assert got == want


def test_median_at_the_limits(frame):
    inf, nan, top = float("inf"), float("nan"), 2 ** 63 - 1
    data = [("last", v) for v in (1e6, 2e6, 3e6, nan, nan)] + [("inf", v) for v in (-inf, 1.0, inf, inf, nan)] + [("close", v) for v in (1.0, 1.0 + 2 ** -40, 1.0 + 2 ** -30)]
    got = {r.g: r.median for r in j.exact_median(frame(data, "g string, v double"), "g", "v").collect()}
    assert got == {"last": 3e6, "inf": inf, "close": 1.0 + 2 ** -40}
    df = frame([("high", top), ("high", top - 1), ("low", -top), ("low", -top + 1), ("both", top), ("both", -top)], "g string, v bigint")
    assert {r.g: r.median for r in j.exact_median(df, "g", "v").collect()} == {"high": float(top), "low": float(-top), "both": 0.0}


def test_a_path_listed_twice_is_one_size(frame):
    df = frame([(1, ["a", "b"])], "id int, image array<string>")
    sizes = frame([("a", 5, 5), ("a", 9, 9), ("b", 7, 7)], "path string, width bigint, height bigint")
    assert rows(j.choose_one(df, "image", sizes), "id", "chosen", "needs_review") == [(1, "a", False)]


def test_band_is_cut_and_bounded(frame):
    df = frame([("a", 100.0), ("b", 250.0), ("c", -5.0)], "g string, v double")
    want = [(g, int(max(0, (1.0 - 0.33) * m)), int(min(255, (1.0 + 0.33) * m))) for g, m in (("a", 100.0), ("b", 250.0), ("c", -5.0))]
    assert rows(j.median_band(df, "g", "v"), "g", "lower", "upper") == want
    values = frame([("a", 67.0), ("a", 133.5), ("a", 66.9)], "g string, v double")
    assert rows(j.within_band(values, j.median_band(df, "g", "v"), "g", "v")) == [("a", 67.0)]


def test_rules(frame):
    df = frame([(1, "A"), (2, "B"), (3, None)], "id int, kind string")
    rules = [("first", F.col("kind") == "A"), ("low", F.col("id") < 2)]
    assert rows(j.assign_by_rules(df, rules), "id", "rule_pos", "rule") == [(1, 0, "first"), (1, 1, "low"), (2, None, None), (3, None, None)]
    assert rows(j.rule_report(df, rules)) == [("(none)", 2), ("(several)", 1), ("first", 1), ("low", 1)]
