"""Facts and plans from image headers and image references; no pixels are touched."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyshelf.session import pin

# Leading bytes by format, as hex.
PNG, GIF87, GIF89, JPEG_RAW = "89504E470D0A1A0A", "474946383761", "474946383961", "FFD8FFDB"
JFIF, EXIF = "4A464946", "45786966"
SHORTEST_HEADER = 24
# Markers among those of frames that hold Huffman tables, an extension, and arithmetic conditioning.
NO_FRAME = (0xC4, 0xC8, 0xCC)

SIZE = T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())])


def _hex(content: Column, start: int, length: int) -> Column:
    return F.hex(F.substring(content, start, length))


def _number(hexed: Column) -> Column:
    return F.conv(hexed, 16, 10).cast("bigint")


def _signed32(col: Column) -> Column:
    return F.when(col >= (1 << 31), col - (1 << 32)).otherwise(col)


def image_format(content: Column) -> Column:
    """png, gif or jpeg by the leading bytes, else null; files shorter than a header are null."""
    return F.when(F.octet_length(content) < SHORTEST_HEADER, F.lit(None)) \
        .when(_hex(content, 7, 4).isin(JFIF, EXIF) | (_hex(content, 1, 4) == JPEG_RAW), F.lit("jpeg")) \
        .when(_hex(content, 1, 8) == PNG, F.lit("png")) \
        .when(_hex(content, 1, 6).isin(GIF87, GIF89), F.lit("gif"))


def _jpeg_frame(content: bytes) -> tuple[int, int] | None:
    """(width, height) from the frame header, found by walking the segments."""
    at = 2
    while at < len(content):
        while at < len(content) and content[at] == 0xFF:
            at += 1
        if at + 3 > len(content):
            return None
        marker, length = content[at], int.from_bytes(content[at + 1:at + 3], "big")
        if 0xC0 <= marker <= 0xCF and marker not in NO_FRAME:
            head = content[at + 4:at + 8]
            return (int.from_bytes(head[2:], "big"), int.from_bytes(head[:2], "big")) if len(head) == 4 else None
        at += 1 + max(length, 2)
    return None


@F.pandas_udf(SIZE)
def jpeg_size(content: pd.Series) -> pd.DataFrame:
    """Sizes of JPEG bytes; null in, null out."""
    found = [None if c is None else _jpeg_frame(bytes(c)) for c in content]
    return pd.DataFrame({
        "width": pd.array([None if f is None else f[0] for f in found], dtype="Int64"),
        "height": pd.array([None if f is None else f[1] for f in found], dtype="Int64")})


# Marked so that a later filter on the size does not run it a second time.
jpeg_size = jpeg_size.asNondeterministic()


def image_sizes(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``format``, ``width`` and ``height``, null where the header cannot be read.

    PNG and GIF are read by built-in expressions; only JPEG bytes go to Python, others as null.
    """
    c, kind = F.col(content), F.col("format")
    sized = files.withColumn("format", image_format(c)).withColumn("_jpeg", jpeg_size(F.when(kind == "jpeg", c)))
    little = lambda start: _number(F.concat(_hex(c, start + 1, 1), _hex(c, start, 1)))
    width = F.when(kind == "png", _signed32(_number(_hex(c, 17, 4)))).when(kind == "gif", little(7)).otherwise(F.col("_jpeg.width"))
    height = F.when(kind == "png", _signed32(_number(_hex(c, 21, 4)))).when(kind == "gif", little(9)).otherwise(F.col("_jpeg.height"))
    return sized.withColumns({"width": width, "height": height}).drop("_jpeg")


def image_inventory(files: DataFrame, content: str = "content") -> DataFrame:
    """Files and unreadable files per format."""
    return image_sizes(files, content).groupBy("format").agg(
        F.count("*").alias("files"), F.count_if(F.col("width").isNull()).alias("unreadable"))


def dimension_summary(sizes: DataFrame, *by: str, predicate: Column | None = None) -> DataFrame:
    """Largest and smallest width and height, per group if asked."""
    rows = sizes if predicate is None else sizes.where(predicate)
    return rows.groupBy(*by).agg(
        F.max("width").alias("max_width"), F.min("width").alias("min_width"),
        F.max("height").alias("max_height"), F.min("height").alias("min_height"))


def resize_plan(sizes: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    """Fitted size and canvas offset of every image that is not on target yet.

    The target defaults to the smallest width and height found, which reads ``sizes`` twice: pin
    sizes that come straight from file contents. Sizes shrink by width first, then
    by height, cut to whole pixels and never below one; they never grow.
    """
    given = F.lit(width).cast("bigint"), F.lit(height).cast("bigint")
    if width is None or height is None:
        least = sizes.agg(F.struct(F.min("width").alias("w"), F.min("height").alias("h")).alias("least")).scalar()
        given = F.coalesce(given[0], least["w"]), F.coalesce(given[1], least["h"])
    rows = sizes.withColumns({"target_width": given[0], "target_height": given[1]})
    rows = rows.where((F.col("width") != F.col("target_width")) | (F.col("height") != F.col("target_height")))
    w, h, tw, th = (F.col(c) for c in ("width", "height", "target_width", "target_height"))
    h1 = F.when(w > tw, F.greatest(F.floor(h * tw / w), F.lit(1))).otherwise(h)
    w1 = F.least(w, tw)
    rows = rows.withColumns({"_w": w1, "_h": h1})
    w2 = F.when(F.col("_h") > th, F.greatest(F.floor(F.col("_w") * th / F.col("_h")), F.lit(1))).otherwise(F.col("_w"))
    rows = rows.withColumns({"new_width": w2, "new_height": F.least(F.col("_h"), th)}).drop("_w", "_h")
    return rows.withColumns({
        "offset_x": F.floor((tw - F.col("new_width")) / 2), "offset_y": F.floor((th - F.col("new_height")) / 2)})


def choose_one(records: DataFrame, col: str, sizes: DataFrame, path: str = "path") -> DataFrame:
    """Pick one of a list of candidate images, or flag the row for review.

    A single candidate is taken; of several, the first when it is larger than the second in both
    directions. Sizes are joined for these two candidates only; of a path listed more than once, its
    largest width and height count.
    """
    unique = sizes.groupBy(path).agg(F.max("width").alias("width"), F.max("height").alias("height"))

    def size_of(side: str) -> DataFrame:
        return unique.select(F.col(path).alias(f"_{side}"), F.col("width").alias(f"_{side}w"), F.col("height").alias(f"_{side}h"))

    several = F.size(col) > 1
    rows = records.withColumns({"_a": F.when(several, F.get(col, F.lit(0))), "_b": F.when(several, F.get(col, F.lit(1)))})
    rows = rows.join(size_of("a"), "_a", "left").join(size_of("b"), "_b", "left")
    larger = F.coalesce((F.col("_aw") > F.col("_bw")) & (F.col("_ah") > F.col("_bh")), F.lit(False))
    chosen = F.when((F.size(col) == 1) | larger, F.get(col, F.lit(0)))
    return rows.withColumns({"chosen": chosen, "needs_review": F.coalesce(several & ~larger, F.lit(False))}).select(
        *records.columns, "chosen", "needs_review")


def unpivot_images(records: DataFrame, table: str, pk: str,
                   attrs: Sequence[str] = ("image", "healthy", "wounded")) -> DataFrame:
    """One row ``(table, id, attr, path)`` per image reference; attributes a table lacks are passed over."""
    present = [a for a in attrs if a in records.columns]
    return (
        records.select(F.lit(table).alias("table"), F.col(pk).alias("id"), *present)
        .unpivot(["table", "id"], present, "attr", "path").where(F.col("path").isNotNull() & (F.col("path") != ""))
    )


def unprocessed(images: DataFrame, done: DataFrame, path: str = "path") -> DataFrame:
    """Image references whose path is not in the processed set."""
    return images.join(done.select(path).distinct(), path, "left_anti")


def copy_manifest(images: DataFrame, read_root: str, write_root: str, path: str = "path") -> DataFrame:
    """Source and target file of each image reference."""
    return images.withColumns({
        "read_path": F.concat_ws("/", F.lit(read_root.rstrip("/")), path),
        "write_path": F.concat_ws("/", F.lit(write_root.rstrip("/")), path)})


# Bin widths by which a median is closed in on, coarse to fine.
MEDIAN_BINS = (2.0 ** 16, 1.0, 2.0 ** -16)
LAST_BIN = 2 ** 63 - 1


def exact_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """Median per group as ``(by, median)``, the mean of the two middle values, as a double.

    Equal values are counted first, and the counts pinned. The middle ranks are then followed from wide bins to
    narrow ones by the bins' totals, so that a window never spans more than the bins inside one wider
    bin and no task holds a whole group. Nulls are left out; NaN is above all other values.
    """
    g, v = F.col(by).alias("_g"), F.col(value).alias("_v")
    counts = pin(df.where(F.col(value).isNotNull()).groupBy(g, v).agg(F.count("*").alias("_n")), "values")
    integral = isinstance(df.schema[value].dataType, T.IntegralType)
    return _narrowed_middle(counts, [w for w in MEDIAN_BINS if w >= 1 or not integral], integral).select(F.col("_g").alias(by), "median")


def _bin(width: float, integral: bool) -> Column:
    """Number of the bin of a value; never falls as the value grows."""
    if integral:
        return F.shiftright(F.col("_v").cast("bigint"), int(width).bit_length() - 1)
    return F.when(F.isnan("_v"), F.lit(LAST_BIN)).otherwise(F.floor(F.col("_v").cast("double") / F.lit(width)))


def _narrowed_middle(counts: DataFrame, widths: Sequence[float], integral: bool) -> DataFrame:
    """Medians by following the middle ranks through bins of falling width."""
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    targets = counts.groupBy(F.col("_g").alias("_tg")).agg(F.sum("_n").alias("_all")).select(
        "_tg", F.explode(F.array_distinct(F.array(low, high))).alias("_rank"), F.lit(0).cast("bigint").alias("_before"))
    wider = None
    for step in [_bin(w, integral) for w in widths] + [F.col("_v")]:
        inside = F.col("_g").eqNullSafe(F.col("_tg"))
        if wider is not None:
            inside = inside & (wider == F.col("_tbin"))
        up_to = Window.partitionBy("_g", "_rank").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = (
            counts.join(targets, inside).groupBy("_g", "_rank", "_before", step.alias("_bin")).agg(F.sum("_n").alias("_n"))
            .withColumn("_upto", F.col("_before") + F.sum("_n").over(up_to))
        )
        targets = bins.where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank"))).select(
            F.col("_g").alias("_tg"), "_rank", (F.col("_upto") - F.col("_n")).alias("_before"), F.col("_bin").alias("_tbin"))
        wider = step
    middle = (F.min("_tbin").cast("double") + F.max("_tbin").cast("double")) / 2
    return targets.groupBy(F.col("_tg").alias("_g")).agg(middle.alias("median"))


def median_band(df: DataFrame, by: str, value: str, sigma: float = 0.33, floor: float = 0, ceiling: float = 255) -> DataFrame:
    """Median per group and the band around it, cut to whole numbers and held within the bounds."""
    m = F.col("median")
    return exact_median(df, by, value).withColumns({
        "lower": F.greatest(F.lit(float(floor)), F.lit(1.0 - sigma) * m).cast("bigint"),
        "upper": F.least(F.lit(float(ceiling)), F.lit(1.0 + sigma) * m).cast("bigint")})


def within_band(df: DataFrame, bands: DataFrame, by: str, value: str) -> DataFrame:
    """Rows whose value lies in the band of their group."""
    limits = bands.select(F.col(by).alias("_g"), "lower", "upper")
    return (
        df.join(limits, F.col(by).eqNullSafe(F.col("_g"))).where(F.col(value).between(F.col("lower"), F.col("upper")))
        .drop("_g", "lower", "upper")
    )


def assign_by_rules(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row per rule that holds, in rule order as ``(rule_pos, rule)``; null for rows no rule takes."""
    hits = F.array(*[F.when(holds, F.struct(F.lit(i).alias("rule_pos"), F.lit(name).alias("rule")))
                     for i, (name, holds) in enumerate(rules)])
    return df.select(*df.columns, F.inline_outer(F.filter(hits, lambda h: h.isNotNull())))


def rule_report(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows per rule, and rows taken by none and by several, in one pass without multiplying rows."""
    holds = [F.coalesce(h, F.lit(False)) for _, h in rules]
    taken = sum((h.cast("int") for h in holds[1:]), holds[0].cast("int"))
    names = [n for n, _ in rules] + ["(none)", "(several)"]
    conditions = holds + [taken == 0, taken > 1]
    counts = df.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(conditions)])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(f"n{i}").alias("rows")) for i, n in enumerate(names)])))
