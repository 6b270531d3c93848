"""Text normalisation as Column -> Column functions; everything stays inside codegen."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The code points that count as white space, as a text and as a regular-expression
# class, and the class of letters, digits and the underscore.
BLANKS = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
SPACE = "".join(f"\\x{{{ord(c):x}}}" for c in BLANKS)
WORD = r"\p{L}\p{N}_"


def strip(col: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(col, F.lit(BLANKS))


def literal_map(mapping: Mapping[str, str]) -> Column:
    """A small mapping as a map literal; large ones are joined instead, see ``replace_by_table``."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")


def replace_exact(col: Column, mapping: Mapping[str, str]) -> Column:
    """Whole-value corrections; values without an entry pass."""
    return F.coalesce(F.try_element_at(literal_map(mapping), col), col)


def replace_by_table(df: DataFrame, col: str, mapping: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Whole-value corrections from a mapping of any size; values without an entry pass.

    A key listed twice counts once, with its greatest value. A left join, so Spark broadcasts the
    mapping when its size allows and splits hot values otherwise.
    """
    entries = mapping.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(value).alias("_value"))
    joined = df.join(entries, F.col(col) == F.col("_key"), "left")
    return joined.select(*[F.coalesce("_value", F.col(c)).alias(c) if c == col else F.col(c) for c in df.columns])


def strip_words(col: Column, words: Sequence[str] | Mapping[str, str]) -> Column:
    """Replace each text everywhere, in the given order, by nothing or by its mapped text."""
    pairs = words.items() if isinstance(words, Mapping) else [(w, "") for w in words]
    for old, new in pairs:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def singular(col: Column) -> Column:
    """Drop one final ``s``."""
    return F.when(F.endswith(col, F.lit("s")), F.left(col, F.length(col) - 1)).otherwise(col)


def resolve_sentinel(col: Column, prefix: str, mapping: Mapping[str, str]) -> Column:
    """Look marked values up without their marker; an unknown key gives null (see ``sentinel_unknown``)."""
    key = F.replace(col, F.lit(prefix), F.lit(""))
    return F.when(F.startswith(col, F.lit(prefix)), F.try_element_at(literal_map(mapping), key)).otherwise(col)


def sentinel_unknown(col: Column, prefix: str, mapping: Mapping[str, str]) -> Column:
    """True for a marked value whose key is not in the mapping."""
    return col.isNotNull() & F.startswith(col, F.lit(prefix)) & resolve_sentinel(col, prefix, mapping).isNull()


def default_by_set(col: Column, key: Column, members: Sequence[str], inside: str, outside: str) -> Column:
    """Fill a null with one constant when the key is in the set, else with the other."""
    is_member = F.coalesce(key.isin(list(members)), F.lit(False))
    return F.coalesce(col, F.when(is_member, F.lit(inside)).otherwise(F.lit(outside)))


def split_suffix(df: DataFrame, col: str, suffixes: Sequence[str], out: str) -> DataFrame:
    """Move a trailing marker into its own column.

    Each marker is tried as written and in lower case. A hit sets ``out`` to the marker and removes
    the marker with its leading blank everywhere in the name.
    """
    name = F.col(col)
    label, rest = F.lit(None).cast("string"), name
    for marker in reversed(list(suffixes)):
        casings = [marker, marker.lower()]
        hit = F.endswith(name, F.lit(casings[0])) | F.endswith(name, F.lit(casings[1]))
        label = F.when(hit, F.lit(marker)).otherwise(label)
        rest = F.when(hit, strip_words(name, [" " + c for c in casings])).otherwise(rest)
    return df.withColumns({out: label, col: rest})


def normalize_source(col: Column, rename: Mapping[str, str], remove: str, corrections: Mapping[str, str]) -> Column:
    """Rename, remove a word, trim, then correct: the fixed order for source names."""
    return replace_exact(strip(strip_words(replace_exact(col, rename), [remove])), corrections)


def slugify(col: Column) -> Column:
    """Lower-case words joined by single hyphens; everything but word characters goes.

    White space and single hyphens are mapped character by character, so that the patterns stay
    short and only real runs are rewritten.
    """
    blank = F.translate(col, BLANKS, " " * len(BLANKS))
    kept = F.btrim(F.regexp_replace(blank, f"[^{WORD} -]+", ""))
    return F.regexp_replace(F.translate(F.lower(kept), " ", "-"), "-{2,}", "-")


def squeeze(col: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.lower(F.regexp_replace(col, r"[^\p{L}\p{N}]+", ""))


def _name_parts(df: DataFrame, attrs: Sequence[str], flags: Sequence[str] | None, elite: str, unique: str,
                set_attr: str, full_set: Sequence[str]) -> list[Column]:
    """One nullable string or string-array column per attribute that can add to a name."""
    parts = []
    for attr in attrs:
        if attr not in df.columns:
            continue
        kind, col = df.schema[attr].dataType, F.col(attr)
        if isinstance(kind, T.BooleanType):
            if flags is not None and attr not in flags:
                continue
            shown = col
            if attr == elite and unique in df.columns:
                shown = col & ~F.coalesce(F.col(unique), F.lit(False))
            parts.append(F.when(shown, F.lit(attr)))
        elif isinstance(kind, (T.StringType, T.IntegralType)):
            parts.append(col.cast("string"))
        elif isinstance(kind, T.ArrayType) and attr == set_attr:
            everything = F.array(*[F.lit(x) for x in sorted(set(full_set))]).cast("array<string>")
            parts.append(F.when(F.array_sort(F.array_distinct(col)) != everything, col))
    return parts


def canonical_name(df: DataFrame, *attrs: str, elite: str = "elite", unique: str = "unique",
                   set_attr: str = "modes", full_set: Sequence[str] = ()) -> Column:
    """Name made of the attributes by their type, squeezed to lower-case letters and digits.

    Nulls and false add nothing, true adds the attribute's own name (``elite`` only on records that
    are not unique), text and integers add themselves, the set attribute adds its values unless it
    holds the full set.
    """
    parts = _name_parts(df, attrs, None, elite, unique, set_attr, full_set)
    return squeeze(F.concat_ws("", *parts)) if parts else F.lit("")


def filename_words(df: DataFrame, *attrs: str, elite: str = "elite", unique: str = "unique",
                   set_attr: str = "modes", full_set: Sequence[str] = (),
                   prefixes: Sequence[str] = (), suffixes: Sequence[str] = ()) -> Column:
    """As ``canonical_name`` with every word slugified and joined by hyphens; only ``elite`` shows as a flag."""
    words = []
    for part, attr in zip(*_parts_with_attr(df, attrs, elite, unique, set_attr, full_set)):
        is_list = isinstance(df.schema[attr].dataType, T.ArrayType)
        words.append(F.transform(part, slugify) if is_list else slugify(part))
    return F.concat_ws("-", *[F.lit(p) for p in prefixes], *words, *[F.lit(s) for s in suffixes])


def _parts_with_attr(df, attrs, elite, unique, set_attr, full_set):
    pairs = [(p, a) for a in attrs for p in _name_parts(df, [a], [elite], elite, unique, set_attr, full_set)]
    return [p for p, _ in pairs], [a for _, a in pairs]


def derived_path(df: DataFrame, table: str, path_attrs: Sequence[str], name_attrs: Sequence[str],
                 parent: str | None = None, extension: str = "png", **naming) -> Column:
    """``table-slug/attr-slugs/name.ext``; null path attributes are left out.

    ``parent`` names a looked-up column whose slug starts the file name.
    """
    stem = filename_words(df, *name_attrs, **naming)
    if parent:
        stem = F.concat_ws("-", slugify(F.col(parent)), F.when(stem != "", stem))
    folders = [slugify(F.col(a).cast("string")) for a in path_attrs]
    return F.concat_ws("/", slugify(F.lit(table)), *folders, F.concat(stem, F.lit("." + extension)))


def rewrite_url(col: Column, host: str, cache: str = "/cache", albums: str = "/albums",
                thumbnail: str = r"_[0-9]{3}_thumb_[a-zA-Z]{8}_whatermark_cc") -> Column:
    """Thumbnail URL -> full-size URL on the host. The defaults are fixed values."""
    full = F.replace(col, F.lit(cache), F.lit(albums))
    return F.concat(F.lit(host), F.regexp_replace(full, thumbnail, ""))


def file_stem(col: Column) -> Column:
    """Text before the first dot."""
    return F.substring_index(col, ".", 1)


def file_extension(col: Column) -> Column:
    """Text after the last dot."""
    return F.substring_index(col, ".", -1)


def trailing_int(col: Column) -> Column:
    """The last run of digits as a number, null without one."""
    return F.try_element_at(F.regexp_extract_all(col, F.lit(r"[0-9]+"), 0), F.lit(-1)).try_cast("bigint")


def strip_to_int(col: Column, words: Sequence[str]) -> Column:
    """Lower-case, remove the words, read the rest as a number, null if it is none."""
    rest = strip(strip_words(F.lower(col), words))
    return F.when(F.rlike(rest, F.lit(r"^[+-]?[0-9]+$")), rest.try_cast("bigint"))


#: The named character references of HTML that end with a semicolon, but for the ampersand's own.
NAMED_REFERENCES = {f"&{name}": text for name, text in html5.items() if name.endswith(";") and text != "&"}


def unescape_html(col: Column, named: Mapping[str, str] = NAMED_REFERENCES) -> Column:
    """Character references as their characters: all numeric ones, decimal or hex, and the named ones given.

    ``&amp;`` comes last, so nothing is decoded twice. Numbers that stand for no character give the replacement character, and
    names without one stay as they are. The names are one constant of the plan, looked up for the references that a text holds.
    """
    found = F.array_distinct(F.regexp_extract_all(col, F.lit("&#([0-9]{1,9}|[xX][0-9a-fA-F]{1,8});"), 1))

    def character(number: Column) -> Column:
        hexadecimal = F.lower(F.substring(number, 1, 1)) == "x"
        code = F.when(hexadecimal, F.conv(F.substr(number, F.lit(2)), 16, 10)).otherwise(number).cast("bigint")
        known = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        bytes_ = F.unhex(F.lpad(F.hex(F.when(known, code).otherwise(F.lit(0xFFFD))), 8, "0"))
        return F.when(code == 38, F.lit("&amp;")).otherwise(F.decode(bytes_, "UTF-32"))

    numbered = F.aggregate(found, col, lambda text, number: F.replace(text, F.concat(F.lit("&#"), number, F.lit(";")), character(number)))
    plain = F.when(F.contains(col, F.lit("&#")), numbered).otherwise(col)
    characters = F.from_json(F.lit(json.dumps(dict(named))), "map<string,string>")
    names = F.array_distinct(F.regexp_extract_all(plain, F.lit("&[A-Za-z][A-Za-z0-9]*;"), 0))
    lettered = F.aggregate(names, plain, lambda text, name: F.replace(text, name, F.coalesce(F.try_element_at(characters, name), name)))
    lettered = F.when(F.contains(plain, F.lit("&")), lettered).otherwise(plain)
    return F.replace(F.replace(lettered, F.lit("&AMP;"), F.lit("&amp;")), F.lit("&amp;"), F.lit("&"))
