"""Text expressions that behave as the note format needs, in built-in functions only.

Java's and Python's classes of white space and line ends differ, so both are spelled out here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: All 29 white-space characters of the note format (fixed values).
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
#: Line ends that split lines (fixed values).
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def once(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """``rows.select(*columns)``, in which expressions are computed once a row, whatever filters and selections follow: the
    optimizer does not inline them. Columns that are given by name pass as they are, and filters on them reach the scan."""
    return rows.select(*(c for c in columns if isinstance(c, str)), F.inline(F.array(F.struct(*(c for c in columns if not isinstance(c, str))))))


#: The same characters one by one, for functions that trim.
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """White space collapsed to one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, f"{SPACE}+", " "))


def unquote(c: Column) -> Column:
    """Without quotation marks at the ends."""
    return F.btrim(c, F.lit("\"'"))


def lines(c: Column) -> Column:
    """Lines of a text; a line end at the very end opens no further line."""
    parts = F.split(c, LINE_END)
    n = F.size(parts)
    return F.when(F.try_element_at(parts, n) == "", F.slice(parts, 1, n - 1)).otherwise(parts)


def last_component(path: Column) -> Column:
    """The last component of a path; empty if there is none."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def without_md(path: Column) -> Column:
    return F.regexp_replace(path, r"\.md$", "")


def stem(path: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(last_component(path), r"(?s)(?<=.)\.[^.]+$", "")


def key_file_name(key: Column) -> Column:
    """The file name of a citation key: ``:`` and ``/`` become hyphens, the rest stays."""
    return F.translate(key, ":/", "--")


def slug(c: Column) -> Column:
    """An idea's name as a folder name: lower case, runs of other characters as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def to_double(c: Column) -> Column:
    """A decimal number, or null: signs, digits with single underscores, exponents, inf and nan."""
    t = F.lower(strip(c))
    digits = r"\d+(?:_\d+)*"
    plain = F.when(t.rlike(rf"^[+-]?(?:{digits}(?:\.(?:{digits})?)?|\.{digits})(?:e[+-]?{digits})?$"), F.regexp_replace(t, "_", "")).try_cast("double")
    special = F.when(t.rlike(r"^\+?inf(?:inity)?$"), F.lit(float("inf"))).when(t.rlike(r"^-inf(?:inity)?$"), F.lit(float("-inf"))).when(t.rlike(r"^[+-]?nan$"), F.lit(float("nan")))
    return F.coalesce(special, plain)


def to_long(c: Column) -> Column:
    """A whole number, or null."""
    t = strip(c)
    return F.when(t.rlike(r"^[+-]?\d+(?:_\d+)*$"), F.regexp_replace(t, "_", "")).try_cast("long")
