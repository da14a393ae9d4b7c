"""Parsers of notes and run records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.text import SPACE, let, lines, rstrip, strip, to_double, to_long, unquote

#: Patterns of the note format (fixed values).
WIKILINK = r"\[\[([^\]|#]+)(?:[#|][^\]]*)?\]\]"
FIGURE = r"(?U)(?<![\w.])(\d+\.\d+|\d{1,3}(?:\.\d+)?\s*%)(?![\w])"
METRIC = r"([A-Za-z_][\w./-]*)\s*:\s*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
EVIDENCE = "## Evidence"
RULE_HEADING = "## Decision rule"

#: Line ends beside \n.
_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_PAIR = "struct<key:string,value:string>"


def front_matter(text: Column) -> Column:
    """Between leading ``---`` and the first line that begins so; empty without both."""
    end = F.locate("\n---", text, 4)
    return F.when(text.startswith("---") & (end > 0), F.substring(text, F.lit(4), end - 4)).otherwise("")


def body(text: Column) -> Column:
    end = F.locate("\n---", text, 4)
    return F.when(text.startswith("---") & (end > 0), F.substring(text, end + 4, F.length(text))).otherwise(text)


def open_front_matter(text: Column) -> Column:
    """Of a run record: as ``front_matter``, but without an end mark it reaches to the end; null without a start."""
    end = F.locate("\n---", text, 4)
    return F.when(text.startswith("---"), F.when(end > 0, F.substring(text, F.lit(4), end - 4)).otherwise(F.substring(text, F.lit(4), F.length(text))))


def _indented(line: Column) -> Column:
    return line.rlike(r"^[ \t-]")


def _pair(line: Column) -> Column:
    at = F.locate(":", line)
    return F.struct(strip(F.substring(line, F.lit(1), at - 1)).alias("key"), strip(F.substring(line, at + 1, F.length(line))).alias("value"))


def _to_map(pairs: Column) -> Column:
    """A map of pairs in which the last of equal keys holds."""
    last = F.aggregate(
        pairs,
        F.array().cast(f"array<{_PAIR}>"),
        lambda acc, p: F.concat(F.filter(acc, lambda q: q["key"] != p["key"]), F.array(p)),
    )
    return F.map_from_entries(last)


def fields(raw: Column, comments: bool = True) -> Column:
    """Top-level ``key: value`` lines as a map. ``comments``: lines with # in the first column are left out."""
    line = rf"(?md)^(?![ \t{'#' if comments else ''}-])([^:\n]*):(.*)$"
    even = F.translate(raw, _ENDS, "\n" * len(_ENDS))
    part = lambda k: F.transform(F.regexp_extract_all(even, F.lit(line), F.lit(k)), strip)

    def of(p: Column) -> Column:
        same = F.size(F.array_distinct(p["k"])) == F.size(p["k"])
        pairs = F.zip_with(p["k"], p["v"], lambda k, v: F.struct(k.alias("key"), v.alias("value")))
        return F.when(same, F.map_from_arrays(p["k"], p["v"])).otherwise(_to_map(pairs))

    return F.when(raw.isNotNull(), let(F.struct(part(1).alias("k"), part(2).alias("v")), of))


def blocks(raw: Column) -> Column:
    """As ``fields``, but lines that are indented or begin with - belong to the key before them."""
    kept = F.filter(lines(raw), lambda x: ~x.rlike(f"^{SPACE}*(?:#|$)"))
    start = F.array().cast(f"array<{_PAIR}>")
    folded = F.aggregate(
        kept,
        start,
        lambda acc, x: F.when(
            _indented(x) & (F.size(acc) > 0),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["key"].alias("key"), F.concat(F.try_element_at(acc, F.lit(-1))["value"], F.lit("\n"), rstrip(x)).alias("value")))),
        )
        .when(F.locate(":", x) > 0, F.concat(F.filter(acc, lambda q: q["key"] != _pair(x)["key"]), F.array(_pair(x))))
        .otherwise(acc),
    )
    return F.map_from_entries(folded)


def commented(fm: Column, *keys: str) -> Column:
    """Those of the keys whose value has a comment after it; the format keeps it as part of the value."""
    marked = lambda k: F.when(F.try_element_at(fm, F.lit(k)).rlike(rf"{SPACE}#"), F.lit(k))
    return F.filter(F.array(*map(marked, keys)), lambda x: x.isNotNull())


def metrics(value: Column) -> Column:
    """Pairs of names and plain decimal numbers in a text, as a map of doubles; the last of equal names holds."""
    names = F.regexp_extract_all(value, F.lit(METRIC), F.lit(1))
    numbers = F.regexp_extract_all(value, F.lit(METRIC), F.lit(2))
    pairs = _to_map(F.transform(F.arrays_zip(names.alias("a"), numbers.alias("b")), lambda p: F.struct(p["a"].alias("key"), p["b"].alias("value"))))
    return F.transform_values(pairs, lambda _, v: v.cast("double"))


def links(text: Column) -> Column:
    """Distinct targets of wikilinks, without aliases and headings."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(1)), strip)))


def figures(text: Column) -> Column:
    """Decimals and percentages that are not part of a word or number, every occurrence."""
    return F.regexp_extract_all(text, F.lit(FIGURE), F.lit(1))


def before_evidence(text: Column) -> Column:
    return F.split(text, EVIDENCE, 2)[0]


def evidence(text: Column) -> Column:
    """What follows the first evidence heading; null without one."""
    return F.try_element_at(F.split(text, EVIDENCE, 2), F.lit(2))


def quoted(text: Column) -> Column:
    """Quoted lines of a text joined by a space, without their marks."""
    own = F.filter(lines(text), lambda x: x.rlike(f"^{SPACE}*>"))
    return F.array_join(F.transform(own, lambda x: strip(F.regexp_replace(x, "^[> ]+", ""))), " ")


def has_quote(text: Column) -> Column:
    return text.rlike(rf"(?m)^{SPACE}*>")


def rule_block(text: Column) -> Column:
    """A decision rule: the indented lines after ``decision_rule:``, else the first fenced yaml that names a metric."""
    marker = rf"(?md)^decision_rule:{SPACE}*$"
    rest = F.regexp_extract(text, rf"(?s){marker}(.*)", 1)
    kept = F.aggregate(
        lines(rest),
        F.struct(F.lit(True).alias("open"), F.array().cast("array<string>").alias("out")),
        lambda acc, x: F.when(acc["open"] & x.rlike(rf"^(?:[ \t]|{SPACE}*$)"), F.struct(F.lit(True).alias("open"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(
            F.struct(F.lit(False).alias("open"), acc["out"].alias("out"))
        ),
        lambda acc: F.array_join(acc["out"], "\n"),
    )
    fenced = F.regexp_extract(text, r"(?s)```ya?ml\n(.*?metric:.*?)```", 1)
    return F.when(text.rlike(marker), kept).otherwise(fenced)


def rule(text: Column) -> Column:
    """The decision rule of a spec as a struct, with defaults for what is absent or not a number; null if there is none.

    ``ignored`` names keys whose value was not a number, so that a default holds in their place.
    """
    # a value that is no number leaves an earlier one of the same key in place
    number = lambda p: F.when(p["key"].isin("threshold", "max_p_value"), to_double(unquote(p["value"])).isNotNull()).when(p["key"] == "min_seeds", to_long(unquote(p["value"])).isNotNull()).otherwise(F.lit(True))

    def of(pairs: Column) -> Column:
        return let(_to_map(F.filter(pairs, number)), lambda m: fields_of(m, pairs))

    def fields_of(m: Column, pairs: Column) -> Column:
        text_of = lambda k: unquote(F.try_element_at(m, F.lit(k)))
        return F.struct(
            text_of("metric").alias("metric"),
            F.coalesce(text_of("comparator"), F.lit(">")).alias("comparator"),
            F.coalesce(to_double(text_of("threshold")), F.lit(0.0)).alias("threshold"),
            F.coalesce(to_long(text_of("min_seeds")), F.lit(3)).alias("min_seeds"),
            F.coalesce(to_double(text_of("max_p_value")), F.lit(0.05)).alias("max_p_value"),
            text_of("refutes_if").alias("refutes_if"),
            F.transform(F.filter(pairs, lambda p: ~number(p)), lambda p: p["key"]).alias("ignored"),
        )

    def whole(block: Column) -> Column:
        good = F.filter(lines(block), lambda x: F.locate(":", x) > 0)
        return F.when(strip(block) != "", let(F.filter(F.transform(good, _pair), lambda p: (p["key"] != "") & ~p["key"].startswith("#")), of))

    return let(rule_block(text), whole)
