"""Sections of a note: which are missing, repeated or out of their order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import let, once, strip
from assayer.operators.lint import finding

#: Sections of a source note, in their order (fixed values).
SOURCE_SECTIONS = ("Summary", "Method", "Setup", "Results", "Limitations", "Relevance", "Evidence")

#: A fenced block: it ends at a fence of the same kind that is at least as long, or at the end of the text.
_FENCED = r"(?ms)^ {0,3}(`{3,}|~{3,})[^\n]*(?:\n.*?(?:^ {0,3}\1[`~]*[ \t]*$|\z)|\z)"


def headings(body: Column, level: int = 2) -> Column:
    """Texts of the headings of a level, in order, without closing marks; lines in fenced blocks are none."""
    found = F.regexp_extract_all(F.regexp_replace(body, _FENCED, ""), F.lit(rf"(?md)^ {{0,3}}#{{{level}}}[ \t]+([^\n]*?)[ \t]*#*[ \t]*$"), F.lit(1))
    return F.transform(found, strip)


def in_order(places: Column) -> Column:
    """Of an array of distinct numbers, the places (from 0) of a longest rising subsequence; of several the one that begins first.

    A fold keeps, for each number, the best chain that ends in it: the square of the array's length, which a format's sections bound.
    """
    chain = lambda neg, at, last: F.struct(neg.alias("neg"), at.alias("at"), last.alias("last"))
    kind = "array<struct<neg:int,at:array<int>,last:int>>"
    best = lambda chains: F.array_min(F.transform(chains, lambda c: F.struct(c["neg"].alias("neg"), c["at"].alias("at"))))

    def add(chains: Column, item: Column) -> Column:
        fit = let(best(F.filter(chains, lambda c: c["last"] < item["p"])), lambda b: chain(F.coalesce(b["neg"], F.lit(0)) - 1, F.concat(F.coalesce(b["at"], F.array().cast("array<int>")), F.array(item["i"])), item["p"]))
        return F.concat(chains, F.array(fit))

    items = F.transform(places, lambda p, i: F.struct(p.cast("int").alias("p"), i.cast("int").alias("i")))
    return F.coalesce(F.aggregate(items, F.array().cast(kind), add, best)["at"], F.array().cast("array<int>"))


def section_findings(notes: DataFrame, kind: str = "source", expected: Sequence[str] = SOURCE_SECTIONS) -> DataFrame:
    """Findings of the notes of a type: missing-section and repeated-section, one a section, and section-order, one for each section
    that has to move so that all others are in order (the fewest). Other sections are ignored; names are compared without case.

    The first of repeated sections counts for the order. ``ord`` is the place in the expected order.
    """
    names = F.array(*(F.lit(n.lower()) for n in expected))
    titles = F.array(*map(F.lit, expected))
    rows = once(notes.where(F.col("type") == kind), "vault", "rel", F.transform(headings(F.col("body")), lambda h: (F.array_position(names, F.lower(h)) - 1).cast("int")).alias("all"))
    rows = once(rows, "vault", "rel", F.filter("all", lambda p: p >= 0).alias("all"))
    rows = once(rows, "vault", "rel", "all", F.array_distinct("all").alias("first"))
    every = F.sequence(F.lit(0), F.lit(len(expected) - 1))
    moved = let(in_order(F.col("first")), lambda kept: F.filter(F.transform("first", lambda p, i: F.when(~F.array_contains(kept, i.cast("int")), p)), lambda p: p.isNotNull()))
    note = lambda check, places: F.transform(places, lambda p: F.struct(F.lit(check).alias("check"), p.cast("int").alias("p")))
    repeated = F.filter(every, lambda p: F.size(F.filter("all", lambda q: q == p)) > 1)
    found = F.concat(note("missing-section", F.array_except(every, "first")), note("repeated-section", repeated), note("section-order", moved))
    rows = rows.select("vault", "rel", F.explode(found).alias("h")).select("vault", "rel", "h.check", "h.p", F.get(titles, F.col("h.p")).alias("title"))
    texts = {"missing-section": ("has no section ", "write it, or say that there is nothing to say"), "repeated-section": ("has more than one section ", "put them together"), "section-order": ("has out of its order ", "move it to its place")}
    parts = [finding(rows.where(F.col("check") == c), "minor", c, "rel", F.concat(F.lit(text), F.col("title")), fix, F.lpad(F.col("p").cast("string"), 3, "0")) for c, (text, fix) in texts.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
