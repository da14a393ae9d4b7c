"""One idea under several names: concepts whose names are spelled alike, are each other's initials, or are shared.

Names that differ little in spelling have a string in common after few letters are taken out of each, so they meet in an equi-join on such
strings and are then measured. Names are made distinct first, so a string is shared by few of them however many concepts bear
a name; a name of many concepts links each to the first one only, never all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import once
from assayer.operators.graphs import components
from assayer.operators.skew import look_up

#: Lengths from which on one and two changed letters leave a name the same.
ONE_CHANGE, TWO_CHANGES = 5, 12
#: Reasons of a link.
SAME, INITIALS, SPELLING = "name", "initials", "spelling"


def plain(name: Column) -> Column:
    """Letters and digits in lower case, all else as one space."""
    return F.btrim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def changes(n: Column) -> Column:
    """Changed letters that a name of n characters bears."""
    return F.when(n >= TWO_CHANGES, 2).when(n >= ONE_CHANGE, 1).otherwise(0)


def _without_one(c: Column) -> Column:
    """The string without each of its characters in turn."""
    return F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.char_length(c))))


def _neighbourhood(c: Column, k: Column) -> Column:
    """Hashes of the string and of what is left after up to k <= 2 deletions."""
    one = F.when(k >= 1, _without_one(c)).otherwise(F.array().cast("array<string>"))
    two = F.when(k >= 2, F.flatten(F.transform(_without_one(c), _without_one))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(F.array(c), one, two), lambda x: F.xxhash64(x)))


def near_names(names: DataFrame) -> DataFrame:
    """Pairs a < b of distinct names (name) within the edit distance that the shorter one bears, with the distance.

    Names whose digits differ are never near. Names too short to bear a change are near none.
    """
    n = F.char_length("name")
    rows = once(names.select("name").distinct().where(n >= ONE_CHANGE), "name", changes(n).alias("k"), F.btrim(F.regexp_replace("name", "[^0-9]+", " ")).alias("digits"))
    keyed = rows.select("name", "k", "digits", F.explode(_neighbourhood(F.col("name"), F.col("k"))).alias("key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.digits") == F.col("b.digits")) & (F.col("a.name") < F.col("b.name")))
    pairs = met.select(F.col("a.name").alias("a"), F.col("b.name").alias("b"), F.least("a.k", "b.k").alias("k")).distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b")).where("distance <= k").select("a", "b", "distance")


def _names(concepts: DataFrame) -> DataFrame:
    """(name, concept) of titles and aliases, as plain names; empty ones are left out."""
    all_names = F.concat(F.array("concept"), F.coalesce("aliases", F.array().cast("array<string>")))
    return concepts.where("concept IS NOT NULL").select("concept", F.explode(all_names).alias("name")).select(plain(F.col("name")).alias("name"), "concept").where("name <> ''").distinct()


def sprawl_links(concepts: DataFrame) -> DataFrame:
    """Links a < b of concepts (concept, aliases) that may be one idea, with reason and distance.

    name: they share a name or alias; initials: a name of one, in one word of two letters or more, is the initials of one of the
    other's in as many words; spelling: names within the edit distance of ``near_names``. A name's concepts are linked to the first of them by
    title, which alone stands for the name in the other links; a concept is never linked with itself, so what its own aliases say is settled.
    """
    names = _names(concepts)
    first = names.groupBy("name").agg(F.min("concept").alias("first"))
    same = look_up(names, first, ["name"]).select(F.col("first").alias("x"), F.col("concept").alias("y"), F.lit(SAME).alias("reason"), F.lit(0).alias("distance"))
    words = F.split("name", " ")
    long = first.where(F.size(words) > 1).select(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "").alias("name"), F.col("first").alias("y"))
    initials = look_up(long, first.where(~F.contains("name", F.lit(" "))), ["name"]).select(F.col("first").alias("x"), "y", F.lit(INITIALS).alias("reason"), F.lit(0).alias("distance"))
    near = near_names(first).join(first.select(F.col("name").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("name").alias("b"), F.col("first").alias("y")), "b")
    spelling = near.select("x", "y", F.lit(SPELLING).alias("reason"), "distance")
    links = same.unionByName(initials).unionByName(spelling).where("x <> y")
    return links.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "reason").agg(F.min("distance").alias("distance"))


def sprawl_groups(concepts: DataFrame) -> DataFrame:
    """Concepts that may be one idea: (concept, idea), idea being the first title of the group. Concepts that stand alone are left out."""
    return components(sprawl_links(concepts).select(F.col("a").alias("x"), F.col("b").alias("y"))).select(F.col("v").alias("concept"), F.col("c").alias("idea"))
