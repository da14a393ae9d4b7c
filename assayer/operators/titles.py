"""Titles of the same work: a join of weighted sets of words.

Rare words weigh more, and a set's prefix is the shortest part, rarest words first, without which too little would be left to be similar. Two
similar sets share a word of both prefixes, so only prefixes are joined: a frequent word is a key only for titles that have nothing rarer.
A key that many sets have is made longer by the next word that a pair shares, each in turn, until few sets have it or it is all that they share; so the
pairs that are compared grow with the sets, not with their square. Of two similar sets the lighter one leaves less out before the key than the heavier
may, so keys without such a set go, and with them keys whose sets all left out the same word: they share it. Words are numbers in all of this; those
that all sets have are no keys and only count.
Equal sets are one row before the join; their works are linked to the first of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import once
from assayer.operators.graphs import components
from assayer.operators.names import plain
from assayer.operators.skew import look_up
from assayer.sources.written import Rounds

#: Words that are in half of all sets or more weigh this; others grow with the logarithm of their rarity, in thousandths.
LEAST_WEIGHT = 1
PERCENT = 80
#: A key of more sets than this gets a further word.
CROWD = 32
#: Sets of a key that one place compares with all others of the key.
PLACE = 1_000
#: Bits of a word's number; those above hold its weight (below 2^15: a word of one in 2^40 sets weighs 27,726).
BITS = 48


def _named(works: DataFrame) -> DataFrame:
    """(key, words) of works: the distinct words of their titles, in order. Titles without a word are left out."""
    rows = once(works.where("key IS NOT NULL"), "key", F.sort_array(F.array_distinct(F.split(plain(F.col("title")), " "))).alias("list"))
    return rows.select("key", F.array_join("list", " ").alias("words")).where("words <> ''")


def weighted_sets(works: DataFrame) -> DataFrame:
    """(words, first, n, items, codes, weight) of the distinct sets of words of the titles of ``works`` (key, title): the first work with the
    set, their number, the words as (w, word) by falling weight, those that not all sets have as numbers, and the sum. Titles without a word are left out.

    A word in df of N sets weighs 1 + floor(1000 ln(N / df)). Its number has its weight in the upper bits, so numbers fall with the weight. Sets and
    weights are written when this is called.
    """
    return _weighted(_named(works), Rounds(works.sparkSession))


def _weighted(named: DataFrame, store: Rounds) -> DataFrame:
    sets = store.keep(named.groupBy("words").agg(F.min("key").alias("first"), F.count("*").alias("n")))
    words = sets.select("words", "first", "n", F.explode(F.split("words", " ")).alias("word"))
    df = words.groupBy("word").agg(F.count("*").alias("df"))
    total = sets.agg(F.count("*").alias("all"))
    weights = df.join(F.broadcast(total)).select("word", "df", "all", (LEAST_WEIGHT + F.floor(1000 * F.ln(F.col("all") / F.col("df")))).cast("long").alias("w"))  # one row on the right
    # the upper bits of this id are a task, of at most 2^15 tasks
    weights = store.keep(weights.withColumn("code", F.when(F.col("df") < F.col("all"), F.shiftleft("w", BITS).bitwiseOR(F.monotonically_increasing_id()))).drop("all"))
    items = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "word")))  # a title's words
    rows = look_up(words, weights, ["word"], counts="df").groupBy("words", "first", "n").agg(items.alias("items"), F.sort_array(F.collect_list("code"), asc=False).alias("codes"), F.sum("w").alias("weight"))
    return rows.withColumn("items", F.transform("items", lambda x: F.struct((-x["w"]).alias("w"), x["word"].alias("word"))))


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc + x["w"])


def prefix(items: Column, weight: Column, percent: int) -> Column:
    """The words from which on at least ``percent`` hundredths of the weight are left: one of them is in every similar set's prefix."""
    left = F.transform(items, lambda x, i: F.struct(x["word"].alias("word"), _sum(F.slice(items, i + 1, F.size(items))).alias("left")))
    return F.transform(F.filter(left, lambda x: 100 * x["left"] >= percent * weight), lambda x: x["word"])


def _extended(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (id, codes, sums, weight, base, key, at, out, early, late) with each key made longer by one shared word, in all ways: ``at`` is the place of the
    key's last word, ``out`` the weight of the words that are left out before it, ``early`` and ``late`` the first and the last of them (0: none).
    ``done`` marks keys that are all that a pair shares, beside the words of all sets, which weigh ``base``."""
    rows = rows.withColumn("then", F.explode(F.sequence(F.col("at") + 1, F.size("codes") + 1)))
    done, skips, code = F.col("then") > F.size("codes"), F.col("then") > F.col("at") + 1, lambda i: F.get("codes", i - 1)
    out = F.col("out") + F.get("sums", F.col("then") - 1) - F.get("sums", F.col("at"))
    rows = rows.where((100 * (F.col("weight") - out) >= percent * F.col("weight")) & (~done | (F.col("at") > 0) | (F.col("base") > 0)))
    early = F.when(skips & (F.col("early") == 0), code(F.col("at") + 1)).otherwise(F.col("early"))
    late = F.when(skips, code(F.col("then") - 1)).otherwise(F.col("late"))
    key = F.when(done, F.col("key")).otherwise(F.concat("key", F.array(code(F.col("then")))))
    return rows.select("id", "codes", "sums", "weight", "base", key.alias("key"), F.col("then").alias("at"), out.alias("out"), early.alias("early"), late.alias("late"), done.alias("done"))


def candidate_keys(sets: DataFrame, percent: int) -> DataFrame:
    """(id, codes, weight, base, key, done, out, early, late, n) of ``sets`` (first, codes, weight): two similar sets meet under the key that is the head of
    the words that they share, rarest first, or all of them if ``done``. At most ``CROWD`` sets have a key, but for done ones; ``n`` is their
    number or more. Runs its rounds when called."""
    store = Rounds(sets.sparkSession)
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = F.aggregate("codes", F.array(F.lit(0).cast("long")), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + F.shiftright(c, BITS))))
    none = F.lit(0).cast("long")
    sets = once(sets.select("first", "codes", "weight"), "first", "codes", "weight", sums.alias("sums"))
    now = sets.select(F.col("first").alias("id"), "codes", "sums", "weight", (F.col("weight") - F.element_at("sums", -1)).alias("base"), F.array().cast("array<bigint>").alias("key"), F.lit(0).alias("at"), *(none.alias(c) for c in ("out", "early", "late")))
    found = []
    while True:
        # few bytes, much work: rows are dealt out to all tasks, whatever their size
        rows = store.keep(_extended(now.repartition(parts, "id"), percent))
        # of two similar sets the lighter one leaves out so little that an equal one could be similar
        light = (100 + percent) * (F.col("weight") - F.col("out")) >= 2 * percent * F.col("weight")
        of = [F.count("*").alias("n"), F.min(F.when(light, F.col("weight"))).alias("least"), *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("early", "late"))]
        common = reduce(lambda x, y: x | y, ((F.col(f"min_{c}") > 0) & (F.col(f"min_{c}") == F.col(f"max_{c}")) for c in ("early", "late")))
        keys = store.keep(rows.groupBy("key", "done").agg(*of).where((F.col("n") > 1) & F.col("least").isNotNull() & ~common).select("key", "done", "n", F.col("n").alias("rows"), "least"))
        met = store.keep(look_up(rows, keys, ["key", "done"], counts="rows").where((100 + percent) * (F.col("weight") - F.col("out")) >= percent * (F.col("weight") + F.col("least"))))
        store.drop(rows)
        crowded = ~F.col("done") & (F.col("n") > CROWD)
        found.append(met.where(~crowded).select("id", "codes", "weight", "base", "key", "done", "out", "early", "late", "n"))
        if keys.where(crowded).isEmpty():
            return reduce(DataFrame.unionByName, found)
        now = met.where(crowded).select("id", "codes", "sums", "weight", "base", "key", "at", "out", "early", "late")


def similar_titles(works: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links a < b of works, with the shared and the united weight of their titles' words: 100 * shared >= percent * united.

    A set of words is stood for by its first work; each other work with the same set is linked to it, with shared = united.
    """
    store = Rounds(works.sparkSession)
    parts = int(works.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = store.keep(_named(works))
    sets = store.keep(_weighted(named, store).select("words", "first", "n", "codes", "weight"))
    keyed = candidate_keys(sets, percent).withColumn("places", F.ceil(F.col("n") / PLACE).cast("int"))
    # each set of a key of many sets is at one place as x, and at all as y
    a = keyed.withColumn("place", F.pmod(F.xxhash64("id"), F.col("places")).cast("int")).repartition(parts, "key", "done", "place").alias("x")
    b = keyed.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1))).repartition(parts, "key", "done", "place").alias("y")
    left = lambda s: F.col(f"{s}.weight") - F.col(f"{s}.out")
    enough = (100 + percent) * F.least(left("x"), left("y")) >= percent * (F.col("x.weight") + F.col("y.weight"))
    differ = reduce(lambda p, q: p & q, ((F.col(f"x.{c}") == 0) | (F.col(f"x.{c}") != F.col(f"y.{c}")) for c in ("early", "late")))
    met = a.join(b, reduce(lambda p, q: p & q, (F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "done", "place"))) & (F.col("x.id") < F.col("y.id")) & enough & differ)
    pairs = once(met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.key").alias("key"), F.col("x.done").alias("done"), (F.col("x.weight") + F.col("y.weight")).alias("sum"), "x.base", F.col("x.codes").alias("xs"), F.col("y.codes").alias("ys")), "a", "b", "key", "done", "sum", "base", F.array_intersect("xs", "ys").alias("both"))
    pairs = once(pairs, "a", "b", "key", "done", "sum", "both", F.aggregate("both", F.col("base"), lambda acc, c: acc + F.shiftright(c, BITS)).alias("shared"))
    # of the keys that a pair has in common, one is the head of what it shares and not taken further
    head = (F.col("key") == F.slice("both", F.lit(1), F.size("key"))) & (~F.col("done") | (F.size("both") == F.size("key")))
    pairs = pairs.where((100 + percent) * F.col("shared") >= percent * F.col("sum")).where(head).select("a", "b", "shared", (F.col("sum") - F.col("shared")).alias("united"))
    equal = look_up(named.distinct(), sets.select("words", "first", "weight", "n"), ["words"], counts="n").where("first < key").select(F.col("first").alias("a"), F.col("key").alias("b"), F.col("weight").alias("shared"), F.col("weight").alias("united"))
    return pairs.unionByName(equal)


def same_works(works: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, work) of all works that are linked to another one: ``work`` is the first key of their group."""
    return components(similar_titles(works, percent).select(F.col("a").alias("x"), F.col("b").alias("y"))).select(F.col("v").alias("key"), F.col("c").alias("work"))
