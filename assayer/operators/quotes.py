"""Quotes that are nearly in their dossier: the best passage, where it is, and how many words differ.

Words are compared in lower case without punctuation. A quote of m words bears k = m // SEED - 1 changes (a word replaced, left out or put in).
Cut into k + 1 blocks of SEED words, one of them is then whole in the passage, so the passage lies about a diagonal on which such a block meets the
text. Only these stretches are aligned, by a fold over their words that keeps one row of the table of edit distances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import let, once
from assayer.operators.names import plain

#: Words of a block.
SEED = 3
#: A cell of the table holds the distance above, and where the passage begins in the lower bits.
_STEP = 1 << 32


def words(text: Column) -> Column:
    """Words in lower case, without punctuation."""
    return F.filter(F.split(plain(text), " "), lambda w: w != "")


def _blocks(w: Column) -> Column:
    """Hashes and places of the k + 1 blocks of a quote's words."""
    n = F.floor(F.size(w) / SEED).cast("int")
    block = lambda i: F.struct(F.xxhash64(*(F.get(w, i * SEED + j) for j in range(SEED))).alias("g"), (i * SEED).alias("at"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), block)).otherwise(F.array().cast("array<struct<g:bigint,at:int>>"))


def _stretches(q: Column, t: Column, k: Column) -> Column:
    """Places from which stretches of the text are aligned: for each 2 k + 1 diagonals in which a block of the quote meets the text, the first one less k."""
    wide = 2 * k + 1
    # the blocks' hashes are listed once a text, not once a place
    seeds = lambda hashes: F.filter(F.transform(F.sequence(F.lit(0), F.size(t) - SEED), lambda i: F.struct(i.alias("i"), F.xxhash64(*(F.get(t, i + j) for j in range(SEED))).alias("g"))), lambda x: F.array_contains(hashes, x["g"]))
    meets = lambda blocks: F.flatten(
        F.transform(
            let(F.transform(blocks, lambda b: b["g"]), seeds),
            lambda x: F.transform(F.filter(blocks, lambda b: b["g"] == x["g"]), lambda b: F.floor((x["i"] - b["at"]) / wide).cast("int")),
        )
    )
    rows = F.array_sort(F.array_distinct(let(_blocks(q), meets)))
    return F.when((F.size(t) >= SEED) & (k >= 0), F.transform(rows, lambda b: b * wide - k)).otherwise(F.array().cast("array<int>"))


def _aligned(q: Column, t: Column, begin: Column, length: Column) -> Column:
    """The best passage of the words of a stretch: a struct of its cell (distance and begin) and its end, by least distance, then
    earliest begin, then earliest end."""
    low = F.greatest(begin, F.lit(0))
    part = F.slice(t, low + 1, F.greatest(begin + length - low, F.lit(0)))
    first = F.transform(F.concat(F.array(F.lit("")), q), lambda _, i: i.cast("long") * _STEP + low.cast("long"))

    def column(acc: Column, w: Column) -> Column:
        old, at = acc["row"], acc["at"] + 1

        def cell(new: Column, i: Column) -> Column:
            value = F.least(F.get(old, i - 1) + F.when(F.get(q, i - 1) == w, F.lit(0)).otherwise(_STEP), F.get(old, i) + _STEP, F.element_at(new, -1) + _STEP)
            return F.concat(new, F.array(value))

        row = F.aggregate(F.sequence(F.lit(1), F.size(q)), F.array(at.cast("long")), cell)
        return let(row, lambda r: F.struct(r.alias("row"), at.alias("at"), F.least(acc["best"], F.struct(F.element_at(r, -1).alias("cell"), at.alias("end"))).alias("best")))

    start = F.struct(first.alias("row"), low.alias("at"), F.struct(F.element_at(first, -1).alias("cell"), low.alias("end")).alias("best"))
    return F.aggregate(part, start, column, lambda acc: acc["best"])


def near_quotes(quotes: DataFrame, dossiers: DataFrame) -> DataFrame:
    """Quotes (quote_id, raw, quote) with what their dossier (raw, text; one row a raw) has of them: verbatim, distance, first_word,
    n_words and passage.

    verbatim: the quote is in the text as it stands. distance: the fewest changed words of any passage, if they are at most a third of
    the quote's words less one, else null; first_word and n_words place the passage among the text's words (the earliest of the best, of equal begins the
    shortest). Quotes of fewer than ``SEED`` words are sought verbatim only. Without a dossier, or with a null quote or text, verbatim is false and
    the rest null. A dossier's text meets each of its quotes once, in a join whose large partitions Spark splits.
    """
    q = once(quotes.select("quote_id", "raw", "quote"), "quote_id", "raw", "quote", words(F.coalesce("quote", F.lit(""))).alias("q"))
    # a dossier's words are made after the join, so that only its text is shuffled
    rows = q.join(dossiers.select("raw", "text"), "raw", "left")
    rows = once(rows, "quote_id", "raw", "quote", "q", "text", words(F.coalesce("text", F.lit(""))).alias("t"))
    k = (F.floor(F.size("q") / SEED) - 1).cast("int")
    rows = once(rows, "quote_id", "raw", "quote", "q", "t", F.coalesce(F.contains("text", F.col("quote")), F.lit(False)).alias("verbatim"), k.alias("k"), _stretches(F.col("q"), F.col("t"), k).alias("from"))
    length = F.size("q") + 4 * F.col("k") + 1
    best = F.array_min(F.transform("from", lambda b: _aligned(F.col("q"), F.col("t"), b, length)))
    rows = once(rows, "quote_id", "raw", "quote", "t", "verbatim", "k", best.alias("best"))
    distance = F.floor(F.col("best.cell") / _STEP).cast("int")
    first = (F.col("best.cell") % _STEP).cast("int")
    near = distance <= F.col("k")
    place = F.when(near, first)
    count = F.when(near, F.col("best.end") - first)
    return rows.select("quote_id", "raw", "quote", "verbatim", F.when(near, distance).alias("distance"), place.alias("first_word"), count.alias("n_words"), F.when(near, F.array_join(F.slice("t", first + 1, count), " ")).alias("passage"))
