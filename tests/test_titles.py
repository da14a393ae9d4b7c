"""Titles of the same work: against all pairs."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayer.operators import titles as T


def all_pairs(rows, percent):
    sets = {}
    for key, title in rows:
        words = " ".join(sorted(set(re.findall(r"[^\W_]+", (title or "").lower()))))
        if key is not None and words:
            sets.setdefault(words, []).append(key)
    df = Counter(w for s in sets for w in s.split())
    weight = {w: 1 + math.floor(1000 * math.log(len(sets) / n)) for w, n in df.items()}
    total = lambda ws: sum(weight[w] for w in ws)
    first = {s: min(keys) for s, keys in sets.items()}
    out = {(first[s], k, total(s.split()), total(s.split())) for s, keys in sets.items() for k in keys if k != first[s]}
    for s in sets:
        for t in sets:
            a, b = set(s.split()), set(t.split())
            if first[s] < first[t] and 100 * total(a & b) >= percent * total(a | b):
                out.add((first[s], first[t], total(a & b), total(a | b)))
    return out


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_links_equal_all_pairs(spark, percent):
    r = random.Random(percent)
    words = [f"w{i}" for i in range(40)] + ["the", "of"]
    rows = [(i, " ".join(["the", "of", *(words[min(int(r.expovariate(0.1)), 41)] for _ in range(r.randint(1, 7)))])) for i in range(150)]
    rows += [(200 + i, t.upper().replace(" ", "--")) for i, t in rows[:20]] + [(300, None), (301, ""), (302, "?!"), (None, "the of w1"), (303, "the"), (304, "of"), (200, rows[0][1]), (305, "Ünder the Şea")]
    works = spark.createDataFrame([(k, t, "x") for k, t in rows], "key long, title string, words string")
    got = T.similar_titles(works, percent)
    assert {tuple(x) for x in got.collect()} == all_pairs(rows, percent) and got.count() == len(all_pairs(rows, percent))


def test_groups_and_hot_words(spark):
    works = spark.createDataFrame([(1, "Attention is all you need"), (2, "ATTENTION IS ALL YOU NEED."), (3, "Attention is all we need"), (4, "Linear attention"), (5, "State spaces")], "key long, title string")
    assert {x["key"]: x["work"] for x in T.same_works(works, 60).collect()} == {1: 1, 2: 1}
    assert T.similar_titles(works.limit(0)).count() == 0
    # a word of all titles is no key: the only prefix words are the rare ones
    sets = T.weighted_sets(spark.range(400).select(F.col("id").alias("key"), F.format_string("a survey of topic%d", "id").alias("title")))
    used = sets.select(F.explode(T.prefix(F.col("items"), F.col("weight"), 80)).alias("w")).distinct()
    assert used.where("w IN ('a', 'survey', 'of')").count() == 0 and used.count() == 400


@pytest.mark.parametrize("crowd", [0, 3])
def test_crowded_keys_get_further_words(spark, monkeypatch, crowd):
    r = random.Random(crowd)
    rows = [(i, " ".join(["the", "of", *(f"{k}{r.randrange(n)}" for k, n in (("a", 12), ("b", 9), ("c", 4), ("d", 3)))])) for i in range(160)]
    monkeypatch.setattr(T, "CROWD", crowd)
    works = spark.createDataFrame(rows, "key long, title string")
    got = T.similar_titles(works, 60)
    assert {tuple(x) for x in got.collect()} == all_pairs(rows, 60) and got.count() == len(all_pairs(rows, 60))
    keys = T.candidate_keys(T.weighted_sets(works), 60)
    assert keys.where("NOT done").groupBy("key").count().where(F.col("count") > crowd).isEmpty()


def test_words_of_nearly_all_titles_are_not_combined(spark, monkeypatch):
    monkeypatch.setattr(T, "CROWD", 3)
    monkeypatch.setattr(T, "PLACE", 2)
    rows = [(i, f"the tale of a{i % 12} and b{i // 12 % 9} in c{i // 108 % 4} for {'all' if i else 'us'}") for i in range(432)]
    works = spark.createDataFrame(rows, "key long, title string")
    got = T.similar_titles(works, 60).collect()
    assert {tuple(x) for x in got} == all_pairs(rows, 60) and len(got) == len(all_pairs(rows, 60)) > 400
    # sets that share six frequent words do not meet under each choice of them
    assert T.candidate_keys(T.weighted_sets(works), 60).count() < 4 * len(rows)
