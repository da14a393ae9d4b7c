"""One idea under several names."""

import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import names as N


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def by_hand(names):
    digits = lambda s: "".join(c if c.isdigit() else " " for c in s).split()
    bears = lambda s: 2 if len(s) >= 12 else 1 if len(s) >= 5 else 0
    own = sorted(set(names))
    return sorted((a, b, edits(a, b)) for a in own for b in own if a < b and digits(a) == digits(b) and min(bears(a), bears(b)) and edits(a, b) <= min(bears(a), bears(b)))


def test_near_names_equal_all_pairs(spark):
    r = random.Random(4)
    stems = ["transformer", "long context model", "recall", "mamba", "ring attention", "état latent", "s4 layer", "s6 layer", "ab", "abc"]

    def spoilt(s):
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(s) + 1)
            s = r.choice([s[:i] + s[i + 1 :], s[:i] + r.choice("aez9") + s[i:], s[:i] + r.choice("aez9") + s[i + 1 :]])
        return s

    names = [spoilt(r.choice(stems)) for _ in range(300)] + stems
    got = N.near_names(spark.createDataFrame([(n, 1) for n in names], "name string, key int"))
    assert sorted(tuple(x) for x in got.collect()) == by_hand(names)


CONCEPTS = "concept string, aliases array<string>"


def test_links_and_groups(spark):
    rows = [
        ("State space model", ["SSM", "Structured state-space"]), ("SSM", None), ("State-Space Models", []), ("Mamba", ["mamba"]), ("Mambo", None),
        ("S4", ["S6"]), ("S6", None), ("Perplexity", None), ("Perplexty", ["PPL"]), ("GPT2", None), ("GPT3", None), ("layer 12 norm", None), ("layer 13 norm", None), ("--", None), (None, ["x"]), ("Perplexity", None),
    ]
    concepts = spark.createDataFrame([(*x, "clash") for x in rows], CONCEPTS + ", name string")
    links = {(x["a"], x["b"], x["reason"]): x["distance"] for x in N.sprawl_links(concepts).collect()}
    assert links == {
        ("SSM", "State space model", "name"): 0, ("SSM", "State-Space Models", "initials"): 0, ("SSM", "State space model", "initials"): 0, ("State space model", "State-Space Models", "spelling"): 1,
        ("Mamba", "Mambo", "spelling"): 1, ("S4", "S6", "name"): 0, ("Perplexity", "Perplexty", "spelling"): 1,
    }
    groups = {x["concept"]: x["idea"] for x in N.sprawl_groups(concepts).collect()}
    assert groups == {"SSM": "SSM", "State space model": "SSM", "State-Space Models": "SSM", "Mamba": "Mamba", "Mambo": "Mamba", "S4": "S4", "S6": "S4", "Perplexity": "Perplexity", "Perplexty": "Perplexity"}
    assert N.sprawl_links(concepts.limit(0)).count() == 0 and N.sprawl_groups(concepts.limit(0)).count() == 0


def test_a_name_of_many_concepts_gives_no_pairs(spark):
    n = 3000
    concepts = spark.range(n).select(F.format_string("idea-%05d", "id").alias("concept"), F.array(F.lit("The Model")).alias("aliases"))
    links = N.sprawl_links(concepts)
    assert links.count() == n - 1 and links.select("a").distinct().count() == 1


@pytest.mark.parametrize("text, plain", [("The  Pile!", "the pile"), ("S4/S6", "s4 s6"), ("Été-2", "été 2"), ("--", "")])
def test_plain_names(spark, text, plain):
    assert spark.range(1).select(N.plain(F.lit(text)).alias("p")).first()["p"] == plain
