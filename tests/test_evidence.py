"""Components, lookups with hot keys, and independence of evidence."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from assayer.operators import evidence as E
from assayer.operators.graphs import components
from assayer.operators.skew import hot_keys, look_up


def by_union_find(links):
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for x, y in links:
        if x is not None and y is not None and x != y:
            a, b = sorted((root(x), root(y)))
            parent[b] = a
    return sorted((v, root(v)) for v in parent)


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, kind):
    r = random.Random(kind)
    order = r.sample(range(300), 300)
    links = {
        "chain": list(zip(order[:120], order[1:121], strict=True)),
        "star": [(order[0], v) for v in order[1:]],
        "random": [(r.choice(order), r.choice(order)) for _ in range(170)] + [(None, 1), (2, None), (3, 3)],
        "none": [(None, 1), (4, 4)],
    }[kind]
    found = components(spark.createDataFrame(links, "x long, y long"))
    assert sorted((r["v"], r["c"]) for r in found.collect()) == by_union_find(links)


def test_lookups_with_a_hot_key(spark):
    rows = spark.createDataFrame([("a" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, -1)], "k string, i int")
    table = spark.createDataFrame([("a", 1.0), ("k0", 2.0), ("unused", 3.0)], "k string, w double")
    assert [r["k"] for r in hot_keys(rows, ["k"]).collect()] == ["a"]
    for how in ("inner", "left"):
        assert sorted(map(repr, look_up(rows, table, ["k"], how).collect())) == sorted(map(repr, rows.join(table, "k", how).collect()))


EDGES = "claim string, src string, grp string, data string, stance string"


def test_shared_groups_and_data_are_one_piece(spark):
    rows = [
        # a-b by group, b-c by data, so a and c are one piece through b; d alone
        ("p", "a", "g1", "d1", "support"), ("p", "b", "g1", "d2", "support"), ("p", "c", "g3", "d2", "support"), ("p", "d", "g4", "d4", "support"),
        # the same group on the other side, or in another claim, joins nothing
        ("p", "e", "g1", "d9", "contradict"), ("q", "a", "g1", "d1", "support"), ("q", "d", "g5", "d5", "support"),
        # several datasets of a source, given in rows; a repeated row
        ("r", "a", "g1", "d1", "support"), ("r", "a", "g1", "d7", "support"), ("r", "b", "g2", "d7", "support"), ("r", "b", "g2", "d7", "support"),
        # unknown groups and datasets
        ("s", "a", None, None, "support"), ("s", "b", None, None, "support"), ("t", "b", None, None, "contradict"), (None, "b", "g1", "d1", "support"),
    ]
    edges = spark.createDataFrame([(*x, "clash", 1) for x in rows], EDGES + ", piece string, n int")
    got = {(r["claim"], r["stance"], r["src"]): r["piece"] for r in E.pieces(edges).collect()}
    assert got == {
        ("p", "support", "a"): "a", ("p", "support", "b"): "a", ("p", "support", "c"): "a", ("p", "support", "d"): "d", ("p", "contradict", "e"): "e",
        ("q", "support", "a"): "a", ("q", "support", "d"): "d", ("r", "support", "a"): "a", ("r", "support", "b"): "a",
        ("s", "support", "a"): "a", ("s", "support", "b"): "b", ("t", "contradict", "b"): "b",
    }
    claims = {r["claim"]: (r["n_sources"], r["n_support"], r["n_contradict"], r["largest_piece"], r["bucket"]) for r in E.independent_claims(edges).collect()}
    assert claims == {"p": (5, 2, 1, 3, "contested"), "q": (2, 2, 0, 1, "settled"), "r": (2, 1, 0, 2, "open"), "s": (2, 2, 0, 1, "settled"), "t": (1, 0, 1, 1, "refuted")}
    assert E.independent_claims(edges.limit(0)).count() == 0


def test_one_claim_of_many_sources(spark):
    """Ten thousand sources of one claim: a chain of shared datasets, and a group that half of the others share."""
    n = 10_000
    chain = F.when(F.col("id") < 200, F.concat(F.lit("d"), F.floor((F.col("id") + 1) / 2).cast("string")))
    chained = spark.range(200).select(F.lit("p").alias("claim"), F.format_string("s%05d", "id").alias("src"), F.concat(F.lit("g"), F.floor(F.col("id") / 2).cast("string")).alias("grp"), chain.alias("data"), F.lit("support").alias("stance"))
    others = spark.range(200, n).select(F.lit("p").alias("claim"), F.format_string("s%05d", "id").alias("src"), F.when(F.col("id") % 2 == 0, "hub").alias("grp"), F.lit(None).cast("string").alias("data"), F.lit("support").alias("stance"))
    row = E.independent_claims(chained.unionByName(others)).first()
    assert (row["n_sources"], row["n_support"], row["largest_piece"]) == (n, 1 + 1 + (n - 200) // 2, (n - 200) // 2)


def test_pieces_equal_a_recursive_query(spark):
    r = random.Random(11)
    rows = [(f"c{r.randrange(6)}", f"s{r.randrange(60)}", r.choice([None, f"g{r.randrange(25)}"]), r.choice([None, f"d{r.randrange(40)}"]), r.choice(["support", "contradict"])) for _ in range(250)]
    con = duckdb.connect()
    con.execute("CREATE TABLE e(claim VARCHAR, src VARCHAR, grp VARCHAR, data VARCHAR, stance VARCHAR)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?)", rows)
    expected = con.execute("""WITH RECURSIVE l AS (SELECT DISTINCT a.claim, a.stance, a.src AS x, b.src AS y FROM e a JOIN e b ON a.claim = b.claim AND a.stance = b.stance AND (a.grp = b.grp OR a.data = b.data)),
    w AS (SELECT DISTINCT claim, stance, src AS x, src AS y FROM e UNION SELECT w.claim, w.stance, w.x, l.y FROM w JOIN l ON l.claim = w.claim AND l.stance = w.stance AND l.x = w.y)
    SELECT claim, stance, x, min(y) FROM w GROUP BY ALL""").fetchall()
    assert sorted(tuple(x) for x in E.pieces(spark.createDataFrame(rows, EDGES)).collect()) == sorted(expected)


def test_small_sides_take_no_rounds_and_large_ones_give_the_same(spark, monkeypatch):
    r = random.Random(5)
    rows = [(f"c{r.randrange(9)}", f"s{r.randrange(40)}", r.choice([None, f"g{r.randrange(30)}"]), r.choice([None, f"d{r.randrange(50)}"]), r.choice(["support", "contradict"])) for _ in range(300)]
    edges, listed = spark.createDataFrame(rows, EDGES), []
    monkeypatch.setattr(E, "components", lambda links: listed.append(links.count()) or components(links))
    figures = lambda: (sorted(map(tuple, E.pieces(edges).collect())), sorted(map(tuple, E.independent_claims(edges).collect())))
    folded = figures()
    assert listed == []
    for most in (15, 0):
        monkeypatch.setattr(E, "FOLDED", most)
        assert figures() == folded
    assert len(listed) == 4
