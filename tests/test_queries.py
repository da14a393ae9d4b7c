"""Every query of the engine's own operators against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from assayer.operators import coverage as C
from assayer.plans import queries as Q

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("%.8g" % x if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query(spark, db, name):
    got, expected = Q.QUERIES[name](spark, DIR).toPandas(), db.execute(Q.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and rows(got) == rows(expected)
    spark.catalog.clearCache()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_registered_specs_verify(spark):
    assert Q.QUERIES["spec_registered"](spark, DIR).where("NOT same").count() == 0
    assert Q.QUERIES["sample_notes"](spark, DIR).count() == 5


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(Q.QUERIES) <= set(e.queries())


def test_aliases_classes_and_costs(spark):
    from pyspark.sql import functions as F

    concepts = spark.createDataFrame([("Ebb", ["Low water"]), ("Flow", None)], "concept string, aliases array<string>")
    got = C.by_alias(spark.createDataFrame([("low WATER",), ("FLOW",), ("x",)], "name string"), concepts)
    assert {r["name"]: r["concept"] for r in got.collect()} == {"low WATER": "Ebb", "FLOW": "Flow", "x": None}
    r = spark.range(1).select(C.node_class(F.array(F.lit("x"), F.lit("claim"))).alias("k"), C.grid_cost(F.lit(2), F.lit(3), F.lit(10), F.lit(50)).alias("c")).first()
    assert r["k"] == "claim" and (r["c"]["minutes"], r["c"]["fits"]) == (60, False)


def test_quotes_in_dossiers(spark):
    q = spark.createDataFrame([("a", "b c"), ("a", "c b"), ("z", "b")], "raw string, quote string")
    d = spark.createDataFrame([("a", "a b c d")], "raw string, text string")
    assert sorted((r["raw"], r["quote"], r["found"]) for r in C.quotes_in_dossiers(q, d).collect()) == [("a", "b c", True), ("a", "c b", False), ("z", "b", False)]


def test_coverage_gaps(spark, db, monkeypatch):
    from pyspark.sql import functions as F

    given = [(1, "a", "x"), (2, "a", "y"), (2, "a", "y"), (3, "b", "z"), (4, "c", "x")]
    uses = spark.createDataFrame(given, "src long, method string, dataset string")
    sql = "WITH u(src, method, dataset) AS (VALUES " + ", ".join(map(str, given)) + ") SELECT m.method, d.dataset FROM (SELECT DISTINCT method FROM u) m, (SELECT DISTINCT dataset FROM u) d WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.method = m.method AND u.dataset = d.dataset%s)"
    gaps = rows(C.coverage_gaps(uses).toPandas())
    assert len(gaps) == 5 and gaps == rows(db.execute(sql % "").df())
    fewer = rows(C.coverage_gaps(uses, F.col("src") % 2 == 0).toPandas())
    assert len(fewer) == 7 and fewer == rows(db.execute(sql % " AND u.src % 2 = 0").df())
    # the query is the operator's
    monkeypatch.setattr(C, "coverage_gaps", lambda *_: "called")
    monkeypatch.setattr(Q, "_uses", lambda *_: None)
    assert Q.QUERIES["coverage_gaps"](spark, DIR) == "called"
