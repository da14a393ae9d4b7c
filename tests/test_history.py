"""As-of joins of runs on registrations, and staleness."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assayer.operators import history as H
from assayer.sources.notes import notes_from_texts

T = datetime(2024, 3, 1)


@pytest.mark.parametrize("seconds, salts", [(H.DAY, 1), (3600, 3), (10**9, 2)])
def test_as_of_equals_a_search(spark, seconds, salts):
    r = random.Random(7)
    at = lambda: T + timedelta(minutes=r.randrange(20_000))
    versions = [(r.choice("abcd"), at(), f"h{r.randrange(9)}", i) for i in range(60)] + [("a", T, "h1", 1), ("a", T, "h2", 0), (None, T, "x", 0), ("b", None, "x", 0)]
    rows = [(i, r.choice("abcdz"), at()) for i in range(300)] + [(900, "a", T), (901, None, T), (902, "a", None), (903, "a", T - timedelta(days=9)), (904, "a", T), (904, "a", T)]
    got = H.as_of(spark.createDataFrame(rows, "id long, k string, at timestamp"), "k", "at", spark.createDataFrame(versions, "k string, since timestamp, digest string, n int"), "since", seconds, salts)

    def best(k, at):
        return max((v[1:] for v in versions if v[0] == k and k is not None and v[1] is not None and at is not None and v[1] <= at), default=None)

    assert sorted((x["id"], x["version"] and tuple(x["version"])) for x in got.collect()) == sorted((i, best(k, at)) for i, k, at in rows)


def test_runs_and_the_spec_in_force(spark):
    day = lambda n: T + timedelta(days=n)
    versions = spark.createDataFrame([("e", day(0), "one"), ("e", day(10), "two"), ("e", day(20), "three"), ("f", day(5), "one")], "spec string, registered timestamp, digest string")
    runs = [("right", "e", day(12), "two"), ("early", "e", day(-1), "one"), ("old", "e", day(25), "two"), ("soon", "e", day(3), "three"), ("other", "e", day(3), "zzz"), ("none", "e", day(3), None), ("undated", "e", None, "one"), ("nowhere", "g", day(3), "one"), ("exact", "f", day(5), "one")]
    got = {x["id"]: x for x in H.runs_in_force(spark.createDataFrame(runs, "id string, spec string, started timestamp, digest string").withColumn("in_force", F.lit("clash")), versions, 3600, 2).collect()}
    assert {k: x["finding"] for k, x in got.items()} == {"right": None, "exact": None, "early": "unregistered", "old": "superseded", "soon": "ahead", "other": "foreign", "none": "foreign", "undated": "undated", "nowhere": "unregistered"}
    assert (got["old"]["registered"], got["old"]["in_force"]) == (day(20), "three") and got["early"]["in_force"] is None
    assert H.runs_in_force(spark.createDataFrame(runs, "id string, spec string, started timestamp, digest string").limit(0), versions).count() == 0


def test_registrations_and_starts_are_read_from_notes(spark):
    texts = [
        ("e/spec.md", "---\ntype: spec\nid: e\nspec_hash: 'one'\npreregistered_at: 2026-08-14T10:00:00Z\n---\n"),
        ("e/later.md", "---\ntype: spec\nid: e\nspec_hash: two\npreregistered_at: 2026-08-16\n---\n"),
        ("e/blank.md", "---\ntype: spec\nid: e\nspec_hash:\npreregistered_at: soon\n---\n"),
        ("e/runs/a.md", '---\ntype: run\nid: "e/new-seed0"\nspec_hash: one\nstarted: 2026-08-14T11:02:00Z\n---\n'),
        ("e/runs/b.md", "---\ntype: run\nid: e/new-seed1\nspec_hash: one\nstarted: 2026-08-17T00:00:00Z\n---\n"),
        ("e/runs/c.md", "---\ntype: run\nid: e/new-seed2\nspec_hash: one\nstarted: yesterday\n---\n"),
        ("e/runs/d.md", "---\ntype: run\nid: e/new-seed3\nstarted: 2026-08-14T09:59:59Z\n---\n"),
    ]
    notes = notes_from_texts(spark.createDataFrame([("v", *t) for t in texts], "vault string, rel string, text string"))
    assert H.registrations(notes).count() == 2
    found = H.runs_in_force(H.starts(notes), H.registrations(notes))
    assert {x["id"]: (x["spec"], x["finding"]) for x in found.collect()} == {"e/new-seed0": ("e", None), "e/new-seed1": ("e", "superseded"), "e/new-seed2": ("e", "undated"), "e/new-seed3": ("e", "unregistered")}


def test_staleness(spark):
    sources = [("year", "t", "2020"), ("month", "t", "2022-06"), ("day", "t", "2022-07-02"), ("fresh", "t", "2023"), ("bad", "t", "in press"), ("none", "t", None), ("feb", "t", "2022-02-30"), ("alone", "u", "1999"), ("lost", None, "1999")]
    surveys = [("t", "2024-07-01"), ("t", "2021-01-01"), ("t", "soon"), ("w", "2024-01-01"), (None, "2024-01-01")]
    s = spark.createDataFrame(sources, "id string, topic string, published string")
    got = H.stale_sources(s, spark.createDataFrame(surveys, "topic string, surveyed string"), 24)
    assert {x["id"]: (x["until"], x["surveyed"], x["age"]) for x in got.collect()} == {"year": (date(2020, 12, 31), date(2024, 7, 1), 42), "month": (date(2022, 6, 30), date(2024, 7, 1), 24)}
    assert {x["id"] for x in H.undated_sources(s).collect()} == {"bad", "none", "feb"}


def test_runs_meet_digests_without_a_sort(spark):
    runs = spark.createDataFrame([("a", "s", None, "h")], "id string, spec string, started timestamp, digest string")
    versions = spark.createDataFrame([("s", None, "h")], "spec string, registered timestamp, digest string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        plan = H.runs_in_force(runs, versions)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin [spec" in plan and "SortMergeJoin [spec" not in plan
