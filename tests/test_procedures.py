"""Snowballing, sections and counts at several grains."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from assayer.operators import grains as G
from assayer.operators import sections as S
from assayer.operators.snowball import snowball
from assayer.sources.notes import notes_from_texts


def followed(edges, seeds, least, rounds):
    edges = {(a, b) for a, b in edges if a is not None and b is not None and a != b}
    depth, log = dict.fromkeys((s for s in seeds if s is not None), 0), []
    for k in range(1, rounds + 1):
        opened = [w for w, d in depth.items() if d == k - 1]
        inside = {w for w, d in depth.items() if d < k}
        n = {r: sum(a in inside for a, b in edges if b == r) for r in {b for a, b in edges if a in inside}}
        new = [r for r, c in n.items() if c >= least and r not in depth]
        log.append((k, len(opened), len(n), len(new)))
        depth |= dict.fromkeys(new, k)
        if not new:
            break
    works = {w: (d, n.get(w, 0), "limit" if d == rounds else "opened") for w, d in depth.items()} | {r: (None, c, "rare") for r, c in n.items() if r not in depth}
    return works, log


@pytest.mark.parametrize("least, rounds", [(1, 6), (2, 6), (2, 2), (3, 5)])
def test_snowball(spark, least, rounds):
    r = random.Random(9)
    edges = [(r.randrange(60), min(int(r.expovariate(0.05)), 90)) for _ in range(260)] + [(1, 1), (None, 2), (3, None), (4, 5), (4, 5)]
    seeds = [1, 2, 3, 4, 77, None, 1]
    works, log = snowball(spark.createDataFrame(edges, "src long, ref long"), spark.createDataFrame([(s,) for s in seeds], "work long"), least, rounds)
    expected, rows = followed(edges, seeds, least, rounds)
    assert {x["work"]: (x["depth"], x["n_citing"], x["reason"]) for x in works.collect()} == expected
    assert sorted(tuple(x) for x in log.collect()) == rows


def test_snowball_of_nothing(spark):
    edges = spark.createDataFrame([(1, 2)], "src long, ref long")
    works, log = snowball(edges, spark.createDataFrame([], "work long"))
    assert works.count() == 0 and [tuple(x) for x in log.collect()] == [(1, 0, 0, 0)]


def test_headings_and_fences(spark):
    body = "# T\n## Summary\ntext ## no\n```yaml\n## Method\n```\n  ## Setup ##\n~~~\n## Results\n```\n~~~~\n### Limitations\n##Relevance\n## Evidence\n````\n```\n## Summary\n````\n## Own\t\n```\n## Method"
    assert spark.range(1).select(S.headings(F.lit(body)).alias("h")).first()["h"] == ["Summary", "Setup", "Evidence", "Own"]
    assert spark.range(1).select(S.headings(F.lit("")).alias("h")).first()["h"] == []


def test_longest_rising_part(spark):
    def longest(p):
        for n in range(len(p), -1, -1):
            for at in itertools.combinations(range(len(p)), n):
                if all(p[a] < p[b] for a, b in itertools.pairwise(at)):
                    return list(at)

    cases = [list(p) for p in itertools.permutations(range(5))] + [[], [3], [6, 0, 5, 1, 4, 2, 3]]
    got = spark.createDataFrame([(p,) for p in cases], "p array<int>").select("p", S.in_order(F.col("p")).alias("at")).collect()
    assert all(x["at"] == longest(x["p"]) for x in got) and len(got) == len(cases)


def test_section_findings(spark):
    head = "---\ntype: source\n---\n"
    right = "".join(f"## {n}\nx\n" for n in S.SOURCE_SECTIONS)
    texts = {
        "right.md": head + right,
        "moved.md": head + "## Evidence\n" + right.replace("## Evidence\n", "## More\n"),
        "two.md": head + right.replace("## Setup", "## RESULTS"),
        "none.md": head,
        "claim.md": "---\ntype: claim\n---\nx",
    }
    notes = notes_from_texts(spark.createDataFrame([("v", k, t) for k, t in texts.items()], "vault string, rel string, text string"))
    got = sorted((x["path"], x["check"], re.sub("has .*? ([A-Z])", r"\1", x["message"])) for x in S.section_findings(notes).collect())
    assert got == sorted([("moved.md", "section-order", "Evidence"), ("two.md", "missing-section", "Setup"), ("two.md", "repeated-section", "Results"), *(("none.md", "missing-section", n) for n in S.SOURCE_SECTIONS)])


def test_grains(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice("xyz"), r.randrange(40), r.choice([r.gauss(0, 5), float("nan"), None])) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "arm string, status string, seed int, v double")
    got = G.by_grains(frame, [["arm", "status"], ["arm"], ["status"], []], "v", "seed", (0.1, 0.5), 200).collect()
    assert len(got) == 9 + 3 + 3 + 1
    for x in got:
        own = [w for w in rows if ("arm" not in x["grain"] or w[0] == x["arm"]) and ("status" not in x["grain"] or w[1] == x["status"])]
        values = sorted(w[3] for w in own if w[3] is not None and w[3] == w[3])
        assert (x["n"], x["n_values"], x["n_distinct"], x["least"], x["most"]) == (len(own), len(values), len({w[2] for w in own}), values[0], values[-1])
        for q, v in zip((0.1, 0.5), x["quantiles"], strict=True):
            assert v in values and abs(values.index(v) + 1 - q * len(values)) <= len(values) / 200 + 1
    assert {x["grain"] for x in got} == {"arm,status", "arm", "status", ""}


def test_specs_are_read_strictly(spark, tmp_path, capsys):
    from assayer import cli

    good, bad = tmp_path / "good.md", tmp_path / "_bad.md"
    good.write_bytes("---\ntype: spec\nid: é\n---\n".encode())
    bad.write_bytes(b"---\ntype: spec\nid: \xe9\n---\n")
    assert cli._file(spark, str(good)) == "---\ntype: spec\nid: é\n---\n"
    with pytest.raises(ValueError, match="not UTF-8"):
        cli._file(spark, str(bad))
    with pytest.raises(ValueError, match="no such spec"):
        cli._file(spark, str(tmp_path))


def test_report_is_in_order(spark):
    from assayer.operators import experiments

    rows = [(i, arm, seed, status, {"m": float(seed)}) for i, (arm, seed, status) in enumerate([("b", 1, "ok"), ("c", 1, "oom"), ("a", 1, "ok"), ("c", 2, "ok"), ("a", 2, "nan"), ("b", 2, "ok")])]
    found = experiments.report(spark.createDataFrame(rows, "ord long, arm string, seed long, status string, metrics map<string,double>"), "m", "b")
    assert [x["arm"] for x in found["arms"].collect()] == ["a", "b", "c"] and [x["arm"] for x in found["comparisons"].collect()] == ["a", "c"]
    assert [x["status"] for x in found["failures"].collect()] == ["nan", "oom"]


def test_a_common_phrase_makes_no_candidates(spark):
    from assayer.operators import coverage

    phrase = "all rights reserved by the authors of this work"
    texts = spark.createDataFrame([(i, f"start {phrase} and tail {i} of text number {i} ends") for i in range(60)], "doc_id long, text string")
    passages = spark.createDataFrame([(1, f"x {phrase} and tail 7 of text number 7 y"), (2, f"t {phrase} an"), (3, "tail 9"), (4, "nowhere in any of these texts at all"), (5, f"rt {phrase} and tail 11 of text number 11 e")], "item_id long, text string")
    got = {(x["item_id"], x["doc_id"]) for x in coverage.containments(passages, texts).collect()}
    assert got == {(2, i) for i in range(60)} | {(3, 9), (5, 11)}


def test_collisions_list_a_part_and_count_all(spark):
    from assayer.operators import lint

    notes = notes_from_texts(spark.createDataFrame([("v", f"d{i:03}/README.md", "") for i in range(30)] + [("v", "a.md", ""), ("w", "README.md", "")], "vault string, rel string, text string"))
    (row,) = lint.stem_collisions(notes, 3).collect()
    assert (row["stem"], row["n"], row["paths"]) == ("README", 30, ["d000/README.md", "d001/README.md", "d002/README.md"])
    assert lint.colliding_notes(notes).count() == 30


def test_digests_of_large_groups(spark):
    from assayer.operators import coverage

    files = spark.createDataFrame([("g", f"f{i}", f"text {i}") for i in range(50)] + [("h", "f1", "text 1")], "grp string, path string, data string")
    digest = lambda f: {x["grp"]: x["code_hash"] for x in coverage.large_content_hash(f, "grp", "path", "data", 8).collect()}
    first = digest(files)
    assert digest(files.repartition(7)) == first and len(set(first.values())) == 2
    changed = digest(files.withColumn("data", F.when(F.col("path") == "f33", "other").otherwise(F.col("data"))))
    assert changed["g"] != first["g"] and changed["h"] == first["h"]


def test_one_sided_links_take_one_aggregation(spark):
    from assayer.operators import coverage

    pairs = lambda rows: spark.createDataFrame(rows, "a long, b long")
    links, listed = pairs([(1, 2), (1, 2), (3, 4), (None, 5), (7, 8)]), pairs([(2, 1), (5, None), (9, 6), (9, 6), (8, 7)])
    found = coverage.one_sided_links(links, listed)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [(3, 4, "not listed"), (None, 5, "not listed"), (None, 5, "not linked"), (6, 9, "not linked")]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Sort" not in plan
    assert coverage.one_sided_links(links.limit(0), listed.limit(0)).count() == 0
