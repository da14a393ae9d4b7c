import hashlib
import json

import pytest

from assayer import cli
from assayer.functions import parsing
from assayer.functions.text import key_file_name
from assayer.operators import lint, specs
from assayer.sources import notes as N
from assayer.sources import reports, sinks
from assayer.sources import runs as R
from pyspark.sql import functions as F

FIELDS = "vault string, rel string, text string"

#: A vault about tides, without a finding.
DOSSIER = "---\ntype: dossier\nkey: almanac:harbour/9\nread: partial\ntags: [raw]\n---\n> the neap range was 3.4 metres that spring\n"
NOTE = """---
type: source
key: almanac:harbour/9
title: Harbour almanac
read: partial
raw: raw/almanac-harbour-9.md
added: 2031-05-02
tags: [source, tides]
---
## Findings
A neap range of 3.4 metres, see [[Neap tide|neaps]].

## Evidence
> the neap range was 3.4 metres that spring
"""
VAULT = {
    "raw/almanac-harbour-9.md": DOSSIER,
    "sources/almanac-harbour-9.md": NOTE,
    "concepts/Neap tide.md": "---\ntype: concept\ntitle: Neap tide\nadded: 2031-05-03\ntags: [concept]\n---\nThe least range. Measured in [[sources/almanac-harbour-9.md]].\n",
}


def as_notes(spark, texts):
    return N.notes_from_texts(spark.createDataFrame([("tides", k, v) for k, v in texts.items()], FIELDS))


def found(spark, **texts):
    return sorted((r["check"], r["path"]) for r in lint.all_findings(as_notes(spark, VAULT | texts)).collect())


def of_type(kind, body="On [[Neap tide]].\n", **more):
    head = {"type": kind, "title": "t", "added": "2031-06-01", "tags": "[x]"} | more
    return "---\n" + "".join(f"{k}: {v}\n" for k, v in head.items() if v is not None) + "---\n" + body


def test_a_sound_vault_has_no_finding(spark):
    assert found(spark) == []


@pytest.mark.parametrize(
    "path, text, expected",
    [
        ("sources/almanac-harbour-9.md", NOTE.replace("metres, see", "metres ([[Spring tide#range]]), see"), ["broken-link"]),
        ("sources/almanac-harbour-9.md", NOTE.replace("A neap", "In 61% of weeks a neap"), ["unsupported-number"]),
        ("sources/almanac-harbour-9.md", NOTE.replace("## Evidence", "## Proof"), ["no-evidence"]),
        ("sources/almanac-harbour-9.md", NOTE.replace("\n> the", "\nthe"), ["no-evidence"]),
        ("sources/almanac-harbour-9.md", NOTE.replace("read: partial", "read: unreachable").replace("\n> the", "\nthe"), []),
        ("sources/almanac-harbour-9.md", NOTE.replace("read: partial", "read: full"), ["upgraded-reading"]),
        ("sources/almanac-harbour-9.md", NOTE.replace("harbour-9.md", "harbour-8.md"), ["missing-dossier"]),
        ("raw/almanac-harbour-9.md", DOSSIER.replace("read: partial", "read:"), []),
        ("raw/almanac-harbour-9.md", DOSSIER.replace("read: partial", "read: unreachable"), ["upgraded-reading"]),
        ("raw/buoy-log.md", DOSSIER + "[[Neap tide]]", ["unscreened-dossier"]),
        ("raw/_buoy-log.md", DOSSIER + "[[Neap tide]]", []),
        ("claims/range.md", of_type("claim", status="settled", supported_by="[a, b]", contradicted_by="[c]"), ["resolved-contest"]),
        ("claims/range.md", of_type("claim", status="open", supported_by="[]"), ["unsupported-claim"]),
        ("claims/range.md", of_type("claim", status="contested", supported_by="[a]", contradicted_by="[c]"), []),
        ("concepts/lonely.md", of_type("concept", "Nobody knows.\n"), ["orphan"]),
        ("reports/lonely.md", of_type("report", "Nobody knows.\n"), []),
        ("concepts/bare.md", "See [[Neap tide]].\n", ["frontmatter"]),
        ("concepts/undated.md", of_type("concept", added=None), ["frontmatter"]),
        ("results/first.md", of_type("result", "[[gauge-seed4]] on [[Neap tide]]\n"), ["broken-link", "dangling-run"]),
    ],
)
def test_one_change_one_finding(spark, path, text, expected):
    assert [check for check, _ in found(spark, **{path: text})] == expected


def test_a_dossier_that_is_no_note(spark):
    texts = VAULT | {"sources/almanac-harbour-9.md": NOTE.replace("raw/almanac-harbour-9.md", "raw/scan.pdf"), "raw/almanac-harbour-9.md": DOSSIER}
    notes, files = as_notes(spark, texts), spark.createDataFrame([("tides", "raw/scan.pdf")], "vault string, rel string")
    assert [r["check"] for r in lint.read_state(notes).collect()] == ["missing-dossier"]
    assert lint.read_state(notes, files).count() == 0


def test_each_check_alone_gives_its_part_of_all(spark):
    texts = VAULT | {"a.md": "[[gone]]", "claims/c.md": of_type("claim"), "raw/x.md": DOSSIER, "specs/s.md": SPEC, "sources/n.md": NOTE.replace("3.4 metres,", "3.4 metres, 77% and 12.5,")}
    notes = as_notes(spark, texts)
    fields = ["severity", "check", "path", "message", "fix", "ord"]
    alone = sorted(tuple(r) for check in lint.CHECKS for r in check(notes).select(*fields).collect())
    assert alone == sorted(tuple(r) for r in lint.all_findings(notes).select(*fields).collect()) and len(alone) > 6
    assert {(r["check"], r["step"]) for r in lint.all_findings(notes).collect()} >= {("frontmatter", 0), ("broken-link", 1), ("unsupported-number", 2), ("unsupported-claim", 3), ("no-spec-hash", 4)}


def test_ranking_counts_and_sinks(spark):
    findings = lint.all_findings(as_notes(spark, VAULT | {"sources/almanac-harbour-9.md": NOTE.replace("metres, see", "metres, 8.25 knots, 8.25 knots, [[Ebb]], see"), "concepts/lonely.md": of_type("concept", "x\n")}))
    assert [r["check"] for r in lint.ranked(findings).collect()] == ["unsupported-number", "unsupported-number", "broken-link", "orphan"]
    assert {r["severity"]: r["n"] for r in lint.counts(findings).collect()} == {"blocker": 2, "major": 1, "minor": 1}
    assert lint.fails(findings) and sinks.exit_code(lint.all_findings(as_notes(spark, VAULT))) == 0
    assert sinks.lint_text(findings).startswith("2 blocker, 1 major, 1 minor") and sinks.todo_text(findings).count("- [ ]") == 4
    row = spark.createDataFrame([(7, float("nan"))], "depth int, drift double")
    assert json.loads(sinks.as_json(row).first()[0]) == {"depth": 7, "drift": None}


def test_names_that_several_notes_share(spark):
    notes = as_notes(spark, VAULT)
    assert [(r["stem"], r["n"], r["paths"]) for r in lint.stem_collisions(notes).collect()] == [("almanac-harbour-9", 2, ["raw/almanac-harbour-9.md", "sources/almanac-harbour-9.md"])]
    keys = spark.createDataFrame([("almanac:harbour/9",), ("x.y:z",), (None,)], "k string")
    assert [r[0] for r in keys.select(key_file_name(F.col("k"))).collect()] == ["almanac-harbour-9", "x.y-z", None]


# -- specs ------------------------------------------------------------------------------------------

SPEC = """---
type: spec
id: gauge-17
title: Gauges in the estuary
hypothesis: "closer gauges   agree"
arms: [near, far]
baseline: far
dataset: {place: estuary}
metrics: [gap]
controls:
  - moon
  - wind
seeds: [4, 5]
scale: pilot
decision_rule:
  metric: gap
  comparator: "<"
  threshold: 0.4
added: 2031-05-09
tags: [spec]
---
Why gauges.

## Decision rule
```yaml
metric: gap
threshold: 0.4
```
Less is better.

## Design
Two gauges. On [[Neap tide]].
"""
#: What the digest covers, written out by hand.
PAYLOAD = """id=gauge-17
hypothesis="closer gauges agree"
arms=[near, far]
baseline=far
dataset={place: estuary}
metrics=[gap]
controls=- moon - wind
seeds=[4, 5]
scale=pilot
decision_rule=## Decision rule ```yaml metric: gap threshold: 0.4 ``` Less is better."""


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()[:16]


@pytest.mark.parametrize(
    "change, payload",
    [
        (("", ""), ("", "")),
        (("threshold: 0.4\n```", "threshold: 0.6\n```"), ("threshold: 0.4", "threshold: 0.6")),
        (("Two gauges", "Three gauges"), ("", "")),
        (("Why gauges", "Why not"), ("", "")),
        (("title: Gauges", "title: Meters"), ("", "")),
        (("pilot", "  pilot "), ("", "")),
        (("agree", "agrée"), ("agree", "agrée")),
        (("  - wind", "  - wind\n  - rain"), ("- wind", "- wind - rain")),
        (("  threshold: 0.4\nadded", "  threshold: 0.9\nadded"), ("", "")),
        (("## Decision rule", "## Judgement"), ("## Decision rule ```yaml metric: gap threshold: 0.4 ``` Less is better.", 'metric: gap comparator: "<" threshold: 0.4')),
    ],
)
def test_digest_covers_the_payload(spark, change, payload):
    text = SPEC.replace(*change) if change[0] else SPEC
    row = spark.createDataFrame([(text,)], "t string").select(specs.digest(parsing.front_matter(F.col("t")), parsing.body(F.col("t")))).first()
    assert row[0] == digest(PAYLOAD.replace(*payload) if payload[0] else PAYLOAD)


def test_registered_altered_and_unregistered_specs(spark):
    registered = SPEC.replace("title:", f"spec_hash: '{digest(PAYLOAD)}'\ntitle:")
    assert found(spark, **{"specs/a.md": registered}) == []
    assert found(spark, **{"specs/a.md": registered.replace("near, far", "near, middle")}) == [("tampered-preregistration", "specs/a.md")]
    assert found(spark, **{"specs/a.md": SPEC}) == [("no-spec-hash", "specs/a.md")]
    rows = spark.createDataFrame([("v", "a.md", SPEC), ("v", "b.md", registered.replace(digest(PAYLOAD), "0")), ("v", "c.md", SPEC.replace("id: gauge-17\n", ""))], FIELDS)
    rows = rows.withColumn("text", specs.with_digest(F.col("text")))
    again = specs.registrations(N.notes_from_texts(rows)).orderBy("rel").collect()
    assert [r["recorded"] == r["digest"] for r in again] == [True] * 3 and again[0]["digest"] == digest(PAYLOAD)
    assert f"id: gauge-17\nspec_hash: {digest(PAYLOAD)}\n" in rows.where("rel = 'a.md'").first()["text"]


def test_warnings(spark):
    edited = SPEC.replace("  threshold: 0.4\nadded", "  threshold: 0.9   # or so\nadded")
    bare = SPEC.replace("```yaml\nmetric", "```yaml\ndecision_rule:\n  metric").replace('  comparator: "<"\n', "")
    run = "---\ntype: run\nid: g\narm: near\nseed: 4\nstatus: ok   # ok or oom\nadded: x\ntags: [run]\n---\n[[Neap tide]]\n"
    notes = as_notes(spark, {"a.md": SPEC.replace('  comparator: "<"\n', ""), "b.md": edited, "c.md": bare, "runs/r.md": run, "runs/s.md": run.replace("   # ok or oom", "")})
    a, b, c = specs.registrations(notes).orderBy("rel").collect()
    assert a["digest"] == b["digest"] and (a["rule_drift"], b["rule_drift"], c["rule_drift"]) == (False, True, False)
    got = sorted((r["check"], r["path"], r["ord"]) for r in lint.warnings(notes).collect())
    assert got == [("rule-drift", "b.md", ""), ("trailing-comment", "b.md", "threshold"), ("trailing-comment", "runs/r.md", "status")]
    assert {"rule-drift", "trailing-comment"}.isdisjoint(r["check"] for r in lint.all_findings(notes).collect())


# -- parsers ----------------------------------------------------------------------------------------


def test_rules(spark):
    texts = [SPEC, "```yml\nmetric: 'gap'\nthreshold: none yet\nmin_seeds: 6\nrefutes_if: it grows\n```", "decision_rule:\n  threshold: 1_0.5\n  threshold: x\n  # max_p_value: 0.2\n\n  max_p_value: 1e-2\nend: 1", "no rule"]
    rows = [r["r"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(parsing.rule(F.col("t")).alias("r")).collect()]
    assert rows[0][:6] == ("gap", "<", 0.4, 3, 0.05, None) and rows[0]["ignored"] == []
    assert rows[1][:6] == ("gap", ">", 0.0, 6, 0.05, "it grows") and rows[1]["ignored"] == ["threshold"]
    assert rows[2][:5] == (None, ">", 10.5, 3, 0.01) and rows[2]["ignored"] == ["threshold"] and rows[3] is None


@pytest.mark.parametrize(
    "raw, comments, expected",
    [
        ("one: 1\ntwo : b: c \n\nthree:", True, {"one": "1", "two": "b: c", "three": ""}),
        ("k: first\nother: x\nk: last", True, {"other": "x", "k": "last"}),
        ("  in: no\n\tin: no\n- in: no\n# c: no\nout: yes", True, {"out": "yes"}),
        ("# c: kept", False, {"# c": "kept"}),
        ("a: 1\x0bb: 2 c: 3\x85d: 4\x1ee: 5", True, dict(a="1", b="2", c="3", d="4", e="5")),
        (" pad　:  v   ", True, {"pad": "v"}),
        (": empty", True, {"": "empty"}),
        ("no colon\n\n", True, {}),
        ("", True, {}),
        (None, True, None),
    ],
)
def test_fields(spark, raw, comments, expected):
    assert spark.createDataFrame([(raw,)], "t string").select(parsing.fields(F.col("t"), comments)).first()[0] == expected


def test_front_matter_links_figures_and_metrics(spark):
    texts = ["---\na: 1\n---- [[Ebb|e]] [[Flow#z]] [[Ebb]]", "---\nb: 2", "c: 3\n---"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(parsing.front_matter(F.col("t")).alias("f"), parsing.open_front_matter(F.col("t")).alias("o"), parsing.links(parsing.body(F.col("t"))).alias("l")).collect()
    assert [(r["f"], r["o"], r["l"]) for r in rows] == [("\na: 1", "\na: 1", ["Ebb", "Flow"]), ("", "\nb: 2", []), ("", None, [])]
    r = spark.range(1).select(parsing.figures(F.lit("4.75 kn, 18 % and 6% of v2.1, 4321%, 0.5m; .5")).alias("n"), parsing.metrics(F.lit("{gap: 0.25, side/left: -2e-2, bad: nan, gap: 1.5}")).alias("m")).first()
    assert r["n"] == ["4.75", "18 %", "6%"] and r["m"] == {"gap": 1.5, "side/left": -0.02}


# -- files and commands -----------------------------------------------------------------------------


def written(folder, texts):
    for rel, text in texts.items():
        (folder / rel).parent.mkdir(parents=True, exist_ok=True)
        (folder / rel).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


def test_reading_folders(spark, tmp_path):
    hidden = {"_meta/screening.md": "left out:\r\nnone", "_meta/_old/a.md": "old", "raw/_index.md": "i", ".trash/b.md": "t"}
    path = written(tmp_path, VAULT | hidden | {".obsidian/w.md": "no", "chart.png": b"\x89", "latin.md": b"gr\xfcn"})
    got = {r["rel"]: r["body"] for r in N.read_notes(spark, path).collect()}
    assert set(got) == {*VAULT, *hidden, "latin.md"} and got["_meta/screening.md"] == "left out:\nnone" and got["latin.md"] == "gr�n"
    assert {r["rel"] for r in N.list_files(spark, path).collect()} >= {"chart.png", "latin.md", "_meta/screening.md"}


def test_reading_runs(spark, tmp_path):
    path = written(tmp_path / "runs", {"1.md": "---\narm: 'near'\nseed: 4\nmetrics: {gap: 0.31, drift: 2e1}\n---\n", "2.md": "---\narm: far\nseed: 5\nstatus: flooded  # or dry", "3.md": "---\narm: far\nseed: five\n---", "4.md": "nothing"})
    rows = R.read_runs(spark, path).orderBy("ord").collect()
    assert [(r["arm"], r["seed"], r["status"], r["metrics"], r["commented"]) for r in rows] == [("near", 4, "ok", {"gap": 0.31, "drift": 20.0}, []), ("far", 5, "flooded  # or dry", {}, ["status"])]
    (tmp_path / "runs.json").write_text('[{"arm": "near", "seed": "6", "metrics": {"gap": "0.25"}}, {"arm": "far", "seed": 7.9, "status": "dry", "metrics": null}, {"arm": "far", "seed": 8, "metrics": {"gap": false}}]')
    rows = R.read_runs(spark, str(tmp_path / "runs.json")).collect()
    assert [(r["arm"], r["seed"], r["status"], r["metrics"]) for r in rows] == [("near", 6, "ok", {"gap": 0.25}), ("far", 7, "dry", {}), ("far", 8, "ok", {"gap": 0.0})]
    with pytest.raises(ValueError):
        R.read_runs(spark, str(tmp_path / "nowhere"))


def test_commands(spark, tmp_path, capsys, monkeypatch):
    runs = {f"runs/{arm}{seed}.md": f"---\narm: {arm}\nseed: {seed}\nmetrics: {{gap: {value}}}\n---\n" for arm, values in (("far", (0.9, 0.8, 1.0)), ("near", (0.3, 0.1, 0.45))) for seed, value in enumerate(values)}
    path = written(tmp_path, runs | {"spec.md": SPEC, "bare.md": "---\ntype: spec\n---\n", "one/x.md": "---\narm: far\nseed: 1\nmetrics: {gap: 0.5}\n---\n"})

    def run(*args):
        code = cli.main(list(args), spark)
        return code, capsys.readouterr().out

    code, saved = run("stats", f"{path}/runs", "--baseline", "far", "--json")
    report = json.loads(saved)
    assert code == 0 and report["metric"] == "gap" and report["runs_ok"] == 6 and report["comparisons"][0]["seeds"] == [0, 1, 2]
    assert run("stats", f"{path}/nowhere")[0] == 2 and run("stats", f"{path}/runs")[0] == 0
    (tmp_path / "report.json").write_text(saved)
    code, said = run("decide", "--spec", f"{path}/spec.md", "--stats", f"{path}/report.json", "--json")
    assert code == 0 and json.loads(said)["verdict"] == "supported" and json.loads(said)["metric"] == "gap"
    import io

    monkeypatch.setattr("sys.stdin", io.StringIO(saved.replace(str(report["comparisons"][0]["p_value"]), "NaN")))
    code, said = run("decide", "--spec", f"{path}/spec.md", "--stats", "-")
    assert code == 0 and said.startswith("INCONCLUSIVE")
    assert run("decide", "--spec", f"{path}/bare.md", "--stats", f"{path}/report.json")[0] == 1
    assert run("decide", "--spec", f"{path}/none.md", "--stats", f"{path}/report.json")[0] == 2
    assert run("hash", f"{path}/spec.md") == (0, digest(PAYLOAD) + "\n") and run("hash", f"{path}/spec.md", "--verify")[0] == 1
    assert run("hash", f"{path}/spec.md", "--write")[0] == 0 and run("hash", f"{path}/spec.md", "--verify")[0] == 0
    assert run("hash", f"{path}/none.md")[0] == 2
    sound = written(tmp_path / "vault", VAULT)
    assert run("lint", sound)[0] == 0 and run("lint", f"{path}/none")[0] == 2
    spark.catalog.clearCache()
    written(tmp_path / "vault", {"concepts/bare.md": "[[Neap tide]] [[nowhere]]"})
    code, said = run("lint", sound, "--json", "--fail-on", "major", "--write-todo")
    assert code == 1 and {r["check"] for r in json.loads(said)} == {"broken-link", "frontmatter"} and "- [ ]" in (tmp_path / "vault/TODO.md").read_text()
    spark.catalog.clearCache()
    assert run("lint", sound)[0] == 0


def test_saved_reports(spark):
    text = '{"metric": "gap", "baseline": "far", "confidence": 0.95, "arms": [], "runs_total": 3, "runs_ok": 2, "failures": {"dry": 1}, "comparisons": [{"arm": "near", "baseline": "far", "n_pairs": 1, "mean_difference": 0.5, "sd_difference": 0.0, "ci_low": NaN, "ci_high": NaN, "p_value": NaN, "seeds": [4]}]}'
    report = reports.parse_report(spark.createDataFrame([(text,)], "value string"))
    row = report["comparisons"].first()
    assert row["n_pairs"] == 1 and row["p_value"] != row["p_value"] and report["failures"].collect() == [("dry", 1)] and report["arms"].count() == 0
    assert json.loads(reports.report_json(report)).keys() == json.loads(text).keys()
    with pytest.raises(Exception):
        reports.parse_report(spark.createDataFrame([("{",)], "value string"))


def test_stream_of_runs(spark, tmp_path):
    from assayer.streaming.runs import keep_runs

    written(tmp_path, {"in/1.md": "---\narm: near\nseed: 4\nmetrics: {gap: 0.5}\n---\n"})
    seen = []
    for _ in range(2):
        keep_runs(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), lambda df: seen.append(df.count())).awaitTermination(120)
        written(tmp_path, {"in/2.md": "---\narm: far\nseed: 5\n---\n"})
    assert seen == [1, 2]


def test_large_tables_are_dealt_out_by_their_rows(spark):
    from pyspark.sql import functions as F

    from assayer.plans import adapters

    parts = adapters.spread(spark.range(0, 1_000_000, 1, 2)).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 1_000_000 and max(r["count"] for r in parts) <= 210_000
