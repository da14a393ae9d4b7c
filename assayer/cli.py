"""Commands: ``python -m assayer.cli stats | decide | hash | lint``.

Exit codes: 0 done; 1 a check failed (``hash --verify``, ``lint`` with a finding at the ceiling, ``decide`` on a spec
without a rule); 2 nothing to work on (no such path, no runs, several metrics and none named).
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from assayer.functions import parsing
from assayer.operators import experiments, lint, specs
from assayer.sources import sinks
from assayer.sources.notes import content, list_files, notes_from_texts, read_texts
from assayer.sources.reports import read_report, report_json
from assayer.sources.runs import read_runs


def _status(spark: SparkSession, path: str):
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(top) if fs.exists(top) else None


def _file(spark: SparkSession, path: str) -> str:
    found = _status(spark, path)
    if found is None or not found.isFile():
        raise ValueError(f"no such spec: {path}")
    try:
        return bytes(content(spark, path)).decode("utf-8")
    except UnicodeDecodeError as e:
        raise ValueError(f"{path} is not UTF-8: {e.reason} at byte {e.start}") from e


def _write(spark: SparkSession, path: str, text: str) -> None:
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(top, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def stats(spark: SparkSession, args: argparse.Namespace) -> int:
    report = experiments.report(read_runs(spark, args.source), args.metric, args.baseline)
    print(report_json(report) if args.json else sinks.stats_text(report))
    return 0


def decide(spark: SparkSession, args: argparse.Namespace) -> int:
    text = spark.createDataFrame([(_file(spark, args.spec),)], "text string")
    rule = text.select(parsing.rule(F.col("text")).alias("r")).where("r IS NOT NULL").select("r.*").persist()
    if rule.isEmpty():
        print(f"{args.spec}: no decision rule", file=sys.stderr)
        return 1
    report = read_report(spark, args.stats)
    rule = rule.withColumn("metric", F.coalesce("metric", F.lit(report["metric"])))
    verdicts = experiments.decide(report["comparisons"], rule.select("metric", "comparator", "threshold", "min_seeds", "max_p_value"), args.arm)
    print(json.dumps([r.asDict() for r in verdicts.collect()][0], indent=2) if args.json else sinks.verdict_text(verdicts))
    return 0


def hash_spec(spark: SparkSession, args: argparse.Namespace) -> int:
    text = spark.createDataFrame([("spec", args.spec, _file(spark, args.spec))], "vault string, rel string, text string")
    if args.write:
        _write(spark, args.spec, text.select(specs.with_digest(F.col("text"))).first()[0])
    own = notes_from_texts(text).select(specs.recorded(F.col("fm")).alias("recorded"), specs.digest(F.col("fm_raw"), F.col("body")).alias("digest")).first()
    if not args.verify:
        print(own["digest"])
        return 0
    good = own["recorded"] == own["digest"]
    print(f"{args.spec}: " + (f"intact ({own['digest']})" if good else f"recorded {own['recorded'] or 'nothing'}, now {own['digest']}"), file=sys.stdout if good else sys.stderr)
    return 0 if good else 1


def lint_vault(spark: SparkSession, args: argparse.Namespace) -> int:
    found = _status(spark, args.vault)
    if found is None or not found.isDirectory():
        raise ValueError(f"not a folder: {args.vault}")
    notes = notes_from_texts(read_texts(spark, args.vault).withColumn("vault", F.lit(args.vault)))
    findings = lint.all_findings(notes, list_files(spark, args.vault).withColumn("vault", F.lit(args.vault))).persist()
    if args.json:
        fields = ("severity", "check", "path", "message", "fix")
        print(json.dumps([{k: r[k] for k in fields} for r in lint.ranked(findings).toLocalIterator()], indent=2))
    else:
        print(sinks.lint_text(findings))
    if args.write_todo:
        _write(spark, f"{args.vault.rstrip('/')}/TODO.md", sinks.todo_text(findings))
    return 0 if args.fail_on == "never" else sinks.exit_code(findings, args.fail_on)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="assayer", description=__doc__)
    commands = parser.add_subparsers(required=True)

    def command(name: str, run, *options: tuple[str, dict]) -> None:
        sub = commands.add_parser(name)
        for flag, more in options:
            sub.add_argument(flag, **more)
        sub.set_defaults(run=run)

    flag = {"action": "store_true"}
    command("stats", stats, ("source", {}), ("--metric", {}), ("--baseline", {}), ("--json", flag))
    command("decide", decide, ("--spec", {"required": True}), ("--stats", {"required": True}), ("--arm", {}), ("--json", flag))
    command("hash", hash_spec, ("spec", {}), ("--write", flag), ("--verify", flag))
    command("lint", lint_vault, ("vault", {}), ("--json", flag), ("--write-todo", flag), ("--fail-on", {"choices": (*lint.SEVERITIES, "never"), "default": "blocker"}))
    args = parser.parse_args(argv)
    try:
        return args.run(spark or SparkSession.builder.getOrCreate(), args)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
