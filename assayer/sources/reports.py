"""Saved reports: the JSON that ``report_json`` writes, from a file or standard input, with bare NaN.

A report has the parts of ``experiments.report``: metric, baseline, confidence, arms, comparisons, totals, failures.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_SCHEMA = """metric string, baseline string, confidence double, runs_total long, runs_ok long, failures map<string,long>,
arms array<struct<arm:string,n:long,mean:double,sd:double,values:array<double>>>,
comparisons array<struct<arm:string,baseline:string,n_pairs:long,mean_difference:double,sd_difference:double,ci_low:double,ci_high:double,p_value:double,seeds:array<long>>>"""


def parse_report(texts: DataFrame) -> dict:
    """The report in the one row of ``texts`` (value). ValueError if it is no JSON object."""
    row = texts.select(F.from_json("value", _SCHEMA, {"mode": "FAILFAST", "allowNonNumericNumbers": "true"}).alias("r")).select("r.*")
    head = row.select("metric", "baseline", "confidence").first()
    if head is None:
        raise ValueError("an empty report")
    part = lambda name: row.select(F.inline(name))
    return {
        **head.asDict(),
        "arms": part("arms"),
        "comparisons": part("comparisons"),
        "totals": row.select("runs_total", "runs_ok"),
        "failures": row.select(F.explode("failures").alias("status", "n")),
    }


def read_report(spark: SparkSession, path: str) -> dict:
    """The report in a file, or in standard input if the path is ``-``."""
    if path == "-":
        return parse_report(spark.createDataFrame([(sys.stdin.read(),)], "value string"))
    return parse_report(spark.read.text(path, wholetext=True))


def report_json(report: dict) -> str:
    """A report as JSON; NaN stays bare. Its rows are an arm's each; lists of values and seeds are those of the report."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.orderBy("arm").collect()]
    total = report["totals"].first()
    out = {k: report[k] for k in ("metric", "baseline", "confidence")} | {"arms": rows(report["arms"]), "comparisons": rows(report["comparisons"])}
    return json.dumps(out | total.asDict() | {"failures": {r["status"]: r["n"] for r in report["failures"].collect()}}, indent=2)
