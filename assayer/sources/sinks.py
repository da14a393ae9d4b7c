"""Reports as text, checklists and JSON. Rows that are rendered are small; findings stream to the writer."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.lint import SEVERITIES, counts, ranked


def _number(x: float | None) -> str:
    return "n/a" if x is None or math.isnan(x) else f"{x:+.4f}"


def stats_text(report: dict) -> str:
    """A report's arms, comparisons and failures as lines."""
    total = report["totals"].first()
    out = [f"metric {report['metric']}, baseline {report['baseline']}, {total['runs_ok']} of {total['runs_total']} runs ok", "", "arm | n | mean | sd"]
    out += [f"{r['arm']} | {r['n']} | {r['mean']:.4f} | {r['sd']:.4f}" for r in report["arms"].orderBy("arm").collect()]
    out += ["", "arm | pairs | difference | interval | p"]
    out += [f"{r['arm']} | {r['n_pairs']} | {_number(r['mean_difference'])} | {_number(r['ci_low'])} .. {_number(r['ci_high'])} | {'n/a' if math.isnan(r['p_value']) else format(r['p_value'], '.4f')}" for r in report["comparisons"].orderBy("arm").collect()]
    failed = report["failures"].orderBy("status").collect()
    return "\n".join(out + ([""] + [f"failed: {r['status']} {r['n']}" for r in failed] if failed else [])) + "\n"


def verdict_text(verdicts: DataFrame) -> str:
    out = []
    for r in verdicts.collect():
        out += [f"{r['verdict'].upper()}: {r['reason']}"] + [f"  {name} {'passed' if r[f'{name}_pass'] else 'failed'}" for name in ("seeds", "effect", "significance")]
    return "\n".join(out) + "\n"


def finding_line() -> Column:
    return F.concat(F.lit("["), "check", F.lit("] "), "path", F.lit(": "), "message", F.lit(" ("), "fix", F.lit(")"))


def lint_text(findings: DataFrame) -> str:
    """Findings by severity, with their numbers."""
    n = {r["severity"]: r["n"] for r in counts(findings).collect()}
    out = [", ".join(f"{n[s]} {s}" for s in SEVERITIES)]
    last = None
    for r in ranked(findings).select("severity", "sev_rank", "check", "path", "step", "ord", finding_line().alias("line")).toLocalIterator():
        if r["severity"] != last:
            out += ["", r["severity"]]
            last = r["severity"]
        out.append(f"- {r['line']}")
    return "\n".join(out) + "\n"


def todo(findings: DataFrame) -> DataFrame:
    """The checklist as rows of one text column, in order: write it with ``write.text``."""
    return ranked(findings).select(F.concat(F.lit("- [ ] **"), "severity", F.lit("** "), finding_line()).alias("value"))


def todo_text(findings: DataFrame) -> str:
    return "\n".join(["---", "type: report", "title: TODO", "tags: [todo]", "---", "", *(r["value"] for r in todo(findings).toLocalIterator())]) + "\n"


def as_json(rows: DataFrame) -> DataFrame:
    """Rows as JSON in one column ``value``; NaN becomes null, as JSON has none."""
    safe = [F.when(~F.isnan(c), F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in rows.dtypes]
    return rows.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("value"))


def exit_code(findings: DataFrame, ceiling: str = "blocker") -> int:
    """1 if a finding is as severe as the ceiling, else 0."""
    from assayer.operators.lint import fails

    return int(fails(findings, ceiling))
