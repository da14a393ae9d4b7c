"""Lint checks of notes, each one relational query, and their ranked union.

FINDING rows: vault, severity, sev_rank, check, path, message, fix, step, ord. ``step`` is the order of
checks and ``ord`` the order within one, so that equal findings keep their order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import parsing
from assayer.functions.text import let, once, strip, unquote, without_md
from assayer.operators.skew import look_up
from assayer.operators.specs import digest, recorded, rule_drift
from assayer.sources.notes import edges

#: Contract of the note format (fixed values).
SEVERITIES = ("blocker", "major", "minor")
REQUIRED = ("type", "title", "added", "tags")
REQUIRED_BY_TYPE = {"dossier": ("type", "key", "read"), "run": ("type", "id", "arm", "seed", "status", "added", "tags")}
DERIVED = ("reports", "_meta", ".obsidian")
UNLINKED_STEMS = ("README", "TODO", "log", "map")
READ_RANK = {"unreachable": 0, "abstract-only": 1, "partial": 2, "full": 3}
EMPTY_LISTS = ("", "[]")

#: Screening records (one a vault) that are broadcast: so many, of so many bytes.
SCREENING_ROWS, SCREENING_BYTES = 10_000, 8 << 20


def field(name: str, default: str = "") -> Column:
    return F.coalesce(F.try_element_at("fm", F.lit(name)), F.lit(default))


def finding(rows: DataFrame, severity: str, check: str, path: str, message: Column, fix: str, order: Column | None = None) -> DataFrame:
    return rows.select(
        "vault",
        F.lit(severity).alias("severity"),
        F.lit(SEVERITIES.index(severity)).alias("sev_rank"),
        F.lit(check).alias("check"),
        F.col(path).alias("path"),
        message.alias("message"),
        F.lit(fix).alias("fix"),
        (F.lit("") if order is None else order.cast("string")).alias("ord"),
    )


# -- checks of a single note: a note's findings are an array, so that one pass gives those of all checks -----------


def _hit(severity: str, check: str, message: Column | str, fix: str, order: Column | None = None) -> Column:
    return F.struct(
        F.lit(severity).alias("severity"),
        F.lit(SEVERITIES.index(severity)).alias("sev_rank"),
        F.lit(check).alias("check"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
        F.lit(fix).alias("fix"),
        (F.lit("") if order is None else order.cast("string")).alias("ord"),
    )


def _if(condition: Column, hit: Column) -> Column:
    return F.when(condition, F.array(hit)).otherwise(F.array().cast(_HITS))


_HITS = "array<struct<severity:string,sev_rank:int,check:string,message:string,fix:string,ord:string>>"


_FIELDS = ("severity", "sev_rank", "check", "message", "fix", "ord")


def _hits(*checks: Callable[[], Column]) -> Column:
    """The findings of a note by the checks, each with ``step``: its place in CHECKS."""

    def stepped_of(check: Callable[[], Column]) -> Column:
        step = F.lit(SINGLE.get(check, len(CHECKS))).alias("step")
        return F.transform(check(), lambda h: F.struct(*(h[c] for c in _FIELDS), step))

    stepped = list(map(stepped_of, checks))
    return F.concat(*stepped) if len(stepped) > 1 else stepped[0]


def _rows_of_hits(notes: DataFrame, hits: Column) -> DataFrame:
    return notes.select("vault", F.col("rel").alias("path"), F.explode(hits).alias("h")).select("vault", "h.severity", "h.sev_rank", "h.check", "path", "h.message", "h.fix", "h.ord", "h.step")


def _of_single_notes(notes: DataFrame, *checks: Callable[[], Column]) -> DataFrame:
    return _rows_of_hits(notes, _hits(*checks))


def _frontmatter() -> Column:
    kind = F.when(F.col("rel").startswith("raw/"), "dossier").otherwise(F.col("type"))
    needed = F.array(*map(F.lit, REQUIRED))
    for name, keys in REQUIRED_BY_TYPE.items():
        needed = F.when(kind == name, F.array(*map(F.lit, keys))).otherwise(needed)
    text = lambda missing: F.when(F.size("fm") == 0, "has no front matter").otherwise(F.concat(F.lit("lacks "), F.array_join(missing, ", ")))
    found = lambda missing: _if(~F.col("rel").startswith("_meta/") & ((F.size(missing) > 0) | (F.size("fm") == 0)), _hit("major", "frontmatter", text(missing), "add the keys that this type of note needs"))
    return let(F.array_except(needed, F.map_keys("fm")), found)


def _evidence() -> Column:
    number = lambda f: F.rtrim(F.replace(f, F.lit(" "), F.lit("")), F.lit("%"))

    def loose(tail: Column) -> Column:
        def of(quotes: Column) -> Column:
            numbered = F.transform(parsing.figures(parsing.before_evidence(F.col("body"))), lambda f, i: F.struct(f.alias("f"), i.alias("i")))
            bad = F.filter(numbered, lambda x: ~F.contains(quotes, number(x["f"])))
            return F.transform(bad, lambda x: _hit("blocker", "unsupported-number", F.concat(F.lit("states "), x["f"], F.lit(", which no quote has")), "quote its source or delete it", F.lpad(x["i"].cast("string"), 9, "0")))

        return let(F.replace(parsing.quoted(tail), F.lit(" "), F.lit("")), of)

    def found(tail: Column) -> Column:
        bare = tail.isNull() | ~parsing.has_quote(tail)
        none = _hit("blocker", "no-evidence", F.when(tail.isNull(), "has no evidence section").otherwise("its evidence holds no quote"), "quote the passages that the note rests on")
        return F.when(bare, F.array(none)).otherwise(loose(tail))

    return F.when((F.col("type") == "source") & (strip(field("read")) != "unreachable"), let(parsing.evidence(F.col("body")), found)).otherwise(F.array().cast(_HITS))


def _claims() -> Column:
    pro, con = strip(field("supported_by", "[]")), strip(field("contradicted_by", "[]"))
    claim = F.col("type") == "claim"
    return F.concat(
        _if(claim & pro.isin(*EMPTY_LISTS) & con.isin(*EMPTY_LISTS), _hit("major", "unsupported-claim", "rests on no source", "list its sources or delete it")),
        _if(claim & (strip(field("status")) == "settled") & ~con.isin(*EMPTY_LISTS), _hit("major", "resolved-contest", "is settled although sources contradict it", "call it contested")),
    )


def _preregistration() -> Column:
    def found(p: Column) -> Column:
        changed = _hit("blocker", "tampered-preregistration", F.concat(F.lit("registered as "), p["recorded"], F.lit(", now "), p["digest"]), "restore it, or register a new spec")
        return F.when(p["recorded"] == "", F.array(_hit("blocker", "no-spec-hash", "has no digest", "register it before its runs"))).otherwise(_if(p["recorded"] != p["digest"], changed))

    now = F.struct(recorded(F.col("fm")).alias("recorded"), digest(F.col("fm_raw"), F.col("body")).alias("digest"))
    return F.when(F.col("type") == "spec", let(now, found)).otherwise(F.array().cast(_HITS))


def frontmatter(notes: DataFrame) -> DataFrame:
    """Notes without the keys that their type needs; what lies under raw/ is a dossier."""
    return _of_single_notes(notes, _frontmatter).drop("step")


def evidence(notes: DataFrame) -> DataFrame:
    """Source notes without quoted evidence, and figures before it that no quote has."""
    return _of_single_notes(notes, _evidence).drop("step")


def claims(notes: DataFrame) -> DataFrame:
    """Claims without any support or contradiction, and settled ones that are contradicted."""
    return _of_single_notes(notes, _claims).drop("step")


def preregistration(notes: DataFrame) -> DataFrame:
    """Specs without a digest, and specs whose digest is another one now."""
    return _of_single_notes(notes, _preregistration).drop("step")


#: Checks of a single note, with their places among all checks.
SINGLE = {_frontmatter: 0, _evidence: 2, _claims: 3, _preregistration: 4}


# -- checks of several notes ------------------------------------------------------------------------------------


def link_names(notes: DataFrame) -> DataFrame:
    """(vault, kind, key) of everything a link can point at: stems, and paths with and without .md. Names may repeat."""
    names = F.array(F.struct(F.lit("stem").alias("kind"), F.col("stem").alias("key")), F.struct(F.lit("path").alias("kind"), F.col("rel").alias("key")), F.struct(F.lit("path").alias("kind"), without_md(F.col("rel")).alias("key")))
    return notes.select("vault", F.explode(names).alias("n")).select("vault", "n.kind", "n.key")


def broken_links(notes: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Links that point at no stem and no path. Two equi-joins on candidate keys, no join on an OR."""
    names = link_names(notes)
    any_name = names.select("vault", F.col("key").alias("target"))
    stems = names.where("kind = 'stem'").select("vault", F.col("key").alias("name"))
    rows = (links or edges(notes)).join(any_name, ["vault", "target"], "left_anti").join(stems, ["vault", "name"], "left_anti")
    return finding(rows, "major", "broken-link", "src", F.concat(F.lit("links to ["), F.col("link"), F.lit("], which is no note")), "create the note or mend the link", F.col("link"))


def runs(notes: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Results that cite runs without a record. Only names with ``seed`` in them count as runs."""
    known = notes.where("type = 'run'")
    stems = known.select("vault", F.col("stem").alias("name")).distinct()
    ids = known.select("vault", unquote(field("id")).alias("link")).distinct()
    cited = (links or edges(notes)).where((F.col("type") == "result") & F.contains("name", F.lit("seed")))
    rows = cited.join(stems, ["vault", "name"], "left_anti").join(ids, ["vault", "link"], "left_anti")
    return finding(rows, "blocker", "dangling-run", "src", F.concat(F.lit("cites run "), F.col("link"), F.lit(", which has no record")), "record the run or drop the citation", F.col("link"))


def dossier_coverage(notes: DataFrame) -> DataFrame:
    """Dossiers that no note names, no source note is called after, and the screening record does not mention."""
    raws = notes.select("vault", unquote(strip(field("raw"))).alias("rel")).distinct()
    stems = notes.where("type = 'source'").select("vault", "stem").distinct()
    screening = notes.where("rel = '_meta/screening.md'").select("vault", F.concat(F.when(F.col("fm_raw") != "", F.concat(F.lit("---"), "fm_raw", F.lit("\n---"))).otherwise(""), "body").alias("screening"))
    n, size = screening.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("screening")), F.lit(0))).first()
    if n <= SCREENING_ROWS and size <= SCREENING_BYTES:
        screening = F.broadcast(screening)  # else a join on the vault, whose large partitions Spark splits
    rows = notes.where((F.col("dir") == "raw") & ~F.col("stem").startswith("_")).join(raws, ["vault", "rel"], "left_anti").join(stems, ["vault", "stem"], "left_anti")
    rows = rows.select("vault", "rel", "stem").join(screening, "vault", "left").where(~F.contains(F.coalesce("screening", F.lit("")), F.col("stem")))
    return finding(rows, "major", "unscreened-dossier", "rel", F.lit("is neither a source nor excluded on record"), "write its note or record why it is left out")


def _rank(c: Column, default: int) -> Column:
    out = F.lit(default)
    for name, k in READ_RANK.items():
        out = F.when(c == name, k).otherwise(out)
    return out


def read_state(notes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Source notes whose dossier is missing, or that claim a fuller reading than it. A dossier without a reading says nothing.

    ``files`` (vault, rel): files that are no notes and so can be a dossier too, without a reading (``sources.notes.list_files``).
    """
    dossiers = notes.select("vault", F.col("rel").alias("raw"), unquote(strip(field("read"))).alias("actual"))
    if files is not None:
        others = files.select("vault", F.col("rel").alias("raw")).distinct().join(dossiers.select("vault", "raw"), ["vault", "raw"], "left_anti")
        dossiers = dossiers.unionByName(others.withColumn("actual", F.lit("")))
    rows = notes.where("type = 'source'").select("vault", "rel", unquote(field("raw")).alias("raw"), unquote(field("read")).alias("claimed")).where("raw <> '' AND claimed <> ''").join(dossiers, ["vault", "raw"], "left")
    missing = rows.where("actual IS NULL")
    more = rows.where((F.col("actual") != "") & (_rank(F.col("claimed"), 3) > _rank(F.col("actual"), 0)))
    return finding(missing, "major", "missing-dossier", "rel", F.concat(F.lit("names "), F.col("raw"), F.lit(", which does not exist")), "restore the dossier").unionByName(
        finding(more, "blocker", "upgraded-reading", "rel", F.concat(F.lit("says it was read "), F.col("claimed"), F.lit(", its dossier says "), F.col("actual")), "state the dossier's reading")
    )


def orphans(notes: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Notes that link nothing and that nothing links; runs and derived files are exempt."""
    linked = (links or edges(notes)).select("vault", F.col("name").alias("stem")).distinct()
    derived = reduce(lambda a, b: a | b, (F.col("rel").startswith(d) for d in DERIVED))
    rows = notes.where(~derived & ~F.col("stem").isin(*UNLINKED_STEMS) & (F.col("type") != "run") & (F.size("links") == 0)).join(linked, ["vault", "stem"], "left_anti")
    return finding(rows, "minor", "orphan", "rel", F.lit("links nothing, and nothing links it"), "link what it is about")


CHECKS = (frontmatter, broken_links, evidence, claims, preregistration, runs, dossier_coverage, read_state, orphans)


def all_findings(notes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """All checks' findings; unsorted, so that consumers can aggregate without a sort.

    Notes are parsed once: that pass runs the checks of a single note and keeps their findings, with the few fields that the other checks
    need, in a persisted table. Clear the cache when the findings are no longer needed (``spark.catalog.clearCache``).
    ``files``: as for ``read_state``.
    """
    notes = condensed(notes).persist()
    links = edges(notes)
    more = {broken_links: (links,), runs: (links,), dossier_coverage: (), read_state: (files,), orphans: (links,)}
    several = [check(notes, *given).withColumn("step", F.lit(CHECKS.index(check))) for check, given in more.items()]
    return reduce(DataFrame.unionByName, several, _rows_of_hits(notes, F.col("hits")))


#: Fields that checks of several notes read.
SHARED_FIELDS = ("id", "raw", "read")


def condensed(notes: DataFrame) -> DataFrame:
    """Notes with ``hits``, the findings of the checks of a single note, and without what no other check reads: texts (but for the
    screening record's) and all fields but ``SHARED_FIELDS``."""
    screening = F.col("rel") == "_meta/screening.md"
    kept = F.map_filter("fm", lambda k, _: k.isin(*SHARED_FIELDS))
    return once(notes, "vault", "rel", "dir", "stem", "type", "links", F.when(screening, F.col("fm_raw")).otherwise("").alias("fm_raw"), F.when(screening, F.col("body")).otherwise("").alias("body"), kept.alias("fm"), _hits(*SINGLE).alias("hits"))


#: Paths that a row of ``stem_collisions`` lists; ``colliding_notes`` gives all of them as rows.
LISTED = 100


def stem_collisions(notes: DataFrame, listed: int = LISTED) -> DataFrame:
    """Names that several notes of a vault share, so that a link by name can mean any of them: vault, stem, n (all of them) and paths, the
    first ``listed`` by name. Names that thousands share (index, README) make no larger row."""
    first = F.row_number().over(Window.partitionBy("vault", "stem").orderBy("rel"))
    heads = notes.select("vault", "stem", "rel", first.alias("k")).where(F.col("k") <= listed).groupBy("vault", "stem").agg(F.sort_array(F.collect_list("rel")).alias("paths"))
    return notes.groupBy("vault", "stem").agg(F.count("*").alias("n")).where("n > 1").join(heads, ["vault", "stem"]).select("vault", "stem", "n", "paths")


def colliding_notes(notes: DataFrame) -> DataFrame:
    """All notes whose name another note of the vault has, as rows (vault, stem, rel)."""
    shared = notes.groupBy("vault", "stem").agg(F.count("*").alias("n")).where("n > 1").select("vault", "stem")
    return look_up(notes.select("vault", "stem", "rel"), shared, ["vault", "stem"])


def _rule_drift() -> Column:
    return _if((F.col("type") == "spec") & rule_drift(F.col("fm_raw"), F.col("body")), _hit("minor", "rule-drift", "its front matter and its text state different rules", "state the rule once, or the same twice"))


def _comments() -> Column:
    mark = lambda k: _hit("minor", "trailing-comment", F.concat(F.lit("the value of "), k, F.lit(" holds a comment")), "move the comment to a line of its own", k)
    run = F.when(F.col("type") == "run", parsing.commented(F.col("fm"), "arm", "seed", "status")).otherwise(F.array().cast("array<string>"))
    rule = F.when(F.col("type") == "spec", F.coalesce(parsing.rule(F.concat(F.lit("---"), "fm_raw", F.lit("\n---"), "body"))["ignored"], F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.concat(run, rule), mark)


def warnings(notes: DataFrame) -> DataFrame:
    """What the checks pass without a word, as minor findings beside theirs: specs whose front matter and text state different
    rules (the digest covers one, a verdict follows the other), values of runs that keep a comment, and keys of a rule whose
    value is no number, so that a default holds."""
    return _of_single_notes(notes, _rule_drift, _comments).drop("step")


def ranked(findings: DataFrame) -> DataFrame:
    """Sorted by severity, check and path; equal ones in the order of their checks."""
    return findings.orderBy("sev_rank", "check", "path", "step", "ord")


def counts(findings: DataFrame) -> DataFrame:
    """Number of findings of each severity, zeros included."""
    spark = findings.sparkSession
    levels = spark.createDataFrame(list(enumerate(SEVERITIES)), "sev_rank int, severity string")
    n = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return levels.join(n, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def fails(findings: DataFrame, ceiling: str = "blocker") -> bool:
    """Whether there is a finding as severe as ``ceiling`` or more."""
    return not findings.where(F.col("sev_rank") <= SEVERITIES.index(ceiling)).limit(1).isEmpty()
