"""Relational parts of the research procedures: coverage, citations, grids, claims, screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import once

PHASES = ("FRAME", "SURVEY", "BUILD", "MAP", "DESIGN", "RUN", "ANALYZE", "MEMO")


def grid_missing(arms: DataFrame, seeds: DataFrame, runs: DataFrame) -> DataFrame:
    """Cells (arm, seed) of the planned grid without a run. The grid is the plan itself: its size is its author's."""
    return arms.select("arm").distinct().crossJoin(seeds.select("seed").distinct()).join(runs.select("arm", "seed"), ["arm", "seed"], "left_anti")


def failure_by_arm(runs: DataFrame) -> DataFrame:
    """Contingency of arm and status, in long form."""
    return runs.groupBy("arm", "status").agg(F.count("*").alias("n"))


def missing_from(checklist: DataFrame, surfaced: DataFrame, key: str) -> DataFrame:
    """Entries of a checklist that a search did not surface, by normalised title."""
    normal = lambda c: F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    return checklist.withColumn("_k", normal(F.col(key))).join(surfaced.select(normal(F.col(key)).alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def recurring_references(citations: DataFrame, least: int = 2) -> DataFrame:
    """References (ref) that at least so many sources (src) cite."""
    return citations.groupBy("ref").agg(F.countDistinct("src").alias("n_sources")).where(F.col("n_sources") >= least)


def unresolved_citations(citations: DataFrame, sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Citations (ref) that are neither a source nor a run (key)."""
    allowed = sources.select(F.col("key").alias("ref")).unionByName(runs.select(F.col("key").alias("ref"))).distinct()
    return citations.join(allowed, "ref", "left_anti")


def quotes_in_dossiers(quotes: DataFrame, dossiers: DataFrame) -> DataFrame:
    """Quotes (raw, quote) with whether their dossier (raw, text) has them verbatim."""
    return quotes.join(dossiers, "raw", "left").withColumn("found", F.coalesce(F.contains("text", F.col("quote")), F.lit(False))).drop("text")


#: Distinct n-grams of passages up to which they are broadcast to the texts' n-grams; more of them meet by a shuffle.
BROADCAST_GRAMS = 1_000_000


def containments(passages: DataFrame, texts: DataFrame, n: int = 5) -> DataFrame:
    """Pairs of a passage (item_id, text) and a text (doc_id, text) that contains it.

    Only n-grams of the texts that some passage has are kept, before anything moves. A passage is sought by the one of its
    n-grams that fewest texts have, so that a common phrase in it costs nothing; with one that no text has, it is in none.
    Each candidate is then searched verbatim. Passages of too few words have no n-gram and are searched in every text.
    """

    def hashes(w: Column) -> Column:
        gram = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n)))
        return F.when(F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - n), gram))).otherwise(F.array().cast("array<bigint>"))

    # a passage may begin and end inside a word, so its outer words are left out
    words = lambda c: F.filter(F.split(c, r"[ \t-\r]+"), lambda w: w != "")
    inner = once(passages, "item_id", F.col("text").alias("passage"), words(F.col("text")).alias("w")).withColumn("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0))))
    key = once(inner, "item_id", "passage", hashes(F.col("w")).alias("g"))
    short, own = key.where(F.size("g") == 0).select("item_id", "passage"), key.select("item_id", "passage", F.explode("g").alias("g"))
    wanted = own.select("g").distinct()
    if wanted.count() <= BROADCAST_GRAMS:
        wanted = F.broadcast(wanted)
    grams = once(once(texts, "doc_id", words(F.col("text")).alias("w")), "doc_id", hashes(F.col("w")).alias("g"))
    hits = grams.select("doc_id", F.explode("g").alias("g")).join(wanted, "g").repartition("g")  # one exchange for both uses
    df = hits.groupBy("g").agg(F.count("*").alias("df"))
    rarest = own.join(df, "g", "left").groupBy("item_id", "passage").agg(F.min_by("g", F.struct("df", "g")).alias("g"), F.count_if(F.col("df").isNull()).alias("absent"))
    near = hits.join(rarest.where("absent = 0"), "g").select("item_id", "passage", "doc_id")
    found = near.join(texts.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("passage"))).select("item_id", "doc_id")
    return found.unionByName(texts.join(short, F.contains("text", F.col("passage"))).select("item_id", "doc_id"))


def one_sided_links(links: DataFrame, listed: DataFrame) -> DataFrame:
    """Links (a, b) whose target does not list them back, and listings without their link; ``side`` tells which.

    One aggregation over both, with partial sums and without a sort. A null end equals nothing, so neither side has the other then.
    """
    both = links.select("a", "b", F.lit(True).alias("_link")).unionByName(listed.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(False).alias("_link")))
    pairs = both.groupBy("a", "b").agg(F.bool_or("_link").alias("_linked"), F.bool_or(~F.col("_link")).alias("_listed"))
    alone = F.col("a").isNull() | F.col("b").isNull()
    sides = F.array(F.when(F.col("_linked") & (alone | ~F.col("_listed")), "not listed"), F.when(F.col("_listed") & (alone | ~F.col("_linked")), "not linked"))
    return pairs.select("a", "b", F.explode(sides).alias("side")).where("side IS NOT NULL")


def foreign_runs(runs: DataFrame, specs: DataFrame) -> DataFrame:
    """Runs (id, spec_id, spec_hash) whose digest is not their spec's (spec_id, digest)."""
    return runs.join(specs, "spec_id").where("spec_hash <> digest").select("id", "spec_id", "spec_hash", "digest")


def claim_buckets(edges: DataFrame) -> DataFrame:
    """Claims by their edges (claim, grp, stance): ``support`` or ``contradict`` from independent groups.

    settled: two groups or more support and none contradicts; contested: both; refuted: only
    contradiction; open: the rest.
    """
    n = edges.groupBy("claim").agg(F.countDistinct(F.when(F.col("stance") == "support", F.col("grp"))).alias("n_support"), F.countDistinct(F.when(F.col("stance") == "contradict", F.col("grp"))).alias("n_contradict"))
    bucket = (
        F.when((F.col("n_support") > 0) & (F.col("n_contradict") > 0), "contested").when(F.col("n_contradict") > 0, "refuted").when(F.col("n_support") > 1, "settled").otherwise("open")
    )
    return n.withColumn("bucket", bucket)


def coverage_matrix(uses: DataFrame) -> DataFrame:
    """Cells (method, dataset) with the number of their sources (src)."""
    return uses.groupBy("method", "dataset").agg(F.countDistinct("src").alias("n_sources"))


def coverage_gaps(uses: DataFrame, counts: Column | None = None) -> DataFrame:
    """Cells of the matrix of methods and datasets that no source covers. The matrix is the result's frame: two short lists.

    ``counts``: which uses cover their cell; all of them if left out. Methods and datasets are those of all uses.
    """
    # one pass over the uses gives the cells; methods, datasets and gaps all come from these few rows
    cells = uses.groupBy("method", "dataset").agg(F.max(F.lit(True) if counts is None else F.coalesce(counts, F.lit(False))).alias("covered")).repartition("method", "dataset")
    methods, datasets = cells.select("method").distinct(), cells.select("dataset").distinct()
    return methods.crossJoin(datasets).join(cells.where("covered").select("method", "dataset"), ["method", "dataset"], "left_anti")


def screening_counts(sources: DataFrame) -> DataFrame:
    """Counts of decisions and of readings that stop at the abstract."""
    return sources.agg(
        F.count_if(F.col("decision") == "include").alias("included"), F.count_if(F.col("decision") == "exclude").alias("excluded"), F.count_if(F.col("read") == "abstract-only").alias("abstract_only"), F.count("*").alias("n")
    )


def grid_cost(arms: Column, seeds: Column, minutes: Column, ceiling: Column) -> Column:
    """Minutes of a grid, and whether they keep to the ceiling."""
    cost = arms * seeds * minutes
    return F.struct(cost.alias("minutes"), (cost <= ceiling).alias("fits"))


def cited(citations: DataFrame) -> DataFrame:
    """Distinct sources and runs that a memo cites: rows (memo, kind, ref)."""
    return citations.groupBy("memo").agg(F.countDistinct(F.when(F.col("kind") == "source", F.col("ref"))).alias("sources_cited"), F.countDistinct(F.when(F.col("kind") == "run", F.col("ref"))).alias("runs_cited"))


def resume_point(done: DataFrame) -> DataFrame:
    """The last finished phase of each project (project, phase) and the next one."""
    order = F.array(*map(F.lit, PHASES))
    last = done.select("project", F.array_position(order, F.col("phase")).alias("k")).groupBy("project").agg(F.max("k").cast("int").alias("k"))
    return last.select("project", F.try_element_at(order, F.when(F.col("k") > 0, F.col("k"))).alias("last_phase"), F.try_element_at(order, F.col("k") + 1).alias("next_phase"))


def capped(sources: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n sources of a ranking, with how many were left out: the cap and its log."""
    left = sources.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("n_dropped"))
    return sources.orderBy(*order).limit(n).crossJoin(F.broadcast(left))  # one row


def sampled(notes: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n notes in an order that depends on the digest of seed and key only, so that any engine draws the same."""
    return notes.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), F.col(key)).limit(n)


def deduplicated(found: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the first by ``order``."""
    return found.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*found.columns), F.col(order)).alias("r")).select("r.*")


def content_hash(files: DataFrame, group: str, path: str, data: str) -> DataFrame:
    """A digest of each group's files, by path: of the sorted list of the files' own digests.

    A group's digests meet in one row (about 100 bytes a file), as the digest of a list can only be taken in order; ``large_content_hash`` is for groups
    of more files than a row holds.
    """
    each = files.select(group, F.concat_ws(":", F.col(path), F.sha2(F.col(data), 256)).alias("d"))
    return each.groupBy(group).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("d")), "\n"), 256).alias("code_hash"))


def large_content_hash(files: DataFrame, group: str, path: str, data: str, buckets: int = 1024) -> DataFrame:
    """A digest of digests: files are dealt into buckets by the digest of their path, each bucket's list is taken as in ``content_hash``, and
    the group's digest is that of its buckets' (bucket:digest). Another value than ``content_hash``'s, as stable, with rows of a
    ``buckets``-th of the files."""
    bucket = F.conv(F.substring(F.sha2(F.col(path), 256), 1, 8), 16, 10).cast("long") % buckets
    each = files.select(group, bucket.alias("_b"), F.concat_ws(":", F.col(path), F.sha2(F.col(data), 256)).alias("d"))
    parts = each.groupBy(group, "_b").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("d")), "\n"), 256).alias("h"))
    return parts.groupBy(group).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_b", "h"))), lambda x: F.concat_ws(":", x["_b"].cast("string"), x["h"])), "\n"), 256).alias("code_hash"))


def by_alias(names: DataFrame, concepts: DataFrame) -> DataFrame:
    """Names (name) with the concept (concept, aliases) that they mean."""
    known = concepts.select("concept", F.explode(F.concat(F.array("concept"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    known = known.select(F.lower("alias").alias("_k"), "concept").groupBy("_k").agg(F.min("concept").alias("concept"))
    return names.withColumn("_k", F.lower("name")).join(known, "_k", "left").drop("_k")


#: Classes of notes and the tags that put a note in them, in the order in which they are tried (fixed values).
NODE_CLASSES = (("source", ("source",)), ("claim", ("claim",)), ("method", ("method",)), ("dataset", ("dataset",)), ("metric", ("metric",)), ("experiment", ("spec", "run", "result")), ("map", ("moc",)))


def node_class(tags: Column) -> Column:
    """The first class of a note that one of its tags puts it in; ``other`` without one."""
    out = F.lit("other")
    for name, own in reversed(NODE_CLASSES):
        out = F.when(F.arrays_overlap(tags, F.array(*map(F.lit, own))), name).otherwise(out)
    return out


def glossary(notes: DataFrame) -> DataFrame:
    """Title and first line of each concept."""
    kinds = ("concept", "method", "dataset", "metric")
    first = F.try_element_at(F.filter(F.split("body", "\n"), lambda x: (F.btrim(x) != "") & ~x.startswith("#")), F.lit(1))
    return notes.where(F.col("type").isin(*kinds)).select("vault", F.coalesce(F.try_element_at("fm", F.lit("title")), F.col("stem")).alias("title"), first.alias("line"))
