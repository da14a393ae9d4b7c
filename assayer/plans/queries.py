"""Queries of the engine's own operators on star-schema tables, each with the SQL that gives its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import parsing, student_t
from assayer.functions.text import key_file_name
from assayer.operators import coverage, experiments, lint, specs
from assayer.plans import adapters as A
from assayer.plans.registry import QUERIES, SQL, query
from assayer.sources.notes import edges
from assayer.sources.runs import runs_from_table, runs_from_texts

def rounded_to(df: DataFrame, *names: str, places: int = 4) -> DataFrame:
    return df.withColumns({n: F.bround(F.col(n), places) for n in names})


# -- experiments ------------------------------------------------------------------------------------

_OK = "SELECT o_orderkey AS ord, o_orderpriority AS arm, o_custkey AS seed, o_totalprice AS value FROM orders WHERE o_orderstatus IN ('F', 'O')"
_LAST = f"SELECT arm, seed, max_by(value, ord) AS value FROM ({_OK}) GROUP BY arm, seed"
_PAIRS = f"SELECT t.arm, t.seed, t.value - b.value AS difference FROM ({_LAST}) t JOIN ({_LAST}) b ON t.seed = b.seed AND b.arm = '{A.BASELINE}' WHERE t.arm <> '{A.BASELINE}'"
_EV = "SELECT event_id AS ord, event_type AS arm, user_id AS seed, value FROM events WHERE value > 1"


def _central(theta: str, df: str) -> str:
    """SQL of P(|T| <= t), theta = atan(t / sqrt(df)), with products as gamma functions."""
    even = f"(1 + coalesce(list_sum(list_transform(range(1, CAST({df} / 2 AS BIGINT)), lambda k: exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - 2 * k * ln(2)) * pow(cos({theta}), 2 * k))), 0))"
    odd = f"(1 + coalesce(list_sum(list_transform(range(1, CAST(({df} - 1) / 2 AS BIGINT)), lambda k: exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * pow(cos({theta}), 2 * k))), 0))"
    return f"CASE WHEN {df} % 2 = 0 THEN sin({theta}) * {even} WHEN {df} = 1 THEN 2 * {theta} / pi() ELSE 2 / pi() * ({theta} + sin({theta}) * cos({theta}) * {odd}) END"


_COMPARED = f"""
WITH RECURSIVE d AS (SELECT arm, count(*) AS n, avg(difference) AS m, coalesce(stddev_samp(difference), 0) AS sd FROM ({_PAIRS}) GROUP BY arm),
b AS (SELECT DISTINCT n - 1 AS df, 0.0::DOUBLE AS lo, pi() / 2 AS hi, 0 AS k FROM d WHERE n > 1
      UNION ALL SELECT df, CASE WHEN {_central("(lo + hi) / 2", "df")} < 0.95 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_central("(lo + hi) / 2", "df")} < 0.95 THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM b WHERE k < 64),
c AS (SELECT df, tan((lo + hi) / 2) * sqrt(df) AS crit FROM b WHERE k = 64),
r AS (SELECT arm, n, m, sd, sd / sqrt(n) AS se, n - 1 AS df, crit, atan(abs(m / (sd / sqrt(n))) / sqrt(n - 1)) AS theta FROM d LEFT JOIN c ON c.df = d.n - 1),
compared AS (SELECT arm, '{A.BASELINE}' AS baseline, n AS n_pairs, round_even(m, 6) AS mean_difference, round_even(sd, 6) AS sd_difference,
  round_even(m - crit * se, 6) AS ci_low, round_even(m + crit * se, 6) AS ci_high, round_even(least(1.0, greatest(0.0, 1 - ({_central("theta", "df")}))), 6) AS p_value FROM r)
"""
_P4 = "SELECT arm, baseline, n_pairs, round_even(mean_difference, 4) AS mean_difference, round_even(sd_difference, 4) AS sd_difference, round_even(ci_low, 4) AS ci_low, round_even(ci_high, 4) AS ci_high, round_even(p_value, 4) AS p_value"


@query(f"SELECT arm, count(*) AS n, round_even(avg(value), 4) AS mean, round_even(stddev_samp(value), 4) AS sd FROM ({_OK}) GROUP BY arm")
def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_to(experiments.arm_moments(A.order_runs(spark, sf_dir), "price"), "mean", "sd")


@query(f"SELECT arm, count(*) AS n, array_to_string(list_transform(list_sort(list(value)), lambda x: CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR)), ',') AS value_list FROM ({_EV}) GROUP BY arm")
def arm_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = experiments.arm_summary(A.event_runs(spark, sf_dir), "value")
    return rows.select("arm", "n", F.array_join(F.transform("values", lambda x: F.round(x * 100).cast("long").cast("string")), ",").alias("value_list"))


@query("SELECT 'skipped' AS status, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.failures(A.order_runs(spark, sf_dir))


@query("SELECT count(*) AS runs_total, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS runs_ok FROM orders")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.totals(A.order_runs(spark, sf_dir))


@query("SELECT 'value' AS metric FROM events LIMIT 1")
def metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.metric_names(A.event_runs(spark, sf_dir))


@query(f"SELECT arm AS baseline FROM (SELECT arm, avg(value) AS m FROM ({_EV}) GROUP BY arm) ORDER BY m, arm LIMIT 1")
def baseline_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.inferred_baseline(A.event_runs(spark, sf_dir), "value")


@query(_LAST)
def run_dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.last_of_each_seed(A.order_runs(spark, sf_dir), "price")


@query(f"SELECT arm, seed, round_even(difference, 4) AS difference FROM ({_PAIRS})")
def paired_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_to(experiments.pairs(A.order_runs(spark, sf_dir), "price", A.BASELINE), "difference")


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.comparisons(A.order_runs(spark, sf_dir), "price", A.BASELINE, seeds=False)


@query(f"{_COMPARED} {_P4} FROM compared")
def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_to(compared(spark, sf_dir), "mean_difference", "sd_difference", "ci_low", "ci_high", "p_value")


@query(f"{_COMPARED} {_P4} FROM compared ORDER BY mean_difference, arm LIMIT 1")
def worst_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_to(experiments.worst_comparison(compared(spark, sf_dir)), "mean_difference", "sd_difference", "ci_low", "ci_high", "p_value")


def _verdicts(name: str, rules: list[tuple[str, float, int, float]]) -> None:
    values = ", ".join(f"('{c}', {t}::DOUBLE, {s}::BIGINT, {p}::DOUBLE)" for c, t, s, p in rules)
    effect = "CASE comparator WHEN '>=' THEN mean_difference >= threshold WHEN '<' THEN mean_difference < threshold WHEN '<=' THEN mean_difference <= threshold ELSE mean_difference > threshold END"
    out = "CASE WHEN comparator IN ('>', '>=') THEN ci_high < threshold ELSE ci_low > threshold END"
    SQL[name] = f"""{_COMPARED}, worst AS (SELECT * FROM compared ORDER BY mean_difference, arm LIMIT 1), rules(comparator, threshold, min_seeds, max_p_value) AS (VALUES {values})
    SELECT comparator, threshold, min_seeds, arm, n_pairs, CASE WHEN n_pairs < min_seeds THEN 'inconclusive' WHEN ({effect}) AND NOT isnan(p_value) AND p_value < max_p_value THEN 'supported' WHEN {out} THEN 'refuted' ELSE 'inconclusive' END AS verdict FROM rules, worst"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rule = spark.createDataFrame(rules, "comparator string, threshold double, min_seeds long, max_p_value double")
        return experiments.decide(compared(spark, sf_dir), rule).select("comparator", "threshold", "min_seeds", "arm", "n_pairs", "verdict")

    run.__name__ = name
    QUERIES[name] = run


_verdicts("verdict_gt", [(">", -1e5, 3, 1.01), (">", 0.0, 3, 0.05), (">=", 1e6, 3, 0.05), (">", -1e5, 3, 0.0)])
_verdicts("verdict_lt", [("<", 1e5, 3, 1.01), ("<", -1e6, 3, 0.05), ("<=", 0.0, 3, 0.05), ("~", 1e6, 3, 0.05), ("~", -1e6, 3, 0.05)])
_verdicts("verdict_seed_floor", [(">", -1e5, 1_000_000_000, 1.01), ("<", -1e6, 1_000_000_000, 0.05)])


@query(f"SELECT o_orderpriority AS arm, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'ok' ELSE 'skipped' END AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def failure_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.failure_by_arm(A.order_runs(spark, sf_dir))


@query("SELECT arm, seed FROM (SELECT DISTINCT event_type AS arm FROM events), (SELECT DISTINCT user_id AS seed FROM events) WHERE (arm, seed) NOT IN (SELECT (event_type, user_id) FROM events WHERE value > 40)")
def grid_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = A.event_runs(spark, sf_dir)
    return coverage.grid_missing(runs, runs, runs.where(F.col("metrics")["value"] > 40))


# -- parsing ----------------------------------------------------------------------------------------


@query(
    "SELECT 'r' || o_orderkey AS id, o_orderpriority AS arm, o_custkey AS seed, strftime(o_orderdate, '%Y-%m-%d') AS added, CASE WHEN o_orderkey % 7 = 0 THEN 'tags' ELSE '' END AS missing, 'c' || o_custkey AS link FROM orders"
)
def frontmatter_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = A.as_notes(A.run_texts(spark, sf_dir))
    get = lambda k: F.try_element_at("fm", F.lit(k))
    missing = F.array_join(F.array_except(F.array(*map(F.lit, lint.REQUIRED_BY_TYPE["run"])), F.map_keys("fm")), ",")
    return notes.select(get("id").alias("id"), F.btrim(get("arm"), F.lit('"')).alias("arm"), get("seed").cast("long").alias("seed"), get("added").alias("added"), missing.alias("missing"), F.array_join("links", ",").alias("link"))


@query("SELECT 'runs/' || o_orderkey || '.md' AS source, o_orderpriority AS arm, o_custkey AS seed, CASE WHEN o_orderstatus = 'P' THEN 'skipped' ELSE 'ok' END AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, round((o_orderkey % 10) / 10.0, 1)::DOUBLE AS size FROM orders")
def metrics_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = runs_from_texts(A.run_texts(spark, sf_dir))
    return runs.select("source", "arm", "seed", "status", F.round(F.col("metrics")["price"] * 100).cast("long").alias("cents"), F.round(F.col("metrics")["size"], 1).alias("size"))


_NL = "chr(10)"
_RULE = "CASE WHEN p_partkey % 2 = 0 THEN '## Decision rule price over 0.' || p_size ELSE 'metric: price threshold: 0.' || p_size END"
_PAYLOAD = f"""'id=s' || p_partkey || {_NL} || 'hypothesis="' || p_name || ' matters"' || {_NL} || 'arms=[' || p_brand || ', none]' || {_NL} || 'baseline=none' || {_NL} || 'dataset={{name: ' || p_type || '}}' || {_NL} || 'metrics=[price]' || {_NL} || 'controls=' || {_NL} || 'seeds=[0, 1, ' || p_size || ']' || {_NL} || 'scale=smoke' || {_NL} || 'decision_rule=' || {_RULE}"""
_DIGEST = f"substr(sha256({_PAYLOAD}), 1, 16)"


@query(f"SELECT 'specs/' || p_partkey || '.md' AS rel, {_DIGEST} AS digest FROM part")
def spec_payload_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.registrations(A.as_notes(A.spec_texts(spark, sf_dir))).select("rel", "digest")


@query(f"SELECT 'specs/' || p_partkey || '.md' AS path, CASE WHEN p_partkey % 3 = 0 THEN 'no-spec-hash' ELSE 'tampered-preregistration' END AS \"check\", CASE WHEN p_partkey % 3 = 0 THEN 'has no digest' ELSE 'registered as ' || CASE WHEN p_partkey % 3 = 1 THEN '0123456789abcdef' ELSE '@' END || ', now ' || {_DIGEST} END AS message FROM part WHERE p_partkey % 4 <> 0")
def spec_tamper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth spec is registered, and so has no finding."""
    texts = A.spec_texts(spark, sf_dir).withColumn("text", F.when(F.regexp_extract("rel", "[0-9]+", 0).cast("long") % 4 == 0, specs.with_digest(F.col("text"))).otherwise(F.col("text")))
    return lint.preregistration(A.as_notes(texts)).select("path", "check", "message")


@query(f"SELECT 'specs/' || p_partkey || '.md' AS rel, {_DIGEST} AS recorded, {_DIGEST} AS digest, true AS same FROM part")
def spec_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs with their digest written in; read again, none is tampered with, so every row is of equal digests."""
    texts = A.spec_texts(spark, sf_dir).select("rel", specs.with_digest(F.col("text")).alias("text"))
    return specs.registrations(A.as_notes(texts)).select("rel", "recorded", "digest", (F.col("recorded") == F.col("digest")).alias("same"))


# -- lint -------------------------------------------------------------------------------------------


def _found(df: DataFrame) -> DataFrame:
    return df.select("severity", "check", "path")


@query("SELECT 'major' AS severity, 'frontmatter' AS \"check\", 'runs/' || o_orderkey || '.md' AS path, 'lacks tags' AS message FROM orders WHERE o_orderkey % 7 = 0")
def lint_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.frontmatter(A.as_notes(A.run_texts(spark, sf_dir))).select("severity", "check", "path", "message")


_CLAIMS = """SELECT 'major' AS severity, 'unsupported-claim' AS "check", 'claims/' || doc_id || '.md' AS path FROM labels WHERE quality <> 1 AND toxic <> 1
UNION ALL SELECT 'major', 'resolved-contest', 'claims/' || doc_id || '.md' FROM labels WHERE doc_id % 2 = 0 AND toxic = 1"""


@query(_CLAIMS)
def lint_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(lint.claims(A.as_notes(A.claim_texts(spark, sf_dir))))


_EVIDENCE = """SELECT 'blocker' AS severity, 'no-evidence' AS "check", 'sources/d' || doc_id || '.md' AS path FROM documents WHERE doc_id % 13 <> 0 AND (doc_id % 17 = 0 OR (doc_id % 11 = 0 AND doc_id % 4 <> 0))"""
_NUMBERS = """SELECT 'blocker' AS severity, 'unsupported-number' AS "check", 'sources/d' || doc_id || '.md' AS path, 'states ' || f || ', which no quote has' AS message
FROM (SELECT doc_id, unnest([(doc_id % 90 + 10) || '.' || (doc_id % 10), '15 %']) AS f FROM documents WHERE doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND (doc_id % 11 <> 0 OR doc_id % 4 = 0))
WHERE doc_id % 4 = 0 OR NOT contains('again of' || (doc_id % 90 + 10) || '.' || (doc_id % 10) || 'points', rtrim(replace(f, ' ', ''), '%'))"""


@query(f"{_EVIDENCE}")
def lint_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(lint.evidence(A.as_notes(A.source_texts(spark, sf_dir))).where("check = 'no-evidence'"))


@query(_NUMBERS)
def lint_unsupported_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.evidence(A.as_notes(A.source_texts(spark, sf_dir))).where("check = 'unsupported-number'").select("severity", "check", "path", "message")


_READ = """SELECT 'major' AS severity, 'missing-dossier' AS "check", 'sources/d' || doc_id || '.md' AS path FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT 'blocker', 'upgraded-reading', 'sources/d' || doc_id || '.md' FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 2 = 1 AND doc_id % 13 <> 0 AND doc_id % 7 <> 0"""


@query(_READ)
def lint_read_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(lint.read_state(A.as_notes(A.source_texts(spark, sf_dir), A.dossier_texts(spark, sf_dir))))


_UNSCREENED = """SELECT 'major' AS severity, 'unscreened-dossier' AS "check", 'raw/x' || doc_id || '.md' AS path FROM documents WHERE doc_id % 19 = 0 AND NOT contains('excluded: x0, x19 and x38', 'x' || doc_id)"""


@query(_UNSCREENED)
def lint_unscreened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(lint.dossier_coverage(A.as_notes(A.source_texts(spark, sf_dir), A.dossier_texts(spark, sf_dir))))


_BROKEN = """SELECT 'major' AS severity, 'broken-link' AS "check", path, 'links to [' || link || '], which is no note' AS message FROM (
SELECT 'results/' || o_orderkey || '.md' AS path, 'Missing ' || o_orderkey AS link FROM orders WHERE o_orderkey % 97 = 0
UNION ALL SELECT 'results/' || o_orderkey || '.md', 'exp-seed' || (o_custkey % 60) FROM orders WHERE o_custkey % 60 >= 40
UNION ALL SELECT 'results/' || o_orderkey || '.md', 'concepts/c' || o_custkey || '.md' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))"""


@query(_BROKEN)
def lint_broken_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.broken_links(A.as_notes(A.result_texts(spark, sf_dir))).select("severity", "check", "path", "message")


_ORPHANS = """SELECT 'minor' AS severity, 'orphan' AS "check", 'concepts/c' || c_custkey || '.md' AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'minor', 'orphan', 'concepts/n' || n_nationkey || '.md' FROM nation"""


@query(_ORPHANS)
def lint_orphan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(lint.orphans(A.as_notes(A.result_texts(spark, sf_dir))))


_DANGLING = """SELECT 'blocker' AS severity, 'dangling-run' AS "check", 'results/' || o_orderkey || '.md' AS path FROM orders WHERE o_custkey % 60 >= 40"""


@query(_DANGLING)
def lint_dangling_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(lint.runs(A.as_notes(A.result_texts(spark, sf_dir))))


def _vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims, sources, dossiers and results in one vault."""
    return A.as_notes(A.claim_texts(spark, sf_dir), A.source_texts(spark, sf_dir), A.dossier_texts(spark, sf_dir), A.result_texts(spark, sf_dir))


_ALL = f"""SELECT severity, "check", path FROM ({_CLAIMS} UNION ALL {_EVIDENCE} UNION ALL SELECT severity, "check", path FROM ({_NUMBERS}) UNION ALL {_READ} UNION ALL {_UNSCREENED}
UNION ALL SELECT severity, "check", path FROM ({_BROKEN}) UNION ALL {_ORPHANS} UNION ALL {_DANGLING}
UNION ALL SELECT 'major', 'frontmatter', 'claims/' || doc_id || '.md' FROM labels
UNION ALL SELECT 'major', 'broken-link', 'sources/d' || doc_id || '.md' FROM documents
UNION ALL SELECT 'minor', 'orphan', 'raw/d' || doc_id || '.md' FROM documents WHERE doc_id % 5 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'minor', 'orphan', 'raw/x' || doc_id || '.md' FROM documents WHERE doc_id % 19 = 0)"""


@query(f"SELECT CASE severity WHEN 'blocker' THEN 0 WHEN 'major' THEN 1 ELSE 2 END AS sev_rank, \"check\", path FROM ({_ALL})")
def lint_all_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.ranked(lint.all_findings(_vault(spark, sf_dir))).select("sev_rank", "check", "path")


@query(f"SELECT severity, count(*) AS n FROM ({_ALL}) GROUP BY severity")
def lint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.counts(lint.all_findings(_vault(spark, sf_dir)))


# -- procedures -------------------------------------------------------------------------------------


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def quote_in_dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.containments(A.table(spark, sf_dir, "benchmark"), A.spread(A.table(spark, sf_dir, "documents"))).distinct()


_USES = "SELECT l_orderkey AS src, p_type AS method, n_name AS dataset FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"
#: Methods by type and brand: so many that some cells stay empty.
_FINE = "p_type || ' ' || p_brand"


def _uses(spark: SparkSession, sf_dir: str, method: str = "p_type") -> DataFrame:
    t = lambda n: A.table(spark, sf_dir, n)
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("l_orderkey").alias("src"), F.expr(method).alias("method"), F.col("n_name").alias("dataset"))


@query(f"SELECT method, dataset, count(DISTINCT src) AS n_sources FROM ({_USES}) GROUP BY method, dataset")
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage_matrix(_uses(spark, sf_dir))


@query(f"WITH u AS ({_USES.replace('p_type AS', f'{_FINE} AS')}) SELECT m.method, d.dataset FROM (SELECT DISTINCT method FROM u) m, (SELECT DISTINCT dataset FROM u) d WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.method = m.method AND u.dataset = d.dataset)")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage_gaps(_uses(spark, sf_dir, _FINE))


@query("SELECT p_partkey AS key, 'Part ' || p_partkey AS title FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def recall_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("title"))
    found = A.table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.concat(F.lit("PART:  "), F.col("l_partkey").cast("string"), F.lit(".")).alias("title"))
    return coverage.missing_from(listed, found, "title")


@query("SELECT l_partkey AS ref, count(DISTINCT l_orderkey) AS n_sources FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 35")
def citation_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.recurring_references(A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("ref")), 35)


@query("SELECT l_orderkey AS src, l_partkey AS ref FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) AND l_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def citation_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    cites = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("ref"))
    return coverage.unresolved_citations(cites, A.table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("key")), A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))).select("src", "ref")


@query("""SELECT lang AS claim, s AS n_support, c AS n_contradict, CASE WHEN s > 0 AND c > 0 THEN 'contested' WHEN c > 0 THEN 'refuted' WHEN s > 1 THEN 'settled' ELSE 'open' END AS bucket
FROM (SELECT lang || '-' || (doc_id % 40) AS lang, count(DISTINCT CASE WHEN quality = 1 THEN source END) AS s, count(DISTINCT CASE WHEN quality <> 1 THEN source END) AS c FROM labels JOIN documents USING (doc_id) GROUP BY 1)""")
def claim_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "labels").join(A.table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return coverage.claim_buckets(rows.select(F.concat_ws("-", "lang", (F.col("doc_id") % 40).cast("string")).alias("claim"), F.col("source").alias("grp"), F.when(F.col("quality") == 1, "support").otherwise("contradict").alias("stance")))


@query("""SELECT a, b, 'not listed' AS side FROM (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_quantity > 45) WHERE (a, b) NOT IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_discount < 0.05)
UNION ALL SELECT a, b, 'not linked' FROM (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_discount < 0.05) WHERE (a, b) NOT IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_quantity > 45)""")
def backlink_asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem")
    return coverage.one_sided_links(rows.where("l_quantity > 45").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")), rows.where("l_discount < 0.05").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")))


@query("SELECT doc_id, n_chars, (SELECT greatest(count(*) - 40, 0) FROM documents) AS n_dropped FROM documents ORDER BY n_chars DESC, doc_id LIMIT 40")
def source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.capped(A.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 40)


@query("SELECT doc_id, source FROM documents ORDER BY sha256('0:' || doc_id), doc_id LIMIT 5")
def sample_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.sampled(A.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 5)


@query("SELECT min(doc_id) AS doc_id, source, lang FROM documents GROUP BY source, lang")
def source_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.concat_ws("/", "source", "lang").alias("key"))
    return coverage.deduplicated(rows, "key", "doc_id").select("doc_id", "source", "lang")


@query("SELECT count(*) FILTER (quality = 1) AS included, count(*) FILTER (quality <> 1) AS excluded, count(*) FILTER (toxic = 1) AS abstract_only, count(*) AS n FROM labels")
def screening_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.screening_counts(A.table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("decision"), F.when(F.col("toxic") == 1, "abstract-only").otherwise("full").alias("read")))


@query("SELECT o_custkey AS memo, count(DISTINCT CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END) AS sources_cited, count(DISTINCT CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END) AS runs_cited FROM orders GROUP BY 1")
def memo_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.cited(A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("memo"), F.when(F.col("o_orderstatus") == "P", "run").otherwise("source").alias("kind"), F.col("o_orderpriority").alias("ref")))


@query("SELECT 'r' || o_orderkey AS id, o_custkey AS spec_id, 'h' || (o_orderkey % 4) AS spec_hash, 'h' || (c_custkey % 4) AS digest FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 4 <> c_custkey % 4")
def foreign_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda c: F.concat(F.lit("h"), (F.col(c) % 4).cast("string"))
    runs = A.table(spark, sf_dir, "orders").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_custkey").alias("spec_id"), digest("o_orderkey").alias("spec_hash"))
    return coverage.foreign_runs(runs, A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("spec_id"), digest("c_custkey").alias("digest")))


@query("""SELECT o_custkey AS project, ['FRAME','SURVEY','BUILD','MAP','DESIGN','RUN','ANALYZE','MEMO'][max(1 + o_orderkey % 8)] AS last_phase, ['FRAME','SURVEY','BUILD','MAP','DESIGN','RUN','ANALYZE','MEMO'][max(1 + o_orderkey % 8) + 1] AS next_phase FROM orders GROUP BY 1""")
def resume_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    phases = F.array(*map(F.lit, coverage.PHASES))
    return coverage.resume_point(A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.element_at(phases, (1 + F.col("o_orderkey") % 8).cast("int")).alias("phase")))


@query("SELECT n_regionkey AS grp, sha256(string_agg(n_nationkey || ':' || sha256(n_name), chr(10) ORDER BY n_nationkey || ':' || sha256(n_name))) AS code_hash FROM nation GROUP BY 1")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.content_hash(A.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("grp"), F.col("n_nationkey").cast("string").alias("path"), "n_name"), "grp", "path", "n_name")


@query("SELECT 'results/' || o_orderkey || '.md' AS src, unnest(['concepts/c' || o_custkey, 'exp-seed' || (o_custkey % 60)] || CASE WHEN o_orderkey % 97 = 0 THEN ['Missing ' || o_orderkey] ELSE [] END) AS target FROM orders")
def note_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(A.as_notes(A.result_texts(spark, sf_dir))).select("src", "target")


# -- rules, names and small functions ---------------------------------------------------------------


@query("""SELECT 'specs/' || p_partkey || '.md' AS rel, 'price' AS metric, CASE p_partkey % 4 WHEN 0 THEN '>=' WHEN 1 THEN '<' ELSE '>' END AS comparator, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE CAST('0.' || p_size AS DOUBLE) END AS threshold,
p_partkey % 9 AS min_seeds, 0.05::DOUBLE AS max_p_value, CASE WHEN p_partkey % 5 = 0 THEN 'threshold' ELSE '' END AS ignored FROM part""")
def rule_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.ruled_texts(spark, sf_dir).select("rel", parsing.rule(F.col("text")).alias("r")).select("rel", "r.*")
    return rows.select("rel", "metric", "comparator", "threshold", "min_seeds", "max_p_value", F.array_join("ignored", ",").alias("ignored"))


@query("""SELECT 'specs/' || p_partkey || '.md' AS path, 'rule-drift' AS "check" FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT 'specs/' || p_partkey || '.md', 'trailing-comment' FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT 'runs/' || o_orderkey || '.md', 'trailing-comment' FROM orders WHERE o_orderkey % 6 = 0""")
def lint_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = A.run_texts(spark, sf_dir)
    commented = F.regexp_replace("text", "(?m)^(status: .*)$", "$1  # ok or skipped")
    runs = runs.withColumn("text", F.when(F.regexp_extract("rel", "[0-9]+", 0).cast("long") % 6 == 0, commented).otherwise(F.col("text")))
    return lint.warnings(A.as_notes(A.ruled_texts(spark, sf_dir), runs)).select("path", "check")


@query("SELECT 'runs/' || o_orderkey || '.md' AS source, o_orderpriority AS arm, o_custkey AS seed, CASE WHEN o_orderkey % 6 = 0 THEN CASE WHEN o_orderstatus = 'P' THEN 'skipped  # once' ELSE 'ok  # once' END WHEN o_orderstatus = 'P' THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN o_orderkey % 6 = 0 THEN 'status' ELSE '' END AS commented FROM orders")
def open_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records of which every third has no end of its front matter, and every sixth a comment after its status."""
    n = F.regexp_extract("rel", "[0-9]+", 0).cast("long")
    text = F.when(n % 6 == 0, F.regexp_replace("text", "(?m)^(status: .*)$", "$1  # once")).otherwise(F.col("text"))
    text = F.when(n % 3 == 0, F.regexp_replace(text, "(?s)\\n---\\n.*", "")).otherwise(text)
    return runs_from_texts(A.run_texts(spark, sf_dir).withColumn("text", text)).select("source", "arm", "seed", "status", F.array_join("commented", ",").alias("commented"))


@query("SELECT 'd' || doc_id AS stem, 2 AS n, 'raw/d' || doc_id || '.md,sources/d' || doc_id || '.md' AS paths FROM documents WHERE doc_id % 5 <> 0")
def stem_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = A.as_notes(A.source_texts(spark, sf_dir), A.dossier_texts(spark, sf_dir))
    return lint.stem_collisions(notes).select("stem", F.col("n").cast("int").alias("n"), F.array_join("paths", ",").alias("paths"))


@query("SELECT 'Customer ' || c_custkey AS title, 'A customer.' AS line FROM customer UNION ALL SELECT n_name, 'Named ' || n_name || '.' FROM nation")
def glossary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.glossary(A.as_notes(A.result_texts(spark, sf_dir))).select("title", "line")


@query("SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'source' WHEN 1 THEN 'claim' WHEN 2 THEN 'method' WHEN 3 THEN 'experiment' ELSE 'other' END AS kind FROM part")
def node_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, tags = F.col("p_size") % 5, lambda *names: F.array(*map(F.lit, names))
    own = F.when(k == 0, tags("moc", "source")).when(k == 1, tags("method", "claim")).when(k == 2, tags("x", "method")).when(k == 3, tags("result")).otherwise(tags("x"))
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), coverage.node_class(own).alias("kind"))


@query("SELECT s.name, n_name AS concept FROM (SELECT lower(n_name) AS name FROM nation UNION ALL SELECT n_name || '-' || n_nationkey FROM nation UNION ALL SELECT 'nowhere') s LEFT JOIN nation ON lower(s.name) IN (lower(n_name), lower(n_name) || '-' || n_nationkey)")
def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = A.table(spark, sf_dir, "nation")
    other = F.concat_ws("-", "n_name", F.col("n_nationkey").cast("string"))
    names = nations.select(F.lower("n_name").alias("name")).unionByName(nations.select(other.alias("name"))).unionByName(spark.createDataFrame([("nowhere",)], "name string"))
    return coverage.by_alias(names, nations.select(F.col("n_name").alias("concept"), F.array(other).alias("aliases"))).select("name", "concept")


@query("SELECT p_partkey AS id, p_size * (1 + p_partkey % 3) * 10 AS minutes, p_size * (1 + p_partkey % 3) * 10 <= 500 AS fits FROM part")
def grid_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = coverage.grid_cost(F.col("p_size").cast("long"), 1 + F.col("p_partkey") % 3, F.lit(10).cast("long"), F.lit(500))
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), cost.alias("c")).select("id", "c.minutes", "c.fits")


@query("SELECT n_name || ':' || n_regionkey || '/v1.' || n_nationkey AS key, n_name || '-' || n_regionkey || '-v1.' || n_nationkey AS file_name FROM nation")
def key_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat("n_name", F.lit(":"), F.col("n_regionkey").cast("string"), F.lit("/v1."), F.col("n_nationkey").cast("string"))
    return A.table(spark, sf_dir, "nation").select(key.alias("key"), key_file_name(key).alias("file_name"))


@query("""SELECT p_partkey AS id, round_even(0.5 - atan(p_size / 10.0) / pi(), 8) AS by_1, round_even(0.5 - (p_size / 10.0) / (2 * sqrt(2 + (p_size / 10.0) * (p_size / 10.0))), 8) AS by_2 FROM part""")
def one_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("p_size") / 10.0
    tail = lambda df: F.bround(student_t.upper_tail(t, F.lit(df)), 8)
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tail(1).alias("by_1"), tail(2).alias("by_2"))


@query("""SELECT * FROM (VALUES ('moved', 25::BIGINT, 0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE, 0.5::DOUBLE, 0.0::DOUBLE), ('single', 1, 2.0, 0.0, NULL, NULL, NULL), ('still', 25, 0.0, 0.0, 0.0, 0.0, 1.0)) t(arm, n_pairs, mean_difference, sd_difference, ci_low, ci_high, p_value)""")
def degenerate_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No spread, and a single pair, whose interval and p are NaN (null here)."""
    arms = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.lit(v).alias("value")) for a, v in (("base", 1.0), ("still", 1.0), ("moved", 1.5), ("single", 3.0)))))
    rows = A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), arms.alias("a")).where("a.arm <> 'single' OR k = 0").select("k", "a.arm", "a.value")
    found = experiments.comparisons(runs_from_table(rows, "arm", "k", "k", {"v": "value"}), "v", "base", seeds=False).drop("baseline")
    return found.select("arm", "n_pairs", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in found.columns[2:]))


@query(f"""{_COMPARED} SELECT arm, n_pairs, CASE WHEN mean_difference > -1e5 AND p_value < 1.01 THEN 'supported' WHEN ci_high < -1e5 THEN 'refuted' ELSE 'inconclusive' END AS verdict FROM compared WHERE arm = '2-HIGH'""")
def verdict_of_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = spark.createDataFrame([(">", -1e5, 3, 1.01)], "comparator string, threshold double, min_seeds long, max_p_value double")
    return experiments.decide(compared(spark, sf_dir), rule, arm="2-HIGH").select("arm", "n_pairs", "verdict")


from assayer.plans import studies  # noqa: E402, F401  registers its queries, which use what stands above
