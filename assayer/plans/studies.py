"""Queries of the operators on evidence, failures, several baselines and sequences, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.text import let, slug
from assayer.operators import baselines, evidence, failures, grains, history, lint, names, quotes, sections, sequence, titles
from assayer.operators.snowball import snowball
from assayer.plans import adapters as A
from assayer.plans import queries as Q
from assayer.plans.registry import query

# -- independence of evidence -------------------------------------------------------------------------

_EDGES = """SELECT 'p' || l_partkey AS claim, CAST(l_orderkey AS VARCHAR) AS src, CASE WHEN l_linenumber % 2 = 0 THEN 's' || l_suppkey END AS grp, strftime(l_shipdate, '%Y-%m') AS data,
CASE WHEN l_returnflag = 'R' THEN 'contradict' ELSE 'support' END AS stance FROM lineitem"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as evidence on parts: sources are orders, groups (unknown for every second line) suppliers, data the month of shipping."""
    text = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    return A.table(spark, sf_dir, "lineitem").select(
        text("p", "l_partkey").alias("claim"),
        text("", "l_orderkey").alias("src"),
        F.when(F.col("l_linenumber") % 2 == 0, text("s", "l_suppkey")).alias("grp"),
        F.date_format("l_shipdate", "yyyy-MM").alias("data"),
        F.when(F.col("l_returnflag") == "R", "contradict").otherwise("support").alias("stance"),
    )


@query(f"""WITH RECURSIVE e AS ({_EDGES}),
l AS (SELECT DISTINCT a.claim, a.stance, a.src AS x, b.src AS y FROM e a JOIN e b ON a.claim = b.claim AND a.stance = b.stance AND a.grp = b.grp
UNION SELECT DISTINCT a.claim, a.stance, a.src, b.src FROM e a JOIN e b ON a.claim = b.claim AND a.stance = b.stance AND a.data = b.data),
w AS (SELECT DISTINCT claim, stance, src AS x, src AS y FROM e UNION SELECT w.claim, w.stance, w.x, l.y FROM w JOIN l ON l.claim = w.claim AND l.stance = w.stance AND l.x = w.y),
p AS (SELECT claim, stance, x, min(y) AS piece FROM w GROUP BY ALL), s AS (SELECT claim, stance, piece, count(*) AS n FROM p GROUP BY ALL),
c AS (SELECT claim, sum(n)::BIGINT AS n_sources, count(*) FILTER (stance = 'support') AS n_support, count(*) FILTER (stance = 'contradict') AS n_contradict, max(n) AS largest_piece FROM s GROUP BY 1)
SELECT *, CASE WHEN n_support > 0 AND n_contradict > 0 THEN 'contested' WHEN n_contradict > 0 THEN 'refuted' WHEN n_support > 1 THEN 'settled' ELSE 'open' END AS bucket FROM c""")
def claim_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.independent_claims(_edges(spark, sf_dir))


# -- failures by arm ----------------------------------------------------------------------------------

#: 1 - sum of the power series of the lower incomplete gamma function.
_CHI = "1 - list_sum(list_transform(range(0, CAST(x / 2 + 12 * sqrt(x / 2) + 200 AS BIGINT)), lambda i: exp((df / 2.0 + i) * ln(x / 2) - x / 2 - lgamma(df / 2.0 + i + 1))))"
_CHOOSE = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
_LOG_P = f"{_CHOOSE.format(n='f', k='{i}')} + {_CHOOSE.format(n='(n - f)', k='(n1 - {i})')} - {_CHOOSE.format(n='n', k='n1')}"
_EXACT = f"list_sum(list_transform(range(greatest(0, n1 + f - n), least(n1, f) + 1), lambda i: CASE WHEN {_LOG_P.format(i='i')} <= {_LOG_P.format(i='f1')} + 1e-7 THEN exp({_LOG_P.format(i='i')}) ELSE 0 END))"


@query(f"""WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS spec, o_orderpriority AS arm, o_orderstatus = 'P' AS late, o_orderkey % 3 <> 0 AS sized FROM orders
UNION ALL SELECT 'c' || o_custkey, CASE WHEN o_orderpriority < '3' THEN 'high' ELSE 'low' END, o_orderstatus = 'P', o_orderkey % 3 <> 0 FROM orders),
o AS (SELECT spec, 'price' AS metric, arm, late AS failed FROM r UNION ALL SELECT spec, 'size', arm, late OR NOT sized FROM r WHERE spec IN (SELECT spec FROM r WHERE sized)),
a AS (SELECT spec, metric, arm, count(*) AS n, count(*) FILTER (failed) AS f FROM o GROUP BY ALL),
t AS (SELECT spec, metric, sum(n)::BIGINT AS n, sum(f)::BIGINT AS f, count(*) AS arms, min(n) AS least, sum(f * (f / n)) AS q, arg_min(n, arm) AS n1, arg_min(f, arm) AS f1 FROM a GROUP BY ALL),
m AS (SELECT *, arms - 1 AS df, CASE WHEN arms < 2 OR f = 0 OR f = n THEN 'none' WHEN arms = 2 AND least * least(f, n - f) / n < 5 THEN 'exact' ELSE 'chi-square' END AS method,
  CASE WHEN arms > 1 AND f > 0 AND f < n THEN greatest(0.0, n::DOUBLE * n / (f::DOUBLE * (n - f)) * (q - f::DOUBLE * f / n)) ELSE 0 END AS x FROM t),
w AS (SELECT spec, metric, arg_min(arm, (-f / n, arm)) AS worst FROM a GROUP BY ALL)
SELECT spec, metric, n, f AS failed, arms, method, round_even(CASE method WHEN 'none' THEN 1.0 WHEN 'exact' THEN least(1.0, {_EXACT}) ELSE CASE WHEN x <= 0 THEN 1.0 ELSE greatest(0.0, {_CHI}) END END, 6) AS p_value, CASE WHEN f > 0 THEN worst END AS worst_arm
FROM m JOIN w USING (spec, metric)""")
def failures_with_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a month by priority (chi-square, four degrees of freedom), and a customer's by two priorities (mostly exact); late ones fail, and a
    third of all has no size."""
    orders = A.table(spark, sf_dir, "orders")
    metrics = F.when(F.col("o_orderkey") % 3 != 0, F.create_map(F.lit("price"), F.lit(1.0), F.lit("size"), F.lit(1.0))).otherwise(F.create_map(F.lit("price"), F.lit(1.0)))
    own = [F.when(F.col("o_orderstatus") == "P", "skipped").otherwise("ok").alias("status"), metrics.alias("metrics")]
    months = orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("spec"), F.col("o_orderpriority").alias("arm"), *own)
    customers = orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("spec"), F.when(F.col("o_orderpriority") < "3", "high").otherwise("low").alias("arm"), *own)
    found = failures.failures_by_arm(failures.deliveries(months.unionByName(customers), ["spec"]), ["spec", "metric"])
    return found.select("spec", "metric", "n", "failed", "arms", "method", F.bround("p_value", 6).alias("p_value"), "worst_arm")


# -- several baselines --------------------------------------------------------------------------------

_BASELINES = ("4-NOT SPECIFIED", A.BASELINE)
_AGAINST = f"""
WITH p AS (SELECT t.arm, b.arm AS baseline, t.value - b.value AS difference FROM ({Q._LAST}) t JOIN ({Q._LAST}) b ON t.seed = b.seed AND b.arm IN {_BASELINES} WHERE t.arm NOT IN {_BASELINES}),
d AS (SELECT arm, baseline, count(*) AS n, avg(difference) AS m, stddev_samp(difference) AS sd FROM p GROUP BY ALL),
r AS (SELECT *, n - 1 AS df, atan(abs(m / (sd / sqrt(n))) / sqrt(n - 1)) AS theta FROM d),
c AS (SELECT arm, baseline, n AS n_pairs, round_even(m, 6) AS mean_difference, round_even(least(1.0, greatest(0.0, 1 - ({Q._central("theta", "df")}))), 6) AS p_value FROM r),
h AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY arm) - row_number() OVER (PARTITION BY arm ORDER BY p_value) + 1) * p_value) AS q FROM c),
found AS (SELECT arm, baseline, n_pairs, round_even(mean_difference, 4) AS mean_difference, round_even(p_value, 4) AS p_value, round_even(max(q) OVER (PARTITION BY arm ORDER BY p_value ROWS UNBOUNDED PRECEDING), 4) AS p_adjusted FROM h)
"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.against_baselines(A.order_runs(spark, sf_dir), "price", _BASELINES, arms=~F.col("arm").isin(*_BASELINES))


@query(f"{_AGAINST} SELECT * FROM found")
def baseline_step_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.rounded_to(_found(spark, sf_dir), "mean_difference", "p_value", "p_adjusted").select("arm", "baseline", "n_pairs", "mean_difference", "p_value", "p_adjusted")


_RULES = [(">", -1e5, 3, 1.01), (">", 0.0, 3, 0.05), ("<", 1e5, 3, 1.01), (">", -1e5, 1_000_000_000, 1.01)]


@query(f"""{_AGAINST}, worst AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY arm ORDER BY mean_difference, baseline) = 1),
rules(comparator, threshold, min_seeds, max_p_value) AS (VALUES {", ".join(f"('{c}', {t}::DOUBLE, {s}::BIGINT, {p}::DOUBLE)" for c, t, s, p in _RULES)})
SELECT comparator, threshold, min_seeds, arm, baseline, n_pairs, CASE WHEN n_pairs < min_seeds THEN false ELSE p_adjusted < max_p_value END AS significant,
CASE WHEN n_pairs < min_seeds THEN false ELSE CASE comparator WHEN '<' THEN mean_difference < threshold ELSE mean_difference > threshold END AND p_adjusted < max_p_value END AS supported FROM rules, worst""")
def baseline_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(_RULES, "comparator string, threshold double, min_seeds long, max_p_value double")
    rows = baselines.decide_against(_found(spark, sf_dir), rules)
    return rows.select("comparator", "threshold", "min_seeds", "arm", "baseline", "n_pairs", (F.col("seeds_pass") & F.col("significance_pass")).alias("significant"), (F.col("verdict") == "supported").alias("supported"))


# -- the verdict after each seed ----------------------------------------------------------------------

_RULE = {"comparator": ">", "threshold": -20_000.0, "min_seeds": 3, "max_p_value": 0.05}
#: Each prefix is summed anew, by a join of each seed with all up to it.
_SEQUENCE = f"""
WITH RECURSIVE p AS ({Q._PAIRS}),
d AS (SELECT a.arm, a.seed, count(*) AS n, avg(b.difference) AS m, stddev_samp(b.difference) AS sd FROM p a JOIN p b ON a.arm = b.arm AND b.seed <= a.seed GROUP BY ALL),
b AS (SELECT DISTINCT n - 1 AS df, 0.0::DOUBLE AS lo, pi() / 2 AS hi, 0 AS k FROM d WHERE n > 1
      UNION ALL SELECT df, CASE WHEN {Q._central("(lo + hi) / 2", "df")} < 0.95 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {Q._central("(lo + hi) / 2", "df")} < 0.95 THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM b WHERE k < 44),
c AS (SELECT df, tan((lo + hi) / 2) * sqrt(df) AS crit FROM b WHERE k = 44),
r AS (SELECT arm, seed, n, m, sd, sd / sqrt(n) AS se, n - 1 AS df, crit, CASE WHEN n > 1 THEN atan(abs(m / (sd / sqrt(n))) / sqrt(n - 1)) END AS theta FROM d LEFT JOIN c ON c.df = d.n - 1),
f AS (SELECT arm, seed, n AS n_pairs, round_even(m, 6) AS mean_difference, coalesce(round_even(sd, 6), 0) AS sd_difference, CASE WHEN n > 1 THEN round_even(m - crit * se, 6) END AS ci_low, CASE WHEN n > 1 THEN round_even(m + crit * se, 6) END AS ci_high,
  CASE WHEN n > 1 THEN round_even(least(1.0, greatest(0.0, 1 - ({Q._central("theta", "df")}))), 6) END AS p_value FROM r),
v AS (SELECT *, CASE WHEN n_pairs < 3 THEN 'inconclusive' WHEN mean_difference > -20000 AND p_value < 0.05 THEN 'supported' WHEN ci_high < -20000 THEN 'refuted' ELSE 'inconclusive' END AS verdict FROM f),
s AS (SELECT *, coalesce(verdict <> lag(verdict) OVER (PARTITION BY arm ORDER BY seed), false) AS changed FROM v)
"""


@query(f"{_SEQUENCE} SELECT arm, seed, n_pairs, round_even(mean_difference, 3) AS mean_difference, round_even(sd_difference, 3) AS sd_difference, round_even(ci_low, 3) AS ci_low, round_even(ci_high, 3) AS ci_high, p_value, verdict, changed FROM s")
def verdict_by_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.verdict_by_seed(A.order_runs(spark, sf_dir), "price", A.BASELINE, _RULE)
    number = lambda c, places: F.when(~F.isnan(c), F.bround(c, places)).alias(c)
    return rows.select("arm", "seed", "n_pairs", *(number(c, 3) for c in ("mean_difference", "sd_difference", "ci_low", "ci_high")), number("p_value", 6), "verdict", "changed")


@query(f"""{_SEQUENCE} SELECT arm, max(n_pairs) AS n_pairs, arg_max(verdict, n_pairs) AS verdict, count(*) FILTER (changed) AS changes, coalesce(max(n_pairs) FILTER (changed), 1) AS holds_from,
coalesce(arg_max(seed, n_pairs) FILTER (changed), min(seed)) AS holds_from_seed, coalesce(min(n_pairs) FILTER (verdict = 'supported'), 0) AS first_supported, count(*) FILTER (verdict = 'supported') > 0 AND count(*) FILTER (verdict = 'refuted') > 0 AS flipped FROM s GROUP BY arm""")
def verdict_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``first_supported`` is 0 for an arm that never was."""
    found = sequence.settled(sequence.verdict_by_seed(A.order_runs(spark, sf_dir), "price", A.BASELINE, _RULE))
    return found.withColumn("first_supported", F.coalesce("first_supported", F.lit(0)))


# -- runs and the spec in force, staleness -------------------------------------------------------------


@query("""WITH v AS (SELECT 'c' || c_custkey AS spec, TIMESTAMP '1995-06-01' + INTERVAL 1 DAY * ((c_custkey * 37) % 900 + 400 * k) AS registered, 'h' || ((c_custkey + k) % 5) AS digest FROM customer, range(3) t(k) WHERE c_custkey % 11 <> 0),
r AS (SELECT 'r' || o_orderkey AS id, 'c' || o_custkey AS spec, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END AS started, CASE WHEN o_orderkey % 13 <> 0 THEN 'h' || (o_orderkey % 6) END AS digest FROM orders),
f AS (SELECT spec, digest, min(registered) AS first FROM v GROUP BY ALL),
j AS (SELECT r.*, v.registered, v.digest AS in_force FROM r ASOF LEFT JOIN v ON r.spec = v.spec AND r.started >= v.registered)
SELECT id, strftime(registered, '%Y-%m-%d') AS registered, in_force, CASE WHEN started IS NULL THEN 'undated' WHEN in_force IS NULL THEN 'unregistered' WHEN j.digest IS NOT DISTINCT FROM in_force THEN 'none' WHEN first IS NULL THEN 'foreign' WHEN first > started THEN 'ahead' ELSE 'superseded' END AS finding
FROM j LEFT JOIN f ON f.spec = j.spec AND f.digest = j.digest""")
def runs_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of their customer's spec, of which there are three registrations 400 days apart, or none."""
    c, o, text = F.col("c_custkey"), F.col("o_orderkey"), lambda mark, x: F.concat(F.lit(mark), x.cast("string"))
    versions = A.table(spark, sf_dir, "customer").where(c % 11 != 0).select("c_custkey", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    versions = versions.select(text("c", c).alias("spec"), F.date_add(F.lit("1995-06-01").cast("date"), ((c * 37) % 900 + 400 * F.col("k")).cast("int")).cast("timestamp").alias("registered"), text("h", (c + F.col("k")) % 5).alias("digest"))
    runs = A.table(spark, sf_dir, "orders").select(text("r", o).alias("id"), text("c", F.col("o_custkey")).alias("spec"), F.when(o % 50 != 0, F.col("o_orderdate").cast("timestamp")).alias("started"), F.when(o % 13 != 0, text("h", o % 6)).alias("digest"))
    found = history.runs_in_force(runs, versions)
    return found.select("id", F.date_format("registered", "yyyy-MM-dd").alias("registered"), "in_force", F.coalesce("finding", F.lit("none")).alias("finding"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_orderpriority || '/' || (o_custkey % 40) AS topic, CASE o_orderkey % 4 WHEN 0 THEN make_date(year(o_orderdate), 12, 31) WHEN 1 THEN last_day(o_orderdate::DATE) WHEN 2 THEN o_orderdate::DATE END AS until FROM orders),
l AS (SELECT o_orderpriority || '/' || (o_custkey % 40) AS topic, max(o_orderdate::DATE) AS surveyed FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 5 <> 0 GROUP BY 1)
SELECT id, topic, strftime(until, '%Y-%m-%d') AS until, strftime(surveyed, '%Y-%m-%d') AS surveyed FROM s JOIN l USING (topic) WHERE until + INTERVAL 24 MONTH < surveyed""")
def stale_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sources with a year, a month, a day or no date, and late orders as surveys of their topic, of which every fifth has no readable date."""
    orders = A.table(spark, sf_dir, "orders").withColumn("topic", F.concat("o_orderpriority", F.lit("/"), (F.col("o_custkey") % 40).cast("string")))
    kind = F.col("o_orderkey") % 4
    published = F.when(kind == 0, F.date_format("o_orderdate", "yyyy")).when(kind == 1, F.date_format("o_orderdate", "yyyy-MM")).when(kind == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("in press")
    surveys = orders.where("o_orderstatus = 'P'").select("topic", F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon").alias("surveyed"))
    found = history.stale_sources(orders.select(F.col("o_orderkey").alias("id"), "topic", published.alias("published")), surveys)
    return found.select("id", "topic", F.date_format("until", "yyyy-MM-dd").alias("until"), F.date_format("surveyed", "yyyy-MM-dd").alias("surveyed"))


# -- concept sprawl -----------------------------------------------------------------------------------

#: Words of the benchmark and parts by name and type as concepts; a part's alias is its name with other spacing, which every part of that name has.
_CONCEPTS = """SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS concept, NULL::VARCHAR AS alias FROM benchmark UNION SELECT DISTINCT p_name || ' ' || lower(p_type), upper(replace(p_name, ' ', '-')) FROM part"""
_SPRAWL = f"""
WITH RECURSIVE c AS ({_CONCEPTS}), plain AS (SELECT trim(regexp_replace(lower(unnest([concept, alias])), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS name, concept FROM c),
n AS (SELECT DISTINCT name, concept FROM plain WHERE name <> ''), f AS (SELECT name, min(concept) AS first, CASE WHEN length(name) >= 12 THEN 2 WHEN length(name) >= 5 THEN 1 ELSE 0 END AS k FROM n GROUP BY name),
i AS (SELECT first, array_to_string(list_transform(string_split(name, ' '), lambda w: w[1]), '') AS name FROM f WHERE contains(name, ' ')),
s AS (SELECT first AS x, concept AS y, 'name' AS reason, 0 AS distance FROM n JOIN f USING (name) UNION ALL SELECT f.first, i.first, 'initials', 0 FROM i JOIN f USING (name)
UNION ALL SELECT a.first, b.first, 'spelling', levenshtein(a.name, b.name) FROM f a JOIN f b ON a.name < b.name AND abs(length(a.name) - length(b.name)) <= 2 AND least(a.k, b.k) > 0 WHERE levenshtein(a.name, b.name) <= least(a.k, b.k)),
l AS (SELECT least(x, y) AS a, greatest(x, y) AS b, reason, min(distance)::INT AS distance FROM s WHERE x <> y GROUP BY ALL)
"""


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = A.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("concept"), F.array().cast("array<string>").alias("aliases"))
    parts = A.table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("concept"), F.array(F.upper(F.replace("p_name", F.lit(" "), F.lit("-")))).alias("aliases"))
    return words.unionByName(parts).distinct()


@query(f"{_SPRAWL} SELECT * FROM l")
def concept_sprawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.sprawl_links(_concepts(spark, sf_dir))


@query(f"{_SPRAWL}, u AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l), w AS (SELECT DISTINCT x AS v, x AS c FROM u UNION SELECT w.v, u.y FROM w JOIN u ON w.c = u.x) SELECT v AS concept, min(c) AS idea FROM w GROUP BY 1")
def concept_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.sprawl_groups(_concepts(spark, sf_dir))


# -- snowballing --------------------------------------------------------------------------------------

_ROUNDS = 3


def _rounds_sql() -> str:
    """The rounds written out one after another: n<k> counts citations by what was collected before round k."""
    parts = ["e AS (SELECT DISTINCT o_custkey % 1009 AS src, (o_orderkey * 31) % 1009 AS ref FROM orders WHERE o_custkey % 1009 <> (o_orderkey * 31) % 1009)", "d0 AS (SELECT DISTINCT c_custkey % 1009 AS work, 0 AS depth FROM customer WHERE c_custkey % 1009 % 100 = 3)"]
    for k in range(1, _ROUNDS + 1):
        parts.append(f"n{k} AS (SELECT ref AS work, count(*) AS n FROM e WHERE src IN (SELECT work FROM d{k - 1}) GROUP BY 1)")
        parts.append(f"d{k} AS (SELECT * FROM d{k - 1} UNION ALL SELECT work, {k} FROM n{k} WHERE n >= 2 AND work NOT IN (SELECT work FROM d{k - 1}))")
    return "WITH " + ", ".join(parts)


def _snowball(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as citations among a thousand works, from every hundredth of those that are customers."""
    citations = A.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 1009).alias("src"), ((F.col("o_orderkey") * 31) % 1009).alias("ref"))
    works = A.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 1009).alias("work"))
    return snowball(citations, works.where("work % 100 = 3"), 2, _ROUNDS)


@query(f"""{_rounds_sql()} SELECT work, coalesce(depth, -1) AS depth, coalesce(n, 0) AS n_citing, CASE WHEN depth IS NULL THEN 'rare' WHEN depth = {_ROUNDS} THEN 'limit' ELSE 'opened' END AS reason
FROM d{_ROUNDS} FULL JOIN n{_ROUNDS} USING (work)""")
def snowball_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth is -1 for works that were left out."""
    return _snowball(spark, sf_dir)[0].withColumn("depth", F.coalesce("depth", F.lit(-1)))


@query(f"""{_rounds_sql()}, l AS ({" UNION ALL ".join(f"SELECT {k} AS round, (SELECT count(*) FROM d{k} WHERE depth = {k - 1}) AS opened, (SELECT count(*) FROM n{k}) AS cited, (SELECT count(*) FROM d{k} WHERE depth = {k}) AS found" for k in range(1, _ROUNDS + 1))})
SELECT round, opened, cited, found FROM l WHERE round = 1 OR opened > 0""")
def snowball_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snowball(spark, sf_dir)[1]


# -- sections -----------------------------------------------------------------------------------------

_SECTIONS = """
WITH o AS (SELECT doc_id, list_transform(list_sort(list_transform(list_filter(range(7), lambda i: (doc_id + i) % 9 <> 0), lambda i: ((i * (doc_id % 11 + 1)) % 13) * 10 + i)), lambda v: v % 10) AS p FROM documents),
q AS (SELECT doc_id, doc_id % 6 = 0 AND list_contains(p, 0) AS twice, CASE WHEN doc_id % 6 = 0 AND NOT list_contains(p, 0) THEN p || [0] ELSE p END AS p FROM o),
m AS (SELECT *, list_transform(range(1::BIGINT << len(p)), lambda m: {'at': list_filter(range(len(p)), lambda i: (m >> i) & 1 = 1), 'kept': list_filter(p, lambda x, i: (m >> (i - 1)) & 1 = 1)}) AS c FROM q),
b AS (SELECT doc_id, p, twice, list_sort(list_transform(list_filter(c, lambda x: x.kept = list_sort(x.kept)), lambda x: {'neg': -len(x.at), 'at': x.at, 'kept': x.kept}))[1].kept AS kept FROM m),
f AS (SELECT doc_id, 'missing-section' AS c, unnest(list_filter(range(7), lambda i: NOT list_contains(p, i))) AS i FROM b UNION ALL SELECT doc_id, 'repeated-section', 0 FROM b WHERE twice
UNION ALL SELECT doc_id, 'section-order', unnest(list_filter(p, lambda i: NOT list_contains(kept, i))) FROM b)
SELECT 'sources/d' || doc_id || '.md' AS path, c AS "check", ['Summary', 'Method', 'Setup', 'Results', 'Limitations', 'Relevance', 'Evidence'][i + 1] AS section FROM f"""


@query(_SECTIONS)
def lint_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source notes whose sections stand in one of eleven orders, some left out, some twice, with headings in fences that do not count."""
    d = F.col("doc_id")
    place = lambda i: F.when((d + i) % 9 != 0, F.struct(((F.lit(i) * (d % 11 + 1)) % 13).alias("k"), F.lit(f"## {sections.SOURCE_SECTIONS[i]}\ntext\n").alias("s")))
    own = F.sort_array(F.filter(F.array(*map(place, range(7))), lambda x: x.isNotNull()))
    texts = F.transform(own, lambda x: x["s"])
    body = F.concat(F.when(d % 2 == 0, F.array_join(texts, "```\n## Results\n## Method\n```\n")).otherwise(F.array_join(texts, "### Setup\n")), F.when(d % 6 == 0, "## summary\nagain\n").otherwise(""))
    rel, text = A.note(F.concat(F.lit("sources/d"), d.cast("string"), F.lit(".md")), [("type", "source")], body)
    found = sections.section_findings(A.as_notes(A.spread(A.table(spark, sf_dir, "documents")).select(rel, text)))
    return found.select("path", "check", F.regexp_extract("message", "[A-Z].*$", 0).alias("section"))


# -- counts at several grains -------------------------------------------------------------------------


@query("""SELECT concat_ws(',', CASE WHEN grouping(o_orderpriority) = 0 THEN 'arm' END, CASE WHEN grouping(o_orderstatus) = 0 THEN 'status' END) AS grain, coalesce(o_orderpriority, '*') AS arm, coalesce(o_orderstatus, '*') AS status,
count(*) AS n, count(*) AS n_values, min(o_totalprice) AS least, max(o_totalprice) AS most, count(DISTINCT o_custkey) AS n_distinct FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority), (o_orderstatus), ())""")
def grain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = A.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("arm"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("value"), "o_custkey")
    rows = grains.by_grains(orders, [["arm", "status"], ["arm"], ["status"], []], "value", "o_custkey")
    return rows.select("grain", F.coalesce("arm", F.lit("*")).alias("arm"), F.coalesce("status", F.lit("*")).alias("status"), "n", "n_values", "least", "most", "n_distinct")


# -- small parts --------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type || '!'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), slug(F.concat("p_name", F.lit(" / "), "p_type", F.lit("!"))).alias("slug"))


@query("SELECT 'n' || n_nationkey || '/' || ['Readme', 'README', 'TODO', 'log', 'map', 'Map'][n_nationkey % 6 + 1] || '.md' AS path FROM nation WHERE n_nationkey % 6 IN (0, 5)")
def orphans_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that nothing links, most of them under a stem that needs no link."""
    k = F.col("n_nationkey")
    stem = F.get(F.array(*map(F.lit, ("Readme", "README", "TODO", "log", "map", "Map"))), (k % 6).cast("int"))
    rel, text = A.note(F.concat(F.lit("n"), k.cast("string"), F.lit("/"), stem, F.lit(".md")), [("type", "note"), ("title", F.col("n_name"))], "No link.\n")
    return lint.orphans(A.as_notes(A.table(spark, sf_dir, "nation").select(rel, text))).select("path")


# -- titles of the same work --------------------------------------------------------------------------

_TITLE = "p_name || ', ' || lower(p_type) || ' part of ' || p_brand || ' in Size-' || p_size"


@query(f"""WITH k AS (SELECT p_partkey AS key, array_to_string(list_sort(list_distinct(string_split(trim(regexp_replace(lower({_TITLE}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '))), ' ') AS words FROM part),
s AS (SELECT words, min(key) AS first FROM k GROUP BY words), t AS (SELECT first, unnest(string_split(words, ' ')) AS word FROM s),
w AS (SELECT word, 1 + CAST(floor(1000 * ln((SELECT count(*) FROM s) / count(*))) AS BIGINT) AS w FROM t GROUP BY word), i AS (SELECT first, word, w FROM t JOIN w USING (word)),
z AS (SELECT first, sum(w)::BIGINT AS weight FROM i GROUP BY 1),
p AS (SELECT x.first AS a, y.first AS b, sum(x.w)::BIGINT AS shared FROM i x JOIN i y ON x.word = y.word AND x.first < y.first GROUP BY 1, 2),
l AS (SELECT a, b, shared, za.weight + zb.weight - shared AS united FROM p JOIN z za ON za.first = a JOIN z zb ON zb.first = b)
SELECT a, b, shared, united FROM l WHERE 100 * shared >= 60 * united UNION ALL SELECT s.first, k.key, weight, weight FROM k JOIN s USING (words) JOIN z ON z.first = s.first WHERE s.first < k.key""")
def similar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' descriptions as titles that share three fifths of their words' weight."""
    title = F.concat("p_name", F.lit(", "), F.lower("p_type"), F.lit(" part of "), "p_brand", F.lit(" in Size-"), F.col("p_size").cast("string"))
    return titles.similar_titles(A.spread(A.table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("key"), title.alias("title")), 60)


# -- near quotes --------------------------------------------------------------------------------------

#: Words of a quote, and which of them are changed.
_QUOTE, _EVERY = 18, 7
#: Each quote against its whole text: one row of the table of edit distances a word; a cell is distance * 2^32 + begin, the state [best, its end, place, row...].
_ALIGNED = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents WHERE doc_id IS NOT NULL),
q AS (SELECT doc_id, text, t, list_transform(t[(doc_id * 5) % greatest(len(t) - {_QUOTE}, 1) + 1:(doc_id * 5) % greatest(len(t) - {_QUOTE}, 1) + {_QUOTE}], lambda x, i: CASE WHEN i % {_EVERY} = 0 THEN 'changed' ELSE x END) AS q FROM w),
c AS (SELECT doc_id, contains(text, array_to_string(q, ' ')) AS verbatim, len(q) AS m, list_transform(q, lambda x: (hash(x) % 1000000007)::BIGINT) AS q, [0::BIGINT] || list_transform(range(1, len(q) + 1), lambda i: i * 4294967296) AS d, list_transform(t, lambda x: [(hash(x) % 1000000007)::BIGINT]) AS h FROM q),
r AS (SELECT doc_id, verbatim, m, list_reduce(h, lambda s, x: list_transform([list_reduce(list_transform(range(1, m + 1), lambda i: [i]), lambda a, i: a || [least(s[i[1] + 3] + CASE WHEN q[i[1]] = x[1] THEN 0 ELSE 4294967296 END, s[i[1] + 4] + 4294967296, a[-1] + 4294967296)], [s[3] + 1])],
    lambda n: [least(s[1], n[-1]), CASE WHEN n[-1] < s[1] THEN s[3] + 1 ELSE s[2] END, s[3] + 1] || n)[1], [d[-1], 0::BIGINT, 0::BIGINT] || d) AS s FROM c)
SELECT doc_id, verbatim, CASE WHEN m > 2 AND s[1] // 4294967296 <= m // 3 - 1 THEN (s[1] // 4294967296)::INT ELSE -1 END AS distance, CASE WHEN m > 2 AND s[1] // 4294967296 <= m // 3 - 1 THEN (s[1] % 4294967296)::INT ELSE -1 END AS first_word, CASE WHEN m > 2 AND s[1] // 4294967296 <= m // 3 - 1 THEN (s[2] - s[1] % 4294967296)::INT ELSE -1 END AS n_words FROM r"""


@query(_ALIGNED)
def near_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighteen words of each document as a quote, of which every seventh is changed, against its whole text; -1 for a quote that is not near."""
    docs = A.spread(A.table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    t = quotes.words(F.col("text"))
    begin = lambda w: (F.col("doc_id") * 5 % F.greatest(F.size(w) - _QUOTE, F.lit(1)) + 1).cast("int")
    spoilt = let(t, lambda w: F.array_join(F.transform(F.slice(w, begin(w), F.lit(_QUOTE)), lambda x, i: F.when((i + 1) % _EVERY == 0, "changed").otherwise(x)), " "))
    raw = F.concat(F.lit("raw/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("raw")
    found = quotes.near_quotes(docs.select(F.col("doc_id").alias("quote_id"), raw, spoilt.alias("quote")), docs.select(raw, "text"))
    return found.select(F.col("quote_id").alias("doc_id"), "verbatim", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("distance", "first_word", "n_words")))
