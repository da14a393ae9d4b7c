"""Runs against the registration that was in force when they started, and sources against the surveys that came after them.

An as-of join without a window over a whole spec: time is cut into buckets, the last registration before each bucket is carried into it, and
a window goes over one spec and bucket only. ``salts`` splits a bucket further, each part with a copy of its registrations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.text import strip, unquote
from assayer.operators.skew import look_up

DAY = 86_400


def moment(c: Column) -> Column:
    """A timestamp of a front-matter value; null if it is none. Without a zone it is in the session's."""
    return F.try_to_timestamp(unquote(strip(c)))


def registrations(notes: DataFrame) -> DataFrame:
    """(spec, registered, digest) of the notes of type spec that have a digest and a date of registration."""
    get = lambda k: unquote(strip(F.try_element_at("fm", F.lit(k))))
    rows = notes.where("type = 'spec'").select(get("id").alias("spec"), moment(F.try_element_at("fm", F.lit("preregistered_at"))).alias("registered"), get("spec_hash").alias("digest"))
    return rows.where("spec <> '' AND registered IS NOT NULL AND digest <> ''")


def starts(notes: DataFrame) -> DataFrame:
    """(id, spec, started, digest) of the notes of type run; the spec is what stands before the slash in their id."""
    get = lambda k: unquote(strip(F.try_element_at("fm", F.lit(k))))
    rows = notes.where("type = 'run'")
    return rows.select(get("id").alias("id"), F.substring_index(get("id"), "/", 1).alias("spec"), moment(F.try_element_at("fm", F.lit("started"))).alias("started"), F.nullif(get("spec_hash"), F.lit("")).alias("digest"))


def as_of(rows: DataFrame, key: str, at: str, versions: DataFrame, since: str, bucket_seconds: int = 30 * DAY, salts: int = 1) -> DataFrame:
    """``rows`` with ``version``, a struct of the columns of ``versions`` but ``key``: the row of the same key with the
    greatest ``since`` that is not after ``at``, or null. Of equal ``since`` the greatest of the other columns counts, in their order.

    Rows whose key or time is null have none. A bucket is at most as long as ``bucket_seconds``; a key has a row for each of
    its buckets in the window that carries versions over, so its size is that of the time span.
    """
    others = [c for c in versions.columns if c not in (key, since)]
    bucket = lambda c: F.floor(F.unix_micros(c) / F.lit(bucket_seconds * 1_000_000)).alias("_b")
    known = versions.where(F.col(key).isNotNull() & F.col(since).isNotNull()).select(F.col(key).alias("_k"), bucket(F.col(since)), F.struct(since, *others).alias("_v"))
    placed = rows.withColumn("_row", F.struct(*rows.columns)).select(F.col(key).alias("_k"), bucket(F.col(at)), F.col(at).alias("_at"), "_row")
    dated = placed.where("_k IS NOT NULL AND _at IS NOT NULL")

    # the last version of each bucket, carried to the next buckets that anything falls into
    none = F.lit(None).cast(known.schema["_v"].dataType)
    last = known.groupBy("_k", "_b").agg(F.max("_v").alias("_v")).unionByName(dated.select("_k", "_b").distinct().withColumn("_v", none)).groupBy("_k", "_b").agg(F.max("_v").alias("_v"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_k", "_b", F.last("_v", ignorenulls=True).over(before).alias("_v")).where("_v IS NOT NULL")

    no_row = F.lit(None).cast(placed.schema["_row"].dataType)
    copies = known.unionByName(carried).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("_k", "_b", "_s", F.col(f"_v.{since}").alias("_at"), "_v", no_row.alias("_row"))
    own = dated.select("_k", "_b", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int").alias("_s"), "_at", none.alias("_v"), "_row")
    # at one time versions come before rows, the greatest last
    order = Window.partitionBy("_k", "_b", "_s").orderBy("_at", F.col("_row").isNotNull(), "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = copies.unionByName(own).withColumn("version", F.last("_v", ignorenulls=True).over(order)).where("_row IS NOT NULL").select("_row.*", "version")
    return found.unionByName(placed.where("_k IS NULL OR _at IS NULL").select("_row.*", none.alias("version")))


#: What a run's digest can be, against the registrations of its spec.
UNDATED, UNREGISTERED, SUPERSEDED, AHEAD, FOREIGN = "undated", "unregistered", "superseded", "ahead", "foreign"


def runs_in_force(runs: DataFrame, versions: DataFrame, bucket_seconds: int = 30 * DAY, salts: int = 1) -> DataFrame:
    """Runs (id, spec, started, digest) with what was in force (registered, in_force) when they started, and ``finding``:

    undated: no start; unregistered: it started before any registration of its spec; superseded: its digest was in force
    earlier; ahead: its digest was registered only later; foreign: its spec never had that digest (or the run names none).
    Null: the digest is the one in force. ``versions``: spec, registered, digest.
    """
    runs = runs.select("id", "spec", "started", "digest")
    found = as_of(runs, "spec", "started", versions.select("spec", "registered", "digest"), "registered", bucket_seconds, salts)
    first = versions.where("spec IS NOT NULL AND digest IS NOT NULL AND registered IS NOT NULL").groupBy("spec", "digest").agg(F.min("registered").alias("_first"))
    first = first.hint("shuffle_hash")  # a row for each spec and digest, hashed so that the runs need no sort
    rows = look_up(found.select("id", "spec", "started", "digest", F.col("version.registered").alias("registered"), F.col("version.digest").alias("in_force")), first, ["spec", "digest"], "left")
    finding = (
        F.when(F.col("started").isNull(), UNDATED)
        .when(F.col("in_force").isNull(), UNREGISTERED)
        .when(F.col("digest").eqNullSafe(F.col("in_force")), F.lit(None))
        .when(F.col("_first").isNull(), FOREIGN)
        .when(F.col("_first") > F.col("started"), AHEAD)
        .otherwise(SUPERSEDED)
    )
    return rows.select("id", "spec", "started", "digest", "registered", "in_force", finding.alias("finding"))


def stale_sources(sources: DataFrame, surveys: DataFrame, months: int = 24) -> DataFrame:
    """Sources (id, topic, published) that a survey of their topic (topic, surveyed) has overtaken: the latest survey came
    more than ``months`` after them. With ``surveyed`` and ``age``, the whole months between.

    Published is a year, a year and month or a date, as text; each counts from its end, so that a source is never
    called older than it may be. Sources without a topic or a readable date, and dates of surveys that cannot be read, are left
    out here; ``undated_sources`` lists the former. Topics' latest surveys are one row a topic.
    """
    latest = surveys.select("topic", moment(F.col("surveyed").cast("string")).cast("date").alias("surveyed")).where("topic IS NOT NULL AND surveyed IS NOT NULL").groupBy("topic").agg(F.max("surveyed").alias("surveyed"))
    dated = sources.select("id", "topic", period_end(F.col("published")).alias("until")).where("topic IS NOT NULL AND until IS NOT NULL")
    age = F.floor(F.months_between("surveyed", "until", roundOff=False)).cast("int")
    return look_up(dated, latest, ["topic"]).select("id", "topic", "until", "surveyed", age.alias("age")).where(F.add_months("until", months) < F.col("surveyed"))


def undated_sources(sources: DataFrame) -> DataFrame:
    """Sources (id, published) whose date is missing or cannot be read."""
    return sources.select("id", "published").where(period_end(F.col("published")).isNull())


def period_end(c: Column) -> Column:
    """The last day of a year (2023), a month (2023-07) or a day (2023-07-05), given as text; null for anything else."""
    t = unquote(strip(c.cast("string")))
    year, month = F.when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-12-31"))), F.when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01")))
    return F.coalesce(F.try_to_date(year), F.last_day(F.try_to_date(month)), F.try_to_date(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(t, 1, 10))))
